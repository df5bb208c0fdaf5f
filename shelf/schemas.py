"""Row types of the engine's tables and results."""

from __future__ import annotations

CHUNK = "struct<text: string, section_path: string>"
#: A page as fetched and read: the input of ingestion.
ARTICLE = f"url string, title string, byline string, site_name string, content_html string, text_content string, links array<string>, error string"
#: A document to be upserted.
UPSERT = f"url string, title string, byline string, site_name string, collection string, chunks array<{CHUNK}>"
DOCS = "id long, url string, title string, byline string, site_name string, collection string, content_hash string, version long, chunk_count long, tokens long, fetched_at timestamp"
CHUNKS = "chunk_id long, doc_id long, version long, idx int, text string, section_path string, dl int"
EMBEDDINGS = "chunk_id long, embedding array<float>"
POSTINGS = "tok string, chunk_id long, pos int, dl int"
HIT = [
    "chunk_id", "doc_id", "doc_title", "doc_url", "collection", "idx", "text", "section_path",
    "fts_score", "vec_distance", "fused_score", "source",
]
EVENTS = "kind string, url string, depth int, doc_id long, error string, reason string"
#: chunk_id = doc_id, version modulo VERSIONS and place in one number, so ids need no coordination and a new version's
#: chunks never meet an old one's vectors. Writes beyond these ranges are refused; a version that would begin anew has the
#: store compacted first.
DOCUMENTS, PLACES, VERSIONS = 1 << 31, 1 << 20, 1 << 12
DEFAULT_COLLECTION = "default"
#: Stores of earlier versions are brought forward by migrations.STEPS.
SCHEMA_VERSION = 3
