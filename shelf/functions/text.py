"""String functions as native expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space when articles are trimmed and split (Java regular expression class body).
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_PY_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SNIPPET = 260


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without white space, in the wide sense, at either end."""
    return F.btrim(col(c), F.lit(_PY_SPACE))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count two."""
    c = col(c)
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def normalize_whitespace(c: Column | str) -> Column:
    """One kind of line end, single blanks, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(col(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalize_whitespace_py(s: str) -> str:
    """The same for one string on the driver or in a parser."""
    s = re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", s))
    return re.sub(r"\n{3,}", "\n\n", s).strip(_PY_SPACE)


def strip_py(s: str | None) -> str:
    return (s or "").strip(_PY_SPACE)


def snippet(c: Column | str) -> Column:
    """The first characters, then white space collapsed, then an ellipsis."""
    return F.concat(F.regexp_replace(F.substring(col(c), 1, SNIPPET), f"[{SPACE}]+", " "), F.lit("…"))


# Combining marks that are dropped from words, and letters that are forms of another.
MARKS = "".join(chr(c) for a, b in ((0x300, 0x304), (0x306, 0x30C), (0x30F, 0x30F), (0x311, 0x311), (0x31B, 0x31B), (0x323, 0x328), (0x32D, 0x32E), (0x330, 0x331)) for c in range(a, b + 1))
_FORMS = {"µ": "μ", "ſ": "s", "ẛ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε", "ι": "ι"}


def _fold_map() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, by canonical decomposition; and the forms above. Letters of
    other scripts keep what belongs to them."""
    pairs = dict(_FORMS)
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and c == c.lower() and d[0].isascii() and d[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            pairs[c] = d[0]
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_map()


def fold(c: Column | str) -> Column:
    """Lower case without diacritics, composed or combining (so that the dotted capital I is an i)."""
    low = F.lower(col(c))
    # Nothing of the map is ASCII, and looking up each character is what takes the time.
    return F.when(F.octet_length(col(c)) == F.length(col(c)), low).otherwise(F.translate(low, FOLD_FROM + MARKS, FOLD_TO))


def fold_py(s: str) -> str:
    return s.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO, MARKS))


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Words of a query that are searched: without surrounding quotes, longer than three characters."""
    bare = (w.strip("\"'`“”‘’") for w in query.split())
    return [w for w in bare if len(w) > 3]


def to_fts_query(query: str) -> str:
    """Prefix matches of each term, any of which may hold; empty if none is left."""
    return " OR ".join(f'"{w}"*' for w in query_terms(query))


def query_terms_col(c: Column | str) -> Column:
    """query_terms() of a column."""
    bare = F.transform(F.split(trim(c), f"[{SPACE}]+"), lambda w: F.regexp_replace(w, "^[\"'`“”‘’]+|[\"'`“”‘’]+$", ""))
    return F.filter(bare, lambda w: F.length(w) > 3)


def to_fts_query_col(c: Column | str) -> Column:
    return F.array_join(F.transform(query_terms_col(c), lambda w: F.concat(F.lit('"'), w, F.lit('"*'))), " OR ")


def each(values: list, make: Callable) -> list[Column]:
    """A column for each value; the value is bound here, as lambdas of higher-order functions can't bind it themselves."""
    return [make(v) for v in values]


def score_tag(hit) -> Column:
    """How a hit's score is shown: bm25 with 2 decimals, dist 3, rrf 4, after rerank with 3 where there is one."""
    base = (
        F.when(F.col("source") == "fts", F.format_string("bm25=%.2f", F.col("fts_score")))
        .when(F.col("source") == "vector", F.format_string("dist=%.3f", F.col("vec_distance")))
        .otherwise(F.format_string("rrf=%.4f", F.col("fused_score")))
    )
    if "rerank_score" in hit.columns:
        return F.when(F.col("rerank_score").isNotNull(), F.concat(F.format_string("rerank=%.3f ", F.col("rerank_score")), base)).otherwise(base)
    return base
