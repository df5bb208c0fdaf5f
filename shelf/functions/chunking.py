"""Splitting of texts into chunks, as native expressions over arrays: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, col, trim, utf16_length

#: Soft target and least length of a chunk, in UTF-16 units.
TARGET, LEAST = 1400, 400
#: Sentence ends: white space after . ! ? and before an ASCII capital.
SENTENCE = rf"(?<=[.!?])[{SPACE}]+(?=[A-Z])"


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), the value being computed once however often it is named."""
    return F.transform(F.array(value), make)[0]


def _pieces(c: Column) -> Column:
    """What chunks are made of: paragraphs or, of those longer than the target, sentences; with their lengths, and whether one
    is a sentence and begins its paragraph."""
    piece = lambda x, n, long, first: F.struct(x.alias("text"), n.alias("n"), F.lit(long).alias("long"), first.alias("first"))

    def of(p: Column) -> Column:
        cut = F.transform(F.split(p["text"], SENTENCE), lambda x, k: piece(x, utf16_length(x), True, k == 0))
        return F.when(p["n"] > TARGET, cut).otherwise(F.array(piece(p["text"], p["n"], False, F.lit(False))))

    paragraphs = F.filter(F.transform(F.split(c, r"\n{2,}"), trim), lambda p: p != "")
    return F.flatten(F.transform(F.transform(paragraphs, lambda p: F.struct(p.alias("text"), utf16_length(p).alias("n"))), of))


def _starts(pieces: Column) -> Column:
    """Places of the pieces that chunks begin with. What is open is closed where it is long enough and would be too long with
    the next piece, and around a long paragraph. Only lengths are looked at; pieces are trimmed, so they add up."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("open"), F.lit(0).alias("at"), F.lit(False).alias("long"))

    def add(s: Column, x: Column) -> Column:
        joined = s["open"] + x["n"] + F.when(x["long"], 1).otherwise(2)
        cut = (s["at"] == 0) | (s["long"] != x["long"]) | x["first"] | ((joined > TARGET) & (s["open"] >= LEAST))
        grown = lambda cut: F.struct(F.when(cut, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"), F.when(cut, x["n"]).otherwise(joined).alias("open"), (s["at"] + 1).alias("at"), x["long"].alias("long"))
        return _bound(cut, grown)

    return F.aggregate(pieces, start, add, lambda s: s["starts"])


def chunk_text(c: Column | str) -> Column:
    """Chunks of a text: paragraphs packed to the target; a longer paragraph is split by sentences on its own. A sentence is
    never cut."""

    def chunks(pieces: Column, starts: Column) -> Column:
        def of(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(pieces))
            texts = F.slice(pieces, at + 1, end - at)["text"]
            return F.when(F.get(pieces, at)["long"], F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n\n"))

        return F.transform(starts, of)

    return _bound(_pieces(col(c)), lambda pieces: _bound(_starts(pieces), lambda starts: chunks(pieces, starts)))


def section_path(path: Column | str) -> Column:
    """Headings above a section, outermost first; null if there are none."""
    joined = F.array_join(F.filter(col(path), lambda x: x.isNotNull() & (x != "")), " > ")
    return F.when(joined != "", joined)


def build_chunks(sections: Column | str) -> Column:
    """Sections (path, text) to chunks (text, section_path), each text led by its path."""

    def of(s: Column) -> Column:
        path = section_path(s["path"])
        lead = F.coalesce(F.concat(path, F.lit("\n\n")), F.lit(""))
        return F.transform(chunk_text(s["text"]), lambda t: F.struct(F.concat(lead, t).alias("text"), path.alias("section_path")))

    return F.flatten(F.transform(col(sections), of))
