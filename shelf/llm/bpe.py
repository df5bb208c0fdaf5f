"""Byte-pair encoding and decoding by tree concatenation.

A text longer than a leaf is cut in the middle, both halves are encoded on their own (those of very long texts as rows of
their own, on any executor), and the two encodings are joined: a window of tokens around the cut is encoded afresh and
grows until both sides agree. They agree on a side where the window begins (or ends)

* at a place where the pre-tokeniser always splits, such as before white space that follows anything else, or where a
  letter meets a digit: nothing beyond can depend on what stands on the other side; or
* inside a run of one character class, with the same token as the half has there: neighbouring tokens of an encoding are
  valid in pairs, and a sequence whose neighbours are all valid pairs is the encoding.

If no smaller window will do, the window is the whole text, so the result is always that of encoding it in one piece.

Cases: null text counts as empty and gives no ids; special tokens in a text are one id each, as the tokenizers library has
it by default; rows repeated under one doc_id give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of a leaf, encoded in one piece.
LEAF = 4096
#: Characters from which a text's pieces are rows of their own.
SPREAD = 65_536
#: The pre-tokeniser's pattern (a fixed value of this vocabulary family).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CLASS = regex.compile(r"(\p{L})|(\p{N})|(\s)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_of = _byte_of_char()
        raw = lambda s: bytes(byte_of[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {raw(s): i for s, i in model["vocab"].items() if s not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = [ranks[raw(a) + raw(b)] for a, b in merges]
        if any(x >= y for x, y in zip(order, order[1:], strict=False)):
            raise ValueError("ids don't follow the order of merges, so they can't serve as ranks")
        self.leaf = leaf
        self.special = special
        self.tokens: list[bytes] = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for s, i in ranks.items():
            self.tokens[i] = s
        for s, i in special.items():
            self.tokens[i] = s.encode()
        self._bpe = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._whole = self._bpe.encode_ordinary
        self._special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._decimal = [str(i) for i in range(len(self.tokens))]

    # -- encoding

    def encode(self, text: str) -> list[int]:
        if self._special is None or not self._special.search(text):
            return self._tree(text)
        out: list[int] = []
        at = 0
        for m in self._special.finditer(text):
            out += self._tree(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._tree(text[at:])

    def _tree(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self._whole(text)
        mid = len(text) // 2
        return self.join(self._tree(text[:mid]), self._tree(text[mid:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring pieces' text, given the encodings of each (without special tokens)."""
        if not left or not right:
            return left + right
        k = 8
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            a, b = b"".join(map(self.tokens.__getitem__, left[i:])), b"".join(map(self.tokens.__getitem__, right[:j]))
            whole = i == 0 and j == len(right)
            if whole or (found := self._agreed(left, right, i, j, a, b)) is not None:
                if whole:
                    return self._whole((a + b).decode())
                return found
            k *= 2

    def _agreed(self, left: list[int], right: list[int], i: int, j: int, a: bytes, b: bytes) -> list[int] | None:
        """left + window + right if a window within left[i:] + right[:j] agrees with both sides, else None."""
        start = 0 if i == 0 else self._start(left, i, a)
        stop = len(b) if j == len(right) else self._stop(right, j, b)
        if start is None or stop is None:
            return None
        if i:
            i, start, loose_left = start
        else:
            loose_left = False
        if j < len(right):
            j, stop, loose_right = stop
        else:
            loose_right = False
        window = self._whole((a[start:] + b[:stop]).decode())
        if loose_left and window[0] != left[i] or loose_right and window[-1] != right[j - 1]:
            return None
        return left[:i] + window + right[j:]

    def _kind(self, text: bytes, at: int) -> str:
        """Class of the character that begins at a byte: letter, number, space or other; empty if it isn't whole."""
        end = at + 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        try:
            m = _CLASS.match(text[at:end].decode())
        except UnicodeDecodeError:
            return ""
        return "LNS"[m.lastindex - 1] if m else "P"

    def _before(self, text: bytes, at: int) -> int:
        at -= 1
        while at > 0 and text[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def _cut(self, text: bytes, at: int) -> str | None:
        """How a window may begin or end at a byte inside text: "split" (always a boundary), "run" (inside a run of one
        class, so tokens must be compared), or None. Needs a character before and two after."""
        if not 0 < at < len(text) or text[at] & 0xC0 == 0x80:
            return None
        p, x = self._before(text, at), self._kind(text, at)
        before = self._kind(text, p)
        if not x or not before:
            return None
        if x == "S" and before != "S" or before + x in ("LN", "NL", "LP", "NP", "PN"):
            return "split"
        if before != x:
            return None
        after = at + 1
        while after < len(text) and text[after] & 0xC0 == 0x80:
            after += 1
        return "run" if after < len(text) and self._kind(text, after) == x else None

    def _start(self, left: list[int], i: int, a: bytes):
        """First token boundary of left[i:] at which a window may begin: (token, byte in a, whether tokens must agree)."""
        at = len(self.tokens[left[i]])
        for k in range(i + 1, len(left)):
            if how := self._cut(a, at):
                return k, at, how == "run"
            at += len(self.tokens[left[k]])
        return None

    def _stop(self, right: list[int], j: int, b: bytes):
        """Last token boundary of right[:j] at which a window may end."""
        at = len(b)
        for k in range(j - 1, 0, -1):
            at -= len(self.tokens[right[k]])
            if how := self._cut(b, at):
                return k, at, how == "run"
        return None

    # -- decoding

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self._decimal.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    return Codec(path, leaf)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_PIECE = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("text", pa.string())])
_CODED = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())])


def _digest(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(c.decimal(ids).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def _short(path: str, leaf: int):
    def run(it):
        c = codec(path, leaf)
        for b in common.each(it):
            done = [_digest(c, c.encode(t or "")) for t in b.column("text").to_pylist()]
            yield common.batch(_OUT, b.column("doc_id"), *zip(*done, strict=True))

    return run


def _pieces(path: str, leaf: int, size: int):
    """Long texts as pieces; special tokens are pieces of their own, so that joins never touch them."""

    def run(it):
        c = codec(path, leaf)
        for b in common.each(it):
            for row, doc, text in zip(*(b.column(n).to_pylist() for n in ("row", "doc_id", "text")), strict=True):
                parts, at = [], 0
                for m in c._special.finditer(text) if c._special else ():
                    parts += [text[at : m.start()], m[0]]
                    at = m.end()
                parts.append(text[at:])
                cut = [p[k : k + size] for p in parts for k in range(0, len(p), size)]
                for k in range(0, len(cut), 64):
                    some = cut[k : k + 64]
                    yield common.batch(_PIECE, [row] * len(some), [doc] * len(some), range(k, k + len(some)), some)

    return run


def _code(path: str, leaf: int):
    def run(it):
        c = codec(path, leaf)
        for b in common.each(it):
            yield common.batch(_CODED, b.column("row"), b.column("doc_id"), b.column("piece"), [array("i", c.encode(t)).tobytes() for t in b.column("text").to_pylist()])

    return run


def join_all(c: Codec, encodings: list[list[int]]) -> list[int]:
    """Neighbouring pieces joined pair by pair, as a tree; special tokens stand between texts and aren't joined over."""
    special = set(c.special.values())
    alone = lambda x: len(x) == 1 and x[0] in special
    out: list[int] = []
    k = 0
    while k < len(encodings):
        if alone(encodings[k]):
            out += encodings[k]
            k += 1
            continue
        run = []
        while k < len(encodings) and not alone(encodings[k]):
            run.append(encodings[k])
            k += 1
        while len(run) > 1:
            run = [c.join(run[x], run[x + 1]) if x + 1 < len(run) else run[x] for x in range(0, len(run), 2)]
        out += run[0]
    return out


def _joined(path: str, leaf: int):
    """Rows sorted by (row, piece). A row that is there more than once has each of its pieces as often."""

    def run(it):
        c = codec(path, leaf)
        held, copies, last, encodings = None, 0, None, []

        def done():
            return common.batch(_OUT, [held[1]] * copies, *([x] * copies for x in _digest(c, join_all(c, encodings))))

        for b in common.each(it):
            for row, d, piece, ids in zip(*(b.column(n).to_pylist() for n in ("row", "doc_id", "piece", "ids")), strict=True):
                if held != (row, d):
                    if held is not None:
                        yield done()
                    held, copies, last, encodings = (row, d), 0, None, []
                copies += piece == 0
                if piece != last:
                    last = piece
                    encodings.append(array("i", ids).tolist())
        if held is not None:
            yield done()

    return run


def encoded(docs: DataFrame, path: str | None = None, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: digests of its ids and of the text decoded from them.

    Texts of up to spread characters are encoded where they are read; longer ones as pieces dealt over all executors.
    """
    path = path or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    is_long = F.coalesce(F.length("text"), F.lit(0)) > spread
    short = common.map_arrow(rows.where(~is_long), _short(path, leaf), out)
    # A long text's row is known by what is in it, so pieces meet whatever the order in which rows arrive.
    long = rows.where(is_long).withColumn("row", F.sha2(F.col("text").cast("binary"), 256))
    pieces = common.map_arrow(long, _pieces(path, leaf, max(leaf, spread // 4)), "row string, doc_id long, piece int, text string")
    coded = common.map_arrow(pieces.repartition(F.xxhash64("row", "doc_id", "piece")), _code(path, leaf), "row string, doc_id long, piece int, ids binary")
    tied = coded.repartition("row", "doc_id").sortWithinPartitions("row", "doc_id", "piece")
    return short.unionByName(common.map_arrow(tied, _joined(path, leaf), out))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.documents(spark, sf_dir))


def id_array(ids: list[int]) -> np.ndarray:
    return np.array(ids, dtype="<u4")
