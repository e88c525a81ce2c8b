"""Byte-level BPE by backtracking over longest matches, and the way back.

A piece of text has one valid encoding: the one in which no two neighbours would
have been merged otherwise. Whether two tokens may stand side by side depends on
these two alone, so an encoder need not replay the merges: it takes the longest
token that matches (an Aho-Corasick automaton over the vocabulary, each byte as
the Latin-1 character of its value), checks it against its left neighbour, goes
on to shorter tokens and then back where the check fails, and never tries a
position twice that once proved a dead end. Checks are memoised by token pair.
Each position is left at most once per token that ends there, so the time is
linear in the length of the piece.
"""

from __future__ import annotations

import array
import base64
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that a worker keeps of encoded pieces and of checked pairs; beyond it they start anew.
MEMO_ENTRIES = 300_000
#: Longer pieces are encoded each time.
MEMO_PIECE = 48
#: Documents to a batch that goes back to Spark.
BATCH_CHARS = 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class BacktrackEncoder:
    """Encodes pieces by ``ranks`` (token bytes -> rank; every single byte must have one)."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.token = {r: t for t, r in ranks.items()}
        self.rank = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for text, r in self.rank.items():
            self.automaton.add_word(text, r)
        self.automaton.make_automaton()
        self.length = {r: len(t) for r, t in self.token.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for text, r in sorted(self.rank.items(), key=lambda x: x[1]):
            self.parts[r] = self._halves(text, r)
        self.fits.clear()
        self.shorter = {r: self._shorter(text) for text, r in self.rank.items()}

    def _halves(self, text: str, r: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; (r, r) for what no merge makes."""
        for k in range(len(text) - 1, 0, -1):
            a, b = self.rank.get(text[:k]), self.rank.get(text[k:])
            if a is not None and b is not None and a < r and b < r and self._compatible(a, b):
                self.merged[a, b] = r
                return a, b
        return r, r

    def _shorter(self, text: str) -> int | None:
        """The longest token that is a proper prefix."""
        return next((self.rank[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.rank), None)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a directly before b stays as it is when all merges are done.

        Walks back through the merges that made the two, the latest first, and asks
        at each step whether the tokens then at the border would have merged sooner
        than what was just undone. Of two merges of one rank the left comes first.
        """
        parts, merged, before = self.parts, self.merged, float("inf")
        while True:
            if merged.get((a, b), before) < before:
                return False
            left_whole, right_whole = parts[a][0] == a, parts[b][0] == b
            if left_whole and right_whole:
                return True
            if not left_whole and (a > b or right_whole):
                before, a = a, parts[a][1]
            else:
                before, b = b + 1, parts[b][0]

    def _pair(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= MEMO_ENTRIES:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return [whole]
        greedy = [r for _, r in self.automaton.iter_long(text)]
        if all(map(self._pair, greedy, greedy[1:])):
            return greedy
        return self._backtrack(text, greedy)

    def _longest(self, text: str, at: int) -> int | None:
        return next((r for _, r in self.automaton.iter_long(text, at)), None)

    def _backtrack(self, text: str, greedy: list[int]) -> list[int]:
        """From the last neighbours in the greedy tokens that fit."""
        length, alive = self.length, bytearray(b"\1") * (len(text) + 1)
        out, at = [greedy[0]], length[greedy[0]]
        candidate = greedy[1]
        while candidate is not None:
            while candidate is not None:
                end = at + length[candidate]
                if alive[end] and (not out or self._pair(out[-1], candidate)):
                    break
                candidate = self.shorter[candidate]
            if candidate is not None:
                out.append(candidate)
                at = end
                candidate = self._longest(text, at) if at < len(text) else None
            else:
                alive[at] = 0
                if not out:
                    raise ValueError("no valid encoding: the ranks are not those of a byte pair encoding")
                candidate = out.pop()
                at -= length[candidate]
        return out


class _Memo(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoder: BacktrackEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = array.array("I", self.encoder.encode_piece(piece.encode("utf-8", "surrogatepass")))
        out = ids.tobytes()
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = out
        return out


_LOADED: dict[tuple[str, str], tuple] = {}


def _load(path: str, pattern: str) -> tuple:
    """Once a Python worker."""
    if (path, pattern) not in _LOADED:
        encoder = BacktrackEncoder(read_ranks(path))
        _LOADED[path, pattern] = encoder, _Memo(encoder), regex.compile(pattern)
    return _LOADED[path, pattern]


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """The ids of a whole text, packed."""
    _, memo, pieces = _load(path, pattern)
    return b"".join(map(memo.__getitem__, pieces.findall(text)))


def decode_ids(packed: bytes, path: str, pattern: str) -> bytes:
    """The bytes that packed ids stand for."""
    encoder, _, _ = _load(path, pattern)
    return b"".join(map(encoder.token.__getitem__, array.array("I", packed)))


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with ``bpe_ids`` (binary: the ids of the whole text as little-endian unsigned 32-bit
    integers) and, with ``decode``, ``bpe_decoded`` (binary: the bytes those ids stand for).

    vocabulary: path of a rank file that every executor has, or the name of a file
    given to ``SparkContext.addFile``. pattern: splits text into pieces, each encoded
    by itself; special tokens are ordinary text. A map over the rows, nothing shuffled.

    Null text is taken as the empty text: no ids. Other columns pass through. A text
    of any length is encoded whole; rows leave a task in batches of about
    ``BATCH_CHARS`` characters, so a batch's memory follows its longest text.
    """
    text_at = docs.columns.index(text_col)
    extra = [pa.field("bpe_ids", pa.binary())] + [pa.field("bpe_decoded", pa.binary())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary if "/" in vocabulary else SparkFiles.get(vocabulary)
        for batch in batches:
            ids, back, chars, first = [], [], 0, 0
            for row, text in enumerate(batch.column(text_at)):
                text = text.as_py() or ""
                ids.append(encode_text(text, path, pattern))
                if decode:
                    back.append(decode_ids(ids[-1], path, pattern))
                chars += len(text)
                if chars >= BATCH_CHARS or row == batch.num_rows - 1:
                    part = batch.slice(first, row + 1 - first)
                    new = [pa.array(ids, pa.binary())] + [pa.array(back, pa.binary())] * decode
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], schema=pa.schema([*part.schema, *extra]))
                    ids, back, chars, first = [], [], 0, row + 1

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", bpe_ids binary" + ", bpe_decoded binary" * decode
    return docs.mapInArrow(run, kinds)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and columns ``more`` of ``encode``'s result."""
    return encoded.select("doc_id", *more, F.expr("cast(length(bpe_ids) / 4 as long)").alias("n_tokens"),
                          F.sha2("bpe_ids", 256).alias("ids_sha256"), F.sha2("bpe_decoded", 256).alias("decoded_sha256"))
