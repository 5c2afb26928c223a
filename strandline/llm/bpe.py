"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut by the byte-level pattern.  The short pieces that a slice of texts adds to those known
are merged together, a row each: a contiguous array of parts and one of the ranks of adjacent pairs.  Each
pass scans every row for its least rank (leftmost first), deletes the boundary between the two parts and
refreshes the ranks of the two pairs that now touch the merged part; a row without a rank is done.
Pieces beyond `SHORT` bytes keep the same order of merges in a heap, as scanning grows
with the square of the length.  Results of pieces are kept in a table of
bounded size; when it is full, those that the slice at hand doesn't use go.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Hashable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tools import byte_slices, id_of, shared, text_of

#: The published pattern of byte-level BPE (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 128
CACHE = 150_000
#: Bytes of text whose new pieces are merged together.
SLICE = 2 << 20
#: Pieces that are merged together, and the widths of their arrays.
ROWS = 20_000
WIDTHS = (4, 8, 16, 32, 64, SHORT)
_FAR = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte: printable Latin-1 is itself, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of tokens, ranks of merges, special strings, and the results of known pieces."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.special = special
        self.tokens = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        self.digits = {i: str(i) for i in self.tokens}
        self.letters = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self.ranks = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(merges)}
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.rank_of_key = np.array([self.ranks[k] for k in self.keys.tolist()], np.int32)
        self.first_ranks = self.rank(self.letters[:, None], self.letters[None, :])
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self._empty()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        return cls({raw(t): i for t, i in spec["model"]["vocab"].items()}, [(raw(a), raw(b)) for a, b in merges], {t["content"]: t["id"] for t in spec["added_tokens"]})

    def _empty(self) -> None:
        """Forgets all pieces; a special string is known by a tuple, so that no piece can be taken for it."""
        self.ids_of: dict[Hashable, str] = {(t,): self.digits[i] for t, i in self.special.items()}
        self.bytes_of: dict[Hashable, bytes] = {(t,): self.tokens[i] for t, i in self.special.items()}
        self.long: list[str] = []

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _FAR where they don't merge (-1 stands for no part)."""
        if not len(self.keys):
            return np.full(np.broadcast_shapes(left.shape, right.shape), _FAR, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], _FAR)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, by contiguous rank arrays of a row each."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        least = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > least) & (size <= width))
            for a in range(0, len(rows), ROWS):
                self._merge_rows(pieces, rows[a : a + ROWS], size, width, out)
            least = width
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = self.merge_long(pieces[i])
        return out

    def _merge_rows(self, pieces: list[bytes], rows: np.ndarray, size: np.ndarray, width: int, out: list[list[int]]) -> None:
        raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(-1, width)
        held = np.arange(width) < size[rows, None]
        part = np.where(held, self.letters[raw], np.int32(-1))
        rank = np.where(held[:, 1:], self.first_ranks[raw[:, :-1], raw[:, 1:]], _FAR)
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), _FAR)
            done = least == _FAR
            if done.any():
                for i, ids, n in zip(rows[done].tolist(), part[done].tolist(), (part[done] >= 0).sum(axis=1).tolist(), strict=True):
                    out[i] = ids[:n]
                rows, part, rank, at, least = (x[~done] for x in (rows, part, rank, at, least))
                if not len(rows):
                    break
            k = np.arange(len(rows))
            part[k, at] = self.made[least]
            part = _without(part, at + 1)
            rank = _without(rank, at)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.rank(part[before, at[before] - 1], part[before, at[before]])
            after = np.flatnonzero(at < rank.shape[1])
            rank[after, at[after]] = self.rank(part[after, at[after]], part[after, at[after] + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        """The same ids for a long piece: links between parts, and a heap of (rank, place, ids of the pair)."""
        n, rank_of, made = len(piece), self.ranks, self.made
        part, prev, nxt = self.letters[np.frombuffer(piece, np.uint8)].tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank_of.get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], nxt[i] = int(made[r]), -1, nxt[j]
            k = nxt[i]
            if k < n:
                prev[k] = i
                if (r := rank_of.get(part[i] << 32 | part[k])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            k = prev[i]
            if k >= 0 and (r := rank_of.get(part[k] << 32 | part[i])) is not None:
                heapq.heappush(heap, (r, k, part[k], part[i]))
        return [i for i in part if i >= 0]

    def pieces(self, text: str) -> list[Hashable]:
        """Pieces of a text in order; a special string is a tuple."""
        if self.cut is None or not self.cut.search(text):
            return self.find(text)
        return [p for k, s in enumerate(self.cut.split(text)) for p in ([(s,)] if k % 2 else self.find(s))]

    def learn(self, pieces: Iterable[Hashable]) -> None:
        """Works out the pieces that aren't known; afterwards all given ones are, until the next call.

        When the table is full, of the old pieces those that are given stay: frequent ones are among them.
        """
        for p in self.long:
            del self.ids_of[p], self.bytes_of[p]
        self.long = []
        asked = set(pieces)
        new = asked.difference(self.ids_of)
        if len(self.ids_of) + len(new) > CACHE + len(self.special):
            ids, raw = self.ids_of, self.bytes_of
            self._empty()
            asked -= new
            self.ids_of |= {p: ids[p] for p in asked}
            self.bytes_of |= {p: raw[p] for p in asked}
        fresh = list(new)
        for p, ids in zip(fresh, self.merge_many([p.encode() for p in fresh]), strict=True):
            self.ids_of[p] = ",".join(map(self.digits.__getitem__, ids))
            self.bytes_of[p] = b"".join(map(self.tokens.__getitem__, ids))
        self.long = [p for p in fresh if len(p) > SHORT]

    def encode_many(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of each text, its ids joined by commas and the bytes that these ids decode to."""
        cut = list(map(self.pieces, texts))
        self.learn(chain.from_iterable(cut))
        for pieces in cut:
            yield ",".join(map(self.ids_of.__getitem__, pieces)), b"".join(map(self.bytes_of.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return _numbers(next(self.encode_many([text]))[0])

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def _without(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row without its value at `at`."""
    keep = np.ones(rows.shape, bool)
    keep[np.arange(len(rows)), at] = False
    return rows[keep].reshape(len(rows), -1)


def _numbers(ids: str) -> list[int]:
    return [int(i) for i in ids.split(",")] if ids else []


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in byte_slices(batches, SLICE):
            n, digest, back = [], [], []
            for ids, raw in vocabulary.encode_many(batch.column("text").to_pylist()):
                n.append(ids.count(",") + 1 if ids else 0)
                digest.append(sha(ids.encode()))
                back.append(sha(raw.decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in byte_slices(batches, SLICE):
            ids = [_numbers(i) for i, _ in vocabulary.encode_many(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decoded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([vocabulary.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_of(docs, id_col).alias("doc_id"), text_of(docs, text_col).alias("text"))


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's content on every executor; its size does not depend on the data."""
    return shared(spark, Vocabulary.load(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every row; null text is empty and has no ids."""
    return _rows(docs, id_col, text_col).mapInArrow(_encoded(shared_vocabulary(docs.sparkSession, path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text, bytes that are no UTF-8 the replacement character."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(shared_vocabulary(encoded.sparkSession, path)), "doc_id long, text string")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every row in one pass.

    Null text is empty.  Special strings of the vocabulary in a text become
    their own id, as the library does by default.  Repeated rows each give a
    row; an empty table gives none.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_digests(shared_vocabulary(docs.sparkSession, path)), _DIGESTS)
