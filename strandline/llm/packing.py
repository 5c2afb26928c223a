"""Conflict-constrained best-fit packing.

Texts are packed into bins of `capacity` words, largest first.  The open bins
of a shard are ordered by what is left in them; each carries a bitmap of the
sources and one of the duplicate clusters it holds.  For a text the search starts at the
tightest bin that has room and goes on through its successors until one
holds neither the text's source nor its cluster; if none is found, a new bin
opens.  A text longer than the capacity is cut into full bins of its
own and a rest that is packed like any other text, so no word is dropped.

Shards are dealt by a hash of the identifier, so no source, however hot, is in one
task; a shard holds about `shard_rows` texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import checkpointed, id_of, text_of

_OUT = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("chunk", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("shard", pa.int64()), ("bin", pa.int64()), ("bin_words", pa.int64())])
_OUT_SQL = "doc_id long, rid long, chunk int, first_word long, n_words long, shard long, bin long, bin_words long"


class Bins:
    """Open bins in order of what is left, with their bitmaps in rows of 64-bit words."""

    def __init__(self, capacity: int, bits: int):
        self.capacity, self.words = capacity, max(1, -(-bits // 64))
        self.left = np.empty(256, np.int64)
        self.name = np.empty(256, np.int64)
        self.bitmap = np.zeros((256, self.words), np.uint64)
        self.n, self.made = 0, 0

    def find(self, need: int, bits: list[int]) -> int:
        """Place of the tightest bin with room that holds none of the bits, or -1."""
        at = int(np.searchsorted(self.left[: self.n], need))
        width = 64
        while at < self.n:
            to = min(self.n, at + width)
            free = np.ones(to - at, bool)
            for b in bits:
                free &= (self.bitmap[at:to, b >> 6] >> np.uint64(b & 63)) & np.uint64(1) == 0
            k = int(free.argmax())
            if free[k]:
                return at + k
            at, width = to, width * 4
        return -1

    def put(self, need: int, bits: list[int]) -> int:
        """Adds a text to the best bin; the bin's name."""
        at = self.find(need, bits)
        if at < 0:
            left, name, row = self.capacity, self.made, np.zeros(self.words, np.uint64)
            self.made += 1
        else:
            left, name, row = int(self.left[at]), int(self.name[at]), self.bitmap[at].copy()
            for x in (self.left, self.name, self.bitmap):
                x[at : self.n - 1] = x[at + 1 : self.n]
            self.n -= 1
        for b in bits:
            row[b >> 6] |= np.uint64(1) << np.uint64(b & 63)
        left -= need
        if left > 0:  # a full bin is closed
            self._insert(left, name, row)
        return name

    def _insert(self, left: int, name: int, row: np.ndarray) -> None:
        if self.n == len(self.left):
            self.left, self.name, self.bitmap = (np.concatenate([x, np.zeros_like(x)]) for x in (self.left, self.name, self.bitmap))
        at = int(np.searchsorted(self.left[: self.n], left, side="right"))
        for x, v in ((self.left, left), (self.name, name), (self.bitmap, row)):
            x[at + 1 : self.n + 1] = x[at : self.n]
            x[at] = v
        self.n += 1


def pack(words: list[int], source: list, cluster: list, capacity: int) -> list[list[tuple[int, int, int]]]:
    """For each text its pieces as (first word, words, bin)."""
    many = [c for c, k in Counter(x for x in cluster if x is not None).items() if k > 1]
    sources = sorted({x for x in source if x is not None})
    bit = {("s", x): i for i, x in enumerate(sources)}
    bit |= {("c", x): len(bit) + i for i, x in enumerate(sorted(many))}
    bins = Bins(capacity, len(bit))
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    rests = []
    for i, n in enumerate(words):
        full, rest = divmod(n, capacity)
        for k in range(full):
            out[i].append((k * capacity, capacity, bins.made))
            bins.made += 1
        if rest or not full:
            rests.append((rest, i, full * capacity))
    rests.sort(key=lambda x: (-x[0], x[1]))
    for rest, i, first in rests:
        bits = [b for b in (bit.get(("s", source[i])), bit.get(("c", cluster[i]))) if b is not None]
        out[i].append((first, rest, bins.put(rest, bits)))
    return out


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("rid", "ascending")])
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        placed = pack(cols["n_words"], cols["source"], cols["cluster"], capacity)
        used = Counter()
        for pieces in placed:
            for _, n, b in pieces:
                used[b] += n
        rows = [(cols["doc_id"][i], cols["rid"][i], k, first, n, cols["shard"][i], b, used[b]) for i, pieces in enumerate(placed) for k, (first, n, b) in enumerate(pieces)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def pack_texts(docs: DataFrame, capacity: int = 2048, shard_rows: int = 16_384, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: F.Column | None = None) -> DataFrame:
    """A row per piece: doc_id, chunk, first_word, n_words, shard, bin, bin_words; (shard, bin) names a bin.

    Words are runs of bytes other than space and \\x09-\\x0D.  `cluster` names
    the duplicate cluster of a row; by default rows whose texts are equal when
    lower-cased and white space is folded share one.  A null source or cluster conflicts with
    nothing.  Null and empty texts have no words and take part with one empty
    piece.  Repeated rows are packed each; an empty table gives no rows.
    """
    text = F.trim(F.regexp_replace(text_of(docs, text_col), r"[\x20\x09-\x0D]+", " "))
    n_words = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)
    if cluster is None:
        cluster = F.when(text != "", F.xxhash64(F.lower(text)))
    rows = docs.select(id_of(docs, id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), n_words.cast("long").alias("n_words"), docs[source_col].cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    rows = checkpointed(rows)
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(shards)).cast("long"))
    return rows.groupBy("shard").applyInArrow(_pack_shard(capacity), _OUT_SQL).drop("rid")
