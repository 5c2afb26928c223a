"""Removal of repeated passages with a run-length index.

Every byte that lies in a SPAN-byte string which also starts in a document with a
smaller identifier is removed.

1. Anchors.  In each SPAN-byte window the GRAM-byte string with the least hash
   is its anchor, so equal windows have equal anchors, and a run of window starts shares one.  Blocks of
   documents send the hashes of their anchors by hash range (32 bits within
   the range: a clash only costs work); what comes back is one bit per anchor: does it occur in
   two documents?
2. Contexts.  For each shared anchor the block sends its context, the bytes of all windows
   that the anchor is responsible for (at most 76), with the smallest identifier that has it.
3. Index.  All contexts of an anchor meet in one shard.  Equal contexts fold.  Where an
   anchor has several, their text gets a Burrows-Wheeler transform in runs (head, start,
   and the suffix at each run's end as sample).  Contexts stream through it from their
   ends by the last-to-first mapping on runs; at each place the row tells the interval of suffixes that
   match SPAN bytes, and the interval the smallest identifier.  A place whose match
   has a smaller identifier than the context's own is marked.
4. Blocks turn the marks into removed bytes.

Contexts, not documents, are dealt, so neither a long text nor a passage with any number
of copies lands in one task: within a block a context is sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tools import checkpointed, gathered, id_of, parts, text_of, tidy
from .words import hash_spans, mix, text_bytes

#: Bytes of a match.
SPAN = 50
#: Bytes of an anchor; a window holds WIDTH of them.
GRAM = 24
WIDTH = SPAN - GRAM + 1
#: Most rows of a block, and bytes of text after which it is closed.  Every block writes to every range, so the number of
#: messages is the product of both numbers, which grow with the input: a block is gathered from as many batches as it takes.
BLOCK_ROWS = 10_000
BLOCK_BYTES = 8 << 20
#: Blocks to a range, where the session has no more partitions than that.
PER_RANGE = 2
_SEP = 0xFF  # never a byte of UTF-8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place (three aligned loads of eight bytes)."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    view = np.ndarray((len(raw) - 7,), "<u8", buffer=np.ascontiguousarray(raw), strides=(1,))
    h = view[:n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += view[8 : n + 8]
    h *= _ODD
    h ^= h >> np.uint64(32)
    h += view[16 : n + 16]
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    return h


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of `width` values."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Block:
    """Documents of a block in a fixed order, with the anchors of their windows."""

    def __init__(self, payload: bytes):
        self.table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()
        self.ids = self.table.column("doc_id").to_numpy()
        self.raw, self.off = text_bytes(self.table.column("text"))
        found = [self._anchors(a, min(len(self.ids), a + 64)) for a in range(0, len(self.ids), 64)]
        self.hash, self.first, self.count, self.doc = (np.concatenate(x) for x in zip(*found, strict=True))

    def _anchors(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """hash, first window start, number of windows and document of each run of windows with one anchor."""
        base = self.off[a]
        off = self.off[a : b + 1] - base
        h = gram_hashes(self.raw[base : self.off[b]])
        least = window_least(h, WIDTH) if len(h) >= WIDTH else h[:0]
        n = len(least)
        inside = np.zeros(n + 1, np.int8)  # windows within one document
        long = np.flatnonzero(np.diff(off) >= SPAN)
        inside[off[long]] += 1
        inside[off[long + 1] - SPAN + 1] -= 1
        inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        new[off[long]] = True
        at = np.flatnonzero(new)
        ends = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False))
        # a hash that stays least over more than WIDTH starts repeats (as in runs of a byte): cut such runs
        count = ends + 1 - at
        if len(count) and count.max() > WIDTH:
            pieces = -(-count // WIDTH)
            row = np.repeat(np.arange(len(at)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, count = at[row] + k * WIDTH, np.minimum(WIDTH, count[row] - k * WIDTH)
        doc = np.searchsorted(off, at, side="right") - 1 + a
        return least[at], at + base, count, doc

    def by_range(self, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order of the anchors by (range, 32-bit key), that key, range, and cuts of the ranges."""
        m = mix(self.hash)
        part = ((m >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        low = m & np.uint64(0xFFFFFFFF)
        order = np.argsort((part.astype(np.uint64) << np.uint64(32)) | low, kind="stable")
        part = part[order]
        return order, low[order].astype(np.uint32), part, np.searchsorted(part, np.arange(ranges + 1))

    def digests(self, chosen: np.ndarray) -> np.ndarray:
        """Digest of the context of each chosen anchor."""
        return hash_spans(self.raw, self.first[chosen], self.count[chosen] + SPAN - 1)

    def bytes_of(self, chosen: np.ndarray) -> np.ndarray:
        """The contexts of chosen anchors, one after the other."""
        length = self.count[chosen] + SPAN - 1
        return self.raw[_runs(self.first[chosen], length)]


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... length[0] of them, then those of start[1] and so on."""
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


@tidy
def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the scan as compressed blocks, each of at most BLOCK_ROWS rows and about BLOCK_BYTES of text."""
    small = zstandard.ZstdCompressor(level=1)
    for batch in gathered(batches, BLOCK_BYTES, BLOCK_ROWS):
        sink = pa.BufferOutputStream()
        kept = batch.drop_columns(["rid"])
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_batch(kept)
        yield pa.RecordBatch.from_arrays([batch.column("rid").slice(0, 1), pa.array([small.compress(sink.getvalue().to_pybytes())], pa.binary())], ["block", "payload"])


def _send_anchors(ranges: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                block = Block(payload)
                order, low, part, _ = block.by_range(ranges)
                doc = block.ids[block.doc[order]]
                if not len(low):
                    continue
                at = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (part[1:] != part[:-1])]))
                several = np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at)
                keys, cut = low[at], np.searchsorted(part[at], np.arange(ranges + 1))
                yield pa.RecordBatch.from_pylist([{"part": p, "block": number, "keys": keys[a:b].tobytes(), "bits": np.packbits(several[a:b]).tobytes()} for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a], schema=_ASKED)

    return run


_ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("bits", pa.binary())])


@tidy
def _shared_bits(table: pa.Table) -> pa.Table:
    """For the keys of every block of a range: one bit, set if two documents have it."""
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for r, k in zip(rows, keys, strict=True):
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(k)).astype(bool)
        at = np.minimum(np.searchsorted(twice, k), max(0, len(twice) - 1))
        if len(twice):
            bits |= twice[at] == k
        out.append({"part": r["part"], "block": r["block"], "bits": np.packbits(bits).tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("bits", pa.binary())]))


def _chosen(block: Block, bits: pa.Table, ranges: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared anchors in order of shard, anchor, context and identifier; their shards; and the first of each equal run."""
    order, low, part, cut = block.by_range(ranges)
    shared = np.zeros(len(order), bool)
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (part[1:] != part[:-1])]) if len(low) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    for place, flags in zip(bits.column("part").to_pylist(), bits.column("bits").to_pylist(), strict=True):
        a, b = cut[place], cut[place + 1]
        mine = run[a:b] - run[a]
        shared[a:b] = np.unpackbits(np.frombuffer(flags, np.uint8), count=int(mine[-1]) + 1).astype(bool)[mine]
    chosen = order[shared]
    digest, own, ids = block.digests(chosen), block.hash[chosen], block.ids[block.doc[chosen]]
    shard = ((mix(own + _ODD) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    again = np.lexsort((ids, digest, own, shard))
    digest, own = digest[again], own[again]
    first = np.concatenate([[True], (digest[1:] != digest[:-1]) | (own[1:] != own[:-1])]) if len(again) else np.zeros(0, bool)
    return chosen[again], shard[again], first


_CONTEXTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("least", pa.int64()), ("payload", pa.binary())])


def _send_contexts(ranges: int, shards: int):
    """Per shard: 32 bits of each context's anchor, its identifier above the block's least, its length and bytes, compressed."""

    @tidy
    def run(table: pa.Table, bits: pa.Table) -> pa.Table:
        small = zstandard.ZstdCompressor(level=3)
        out = []
        for number, payload in zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True):
            block = Block(payload)
            chosen, shard, first = _chosen(block, bits, ranges, shards)
            at = np.flatnonzero(first)
            who = chosen[at]
            anchor, length = block.hash[who].astype(np.uint32), (block.count[who] + SPAN - 1).astype(np.uint8)
            least = int(block.ids.min()) if len(block.ids) else 0
            doc = (block.ids[block.doc[who]].view(np.uint64) - np.array(least).view(np.uint64)).astype(np.uint64)
            cut = np.searchsorted(shard[at], np.arange(shards + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[p], cut[p + 1]
                data = anchor[a:b].tobytes() + doc[a:b].tobytes() + length[a:b].tobytes() + block.bytes_of(who[a:b]).tobytes()
                out.append({"shard": p, "block": number, "n": b - a, "least": least, "payload": small.compress(data)})
        return pa.Table.from_pylist(out, schema=_CONTEXTS)

    return run


def _read_contexts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, n = zstandard.ZstdDecompressor().decompress(row["payload"]), row["n"]
    anchor = np.frombuffer(data, np.uint32, n)
    doc = np.frombuffer(data, np.uint64, n, 4 * n) + np.array(row["least"]).view(np.uint64)
    return anchor, doc.view(np.int64), np.frombuffer(data, np.uint8, n, 12 * n), np.frombuffer(data, np.uint8, -1, 13 * n)


class RunIndex:
    """Burrows-Wheeler transform in runs of a collection of short texts, each ended by a mark of its own.

    heads, starts: symbol and first row of each run; ends: text place of the suffix in
    the last row of each run (the samples); before: rows with the run's symbol in
    earlier runs; base: first row of each symbol's suffixes.  Marks sort above all bytes, in the order of the texts.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n_texts = len(off) - 1
        length = np.diff(off)
        n = len(data) + n_texts
        self.first = off[:-1] + np.arange(n_texts)
        mark = self.first + length
        text = np.full(n + 8, _SEP, np.uint8)
        inner = np.ones(n, bool)
        inner[mark] = False
        text[:n][inner] = data
        owner = np.repeat(np.arange(n_texts), length + 1)
        to_mark = mark[owner] - np.arange(n)  # bytes before the own mark
        view = np.ndarray((n,), ">u8", buffer=text, strides=(1,)).astype(np.uint64)
        short = np.flatnonzero(to_mark < 8)
        view[short] |= (~np.uint64(0)) >> (to_mark[short].astype(np.uint64) * np.uint64(8))
        rank = _dense(view)
        self.rank32 = None
        k = 8
        while k < SPAN + WIDTH + 1:
            if k == 32:
                self.rank32 = rank
            after = np.minimum(np.arange(n) + k, n - 1)
            nxt = np.where(to_mark >= k, rank[after] + 1, 0)
            rank = _dense(rank.astype(np.uint64) * np.uint64(n + 2) + nxt.astype(np.uint64))
            k *= 2
        sa = np.lexsort((owner, rank))
        self.sa, self.n = sa, n
        before = np.where(sa > 0, sa - 1, n - 1)
        bwt = text[before]
        new = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.starts = np.flatnonzero(new)
        self.heads = bwt[self.starts]
        run_length = np.diff(np.append(self.starts, n))
        self.ends = sa[np.append(self.starts[1:], n) - 1]
        order = np.argsort(self.heads, kind="stable")
        total = np.concatenate([[0], np.cumsum(run_length[order])])
        # rows of smaller symbols, plus those of the same symbol in earlier runs
        self.map_to = np.empty(len(order), np.int64)
        self.map_to[order] = total[:-1]
        self.mark_rows = np.flatnonzero(text[sa] == _SEP)  # in order of the texts
        inside = to_mark[sa] >= SPAN
        pair = self.rank32[sa].astype(np.int64) * (n + 2) + self.rank32[np.minimum(sa + SPAN - 32, n - 1)]
        self.match_start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | ~inside[1:] | ~inside[:-1]]))

    def step(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one byte to the left, by the mapping on runs."""
        run = np.searchsorted(self.starts, row, side="right") - 1
        return self.map_to[run] + row - self.starts[run]

    def smallest(self, docs: np.ndarray) -> np.ndarray:
        """Smallest identifier of each interval of rows that match SPAN bytes; docs: identifier of each text."""
        owner = np.searchsorted(self.first, self.sa, side="right") - 1
        return np.minimum.reduceat(docs[owner], self.match_start)


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    s = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
    return rank


def earlier_matches(data: np.ndarray, off: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each text (of at most SPAN + WIDTH - 1 bytes) a bit per place where a match of SPAN bytes has a smaller identifier."""
    index = RunIndex(data, off)
    least = index.smallest(docs)
    length = np.diff(off)
    bits = np.zeros(len(length), np.uint32)
    live = np.arange(len(length))
    row = index.mark_rows.copy()
    for done in range(1, int(length.max()) + 1):  # bytes from the end that have streamed through
        on = length[live] >= done
        live, row = live[on], index.step(row[on])
        if done >= SPAN:
            place = length[live] - done
            interval = np.searchsorted(index.match_start, row, side="right") - 1
            bits[live] |= (least[interval] < docs[live]).astype(np.uint32) << place.astype(np.uint32)
    return bits


@tidy
def _match_shard(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    sent = [_read_contexts(r) for r in rows]
    sizes = [r["n"] for r in rows]
    anchor, docs, length, data = (np.concatenate(x) for x in zip(*sent, strict=True))
    length = length.astype(np.int64)
    off = np.concatenate([[0], np.cumsum(length)])
    blob = data.tobytes()
    # equal contexts fold into the one with the smallest identifier
    number: dict[bytes, int] = {}
    kind = np.array([number.setdefault(blob[a:b], len(number)) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
    order = np.lexsort((docs, kind))
    lead = np.flatnonzero(np.concatenate([[True], kind[order][1:] != kind[order][:-1]]))
    head = order[lead]  # by kind
    bits = np.where(docs > docs[head][kind], np.uint32(0xFFFFFFFF), np.uint32(0))
    # of the rest only anchors with several contexts need the index
    _, inverse, many = np.unique(anchor[head], return_inverse=True, return_counts=True)
    wanted = head[many[inverse] > 1]
    step = 5_000  # texts of an index, which stays small enough for a cache; an anchor's contexts stay together unless it alone has more
    if len(wanted):
        wanted = wanted[np.argsort(anchor[wanted], kind="stable")]
        group = np.flatnonzero(np.concatenate([[True], anchor[wanted][1:] != anchor[wanted][:-1]]))
        a = 0
        while a < len(wanted):
            later = group[group > a]
            ends = np.append(later[later <= a + step], [])
            b = int(ends[-1]) if len(ends) and a + step < len(wanted) else (len(wanted) if a + step >= len(wanted) else int(later[0]) if len(later) else len(wanted))
            mine = wanted[a:b]
            size = length[mine]
            cut = np.concatenate([[0], np.cumsum(size)])
            bits[mine] = earlier_matches(data[_runs(off[mine], size)], cut, docs[mine])
            a = b
    cut = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Table.from_pylist([{"shard": r["shard"], "block": r["block"], "marks": bits[a:b].tobytes()} for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True)], schema=pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("marks", pa.binary())]))


def _removed(block: Block, bits: pa.Table, marks: pa.Table, ranges: int, shards: int) -> np.ndarray:
    """Which bytes of the block go."""
    chosen, shard, first = _chosen(block, bits, ranges, shards)
    edge = np.zeros(len(block.raw) + 1, np.int32)
    if len(chosen):
        at = np.flatnonzero(first)
        mark = np.zeros(len(at), np.uint32)
        cut = np.searchsorted(shard[at], np.arange(shards + 1))
        for r in marks.to_pylist():
            mark[cut[r["shard"]] : cut[r["shard"] + 1]] = np.frombuffer(r["marks"], np.uint32)
        run = np.cumsum(first) - 1
        each = mark[run]
        lead = block.ids[block.doc[chosen[at]]][run]
        each[block.ids[block.doc[chosen]] > lead] = np.uint32(0xFFFFFFFF)
        for k in range(WIDTH):
            hit = chosen[((each >> np.uint32(k)) & np.uint32(1)).astype(bool) & (block.count[chosen] > k)]
            start = block.first[hit] + k  # a window has one anchor, so no place comes twice
            edge[start] += 1
            edge[start + SPAN] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _finish(ranges: int, shards: int, schema: pa.Schema):
    @tidy
    def run(table: pa.Table, sent: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        block = Block(table.column("payload")[0].as_py())
        is_bits = pa.compute.equal(sent.column("kind"), 0)
        bits = sent.filter(is_bits).select(["place", "payload"]).rename_columns(["part", "bits"])
        marks = sent.filter(pa.compute.invert(is_bits)).select(["place", "payload"]).rename_columns(["shard", "marks"])
        gone = _removed(block, bits, marks, ranges, shards)
        off = block.off
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for i in range(len(block.ids)):
            g = gone[off[i] : off[i + 1]]
            n = int(g.sum())
            kept = block.raw[off[i] : off[i + 1]]
            kept = (kept[~g] if n else kept).tobytes()
            out["n_bytes"].append(len(g))
            out["n_removed"].append(n)
            out["n_spans"].append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if "kept_text" in schema.names:
                out["kept_text"].append(kept.decode("utf-8", "ignore"))
        columns = {"doc_id": pa.array(block.ids, mask=block.ids == _NO_ID)} | out
        if "rest" in schema.names:
            columns["rest"] = block.table.column("rest")
        return pa.table([columns[c] if isinstance(columns[c], (pa.Array, pa.ChunkedArray)) else pa.array(columns[c], schema.field(c).type) for c in schema.names], names=schema.names)

    return run


_NO_ID = np.iinfo(np.int64).max


def _passes(docs: DataFrame, id_col: str, text_col: str, fields: list[str], rest: list[str]) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(id_of(docs, id_col), F.lit(int(_NO_ID))).alias("doc_id"), text_of(docs, text_col).alias("text"), F.monotonically_increasing_id().alias("rid"), *([F.struct(*(docs[c] for c in rest)).alias("rest")] if rest else []))
    ways = parts(spark)
    blocks = checkpointed(rows.mapInArrow(_pack_blocks, "block long, payload binary"))
    ranges = shards = max(ways, -(-blocks.count() // PER_RANGE))
    asked = blocks.mapInArrow(_send_anchors(ranges), "part int, block long, keys binary, bits binary")
    bits = checkpointed(asked.groupBy("part").applyInArrow(_shared_bits, "part int, block long, bits binary"))
    dealt = blocks.repartition(ways, "block")
    contexts = dealt.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_send_contexts(ranges, shards), "shard int, block long, n int, least long, payload binary")
    marks = contexts.groupBy("shard").applyInArrow(_match_shard, "shard int, block long, marks binary")
    sent = bits.select("block", F.lit(0).alias("kind"), F.col("part").alias("place"), F.col("bits").alias("payload")).unionByName(marks.select("block", F.lit(1).alias("kind"), F.col("shard").alias("place"), F.col("marks").alias("payload")))
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
    out = StructType([f for f in StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string") if f.name in fields] + [f for f in rows.schema if f.name == "rest"])
    schema = pa.schema([(c, types[c]) for c in types if c in fields] + ([("rest", pa.null())] if rest else []))
    return dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_finish(ranges, shards, schema), out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and kept_text if `texts` is set.

    Null text is empty; a null identifier is larger than any other; rows with equal identifiers don't
    remove from each other.  In kept_text the bytes of a character that was cut are
    dropped.  An empty table gives no rows.
    """
    return _passes(docs, id_col, text_col, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if texts else [])], [])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every row, repeated passages cut from its text, in the same columns; n_chars, if there, follows."""
    rest = [c for c in docs.columns if c != text_col]
    found = _passes(docs, id_col, text_col, ["kept_text"], rest)
    new = {text_col: F.col("kept_text"), "n_chars": F.length("kept_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*((new[c] if c in new else F.col("rest")[c]).alias(c) for c in docs.columns))
