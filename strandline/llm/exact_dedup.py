"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition makes one sorted run of digests per digest range, each
with the smallest identifier and the number of its rows.  Runs of a range then
meet in rounds: in round k the runs whose numbers agree after dropping k digits
in base FAN_IN are merged, so after log(runs) rounds each range has a single
run.  Equal neighbours fold at every level, therefore a text with any number of
copies costs at most one entry per run and no task gathers its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import checkpointed, digest_of, id_of, parts, text_of, without_rows

#: Runs merged at once.
FAN_IN = 8
#: Rows for which a digest range is made, so that the last run of a range stays small (64 bytes an entry).
RANGE_ROWS = 2_000_000
#: Digest (four lanes of SHA-256), then length and a second hash that verify it.
_LANES = 6
_RUN = "part int, run int, lanes binary, keep binary, rows binary"
_NO_ID = np.iinfo(np.int64).max
_WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: F.Column) -> F.Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, _WHITE, " ")


def _fold(lanes: np.ndarray, keep: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort and fold entries whose lanes all agree: smallest identifier, sum of rows."""
    order = np.lexsort(lanes.T[::-1])
    lanes, keep, rows = lanes[order], keep[order], rows[order]
    if not len(lanes):
        return lanes, keep, rows
    at = np.flatnonzero(np.concatenate([[True], (lanes[1:] != lanes[:-1]).any(axis=1)]))
    return lanes[at], np.minimum.reduceat(keep, at), np.add.reduceat(rows, at)


def _packed(part: int, run: int, lanes: np.ndarray, keep: np.ndarray, rows: np.ndarray) -> dict:
    return {"part": part, "run": run, "lanes": lanes.tobytes(), "keep": keep.tobytes(), "rows": rows.tobytes()}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["lanes"], np.uint64).reshape(-1, _LANES), np.frombuffer(row["keep"], np.int64), np.frombuffer(row["rows"], np.int64)


_SCHEMA = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("lanes", pa.binary()), ("keep", pa.binary()), ("rows", pa.binary())])


def _runs(ranges: int, most: int = 1 << 19):
    """Sorted runs of a partition, by digest range; a run is folded whenever `most` entries have come in."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, number = 0, 0

        def emit() -> pa.RecordBatch:
            lanes, keep, rows = _fold(*(np.concatenate(x) for x in zip(*held, strict=True)))
            part = ((lanes[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(int)
            cut = np.searchsorted(part, np.arange(ranges + 1))
            return pa.RecordBatch.from_pylist([_packed(p, number, lanes[a:b], keep[a:b], rows[a:b]) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a], schema=_SCHEMA)

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)
            rest = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("length", "second")]
            number = batch.column("run")[0].as_py()
            held.append((np.column_stack([raw, *rest]), batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), np.ones(batch.num_rows, np.int64)))
            size += batch.num_rows
            if size > most:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    return make


def _merge(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    merged = _fold(*(np.concatenate(x) for x in zip(*map(_unpacked, rows), strict=True)))
    return pa.Table.from_pylist([_packed(rows[0]["part"], rows[0]["run"], *merged)], schema=_SCHEMA)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest with several rows."""
    for batch in batches:
        for row in batch.to_pylist():
            lanes, keep, rows = _unpacked(row)
            many = np.flatnonzero(rows > 1)
            digest = lanes[many, :4].astype(">u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([digest[i : i + 32] for i in range(0, len(digest), 32)], pa.binary()), pa.array(lanes[many, 4].view(np.int64)), pa.array(lanes[many, 5].view(np.int64)), pa.array(keep[many]), pa.array(rows[many])], ["digest", "length", "second", "keep", "rows"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is empty.  A null identifier loses to any other; where a group
    has none, keep_id is null and all its rows are kept.  Rows that repeat
    an identifier with the same text count as copies, each row with the
    smallest identifier being kept.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = normalised(text_of(docs, text_col))
    leaf = docs.select(
        F.coalesce(id_of(docs, id_col), F.lit(int(_NO_ID))).alias("id"),
        digest_of(text).alias("digest"),
        F.octet_length(text).cast("long").alias("length"),
        F.xxhash64(text).alias("second"),
        F.spark_partition_id().alias("run"),
    )
    leaf = checkpointed(leaf)
    ranges = ranges or max(parts(spark), -(-leaf.count() // RANGE_ROWS))
    runs = checkpointed(leaf.mapInArrow(_runs(ranges), _RUN))
    left = runs.agg(F.max("run")).first()[0]
    while left:
        runs = runs.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
        runs = checkpointed(runs.groupBy("part", "run").applyInArrow(_merge, _RUN))
        left //= FAN_IN
    runs = runs.groupBy("part", "run").applyInArrow(_merge, _RUN)  # a partition may have made several runs
    found = checkpointed(runs.mapInArrow(_repeated, "digest binary, length long, second long, keep long, rows long"))
    out = leaf.join(found, ["digest", "length", "second"], "left")
    keep = F.coalesce("keep", "id")
    real = F.when(keep != F.lit(int(_NO_ID)), keep)
    return out.select(
        F.when(F.col("id") != F.lit(int(_NO_ID)), F.col("id")).alias("doc_id"),
        real.alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id") == keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the smallest identifier, and one row of several with it.

    Null text is empty; a null identifier, or one that is no integer, loses to any other.  A row goes by its identifier and
    its text, so another text with the same identifier stays.  Columns stay as they are, whatever their
    names; an empty table gives no rows.
    """
    groups = checkpointed(exact_groups(docs, id_col, text_col).select("doc_id", "kept", F.unhex("text_sha256").alias("digest")))
    gone = groups.where("not kept").select("doc_id", "digest").distinct()
    twins = groups.where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest")
    return without_rows(docs, normalised(text_of(docs, text_col)), id_col, gone, twins)
