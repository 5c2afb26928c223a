"""Shared plan pieces: checkpoints, partition counts and connected components."""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Removes a query's shuffle files when it ends; nothing reads those of a checkpointed frame again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch between the engine and Python; the engine's default of 64 MB is held several times by each running task.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset a temporary one, on a local master only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="strandline-")


def _bound_batches(spark: SparkSession) -> None:
    """Bounds the session's batches by BATCH bytes, unless the application was started with a bound of its own."""
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, BATCH)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the cluster's shared checkpoint folder."""
    spark = df.sparkSession
    _bound_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes this setting when it is made
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class _WithCode:
    """Pickles to an object together with the code of its classes."""

    def __init__(self, value: object):
        self.value = value

    def __reduce__(self):
        return pickle.loads, (cloudpickle.dumps(self.value),)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """An object of bounded size on every executor; a Python worker reads it once and keeps it from task to task."""
    _bound_batches(spark)
    return spark.sparkContext.broadcast(_WithCode(value))


def _ends(batch: pa.RecordBatch, column: str) -> np.ndarray:
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def byte_slices(batches: Iterator[pa.RecordBatch], most: int = 2 << 20, rows: int = 2000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most `rows` rows and about `most` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        end = _ends(batch, column)
        a = 0
        while a < batch.num_rows:
            b = min(batch.num_rows, a + rows, max(a + 1, int(np.searchsorted(end, end[a] + most, side="right")) - 1))
            yield batch.slice(a, b - a)
            a = b


def gathered(batches: Iterator[pa.RecordBatch], most: int, rows: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """All rows in batches of at most `rows` rows and about `most` bytes of text, each put together from as many of the given
    ones as it takes; a longer text is a batch of its own."""
    held, size, many = [], 0, 0
    for batch in batches:
        end = _ends(batch, column)
        a = 0
        while a < batch.num_rows:
            fits = int(np.searchsorted(end, end[a] + most - size, side="right")) - 1
            b = min(batch.num_rows, a + rows - many, fits if held else max(a + 1, fits))
            if b > a:
                held.append(batch.slice(a, b - a))
                size, many, a = size + int(end[b] - end[a]), many + b - a, b
            if a < batch.num_rows:
                yield pa.concat_batches(held)
                held, size, many = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def discard(df: DataFrame) -> None:
    """Deletes the files of a checkpointed frame that no unfinished plan reads any more."""
    held = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if held.isDefined():
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(held.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Parameters of mallopt: blocks from 1 MB on are mapped by themselves, at most two arenas.
_MALLOPT = ((-3, 1 << 20), (-1, 1 << 20), (-8, 2))


def _libc():
    try:
        return ctypes.CDLL(None)
    except OSError:
        return None


def _tune() -> None:
    """Makes the worker's allocator give large blocks back at once."""
    lib = _libc()
    if hasattr(lib, "mallopt"):
        for name, value in _MALLOPT:
            lib.mallopt(name, value)


def _release() -> None:
    """Gives freed memory back to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    lib = _libc()
    if hasattr(lib, "malloc_trim"):
        lib.malloc_trim(0)


def tidy(run):
    """A function of batches (a generator) or of one group, releasing memory after each."""

    def done(*data):
        _tune()
        got = run(*data)
        if isinstance(got, types.GeneratorType):
            return _released(got)
        _release()
        return got

    if run.__code__.co_argcount == 1:  # the engine looks at the number of arguments
        return lambda data: done(data)
    return lambda left, right: done(left, right)


def _released(batches):
    for batch in batches:
        yield batch
        _release()
    _release()


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(df: DataFrame, text_col: str) -> F.Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def id_of(df: DataFrame, id_col: str) -> F.Column:
    """The identifier as a long; one that is no integer counts as null."""
    return df[id_col].try_cast("long")


def digest_of(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def without_rows(docs: DataFrame, text: F.Column, id_col: str, gone: DataFrame, twins: DataFrame) -> DataFrame:
    """docs without the rows that gone (doc_id, digest) names, and one row of those that twins names; digest is that of `text`.

    Rows are told apart by identifier and text, so a text with an identifier that some other text has isn't lost.  Columns of any
    name stay as they are.
    """
    free = next(f"row_{k}" for k in range(1 << 20) if not any(c.lower().startswith(f"row_{k}_") for c in docs.columns))
    who, what = f"{free}_id", f"{free}_text"
    keyed = docs.withColumns({who: id_of(docs, id_col), what: digest_of(text)})
    name = lambda df, k: df.select(F.col("doc_id").alias(f"{free}_{k}"), F.col("digest").alias(f"{free}_{k}_text"))
    match = lambda df, k: keyed[who].eqNullSafe(df[f"{free}_{k}"]) & (keyed[what] == df[f"{free}_{k}_text"])
    lost, double = name(gone, "gone"), name(twins, "twin")
    left = keyed.join(lost, match(lost, "gone"), "left_anti")
    if not twins.isEmpty():
        left = left.join(double, match(double, "twin"), "left_anti").unionByName(left.join(double, match(double, "twin"), "left_semi").dropDuplicates([who, what]))
    return left.drop(who, what)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in links (a, b): the smallest id reachable.

    Alternates large-star and small-star steps: every edge is hung under the
    least neighbour until nothing moves, in a logarithmic number of rounds.  Each step is
    a map-side combined minimum and an equi-join with a checkpointed side, so
    a hub's edges can be split by the engine's skew handling.  Self links and
    nulls are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not mark["n"] or (mark["n"], mark["s"]) == seen:
            break
        seen = (mark["n"], mark["s"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = checkpointed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
