"""Similarity of motifs and the graph it spans: pairs, orientation, components, averages, matches with a library."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import checkpointed

LEAST_NORM = 1e-10


def motif_vector(pwm: Column, flank: int = 5) -> Column:
    """The places of a matrix (array of places of four shares) but the two centre ones, each less 0.25 and of length 1, in one array.

    Null for a matrix without 2*flank+2 places of four shares.
    """
    rest = F.concat(F.slice(pwm, 1, flank), F.slice(pwm, flank + 3, flank))

    def unit(place: Column) -> Column:
        moved = F.transform(place, lambda v: v - 0.25)
        norm = F.greatest(F.sqrt(F.aggregate(moved, F.lit(0.0), lambda s, v: s + v * v)), F.lit(LEAST_NORM))
        return F.transform(F.array(norm), lambda n: F.transform(moved, lambda v: v / n))[0]

    whole = (F.size(pwm) == 2 * flank + 2) & F.forall(pwm, lambda place: F.coalesce(F.size(place) == 4, F.lit(False)) & F.forall(place, lambda v: v.isNotNull()))
    return F.when(whole, F.flatten(F.transform(rest, unit)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


#: Vectors of a block at most; a task holds two blocks.
BLOCK = 1 << 16
#: Blocks smaller than this are not made for the sake of more tasks.
SMALL_BLOCK = 1 << 10
#: Products that a task holds at a time.
PRODUCTS = 1 << 22


def similar_pairs(vectors: DataFrame, threshold: float, blocks: int = 10) -> DataFrame:
    """Pairs id1 < id2 with sim = dot / blocks >= threshold (vectors: id, vec made of `blocks` unit vectors); null vectors pair with nothing.

    Rows are dealt to equal blocks by hash, and a task takes each pair of blocks (a
    block with itself too), so every pair of rows is compared in one place. Single
    precision products pass over what is below the threshold by more than their
    error; the others are summed place by place in double precision. Work grows with
    the square of the rows, memory of a task does not grow, and no side is broadcast.
    """
    x = vectors.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = x.count()
    many = max(-(-rows // BLOCK), min(-(-rows // SMALL_BLOCK), math.ceil((6 * cores) ** 0.5)), 1)  # three tasks a core, where rows suffice
    x = x.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(many)))
    lesser, larger = (lambda c: F.least(c, F.col("block"))), (lambda c: F.greatest(c, F.col("block")))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")), lambda c: (larger(c) * (larger(c) + 1) / 2).cast("int") + lesser(c).cast("int"))
    dealt = x.select("id", "vec", "block", F.explode(parts).alias("part")).repartitionById(many * (many + 1) // 2, F.col("part"))
    kind = dict(vectors.dtypes)["id"]
    found = dealt.mapInArrow(_block_pairs(threshold, blocks), f"a {kind}, b {kind}, sim double").where("a <> b")
    return found.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "sim")).alias("sim"))


def _block_pairs(threshold: float, blocks: int):
    """A task over rows id, vec, block, part: a, b, sim of the pairs of rows of each part's two blocks, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        part, block = held["part"].to_numpy(), held["block"].to_numpy()
        length = pc.list_value_length(held["vec"]).to_numpy()
        for p in np.unique(part):
            larger = int((math.isqrt(8 * int(p) + 1) - 1) // 2)
            lesser = int(p) - larger * (larger + 1) // 2
            for n in np.unique(length[part == p]):  # vectors of other lengths pair with nothing
                here = (part == p) & (length == n)
                sides = [held.filter(pa.array(here & (block == k))).select(["id", "vec"]).combine_chunks() for k in dict.fromkeys((larger, lesser))]
                if all(s.num_rows for s in sides):
                    yield from _pairs(sides[0], sides[-1], int(n), larger == lesser, threshold, blocks)

    return run


def _pairs(left: pa.Table, right: pa.Table, n: int, same: bool, threshold: float, blocks: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a row of `left` and one of `right`; same: both are one table, of which each pair is taken once."""
    x, y = (pc.list_flatten(t["vec"]).to_numpy().reshape(-1, n) for t in (left, right))  # nulls become NaN, which passes no test
    fine = np.ascontiguousarray(y.T, np.float32)
    by_place = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    size = float(np.nanmax(np.einsum("ij,ij->i", x, x), initial=0.0)) ** 0.5 * float(np.nanmax(np.einsum("ij,ij->i", y, y), initial=0.0)) ** 0.5
    least = np.float32(threshold * blocks - (n + 8) * 2.0**-23 * (size + abs(threshold * blocks)))  # twice the rounding of a single precision dot product
    step = max(1, PRODUCTS // len(y))
    for i in range(0, len(x), step):
        first = i if same else 0
        near = x[i : i + step].astype(np.float32) @ fine[:, first:] >= least
        a, b = np.divmod(np.flatnonzero(near), near.shape[1])  # faster than nonzero of two dimensions
        a, b = a + i, b + first
        if same:
            a, b = a[b > a], b[b > a]
        for k in range(0, len(a), PRODUCTS // 16):
            c, d = a[k : k + PRODUCTS // 16], b[k : k + PRODUCTS // 16]
            total = np.zeros(len(c))
            for u, v in zip(*by_place, strict=True):
                total += u[c] * v[d]
            sim = total / blocks
            hit = sim >= threshold
            if hit.any():
                out = [left["id"].take(pa.array(c[hit])), right["id"].take(pa.array(d[hit])), pa.array(sim[hit])]
                yield from pa.table(out, names=["a", "b", "sim"]).to_batches()


def oriented(pairs: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """index1, index2, sim: from the higher score to the lower (equal scores: both ways); without scores id1 -> id2 (scores: id, score)."""
    if scores is None:
        return pairs.select(F.col("id1").alias("index1"), F.col("id2").alias("index2"), "sim")
    s = scores.select("id", "score")
    x = pairs.join(s.select(F.col("id").alias("id1"), F.col("score").alias("s1")), "id1").join(s.select(F.col("id").alias("id2"), F.col("score").alias("s2")), "id2")
    ends = F.array(F.when(F.col("s1") >= F.col("s2"), F.struct(F.col("id1").alias("index1"), F.col("id2").alias("index2"))), F.when(F.col("s2") >= F.col("s1"), F.struct(F.col("id2").alias("index1"), F.col("id1").alias("index2"))))
    return x.select(F.explode(F.array_compact(ends)).alias("e"), "sim").select("e.index1", "e.index2", "sim")


#: Rows of a task, about, in the steps of components.
TASK_ROWS = 1 << 20
#: A key with more than this share of the rows isn't shuffled, so there are 2 * SHARES such keys at most.
SHARES = 1024


@contextmanager
def _dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of plans that run meanwhile have parts of about TASK_ROWS of so many rows, and one a core where rows suffice."""
    cores = spark.sparkContext.defaultParallelism
    now = {"spark.sql.shuffle.partitions": str(max(-(-rows // TASK_ROWS), min(cores, -(-rows // 10_000)), 1)), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _with_least(x: DataFrame, key: str, other: str, rows: int) -> DataFrame:
    """x with m, the least of `key` and every `other` of it, for the key of each row.

    Keys with many of the `rows` get theirs from a broadcast of 2 * SHARES rows at most; only rows of the others are dealt by key.
    """
    spark = x.sparkSession
    least = lambda y: y.groupBy(key).agg(F.least(F.min(other), F.col(key)).alias("m"), F.count(F.lit(1)).alias("many"))
    found = least(x).where(F.col("many") > rows // SHARES + 1)
    hubs = found.select(key, "m").collect()
    if not hubs:
        return x.join(least(x).drop("many"), key)
    hubs = F.broadcast(spark.createDataFrame(hubs, found.select(key, "m").schema))
    rest = x.join(hubs.select(key), key, "left_anti")
    return rest.join(least(rest).drop("many"), key).unionByName(x.join(hubs, key))


def components(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """id, root of every end of a pair (id1, id2); root: the smallest id reachable.

    Stars alternate: each node's larger neighbours, then its smaller ones, are hung
    on its smallest neighbour, until nothing moves; every round is checkpointed. The
    pairs are read twice. Tasks take about TASK_ROWS rows, also those of a hub with
    most of the pairs, as every root of a large component becomes one.
    """
    spark = pairs.sparkSession
    edge = pairs.select(F.least("id1", "id2").alias("u"), F.greatest("id1", "id2").alias("v")).where("id1 is not null and id2 is not null and u <> v")
    rows, seen = edge.count(), None
    with _dealt(spark, rows):
        edge = checkpointed(edge.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "u", "v").distinct())
    for _ in range(rounds + 1):
        mark = tuple(edge.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == seen:
            leaves = edge.select(F.col("v").alias("id"), F.col("u").alias("root"))
            return leaves.union(edge.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
        rows, seen = mark[0], mark
        with _dealt(spark, 2 * rows):
            both = edge.select("u", "v").union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = checkpointed(_with_least(both, "u", "v", rows).where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct())
            small = _with_least(large, "v", "u", rows).select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b")
            edge = checkpointed(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    raise RuntimeError(f"components still move after {rounds} rounds")


def numbered_components(pairs: DataFrame, least: int = 2) -> DataFrame:
    """id, component_id, size: components of at least `least` members, numbered from 1 by size, then by smallest id."""
    found = components(checkpointed(pairs))
    size = found.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    rank = size.withColumn("component_id", F.row_number().over(Window.orderBy(F.desc("size"), "root")).cast("long"))  # a row per component
    return found.join(rank, "root").select("id", "component_id", "size")


def average_pwm(members: DataFrame, key: str = "component_id", pwm: str = "pwm") -> DataFrame:
    """key, place (from 1), mean shares f_a, f_c, f_g, f_t over the members' matrices, scaled to sum 1, and the first largest base."""
    x = members.select(key, F.posexplode(pwm).alias("p", "f")).groupBy(key, (F.col("p") + 1).cast("long").alias("place"))
    x = x.agg(*(F.avg(F.col("f")[i]).alias(f"f_{b}") for i, b in enumerate("acgt")))
    total = F.col("f_a") + F.col("f_c") + F.col("f_g") + F.col("f_t")
    x = x.select(key, "place", *((F.col(f"f_{b}") / total).alias(f"f_{b}") for b in "acgt"))
    top = F.greatest("f_a", "f_c", "f_g", "f_t")
    return x.withColumn("base", F.when(F.col("f_a") == top, "A").when(F.col("f_c") == top, "C").when(F.col("f_g") == top, "G").otherwise("T"))


def aligned_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Largest mean cosine of the columns of two matrices (places x 4) over all shifts of the shorter along the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    cosine = (short @ long.T) / (np.linalg.norm(short, axis=1)[:, None] * np.linalg.norm(long, axis=1)[None, :] + LEAST_NORM)
    return max(float(np.trace(cosine, offset=s)) / len(short) for s in range(len(long) - len(short) + 1))


def library_matches(motifs: DataFrame, library: DataFrame, least: float = 0.9, limit: int = 20_000) -> DataFrame:
    """id, motif_id, motif_name, corr: each motif's best library match on either strand, if at least `least` (ties: smallest motif_id).

    motifs: id, pwm; library: motif_id, motif_name, pwm. The library is sent to every
    executor, so it may hold at most `limit` matrices; a larger one is refused.
    """
    held = library.select("motif_id", "motif_name", "pwm").orderBy("motif_id").limit(limit + 1).collect()
    if len(held) > limit:
        raise ValueError(f"the library holds more than {limit} matrices")
    known = [(r["motif_id"], r["motif_name"], np.array(r["pwm"], float)) for r in held]
    # turned round, A pairs with T and C with G: both axes are reversed
    kind, id_kind = dict(library.dtypes)["motif_id"], dict(motifs.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, p in zip(b["id"], b["pwm"], strict=True):
                p = np.array([list(place) for place in p], float)
                best = None
                for m, name, q in known:
                    c = max(aligned_similarity(p, q), aligned_similarity(p, q[::-1, ::-1]))
                    if c >= least and (best is None or c > best[3]):
                        best = (i, m, name, c)
                if best:
                    rows.append(best)
            yield pd.DataFrame(rows, columns=["id", "motif_id", "motif_name", "corr"])

    return motifs.select("id", "pwm").where("pwm is not null").mapInPandas(run, f"id {id_kind}, motif_id {kind}, motif_name string, corr double")
