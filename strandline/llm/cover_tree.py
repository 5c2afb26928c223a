"""Embedding near-duplicates by dual traversal of cover trees.

Cosine of at least c means a distance of at most t = sqrt(2 - 2c) between
unit vectors.  Equal vectors of a label are first folded into one with a
weight.  The rest is dealt into chunks of bounded size that hold neighbours in a
spatial order; a pair of chunks is opened only if their balls come within t.  Each
chunk gets a cover tree: nested centres whose radii halve from level to level, every
node with its true covering radius.  A pair of nodes goes on to its children only if

    d(a, b) <= t + radius(a) + radius(b),

so no link is lost; pairs of leaves are confirmed by the cosine in double precision.
A pair of chunks returns degrees and a spanning forest, never its pairs of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tools import checkpointed, connected_components, id_of

CHUNK = 1024
#: Signs of this many fixed random directions give the spatial order.
ORDER_BITS = 16
_SLACK = 1e-7


@dataclass
class Level:
    """Centres (rows of points), covering radius of each, and its children's places in the next level."""

    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray  # children of node i: first[i] .. first[i + 1]


def cover_tree(points: np.ndarray) -> list[Level]:
    """Levels from the root to single points.  Every centre is its own first child; radii of the cover halve."""
    n = len(points)
    levels: list[Level] = []
    groups = [np.arange(n)]
    cover = 2.0
    while groups:
        levels.append(Level(np.array([g[0] for g in groups]), np.array([_far(points, g) for g in groups]), np.zeros(1, int)))
        if all(len(g) == 1 for g in groups):
            levels[-1].first = np.zeros(len(groups) + 1, int)
            break
        cover /= 2
        below, first = [], [0]
        for g in groups:
            below += _split(points, g, cover)
            first.append(len(below))
        levels[-1].first = np.array(first)
        groups = below
    return levels


def _far(points: np.ndarray, g: np.ndarray) -> float:
    return float(np.sqrt(((points[g] - points[g[0]]) ** 2).sum(axis=1).max())) if len(g) > 1 else 0.0


def _split(points: np.ndarray, g: np.ndarray, cover: float) -> list[np.ndarray]:
    """Parts of g, each within `cover` of its first point, first points further apart than that."""
    if len(g) == 1:
        return [g]
    if cover < 1e-9:
        return [g[i : i + 1] for i in range(len(g))]
    out, left = [], g
    while len(left):
        d = ((points[left] - points[left[0]]) ** 2).sum(axis=1)
        near = d <= cover * cover
        near[0] = True
        out.append(left[near])
        left = left[~near]
    return out


def close_pairs(a: np.ndarray, ta: list[Level], b: np.ndarray, tb: list[Level], t: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of every pair of points within t (and a little more), by traversing both trees."""
    depth = max(len(ta), len(tb))
    level = lambda tree, k: tree[min(k, len(tree) - 1)]
    x, y = np.array([0]), np.array([0])
    for k in range(depth):
        la, lb = level(ta, k), level(tb, k)
        d = np.sqrt(((a[la.centre[x]] - b[lb.centre[y]]) ** 2).sum(axis=1))
        near = d <= t + la.radius[x] + lb.radius[y] + _SLACK
        x, y = x[near], y[near]
        if k == depth - 1 or not len(x):
            break
        if k < len(ta) - 1:
            many = np.diff(la.first)[x]
            start = np.repeat(la.first[x] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            x, y = start + np.arange(many.sum()), np.repeat(y, many)
        if k < len(tb) - 1:
            # children of y whose distance to x's centre can matter are found with a matrix product per y
            px, py = [], []
            nx = level(ta, k + 1)
            order = np.argsort(y, kind="stable")
            x, y = x[order], y[order]
            at = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
            for s, e in zip(at, np.append(at[1:], len(y)), strict=True):
                kids = np.arange(lb.first[y[s]], lb.first[y[s] + 1])
                nb = tb[k + 1]
                for c in range(s, e, 1024):
                    xs = x[c : min(e, c + 1024)]
                    pa_, pb = a[nx.centre[xs]], b[nb.centre[kids]]
                    d2 = (pa_**2).sum(axis=1)[:, None] + (pb**2).sum(axis=1)[None] - 2 * pa_ @ pb.T
                    i, j = np.nonzero(d2 <= (t + nx.radius[xs][:, None] + nb.radius[kids][None] + 10 * _SLACK) ** 2 + _SLACK)
                    px.append(xs[i])
                    py.append(kids[j])
            x, y = np.concatenate(px), np.concatenate(py)
    return level(ta, depth).centre[x] if len(x) else x, level(tb, depth).centre[y] if len(y) else y


_CHUNK_SQL = "label string, dim int, chunk long, ids binary, weights binary, vectors binary, centre array<double>, radius double"
_FOUND = pa.schema([("id", pa.int64()), ("parent", pa.int64()), ("degree", pa.int64())])


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by("rep")
    dim = table.column("dim")[0].as_py()
    v = np.array(table.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)
    unit = v / np.sqrt((v**2).sum(axis=1))[:, None]
    centre = unit.mean(axis=0)
    radius = float(np.sqrt(((unit - centre) ** 2).sum(axis=1).max()))
    row = {"label": table.column("label")[0].as_py(), "dim": dim, "chunk": table.column("chunk")[0].as_py(), "ids": table.column("rep").to_numpy().tobytes(), "weights": table.column("copies").to_numpy().tobytes(), "vectors": v.tobytes(), "centre": centre.tolist(), "radius": radius}
    return pa.Table.from_pylist([row], schema=pa.schema([("label", pa.string()), ("dim", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))


def _join(cosine: float):
    t = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                same = row["chunk_a"] == row["chunk_b"]
                sides = []
                for s in ("a",) if same else ("a", "b"):
                    v = np.frombuffer(row[f"vectors_{s}"]).reshape(-1, row["dim"])
                    norm = np.sqrt((v**2).sum(axis=1))
                    unit = v / norm[:, None]
                    sides.append((np.frombuffer(row[f"ids_{s}"], np.int64), np.frombuffer(row[f"weights_{s}"], np.int64), v, norm, unit, cover_tree(unit)))
                a, b = sides[0], sides[-1]
                x, y = close_pairs(a[4], a[5], b[4], b[5], t)
                if same:
                    x, y = x[x < y], y[x < y]
                sure = np.concatenate([np.zeros(0, bool), *((a[2][x[k : k + 65536]] * b[2][y[k : k + 65536]]).sum(axis=1) / (a[3][x[k : k + 65536]] * b[3][y[k : k + 65536]]) >= cosine for k in range(0, len(x), 65536))])
                x, y = x[sure], y[sure]
                if not len(x):
                    continue
                n = len(a[0])
                ids = a[0] if same else np.concatenate([a[0], b[0]])
                y_at = y if same else y + n
                degree = np.bincount(x, weights=b[1][y], minlength=len(ids)) + np.bincount(y_at, weights=a[1][x], minlength=len(ids))
                root = _forest(len(ids), x, y_at, ids)
                out = np.flatnonzero(degree)
                yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[root[out]]), pa.array(degree[out].astype(np.int64))], schema=_FOUND)

    return run


def _forest(n: int, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place the place of the smallest id it is connected to."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, int)
    rank[order] = np.arange(n)
    label = np.arange(n)
    a, b = rank[x], rank[y]
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            return order[label[rank]]


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link when labels are equal and not null and the cosine is at least
    `cosine`.  A vector that is null, empty, zero or holds a null or a
    non-finite component links with nothing, nor do vectors of different
    lengths.  Rows that repeat an id count as different vectors with that id.
    An empty table gives no rows.
    """
    v = vectors.select(id_of(vectors, id_col).alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("unit"))
    finite = F.forall("unit", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("unit") > 0) & finite & F.exists("unit", lambda c: c != 0), F.lit(False))
    v = v.withColumn("usable", usable).withColumn("digest", F.when(F.col("usable"), F.xxhash64("unit")))
    good = v.where("usable")
    reps = good.groupBy("label", "digest", "unit").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = checkpointed(reps.withColumn("dim", F.size("unit")))
    rng = np.random.default_rng(7)
    # a spatial order within the label: signs along fixed random directions (each a different short run of components)
    picks = [[(int(i), float(s)) for i, s in zip(rng.integers(0, 1 << 30, 24), rng.choice([-1.0, 1.0], 24), strict=True)] for _ in range(ORDER_BITS)]
    side = [F.aggregate(F.array(*(F.struct((F.lit(i) % F.col("dim")).cast("int").alias("i"), F.lit(s).alias("s")) for i, s in p)), F.lit(0.0), lambda acc, q: acc + F.get("unit", q["i"]) * q["s"]) > 0 for p in picks]
    code = sum((F.when(s, F.lit(1 << k)).otherwise(F.lit(0)) for k, s in enumerate(side)), F.lit(0))
    # a bucket of a code holds any number of rows, so it is cut into chunks by counted sub-buckets
    coded = reps.withColumn("code", code).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(1 << 20)))
    sizes = coded.groupBy("label", "dim", "code").agg(F.count(F.lit(1)).alias("n"))
    # consecutive codes fill a chunk; a code with more rows than a chunk takes several
    w = Window.partitionBy("label", "dim").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("own", F.ceil(F.col("n") / chunk)).withColumn("first", F.floor(F.col("before") / chunk) * (1 << 20))
    coded = coded.join(placed.select("label", "dim", "code", "own", "first", "n"), ["label", "dim", "code"])
    coded = coded.withColumn("chunk", F.when(F.col("own") > 1, F.col("first") + F.lit(1) + F.pmod(F.col("salt"), F.col("own"))).otherwise(F.col("first")).cast("long"))
    packed = checkpointed(coded.select("label", "dim", "chunk", "rep", "copies", "unit").groupBy("label", "dim", "chunk").applyInArrow(_pack, _CHUNK_SQL))
    t = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    head = packed.select("label", "dim", "chunk", "centre", "radius")
    a, b = (head.select("label", "dim", *(F.col(c).alias(f"{c}_{s}") for c in ("chunk", "centre", "radius"))) for s in "ab")
    gap = F.sqrt(F.aggregate(F.zip_with("centre_a", "centre_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, q: s + q))
    pairs = a.join(b, ["label", "dim"]).where((F.col("chunk_a") <= F.col("chunk_b")) & (gap <= F.lit(t + 1e-6) + F.col("radius_a") + F.col("radius_b"))).select("label", "dim", "chunk_a", "chunk_b")
    data_a, data_b = (packed.select("label", "dim", *(F.col(c).alias(f"{c}_{s}") for c in ("chunk", "ids", "weights", "vectors"))) for s in "ab")
    work = pairs.join(data_a, ["label", "dim", "chunk_a"]).join(data_b, ["label", "dim", "chunk_b"])
    work = work.repartition(max(1, packed.count() * 2), "label", "chunk_a", "chunk_b")
    found = checkpointed(work.mapInArrow(_join(cosine), "id long, parent long, degree long"))
    degree = found.groupBy(F.col("id").alias("rep")).agg(F.sum("degree").alias("degree"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("parent").alias("b"))).withColumnRenamed("id", "rep")
    answer = reps.select("label", "digest", "unit", "rep", "copies").join(degree, "rep", "left").join(component, "rep", "left")
    answer = checkpointed(answer.select("label", "digest", "unit", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("links"), F.coalesce("component_id", "rep").alias("smallest")))
    out = v.select("vec_id", "label", "digest", "unit").join(answer, ["label", "digest", "unit"], "left")
    smallest = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), smallest.alias("component_id"), F.coalesce(F.col("vec_id") == smallest, F.lit(True)).alias("kept"))
