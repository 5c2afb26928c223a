"""Pairs of similar vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import graph


def sim_of(a, b, blocks):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return max(-1.0, min(1.0, total / blocks))


@pytest.mark.parametrize("block", [60, 1 << 16])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_equal_all_pairs_without_a_join_of_rows(spark, monkeypatch, block, kind):
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "PRODUCTS", 1000)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 4, 3))
    v = (v / np.linalg.norm(v, axis=2, keepdims=True)).reshape(300, 12)
    v[40:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[8].tolist()), (300, None), (301, [None] * 12), (302, v[0][:9].tolist())]
    data = spark.createDataFrame(rows, "id long, vec array<double>").withColumn("id", F.col("id").cast(kind))
    found = graph.similar_pairs(data, 0.5, 4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # a join of rows by one distance holds nearly all pairs
    name = int if kind == "long" else str
    x = [(name(i), u) for i, u in rows if u and len(u) == 12 and None not in u]
    want = [(min(i, j), max(i, j), s) for k, (i, a) in enumerate(x) for j, b in x[k + 1 :] if i != j and (s := sim_of(a, b, 4)) >= 0.5]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 190


def test_pairs_at_the_threshold_stay(spark):
    data = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.75**0.5]), (3, [0.5 - 1e-12, 0.75**0.5])], "id long, vec array<double>")
    assert [(r["id1"], r["id2"]) for r in graph.similar_pairs(data, 0.5, 1).orderBy("id1", "id2").collect()] == [(1, 2), (2, 3)]
    assert graph.similar_pairs(data.limit(0), 0.5, 1).count() == 0


def test_orientation_of_many_pairs(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 2, 4))
    v = (v / np.linalg.norm(v, axis=2, keepdims=True)).reshape(400, 8)
    data = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, vec array<double>, score int")
    found = graph.oriented(graph.similar_pairs(data, 0.4, 2), data)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()  # no product row by row
    want = {(i, j) for i in range(400) for j in range(400) if i != j and i % 3 >= j % 3 and sim_of(v[min(i, j)].tolist(), v[max(i, j)].tolist(), 2) >= 0.4}
    rows = found.collect()
    assert {(r["index1"], r["index2"]) for r in rows} == want and len(rows) == len(want)
