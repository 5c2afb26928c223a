"""Components of graphs with hubs against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph


def roots(pairs):
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in list(up)}


@pytest.mark.parametrize("task_rows", [100, 1 << 20])
def test_components_with_hubs(spark, monkeypatch, task_rows):
    monkeypatch.setattr(graph, "TASK_ROWS", task_rows)
    pick = random.Random(3)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(k, 5000) for k in range(2000, 2200)]
    pairs += [(pick.randrange(6000, 6300), pick.randrange(6000, 6300)) for _ in range(150)] + [(1, None), (None, 7000), (8000, 8000), (5, 4), (4, 5)]
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    got = [tuple(r) for r in graph.components(spark.createDataFrame(pairs, "id1 long, id2 long")).collect()]
    assert dict(got) == roots(pairs) and len(got) == len(dict(got))
    assert before == {k: spark.conf.get(k, None) for k in before}
    assert graph.components(spark.createDataFrame([], "id1 long, id2 long")).count() == 0


def test_rows_of_a_hub_stay_in_many_tasks(spark):
    x = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(3).alias("u"), (F.col("id") + 7).alias("v"))
    y = graph._with_least(x, "u", "v", 40_000)
    tasks = [r["n"] for r in y.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(tasks) == 40_000 and max(tasks) < 10_000  # nine of ten rows have one key
    assert y.where("u = 3 and m <> 3 or u <> 3 and m <> least(u, v)").isEmpty()
