"""Statistics of regions must not hang on the order in which sums were made."""

from strandline.operators import regions


def test_a_delta_of_nothing_has_no_vote(spark):
    rows = [(1, 0.5), (1, -0.25), (1, 0.1 + 0.2 - 0.3), (2, 0.5), (2, -0.25), (2, 0.3 - (0.1 + 0.2)), (3, 0.5), (3, 0.25), (3, -0.1), (4, 0.1), (4, None)]
    got = {r["region"]: r["delta_beta"] for r in regions.region_stats(spark.createDataFrame(rows, "region long, delta_beta double")).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.25, 4: None}
