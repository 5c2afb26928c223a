"""The search and its options on small fixtures with known results."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.plans.finder import Options, annotated, find_regions, marker_test, ordered, scored, with_members

SHEET = [(f"S{i}", "A" if i < 4 else "B", i > 3) for i in range(1, 7)]


def tables(spark, rows, places):
    cells = [(s, f"S{i + 1}", v) for s, row in rows.items() for i, v in enumerate(row)]
    c = spark.createDataFrame(cells, "site string, sample string, beta double")
    s = spark.createDataFrame([(k, *p) for k, p in places.items()], "site string, chr string, pos long")
    return c, s, spark.createDataFrame([(k,) for k in rows], "site string"), spark.createDataFrame(SHEET, "sample string, grp string, is_case boolean")


UP = {"cgA": [0.10, 0.20, 0.30, 0.15, 0.25, 0.35], "cgB": [0.11, 0.21, 0.31, 0.14, 0.24, 0.34]}
LOOSE = Options(max_pval=0.05, rescue_delta=None, max_distance=1000, min_sites=2, bridge_sites=0)


def test_no_bridge_between_chromosomes(spark):
    rows = UP | {"cgC": [0.60, 0.50, 0.40, 0.65, 0.55, 0.45], "cgD": [0.59, 0.49, 0.39, 0.66, 0.56, 0.46]}
    t = tables(spark, rows, {"cgA": ("chr1", 100), "cgB": ("chr1", 200), "cgC": ("chr2", 100), "cgD": ("chr2", 200)})
    got = find_regions(*t, LOOSE).collect()
    assert {(r["chr"], r["start_seed"], r["end_seed"]) for r in got} == {("chr1", "cgA", "cgB"), ("chr2", "cgC", "cgD")}


def test_last_seed_is_kept_with_statistics(spark):
    rows = UP | {"cgC": [0.12, 0.22, 0.32, 0.13, 0.23, 0.33]}
    t = tables(spark, rows, {"cgA": ("chr1", 100), "cgB": ("chr1", 200), "cgC": ("chr1", 300)})
    (r,) = find_regions(*t, LOOSE).collect()
    assert (r["id"], r["seeds_num"], r["sites_num"], r["start_seed"], r["end_seed"]) == ("chr1:100-300", 3, 3, "cgA", "cgC")
    assert r["delta_beta"] == pytest.approx(0.03)
    assert r["sites_cases_beta_min"] == pytest.approx(0.23)


def test_members_and_order(spark):
    from strandline.sources import writers

    rows = {f"{c}_{k}": [x + 0.01 * k for x in UP["cgA"]] for c in ("chr10", "chr2") for k in (3, 1, 2)}
    t = tables(spark, rows, {n: (n.split("_")[0], 100 * int(n[-1])) for n in rows})
    seeds = t[2].where(~F.col("site").endswith("2"))
    found = find_regions(t[0], t[1], seeds, t[3], LOOSE)
    listed = ordered(with_members(found, t[1], seeds.unionByName(seeds)))
    got = [(r["chr"], r["seeds"], r["sites"]) for r in listed.collect()]
    assert got == [(c, [f"{c}_1", f"{c}_3"], [f"{c}_1", f"{c}_2", f"{c}_3"]) for c in ("chr2", "chr10")]
    values = {r["site"]: r["S1"] for r in writers.member_values(listed, t[0], ["S1"]).collect()}
    assert values == {n: pytest.approx(v[0]) for n, v in rows.items()}
    assert with_members(found.limit(0), t[1], seeds).count() == 0


def test_rescue_by_delta(spark):
    rows = {"s1": [0.10, 0.85, 0.40, 0.20, 0.75, 0.35], "s2": [0.80, 0.20, 0.60, 0.70, 0.10, 0.90]}
    t = tables(spark, rows, {"s1": ("chr1", 100), "s2": ("chr1", 200)})
    assert find_regions(*t, LOOSE).count() == 0
    kept = Options(max_pval=0.05, rescue_delta=0.0, max_distance=1000, min_sites=2)
    assert find_regions(*t, kept).count() == 1
    assert find_regions(*t, Options(rescue_delta=0.0, max_distance=50, min_sites=2, bridge_seeds=0)).count() == 0


def test_empty_and_too_few_samples(spark):
    t = tables(spark, UP, {"cgA": ("chr1", 100), "cgB": ("chr1", 200)})
    assert find_regions(t[0].limit(0), t[1].limit(0), t[2].limit(0), t[3], LOOSE).count() == 0
    with pytest.raises(ValueError):
        find_regions(*t, Options(ignored=["A", "B"]))


def test_background_genes_and_covariates(spark):
    t = tables(spark, UP, {"cgA": ("chr1", 100), "cgB": ("chr1", 200)})
    points = spark.createDataFrame([(i, "chr1", 90 + i * 20, 90 + i * 20) for i in range(8)], "id long, chr string, start long, end long")
    found = find_regions(*t, LOOSE, background=points)
    assert [(r["background"], r["seeds_num_adj"]) for r in found.collect()] == [(5, 1)]
    genes = spark.createDataFrame([("G1", "chr1", 150, 900, "+"), ("G2", "chr1", 5000, 6000, "+")], "symbol string, chr string, start long, end long, strand string")
    (r,) = annotated(found, genes).collect()
    assert (r["in_promoter_of"], r["in_gene_body_of"]) == ("G1", "G1")
    sheet = t[3].withColumn("age", F.substring("sample", 2, 1).cast("int"))
    assert find_regions(t[0], t[1], t[2], sheet, Options(rescue_delta=None, min_sites=2, covariates=["age"])).count() in (0, 1)


def test_marker_test_and_scores(spark):
    rows = {f"c{i}": [0.1 + 0.01 * i, 0.12, 0.11, 0.8, 0.82, 0.81 + 0.01 * i] for i in range(4)} | {"z": [0.5, 0.4, 0.6, 0.5, 0.41, 0.6]}
    t = tables(spark, rows, {k: ("chr1", 100 * (i + 1)) for i, k in enumerate(rows)})
    got = {r["site"]: r for r in marker_test(t[0], t[1], t[3]).collect()}
    assert set(got) == {"c0", "c1", "c2", "c3"} and all(0 <= r["score"] <= 1 for r in got.values())
    found = find_regions(*t, Options(max_pval=1.0, min_sites=2, bridge_seeds=0, bridge_sites=0))
    (r,) = scored(found, t[0], t[1], t[3], folds=3).collect()
    assert r["cv_accuracy"] == 1.0 and 0.5 < r["score"] <= 1


def brute_bridge(connected, spans, last, most):
    """Connected edges after every allowance's passes have come to rest; spans: by gap, whether the pair (i, i + gap) passes."""
    now = list(connected)
    n = len(now)
    for allowed in range(1, most + 1):
        changed = True
        while changed:
            changed = False
            for gap in range(1, allowed + 1):
                for side in ("begin", "end"):
                    add = set()
                    for i in range(n):
                        if side == "begin":
                            s = i + gap
                            hit = s < n and now[s] and not now[s - 1] and not any(last[i:s]) and spans[gap][i]
                        else:
                            hit = i > 0 and now[i - 1] and not last[i - 1] and not now[i] and spans[gap][i] and i + gap <= n and not any(last[i : i + gap])
                        if hit:
                            add |= set(range(i, i + gap))
                    changed |= any(not now[i] for i in add)
                    now = [c or i in add for i, c in enumerate(now)]
    return now


def test_bridges_go_where_the_pair_across_the_gap_passes(spark):
    from strandline.operators import connect

    r = random.Random(12)
    rows = [(k, f"chr{k // 45}", 100 * k) for k in range(90)]
    base = [r.random() for _ in range(7)]
    cells = [(k, s, min(0.99, max(0.01, (base[s] if k % 3 else r.random()) + r.gauss(0, 0.05)))) for k, _, _ in rows for s in range(7)]
    packed = connect.pack(spark.createDataFrame(cells, "site long, sample long, beta double"), spark.createDataFrame(rows, "site long, chr string, pos long"), list(range(7)))
    test = connect.Test(0.05, "weak", 250)
    steps = {k: connect.edges(packed, {"A": [0, 1, 2, 3], "B": [4, 5, 6]}, "B", "A", test, None, k) for k in (1, 2, 3)}
    held = {k: sorted((x["site"], x["connected"], x["next_site"] is None) for x in e.collect()) for k, e in steps.items()}
    for most in (1, 2, 3):
        want = brute_bridge([c for _, c, _ in held[1]], {k: [c for _, c, _ in held[k]] for k in held}, [e for _, _, e in held[1]], most)
        got = {x["site"]: x for x in connect.bridge(steps[1], {k: steps[k] for k in range(1, most + 1)}).collect()}
        assert [got[k]["connected"] for k in range(90)] == want
        assert (sum(want) > sum(c for _, c, _ in held[1])) == (most > 1)
        assert all(not x["connected"] for x in got.values() if x["reason"] in ("end-of-input", "exceeded max distance"))


def test_a_failed_edge_beside_a_run_is_asked_again(spark):
    """The six equal sites of the bridge fixture; only the first edge is connected to begin with."""
    from strandline.operators import connect

    rows = [(k, "chr1", 100 * k) for k in range(1, 7)]
    packed = connect.pack(spark.createDataFrame([(k, s, (s + 1) / 10) for k, _, _ in rows for s in range(6)], "site long, sample long, beta double"), spark.createDataFrame(rows, "site long, chr string, pos long"), list(range(6)))
    asked = connect.edges(packed, {"A": [0, 1, 2], "B": [3, 4, 5]}, "B", "A", connect.Test(0.05, "strong", 1000))
    begun = asked.withColumn("connected", F.col("site") == 1).withColumn("reason", F.when(F.col("site") == 1, "").when(F.col("site") == 6, "end-of-input").otherwise("pval>max_pval"))
    got = {x["site"]: x["connected"] for x in connect.bridge(begun, {1: asked}).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False}


def test_the_median_rescues_what_the_mean_does_not(spark):
    from strandline.operators import connect

    rows = [(1, "chr1", 100), (2, "chr1", 200)]
    values = [0.1, 0.1, 0.9, 0.5, 0.5, 0.5]  # means are 0.13 apart, medians 0.4
    packed = connect.pack(spark.createDataFrame([(k, s, v) for k, _, _ in rows for s, v in enumerate(values)], "site long, sample long, beta double"), spark.createDataFrame(rows, "site long, chr string, pos long"), list(range(6)))
    for statistic, hit in (("mean", False), ("median", True)):
        e = connect.edges(packed, {"A": [0, 1, 2], "B": [3, 4, 5]}, "B", "A", connect.Test(1e-9, "strong", 1000, 0.3, statistic)).where("site = 1").first()
        assert (e["reason"] == "abs(delta_beta)>=force_connect_delta_beta") == hit
