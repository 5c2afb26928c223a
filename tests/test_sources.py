"""Readers, writers, sequences, motif graphs and plot tables on small tables."""

import pytest

from strandline import cli
from strandline.operators import graph
from strandline.plans import plotdata
from strandline.sources import readers, writers


def test_text_matrix_bed_and_seeds(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("site\tS1\tS2\nc1\t0.1\tNA\nc2\t0.3\t0.4\n")
    got = {(r["site"], r["sample"]): r["beta"] for r in readers.read_matrix(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {("c1", "S1"): 0.1, ("c1", "S2"): None, ("c2", "S1"): 0.3, ("c2", "S2"): 0.4}
    with pytest.raises(ValueError):
        readers.read_matrix(spark, str(tmp_path / "m.tsv"), ["S9"])
    (tmp_path / "b.bed").write_text("chrom\tstart\tS1\tS2\nchr7\t44999999\t0.5\t0.6\n")
    cells, sites = readers.read_bed(spark, str(tmp_path / "b.bed"), ["S1", "S2", "S3"])
    assert [tuple(r) for r in sites.collect()] == [("chr7:44999999", "chr7", 44999999, 45000000)]
    assert cells.count() == 2
    seeds = spark.createDataFrame([("7:44999999",)], "site string")
    assert [r["site"] for r in readers.match_seeds(seeds, sites).collect()] == ["chr7:44999999"]
    with pytest.raises(ValueError):
        readers.match_seeds(spark.createDataFrame([("x",)], "site string"), sites)
    (tmp_path / "s.tsv").write_text("Sample_ID\tSample_Group\nS1\tb\nS2\ta\nS3\tc\n")
    sheet = readers.read_samplesheet(spark, str(tmp_path / "s.tsv"), case=["b"], control=["a"])
    assert {(r["sample"], r["is_case"]) for r in sheet.collect()} == {("S1", True), ("S2", False)}
    writers.write_matrix(cells, sites, str(tmp_path / "out"))
    assert writers.read_region(spark, str(tmp_path / "out"), "chr7", 1, 45_000_000).count() == 2


def test_order_errors(spark):
    make = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, chr string, pos long")
    with pytest.raises(ValueError, match="not sorted within chromosome chr1"):
        readers.check_order(make([("chr1", 100), ("chr1", 300), ("chr1", 200)]), "n")
    with pytest.raises(ValueError, match="chr1 appears in multiple blocks"):
        readers.check_order(make([("chr1", 1), ("chr2", 1), ("chr1", 2)]), "n")
    readers.check_order(make([("chr1", 1), ("chr1", 2), ("chr2", 1)]), "n")


def test_sequences(spark):
    tiles = spark.createDataFrame([("c", 1, "ACGTA"), ("c", 6, "CGTAC"), ("c", 11, "GT")], "chr string, tile_start long, seq string")
    regions = spark.createDataFrame([(1, "c", 4, 7), (2, "c", 1, 2), (3, "c", 11, 12)], "id long, chr string, start long, end long")
    got = {r["id"]: r["seq"] for r in readers.sequences(regions, tiles, 5, 2, 3).collect()}
    assert got == {1: "CGTACGTAC", 2: "NNACGTA", 3: "ACGTNNN"}


def test_similarity_and_components(spark):
    a, t, flat = ([[1.0, 0.0, 0.0, 0.0]] * 12, [[0.0, 0.0, 0.0, 1.0]] * 12, [[0.25] * 4] * 12)
    rows = [(i, p) for i, p in enumerate([a, a, a, t, t, flat, [[1.0, 0.0, 0.0, 0.0]] * 3], 1)]
    x = spark.createDataFrame(rows, "id long, pwm array<array<double>>")
    pairs = graph.similar_pairs(x.select("id", graph.motif_vector(x["pwm"]).alias("vec")), 0.8)
    assert sorted((r["id1"], r["id2"]) for r in pairs.collect()) == [(1, 2), (1, 3), (2, 3), (4, 5)]
    found = {r["id"]: r["component_id"] for r in graph.numbered_components(pairs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2}
    lib = spark.createDataFrame([("M1", "one", a), ("M2", "two", flat)], "motif_id string, motif_name string, pwm array<array<double>>")
    hits = {r["id"]: r["motif_id"] for r in graph.library_matches(x.where("id < 6"), lib).collect()}
    assert hits == {1: "M1", 2: "M1", 3: "M1", 4: "M1", 5: "M1"}  # T is A on the other strand


def test_plot_tables_and_options(spark):
    picked = plotdata.chosen_regions([{"chr": c, "start": s, "end": s + 10} for c, s in (("a", 100), ("a", 200), ("a", 10**8), ("a", 10**9), ("b", 5))], n=3, per_chromosome=2, apart=1000, flank=10)
    assert [(r["chr"], r["start"], r["end"]) for r in picked] == [("a", 90, 220), ("a", 10**8 - 10, 10**8 + 20), ("b", 1, 25)]
    scope = spark.createDataFrame([("chr2", 1, 100), ("chr10", 1, 50)], "chr string, start long, end long")
    assert [(r["chr"], r["offset"]) for r in plotdata.spans(scope).orderBy("id").collect()] == [("chr2", 0), ("chr10", 100)]
    o = cli.options_of(cli.parser().parse_args(["--beta", "b", "--seeds", "s", "--samplesheet", "p", "--output", "o", "--ext_site_delta_beta", "-1", "--max_lookup_dist", "500"]))
    assert o.rescue_delta is None and o.max_distance == 500 and o.min_sites == 50
