"""Command line: python -m strandline.cli --beta B --seeds S --samplesheet P --locations L --output O [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.plans.finder import Options, find_regions, ordered, with_members
from strandline.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description="Finds regions of connected sites from seeds.")
    for name, text in (("beta", "matrix: tab-separated text or a .parquet folder"), ("seeds", "table of seeds"), ("samplesheet", "table of samples"), ("output", "folder for the regions")):
        p.add_argument(f"--{name}", required=True, help=text)
    p.add_argument("--locations", help="table site, chr, pos; not needed for BED input")
    p.add_argument("--bed", action="store_true", help="the matrix is BED-like")
    p.add_argument("--bed_chrom_col", default="#chrom")
    p.add_argument("--bed_start_col", default="start")
    p.add_argument("--seeds_id_col")
    p.add_argument("--samplesheet_sep", default="\t")
    p.add_argument("--target_col", default="Sample_ID")
    p.add_argument("--sample_group_col", default="Sample_Group")
    p.add_argument("--case_groups", type=lambda t: t.split(","))
    p.add_argument("--control_groups", type=lambda t: t.split(","))
    p.add_argument("--ignored_sample_groups", type=lambda t: t.split(","), default=[])
    p.add_argument("--covariates", type=lambda t: t.split(","), default=[])
    p.add_argument("--max_pval", type=float, default=0.05)
    p.add_argument("--entanglement", choices=("strong", "weak"), default="strong")
    p.add_argument("--ext_site_delta_beta", type=float, default=0.2, help="negative: no rescue")
    p.add_argument("--max_lookup_dist", type=int, default=10_000)
    p.add_argument("--max_bridge_seeds_gaps", type=int, default=1)
    p.add_argument("--max_bridge_extension_gaps", type=int, default=1)
    p.add_argument("--min_seeds", type=int, default=2)
    p.add_argument("--min_adj_seeds", type=int, default=2, help="takes effect with --background")
    p.add_argument("--background", help="table id, chr, start, end of points for the adjusted number of seeds")
    p.add_argument("--min_sites", type=int, default=50)
    p.add_argument("--aggfun", choices=("median", "mean"), default="median")
    return p


def options_of(a: argparse.Namespace) -> Options:
    rescue = None if a.ext_site_delta_beta < 0 else a.ext_site_delta_beta
    return Options(a.max_pval, a.entanglement, rescue, a.max_lookup_dist, a.max_bridge_seeds_gaps, a.max_bridge_extension_gaps, a.min_seeds, a.min_adj_seeds, a.min_sites, a.aggfun, a.covariates, a.ignored_sample_groups)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    sheet = readers.read_samplesheet(spark, a.samplesheet, a.samplesheet_sep, a.target_col, a.sample_group_col, a.case_groups, a.control_groups)
    samples = [r["sample"] for r in sheet.select("sample").orderBy("sample").collect()]  # a row per sample
    if a.bed:
        cells, sites = readers.read_bed(spark, a.beta, samples, a.bed_chrom_col, a.bed_start_col)
    elif a.locations:
        cells = readers.read_matrix(spark, a.beta, samples)
        sites = spark.read.options(**readers.TABULAR).csv(a.locations).select("site", "chr", F.expr("try_cast(pos as bigint)").alias("pos"))
    else:
        raise SystemExit("--locations is needed unless --bed is given")
    seeds = readers.match_seeds(readers.read_seeds(spark, a.seeds, a.seeds_id_col).select("site"), sites)
    points = None
    if a.background:
        points = spark.read.options(**readers.TABULAR).csv(a.background).select("id", "chr", *(F.expr(f"try_cast({c} as bigint)").alias(c) for c in ("start", "end")))
    found = find_regions(cells, sites, seeds, sheet, options_of(a), points)
    writers.write_table(ordered(with_members(found, sites, seeds)), a.output)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    run(SparkSession.builder.appName("strandline").getOrCreate(), a)


if __name__ == "__main__":
    main()
