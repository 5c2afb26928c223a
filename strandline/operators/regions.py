"""Runs, windows, expansion, merging and statistics of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(edge: DataFrame) -> DataFrame:
    """Adds `run`: sites joined by connected edges share one within their chromosome."""
    w = Window.partitionBy("chr").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return edge.withColumn("run", F.coalesce(F.sum(F.when(F.col("connected"), 0).otherwise(1)).over(w), F.lit(0)).cast("long"))


def runs(edge: DataFrame, min_seeds: int = 2) -> DataFrame:
    """chr, run, first and last site and position, seeds_num and mean p of connected edges of each run."""
    found = islands(edge).groupBy("chr", "run").agg(
        F.min_by("site", "pos").alias("start_seed"), F.max_by("site", "pos").alias("end_seed"), F.min("pos").alias("start"), F.max("pos").alias("end"),
        F.count(F.lit(1)).alias("seeds_num"), F.avg(F.when(F.col("connected"), F.col("pval"))).alias("connection_corr_pval"),
    )
    return found.where(F.col("seeds_num") >= min_seeds)


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Union of closed intervals (chr, start, end) per chromosome; touching ones (next start = end + 1) merge.

    Reversed ends are swapped.  Returns chr, start, end, merged.
    """
    x = intervals.select("chr", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))
    w = Window.partitionBy("chr").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("reach", F.max("end").over(w))
    x = x.withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1), 1).otherwise(0))
    x = x.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("merged")).drop("island")


def boundaries(edge: DataFrame) -> DataFrame:
    """Adds site_idx, and prev_failed / next_failed: nearest failed edge at or before, at or after each site (null: none)."""
    w = Window.partitionBy("chr").orderBy("pos")
    failed = F.when(~F.col("connected"), F.col("site_idx"))
    x = edge.withColumn("site_idx", F.row_number().over(w).cast("long"))
    return x.withColumn("prev_failed", F.last(failed, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_failed", F.first(failed, True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def expand(run: DataFrame, site_edges: DataFrame) -> DataFrame:
    """Runs grown over all neighbouring connected sites: start_idx, end_idx and positions after expansion.

    Windows give every site the ends of its own stretch, so a run needs just the rows of its first and last seed.
    """
    w = Window.partitionBy("chr").orderBy("pos")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = site_edges.select("chr", "site", "pos", "connected", F.row_number().over(w).cast("long").alias("idx"), F.lag("connected").over(w).alias("joined"))
    here = F.struct(F.col("idx"), F.col("pos"))
    x = x.select("chr", "site", F.last(F.when(~F.coalesce("joined", F.lit(False)), here), True).over(back).alias("a"), F.first(F.when(~F.col("connected"), here), True).over(ahead).alias("b"))
    first = x.select("chr", F.col("site").alias("start_seed"), F.col("a.idx").alias("start_idx"), F.col("a.pos").alias("start_pos"))
    last = x.select("chr", F.col("site").alias("end_seed"), F.col("b.idx").alias("end_idx"), F.col("b.pos").alias("end_pos"))
    return run.join(first, ["chr", "start_seed"]).join(last, ["chr", "end_seed"]).withColumn("sites_num", F.col("end_idx") - F.col("start_idx") + 1)


def site_stats(cells: DataFrame) -> DataFrame:
    """Per site: mean, sd and count of cases and controls, and their difference (cells: site, beta, is_case)."""
    case, control = F.when(F.col("is_case"), F.col("beta")), F.when(~F.col("is_case"), F.col("beta"))
    return cells.groupBy("site").agg(
        F.avg(case).alias("cases_beta"), F.avg(control).alias("controls_beta"), F.stddev_samp(case).alias("cases_sd"), F.stddev_samp(control).alias("controls_sd"),
        F.count(case).alias("cases_num"), F.count(control).alias("controls_num"),
    ).withColumn("delta_beta", F.col("cases_beta") - F.col("controls_beta"))


def region_stats(members: DataFrame) -> DataFrame:
    """Per region: median |delta| with the sign of the majority; null if a member has none (members: region, delta_beta).

    A delta below 1e-12 has no vote: it is what is left of a sum that is 0, and its sign depends on the order of the terms.
    """
    d = F.col("delta_beta")
    agg = members.groupBy("region").agg(F.median(F.abs(d)).alias("size"), F.sum(F.when(F.abs(d) < 1e-12, 0.0).otherwise(F.signum(d))).alias("vote"), F.count(F.lit(1)).alias("sites_num"), F.count(d).alias("known"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"))
    return agg.select("region", F.when(F.col("known") == F.col("sites_num"), F.col("size") * F.signum("vote")).alias("delta_beta"), "sites_num", "min_delta", "max_delta")
