"""Interval joins by bins: an equi-join on (chr, bin), so no side is broadcast and no nested loop is planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.regions import merge_intervals


def overlaps(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of closed intervals of a and b (id, chr, start, end) that overlap: a_id, b_id, chr, start, end of the overlap.

    Each interval goes to the bins it touches; a pair is kept in the first bin that both touch, so it comes once.
    """

    def binned(x: DataFrame, s: str) -> DataFrame:
        return x.select(F.col("id").alias(f"{s}_id"), "chr", F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bin"))

    j = binned(a, "a").join(binned(b, "b"), ["chr", "bin"]).where("a_start <= b_end and b_start <= a_end")
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return j.where(F.floor(start / width) == F.col("bin")).select("a_id", "b_id", "chr", start.alias("start"), end.alias("end"))


def annotate(regions: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    """id and the sorted distinct genes (symbol) that overlap, null without any."""
    hits = overlaps(regions, genes.withColumnRenamed("symbol", "id"), width)
    names = hits.groupBy(F.col("a_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(F.col("b_id").cast("string"))), ",").alias("genes"))
    return regions.select("id").join(names, "id", "left")


def background_counts(regions: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Points inside each region, at least 1 (points: id, chr, start, end)."""
    n = overlaps(regions, points, width).groupBy(F.col("a_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return regions.select("id").join(n, "id", "left").select("id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("long").alias("background"))


def assign_spans(regions: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Each region's span: midpoint inside first, then most overlap, then order (id)."""
    hit = overlaps(regions, spans, width)
    r = regions.select(F.col("id").alias("a_id"), F.floor((F.col("start") + F.col("end")) / 2).alias("middle"))
    s = spans.select(F.col("id").alias("b_id"), F.col("start").alias("s0"), F.col("end").alias("s1"))
    x = hit.join(r, "a_id").join(s, "b_id").withColumn("inside", F.col("middle").between(F.col("s0"), F.col("s1")))
    w = Window.partitionBy("a_id").orderBy(F.desc("inside"), F.desc(F.col("end") - F.col("start")), "b_id")
    return x.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("a_id").alias("id"), F.col("b_id").alias("span"))


def overlap_metrics(found: DataFrame, truth: DataFrame, width: int) -> DataFrame:
    """One row: region and base-pair precision, recall and Jaccard index of found against true intervals."""
    hit = overlaps(found, truth, width)
    u, v = merge_intervals(found), merge_intervals(truth)
    named = [x.withColumn("id", F.concat_ws(":", "chr", "start")) for x in (u, v)]
    both = overlaps(*named, width).agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("both"))
    size = lambda x, n: x.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias(n))
    one = found.agg(F.count(F.lit(1)).alias("n_found")).crossJoin(truth.agg(F.count(F.lit(1)).alias("n_truth"))).crossJoin(hit.agg(F.countDistinct("a_id").alias("tp"), F.countDistinct("b_id").alias("hit_truth")))
    one = one.crossJoin(both).crossJoin(size(u, "bp_found")).crossJoin(size(v, "bp_truth"))  # six tables of one row
    return one.select("tp", (F.col("tp") / F.col("n_found")).alias("prec"), (F.col("hit_truth") / F.col("n_truth")).alias("recall"), (F.col("both") / F.col("bp_found")).alias("bp_prec"), (F.col("both") / F.col("bp_truth")).alias("bp_recall"), (F.col("both") / (F.col("bp_found") + F.col("bp_truth") - F.col("both"))).alias("bp_jaccard"))
