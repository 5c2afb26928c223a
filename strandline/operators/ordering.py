"""Ordered and ranked operators: natural chromosome order, region strings, gaps, folds, top k, false discovery rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.stats import quantile8


def natural_key(chrom: Column) -> Column:
    """Sort key: numbers first, then X, Y, M, MT, then other names."""
    name = F.regexp_replace(chrom, "^chr", "")
    number = F.when(name.rlike("^[0-9]+$"), name.cast("int"))
    special = F.when(name == "X", 1).when(name == "Y", 2).when(name == "M", 3).when(name == "MT", 4)
    return F.struct(number.isNull().alias("a"), F.coalesce(number, F.lit(0)).alias("b"), F.coalesce(special, F.lit(9)).alias("c"), name.alias("d"))


def coordinate(text: Column) -> Column:
    """A coordinate with an optional suffix k, m or g (and b)."""
    number = F.regexp_extract(text, r"(?i)^\s*([0-9.]+)\s*([kmg]?)b?\s*$", 1).cast("double")
    unit = F.lower(F.regexp_extract(text, r"(?i)^\s*([0-9.]+)\s*([kmg]?)b?\s*$", 2))
    return F.floor(number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)).cast("long")


def parse_region(text: Column) -> Column:
    """chr, start and end of a region string chr:start-end."""
    part = lambda k: F.regexp_extract(text, r"^([^:]+):([^-]+)-(.+)$", k)
    return F.struct(part(1).alias("chr"), coordinate(part(2)).alias("start"), coordinate(part(3)).alias("end"))


def clusters_by_gap(df: DataFrame, key: str, at: str, max_gap: float) -> DataFrame:
    """Adds `cluster`, counted from 0 within key: a gap of more than max_gap starts a new one."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) > max_gap, 1).otherwise(0)
    return df.withColumn("new", new).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("new")


def gap_threshold(gaps: DataFrame, key: str, gap: str, quantile: float = 0.95, factor: float = 1.5, low: float = 2500, high: float = 50000) -> DataFrame:
    """Per key the clamped quantile (type 8) of its gaps times a factor."""
    q = gaps.groupBy(key).agg(F.sort_array(F.collect_list(F.col(gap).cast("double"))).alias("g"))
    return q.select(key, F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), quantile8(F.col("g"), quantile) * factor)).alias("threshold"))


def benjamini_hochberg(df: DataFrame, key: str, p: str, tie: str) -> DataFrame:
    """Adds `fdr` within key."""
    up = Window.partitionBy(key).orderBy(p, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    x = df.withColumn("q", F.col(p) * n / F.row_number().over(up))
    down = Window.partitionBy(key).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("fdr", F.least(F.lit(1.0), F.min("q").over(down))).drop("q")


def top_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rk") <= k)


def stratified_folds(df: DataFrame, label: str, order: list[Column], k: int) -> DataFrame:
    """Adds `fold` 0..k-1, even within each label."""
    return df.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy(label).orderBy(*order)) - 1, F.lit(k)).cast("long"))
