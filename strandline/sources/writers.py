"""Sinks: matrices by position, region tables as text or Parquet, and the folder a viewer reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordering import natural_key


def write_matrix(cells: DataFrame, sites: DataFrame, path: str) -> None:
    """Long cells with positions as Parquet in a folder per chromosome, sorted by position, so that a region reads few row groups."""
    placed = cells.join(sites.select("site", "chr", "pos"), "site")
    placed.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos", "sample").write.partitionBy("chr").parquet(path)


def read_region(spark, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """Cells of a region from write_matrix: the folder and the row groups are pruned."""
    return spark.read.parquet(path).where((F.col("chr") == chrom) & F.col("pos").between(start, end))


def sort_wide(wide: DataFrame, site: str, sites: DataFrame) -> DataFrame:
    """A wide matrix in natural order of chromosome and position; unknown sites are an error."""
    if not wide.join(sites.select(F.col("site").alias(site)), site, "left_anti").isEmpty():
        raise ValueError("the matrix has sites without a position")
    place = sites.select(F.col("site").alias(site), natural_key(F.col("chr")).alias("k_"), F.col("pos").alias("p_"))
    return wide.join(place, site).orderBy("k_", "p_").select(*wide.columns)


def flat(df: DataFrame) -> DataFrame:
    """Lists joined by commas and other nested columns as JSON, so that text formats can hold them."""
    out = []
    for c, t in df.dtypes:
        if t.startswith("array<") and not t.startswith(("array<array", "array<struct", "array<map")):
            out.append(F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c))
        elif t.startswith(("array", "struct", "map")):
            out.append(F.to_json(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated text, compressed; an empty table leaves its header."""
    flat(df).write.options(sep="\t", header="true", compression="gzip").csv(path)


def member_values(regions: DataFrame, cells: DataFrame, samples: list[str]) -> DataFrame:
    """A row per member site of any region (sites: array) with a column per sample."""
    members = regions.select(F.explode("sites").alias("site")).distinct()
    return members.join(cells, "site", "left").groupBy("site").pivot("sample", samples).agg(F.max("beta"))


def write_viewer(folder: str, regions: DataFrame, values: DataFrame, edges: DataFrame, parts: DataFrame, meta: dict) -> None:
    """Regions, member values, motif edges and components, and a JSON description."""
    for name, df in (("regions", regions), ("values", values), ("edges", edges), ("components", parts)):
        df.write.parquet(f"{folder}/{name}")
    regions.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.text(f"{folder}/meta")


def read_viewer(spark, folder: str) -> dict:
    got = {n: spark.read.parquet(f"{folder}/{n}") for n in ("regions", "values", "edges", "components")}
    return got | {"meta": json.loads(spark.read.text(f"{folder}/meta").first()[0])}


def viewer_rows(regions: DataFrame, chrom: str | None = None, least_delta: float = 0.0, least_sites: int = 0) -> DataFrame:
    """The rows a viewer's filters leave."""
    x = regions.where((F.abs("delta_beta") >= least_delta) & (F.col("sites_num") >= least_sites))
    return x if chrom is None else x.where(F.col("chr") == chrom)
