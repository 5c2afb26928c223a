"""The tables behind the pictures: region structure, heat maps, Manhattan points and spans, links, chosen regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.intervals import assign_spans, overlaps
from strandline.operators.ordering import natural_key, top_k
from strandline.operators.regions import merge_intervals


def structure(region: DataFrame, sites: DataFrame, seeds: DataFrame, ratio: float = 0.2, least: int = 50, width: int = 100_000) -> DataFrame:
    """id, site, chr, pos, role (seed, member, outside) of the sites around each region, up to max(ratio * size, least) beyond it."""
    reach = F.greatest(F.ceil((F.col("end") - F.col("start") + 1) * ratio), F.lit(least))
    wide = region.select("id", "chr", (F.col("start") - reach).alias("start"), (F.col("end") + reach).alias("end"))
    points = sites.select(F.col("site").alias("id"), "chr", F.col("pos").alias("start"), F.col("pos").alias("end"))
    hit = overlaps(wide, points, width).select(F.col("a_id").alias("id"), F.col("b_id").alias("site"), F.col("start").alias("pos"))
    inner = region.select("id", "chr", F.col("start").alias("a"), F.col("end").alias("b"))
    marked = hit.join(inner, "id").join(seeds.select("site").distinct().withColumn("seed", F.lit(True)), "site", "left")
    inside = F.col("pos").between(F.col("a"), F.col("b"))
    return marked.select("id", "site", "chr", "pos", F.when(inside & F.col("seed"), "seed").when(inside, "member").otherwise("outside").alias("role"))


def heat_map(shape: DataFrame, cells: DataFrame, sheet: DataFrame, per_group: int = 10, seed: int = 42) -> DataFrame:
    """id, site, pos, role, sample, grp, beta; at most per_group samples of a group, chosen by a hash."""
    w = Window.partitionBy("grp").orderBy(F.xxhash64(F.lit(seed), "sample"), "sample")
    few = sheet.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_group).select("sample", "grp")
    return shape.join(cells, "site").join(F.broadcast(few), "sample").select("id", "site", "pos", "role", "sample", "grp", "beta")  # few: a bounded number of samples


def kind(promoter: Column, body: Column) -> Column:
    """Promoter, Gene Body or Intergenic; null where a region has both."""
    return F.when(promoter.isNotNull() & body.isNull(), "Promoter").when(body.isNotNull() & promoter.isNull(), "Gene Body").when(promoter.isNull() & body.isNull(), "Intergenic")


def spans(scope: DataFrame) -> DataFrame:
    """id, chr, start, end, offset of the merged scope intervals, side by side in natural order (a row per interval of a picture)."""
    w = Window.orderBy("key", "start")
    x = merge_intervals(scope).withColumn("key", natural_key(F.col("chr").cast("string")))
    before = F.sum(F.col("end") - F.col("start") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return x.select(F.row_number().over(w).cast("long").alias("id"), "chr", "start", "end", F.coalesce(before, F.lit(0)).alias("offset"))


def manhattan(found: DataFrame, scope: DataFrame, width: int = 100_000) -> DataFrame:
    """id, span, position (offset + midpoint within the span), score and kind; regions of both kinds or outside the scope go."""
    s = spans(scope)
    x = found.join(assign_spans(found, s, width), "id").join(s.select(F.col("id").alias("span"), F.col("start").alias("s0"), F.col("end").alias("s1"), "offset"), "span")
    middle = F.least(F.col("s1"), F.greatest(F.col("s0"), F.floor((F.col("start") + F.col("end")) / 2)))
    return x.withColumn("kind", kind(F.col("in_promoter_of"), F.col("in_gene_body_of"))).where("kind is not null").select("id", "span", (F.col("offset") + middle - F.col("s0")).alias("position"), "score", "kind")


def strongest(found: DataFrame, per_chromosome: int = 10) -> DataFrame:
    """The regions of each chromosome with the largest |delta|."""
    return top_k(found, "chr", [F.desc(F.abs("delta_beta")), F.col("start")], per_chromosome).drop("rk")


def chosen_links(links: DataFrame, parts: int = 30) -> DataFrame:
    """The links of at most `parts` components: those with a library match first, then by best score, then by number (links: component_id, matched, best, sim)."""
    c = links.groupBy("component_id").agg(F.max("matched").alias("m"), F.max("best").alias("b"))  # a row per component
    c = c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("m"), F.desc("b"), "component_id"))).where(F.col("place") <= parts)
    return links.join(c.select("component_id", "place"), "component_id").orderBy("place", F.desc("sim"))


def chosen_regions(candidates: list[dict], n: int = 6, per_chromosome: int = 2, apart: int = 5_000_000, flank: int = 1_000_000) -> list[dict]:
    """Regions for a picture from candidates (chr, start, end) in order of priority: one near a chosen region widens it, others are added up to the caps."""
    out: list[dict] = []
    for c in candidates:
        start, end = max(1, c["start"] - flank), c["end"] + flank
        near = next((r for r in out if r["chr"] == c["chr"] and start <= r["end"] + apart and end >= r["start"] - apart), None)
        if near:
            near["start"], near["end"] = min(near["start"], start), max(near["end"], end)
        elif len(out) < n and sum(r["chr"] == c["chr"] for r in out) < per_chromosome:
            out.append({"chr": c["chr"], "start": start, "end": end})
    return out


def candidates(found: DataFrame, group: str, limit: int = 200) -> DataFrame:
    """chr, start, end, size of each block or component (column `group`) within a chromosome, best mean |delta| first; at most `limit`, for chosen_regions."""
    x = found.where(F.col(group).isNotNull()).groupBy(group, "chr").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("size"), F.avg(F.abs("delta_beta")).alias("strength"))
    return x.orderBy(F.desc("strength"), F.desc("size"), group, "chr").limit(limit)
