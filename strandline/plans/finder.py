"""The whole search: seeds are joined to runs, runs grow over all sites, overlapping ones merge, and regions get their statistics.

One lazy plan over all chromosomes. The sample sheet (a row per sample) is the only
table read by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import connect, intervals, ordering, regions, scoring
from strandline.operators.lineage import checkpointed


@dataclass(frozen=True)
class Options:
    max_pval: float = 0.05
    mode: str = "strong"
    rescue_delta: float | None = 0.2
    max_distance: int = 10_000
    bridge_seeds: int = 1
    bridge_sites: int = 1
    min_seeds: int = 2
    min_adjusted: int = 2
    min_sites: int = 3
    statistic: str = "median"
    covariates: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.mode not in ("strong", "weak") or self.statistic not in ("median", "mean"):
            raise ValueError("mode is strong or weak, statistic median or mean")
        if self.rescue_delta is not None and not 0 <= self.rescue_delta <= 1:
            raise ValueError("rescue_delta lies in [0, 1]")


def _taking_part(sheet: list[dict], ignored: list[str]) -> list[dict]:
    left = [r for r in sheet if r["grp"] not in ignored and not (r["is_case"] and "case" in ignored) and not (not r["is_case"] and "control" in ignored)]
    if len(left) < 2:
        raise ValueError("fewer than two samples remain")
    return left


def find_regions(cells: DataFrame, sites: DataFrame, seeds: DataFrame, sheet: DataFrame, options: Options | None = None, background: DataFrame | None = None, width: int = 100_000) -> DataFrame:
    """Regions with their seeds, sites, reasons and statistics.

    cells: site, sample, beta; sites: site, chr, pos; seeds: site; sheet: sample, grp,
    is_case and covariates; background: id, chr, start, end of points for the adjusted
    number of seeds. Nothing found gives no rows. Rows have no order (see `ordered`); members are listed by `with_members`.
    """
    o = options or Options()
    rows = _taking_part([r.asDict() for r in sheet.orderBy("sample").collect()], o.ignored)
    samples = [r["sample"] for r in rows]
    groups = {g: [i for i, r in enumerate(rows) if r["grp"] == g] for g in sorted({r["grp"] for r in rows})}
    case, control = ([i for i, r in enumerate(rows) if r["is_case"] is side] for side in (True, False))
    basis = connect.design_basis(rows, o.covariates) if o.covariates else None
    rescue = o.rescue_delta if case and control else None
    test = connect.Test(o.max_pval, o.mode, o.max_distance, rescue, o.statistic)
    place = sites.select("site", "chr", "pos")
    if seeds.join(place, "site", "left_semi").isEmpty() and not seeds.isEmpty():
        raise ValueError("no seed is among the sites")
    packed = connect.pack(cells, place, samples)
    seed_sites = seeds.select("site").distinct()

    def edge(x: DataFrame, gap: int) -> DataFrame:
        steps = {k: connect.edges(x, groups, case, control, test, basis, k) for k in range(1, max(gap, 1) + 1)}
        return connect.bridge(steps[1], steps) if gap > 1 else steps[1]  # a gap of 1 asks the pair that failed, with the same answer

    seed_edges = edge(packed.join(seed_sites, "site", "left_semi"), o.bridge_seeds)
    run = regions.islands(seed_edges).groupBy("chr", "run").agg(
        F.min_by("site", "pos").alias("start_seed"), F.max_by("site", "pos").alias("end_seed"), F.min("pos").alias("start_seed_pos"), F.max("pos").alias("end_seed_pos"),
        F.count(F.lit(1)).alias("seeds_num"), F.avg(F.when(F.col("connected"), F.col("pval"))).alias("connection_corr_pval"), F.max_by("reason", "pos").alias("stop_connection_reason"),
    ).where(F.col("seeds_num") >= o.min_seeds)
    grown = regions.expand(run, edge(packed, o.bridge_sites))
    w = Window.partitionBy("chr").orderBy("start_pos", "end_pos")  # overlapping or touching positions merge
    new = F.when(F.coalesce(F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1 < F.col("start_pos"), F.lit(True)), 1).otherwise(0)
    island = grown.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = F.median("connection_corr_pval") if o.statistic == "median" else F.avg("connection_corr_pval")
    merged = island.groupBy("chr", "island").agg(
        F.min("start_pos").alias("start"), F.max("end_pos").alias("end"), F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"),
        F.min_by("start_seed", "start_seed_pos").alias("start_seed"), F.max_by("end_seed", "end_seed_pos").alias("end_seed"), F.min("start_seed_pos").alias("start_seed_pos"), F.max("end_seed_pos").alias("end_seed_pos"),
        F.sum("seeds_num").alias("seeds_num"), p.alias("connection_corr_pval"), F.count(F.lit(1)).alias("merged_num"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_idx", "stop_connection_reason"))), lambda x: x["stop_connection_reason"]), ",").alias("stop_connection_reason"),
    )
    merged = checkpointed(merged).withColumn("sites_num", F.col("end_idx") - F.col("start_idx") + 1).where((F.col("sites_num") >= o.min_sites) & (F.col("seeds_num") >= o.min_seeds))
    merged = merged.withColumn("id", F.concat(F.col("chr").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    if background is not None:
        merged = merged.join(intervals.background_counts(merged, background, width), "id")
        merged = merged.withColumn("seeds_num_adj", F.ceil(F.col("sites_num") / F.col("background") * F.col("seeds_num")))
        if o.min_adjusted > o.min_seeds:
            merged = merged.where(F.col("seeds_num_adj") >= o.min_adjusted)
    return merged.join(region_values(merged, cells, place, seed_sites, sheet, o.statistic, width), "id", "left").drop("island", "start_idx", "end_idx")


def members(found: DataFrame, place: DataFrame, width: int) -> DataFrame:
    """id and site of every site inside a region."""
    points = place.select(F.col("site").alias("id"), "chr", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return intervals.overlaps(found, points, width).select(F.col("a_id").alias("id"), F.col("b_id").alias("site"))


def with_members(found: DataFrame, sites: DataFrame, seeds: DataFrame, width: int = 100_000) -> DataFrame:
    """found with arrays `seeds` and `sites` of each region's members by position (ties by name); a row holds a whole region."""
    place = sites.select("site", "chr", "pos")
    x = members(found, place, width).join(place.select("site", "pos"), "site").join(seeds.select("site").distinct().withColumn("is_seed", F.lit(True)), "site", "left")
    at = F.struct("pos", "site")
    listed = lambda v: F.transform(F.sort_array(F.collect_list(v)), lambda m: m["site"])
    return found.join(x.groupBy("id").agg(listed(F.when(F.col("is_seed"), at)).alias("seeds"), listed(at).alias("sites")), "id", "left")


def ordered(found: DataFrame) -> DataFrame:
    """Regions by natural order of chromosomes, then position."""
    return found.orderBy(ordering.natural_key(F.col("chr").cast("string")), "start", "end")


def region_values(found: DataFrame, cells: DataFrame, place: DataFrame, seed_sites: DataFrame, sheet: DataFrame, statistic: str, width: int) -> DataFrame:
    """Case and control statistics per region over its seeds and (prefix sites_) over all its sites; a member without a mean nulls the means."""
    known = cells.join(F.broadcast(sheet.select("sample", "is_case")), "sample")  # a row per sample
    mid = F.median if statistic == "median" else F.avg
    case, control = F.when(F.col("is_case"), F.col("beta")), F.when(~F.col("is_case"), F.col("beta"))
    m = members(found, place, width)
    per_site = known.join(m.select("site").distinct(), "site", "left_semi").groupBy("site").agg(
        mid(case).alias("cases_beta"), mid(control).alias("controls_beta"), F.stddev_samp(case).alias("cases_beta_sd"), F.stddev_samp(control).alias("controls_beta_sd"),
    ).withColumn("delta_beta", F.col("cases_beta") - F.col("controls_beta"))
    x = m.join(per_site, "site", "left").join(seed_sites.withColumn("is_seed", F.lit(True)), "site", "left")
    out = []
    for prefix, inside in (("", F.col("is_seed")), ("sites_", F.lit(True))):
        for c in ("cases_beta", "controls_beta", "delta_beta"):
            v = F.when(inside, F.col(c))
            whole = F.count(v) == F.count(F.when(inside, F.lit(1)))
            out.append(F.when(whole, mid(F.abs(v)) * F.signum(F.sum(F.signum(v)))).alias(prefix + c))
        out += [mid(F.when(inside, F.col(f"{c}_beta_sd"))).alias(f"{prefix}{c}_beta_sd") for c in ("cases", "controls")]
        out += [f(F.when(inside, F.col(f"{c}_beta"))).alias(f"{prefix}{c}_beta_{n}") for c in ("cases", "controls") for n, f in (("min", F.min), ("max", F.max))]
    return x.groupBy("id").agg(*out)


def scored(found: DataFrame, cells: DataFrame, sites: DataFrame, sheet: DataFrame, folds: int = 5, gap: scoring.Gap | None = None, width: int = 100_000) -> DataFrame:
    """found with score, cv_accuracy, smoothed score, segment and block; a class smaller than the number of folds is an error."""
    from strandline.functions.stats import m_value

    small = sheet.groupBy("is_case").count().agg(F.min("count"), F.count(F.lit(1))).first()
    if small[1] < 2 or small[0] < folds:
        raise ValueError("scoring needs two classes with at least as many samples as folds")
    dealt = ordering.stratified_folds(sheet.select("sample", "is_case"), "is_case", [F.xxhash64("sample"), F.col("sample")], folds)
    x = members(found, sites.select("site", "chr", "pos"), width).join(cells, "site").join(F.broadcast(dealt), "sample")
    rows = x.select(F.col("id").alias("region"), "site", "sample", m_value(F.col("beta")).alias("value"), "is_case", "fold")
    with_score = found.join(scoring.score_regions(rows).withColumnRenamed("region", "id"), "id", "left")
    return with_score.join(scoring.blocks(with_score.select("id", "chr", "start", "end", "score"), gap).drop("chr", "midpoint", "score"), "id", "left")


def annotated(found: DataFrame, genes: DataFrame, upstream: int = 2000, downstream: int = 200, width: int = 100_000) -> DataFrame:
    """found with in_promoter_of and in_gene_body_of (genes: symbol, chr, start, end, strand)."""
    first = F.when(F.col("strand") == "-", F.col("end") - downstream + 1).otherwise(F.col("start") - upstream)
    last = F.when(F.col("strand") == "-", F.col("end") + upstream).otherwise(F.col("start") + downstream - 1)
    promoters = genes.select("symbol", "chr", F.greatest(first, F.lit(1)).alias("start"), last.alias("end"))
    out = found
    for name, table in (("in_promoter_of", promoters), ("in_gene_body_of", genes.select("symbol", "chr", "start", "end"))):
        out = out.join(intervals.annotate(found, table, width).withColumnRenamed("genes", name), "id", "left")
    return out


def marker_test(cells: DataFrame, sites: DataFrame, sheet: DataFrame, fdr: float | None = 0.05) -> DataFrame:
    """site, chr, delta_beta, pval, fdr (per chromosome), score of each site; rows above fdr go.

    Each site's M values are compared between cases and controls by their correlation
    with the class, i.e. a two-sample t test; it stands in for a fit of counts with
    shrunken dispersions. score: -log10 p times |delta|, scaled to 0..1 over all sites.
    """
    from strandline.functions.stats import correlation_p, m_value

    rows = sheet.select("sample", "is_case").orderBy("sample").collect()  # a row per sample
    side = F.when(F.col("is_case"), 1.0).otherwise(0.0)
    x = cells.join(F.broadcast(sheet.select("sample", "is_case")), "sample").withColumn("m", m_value(F.col("beta"))).where("m is not null")
    spread = F.stddev_pop("m") * F.stddev_pop(side)
    fit = x.groupBy("site").agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("m", side) / F.when(spread > 1e-12, spread)).alias("r"), (F.avg(F.when(F.col("is_case"), F.col("beta"))) - F.avg(F.when(~F.col("is_case"), F.col("beta")))).alias("delta_beta"))
    p = F.lit(None).cast("double")
    for n in range(3, len(rows) + 1):
        p = F.when(F.col("n") == n, correlation_p(F.col("r"), n - 2)).otherwise(p)
    tested = fit.withColumn("pval", F.greatest(p, F.lit(0.0))).where("pval is not null and delta_beta is not null").join(sites.select("site", "chr"), "site")
    tested = ordering.benjamini_hochberg(tested, "chr", "pval", "site")
    raw = tested.withColumn("raw", -F.log10(F.col("pval") + F.lit(2.2250738585072014e-308)) * F.abs("delta_beta"))
    span = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))  # one row
    out = raw.crossJoin(F.broadcast(span)).select("site", "chr", "delta_beta", "pval", "fdr", ((F.col("raw") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-10))).alias("score"))
    return out if fdr is None else out.where(F.col("fdr") <= fdr)
