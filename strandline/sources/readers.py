"""Readers: matrices, BED-like tables, counts, sample sheets, seeds, positions and sequences, all as DataFrames.

Values go to the long form (site, sample, beta), positions to (site, chr, pos).
NaN becomes null here, so no operator meets NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABULAR = {"sep": "\t", "header": "true"}
BED_FIELDS = ("chrom", "start", "end", "id", "score", "strand")



def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def to_long(wide: DataFrame, site: str, samples: list[str]) -> DataFrame:
    """site, sample, beta from a column per sample; texts that are no numbers count as missing."""
    kept = wide.select(F.col(_quoted(site)).cast("string").alias("site"), *(F.nanvl(F.expr(f"try_cast({_quoted(s)} as double)"), F.lit(None).cast("double")).alias(s) for s in samples))
    return kept.unpivot(["site"], [F.col(_quoted(s)) for s in samples], "sample", "beta")


def read_matrix(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """A site x sample matrix as text (first column: site, also without a header of its own) or as a Parquet folder.

    Only the wanted samples are parsed.
    """
    wide = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.options(**TABULAR).csv(path)
    site, have = wide.columns[0], wide.columns[1:]
    absent = sorted(set(samples or []) - set(have))
    if absent:
        raise ValueError(f"the matrix lacks the samples {', '.join(absent)}")
    return to_long(wide, site, samples or have)


def read_bed(spark: SparkSession, path: str, samples: list[str], chrom: str = "chrom", start: str = "start") -> tuple[DataFrame, DataFrame]:
    """(cells, sites) of a BED-like table: a site is named chr:start and ends at start + 1; samples that the table lacks are left out."""
    wide = spark.read.options(**TABULAR).csv(path)
    for need in (chrom, start):
        if need not in wide.columns:
            raise ValueError(f"the table lacks the column {need}")
    kept = [s for s in samples if s in wide.columns and s not in (chrom, start, *BED_FIELDS)]
    if not kept:
        raise ValueError("the table holds none of the samples")
    at = F.expr(f"cast(try_cast({_quoted(start)} as double) as int)")
    named = wide.withColumn("site_", F.concat_ws(":", F.col(_quoted(chrom)), at.cast("string")))
    sites = named.select(F.col("site_").alias("site"), F.col(_quoted(chrom)).alias("chr"), at.alias("pos"), (at + 1).alias("end")).dropDuplicates(["site"])
    return to_long(named, "site_", kept), sites


def beta_of_counts(counts: DataFrame) -> DataFrame:
    """site, sample, beta from counts (chr, pos, sample, m, cov); no coverage: null. Rows of one site and sample are added up."""
    whole = counts.groupBy("chr", "pos", "sample").agg(F.sum("m").alias("m"), F.sum("cov").alias("cov"))
    return whole.select(F.concat_ws(":", "chr", F.col("pos").cast("string")).alias("site"), "chr", "pos", "sample", F.try_divide(F.col("m").cast("double"), F.col("cov").cast("double")).alias("beta"))


def read_samplesheet(spark: SparkSession, path: str, sep: str = "\t", sample: str = "Sample_ID", group: str = "Sample_Group", case: list[str] | None = None, control: list[str] | None = None) -> DataFrame:
    """sample, grp, is_case and the sheet's other columns.

    With case and control labels, rows of other groups go. Without case labels the
    alphabetically first group is the control.
    """
    sheet = spark.read.options(sep=sep, header="true").csv(path)
    for need in (sample, group):
        if need not in sheet.columns:
            raise ValueError(f"the sheet lacks the column {need}")
    rest = [F.col(_quoted(c)) for c in sheet.columns if c not in (sample, group)]
    sheet = sheet.select(F.col(_quoted(sample)).alias("sample"), F.trim(F.col(_quoted(group))).alias("grp"), *rest)
    if case:
        if control:
            sheet = sheet.where(F.col("grp").isin(*case, *control))
        return sheet.withColumn("is_case", F.col("grp").isin(*case))
    first = sheet.agg(F.min("grp")).first()[0]
    return sheet.withColumn("is_case", F.col("grp") != F.lit(first))


def without_groups(sheet: DataFrame, ignored: list[str]) -> DataFrame:
    """The samples that take part in detection: `case` and `control` name a whole side; fewer than two left is an error."""
    drop = F.col("grp").isin(*[g for g in ignored if g not in ("case", "control")] or [""])
    for word, side in (("case", F.col("is_case")), ("control", ~F.col("is_case"))):
        drop = drop | side if word in ignored else drop
    left = sheet.where(~drop)
    if left.limit(2).count() < 2:
        raise ValueError("fewer than two samples remain")
    return left


def read_seeds(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """site and the table's other columns; the site column is named, or the first."""
    t = spark.read.options(**TABULAR).csv(path)
    return t.withColumnRenamed(site or t.columns[0], "site")


def match_seeds(seeds: DataFrame, sites: DataFrame) -> DataFrame:
    """Seeds that name a site, with its chr and pos: by identifier, else by chr:pos with or without the prefix chr.

    No match at all is an error.
    """
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    part = lambda k: F.regexp_extract("site", r"^([^:]+):([0-9]+)$", k)
    place = sites.select("site", "chr", "pos")
    named = seeds.join(place, "site")
    rest = seeds.join(place.select("site"), "site", "left_anti").withColumn("chr_", bare(part(1))).withColumn("pos_", F.expr("try_cast(regexp_extract(site, '^([^:]+):([0-9]+)$', 2) as bigint)"))
    by_place = place.select(F.col("site").alias("found"), "chr", "pos", bare(F.col("chr")).alias("chr_"), F.col("pos").cast("long").alias("pos_"))
    placed = rest.join(by_place, ["chr_", "pos_"]).withColumn("site", F.col("found")).select(*named.columns)
    out = named.unionByName(placed).dropDuplicates(["site"])
    if out.isEmpty():
        raise ValueError("no seed names a site of the matrix")
    return out


def seed_column(seeds: DataFrame, sites: DataFrame) -> str | None:
    """The first column of seeds all of whose values are sites."""
    for c in seeds.columns:
        ids = seeds.select(F.col(_quoted(c)).cast("string").alias("site"))
        if ids.join(sites.select("site"), "site", "left_anti").isEmpty():
            return c
    return None


def check_order(sites: DataFrame, order: str) -> None:
    """Sites must come grouped by chromosome and ascending (order: column with their row number in the file).

    One aggregate per chromosome and one window; the driver gets at most one row.
    """
    from pyspark.sql import Window

    span = sites.groupBy("chr").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count(F.lit(1)).alias("n"))
    torn = span.where(F.col("b") - F.col("a") + 1 != F.col("n")).orderBy("chr").limit(1).collect()
    if torn:
        raise ValueError(f"not grouped by chromosome: {torn[0]['chr']} appears in multiple blocks")
    back = sites.withColumn("before", F.lag("pos").over(Window.partitionBy("chr").orderBy(order))).where("before > pos").agg(F.min("chr").alias("chr")).first()["chr"]
    if back is not None:
        raise ValueError(f"not sorted within chromosome {back}")


def sequences(regions: DataFrame, tiles: DataFrame, tile: int, before: int = 0, after: int = 0) -> DataFrame:
    """id, seq of closed regions (id, chr, start, end; from 1) with flanks, cut from tiles (chr, tile_start from 1, seq of `tile` bases).

    Places outside the chromosome read N. An equi-join on (chr, tile) fetches each region's tiles.
    """
    a, b = F.col("start") - before, F.col("end") + after
    first = lambda c: F.floor((c - 1) / tile)
    wanted = regions.select("id", "chr", a.alias("a"), b.alias("b"), F.explode(F.sequence(first(F.greatest(a, F.lit(1))), F.greatest(first(F.greatest(a, F.lit(1))), first(b)))).alias("t"))
    have = tiles.select("chr", first(F.col("tile_start")).alias("t"), "tile_start", "seq")
    got = wanted.join(have, ["chr", "t"], "left").withColumn("lo", F.greatest(F.col("a"), F.col("tile_start"))).withColumn("hi", F.least(F.col("b"), F.col("tile_start") + F.length("seq") - 1))
    piece = F.when(F.col("hi") >= F.col("lo"), F.expr("substring(seq, cast(lo - tile_start + 1 as int), cast(hi - lo + 1 as int))")).otherwise("")
    whole = got.groupBy("id", "a", "b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("t").alias("t"), piece.alias("s")))), lambda x: x["s"]), "").alias("s"))
    lead = F.greatest(F.least(F.lit(0) - F.col("a") + 1, F.col("b") - F.col("a") + 1), F.lit(0)).cast("int")
    padded = F.concat(F.repeat(F.lit("N"), lead), F.col("s"))
    size = (F.col("b") - F.col("a") + 1).cast("int")
    return whole.select("id", F.upper(F.rpad(padded, size, F.lit("N"))).alias("seq"))


def lift(intervals: DataFrame, chain: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Intervals (id, chr, start, end) carried over by chain blocks (chr, start, end, to_chr, shift); one that meets several blocks comes several times, one that meets none goes."""
    from strandline.operators.intervals import overlaps

    blocks = chain.select(F.concat_ws(":", "chr", F.col("start").cast("string"), "to_chr", F.col("shift").cast("string")).alias("id"), "chr", "start", "end", "to_chr", "shift")
    hit = overlaps(intervals, blocks, width)
    return hit.join(blocks.select(F.col("id").alias("b_id"), "to_chr", "shift"), "b_id").select(F.col("a_id").alias("id"), F.col("to_chr").alias("chr"), (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"))
