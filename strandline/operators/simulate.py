"""Simulated regions and added samples on count data (chr, pos, sample, m, cov).

Random numbers come from hashes of the seed and the row's own keys, so a rerun task
draws the same ones and the result does not depend on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH = 1e-6, 1 - 1e-6


def share(m: Column, cov: Column) -> Column:
    """(m + 0.5) / (cov + 1), null without coverage."""
    return F.when(cov > 0, (m + 0.5) / (cov + 1.0))


def logit(p: Column) -> Column:
    q = F.least(F.lit(HIGH), F.greatest(F.lit(LOW), p))
    return F.log(q / (F.lit(1.0) - q))


def expit(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def draw(seed: int, *keys: str) -> Column:
    """A number in (0, 1) fixed by the seed and the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def profile(pos: Column, first: Column, last: Column, degree: int = 4, flank: float = 0.2, shape: str = "triweight") -> Column:
    """Effect between 0 and 1: (1 - |distance from the centre / half width|^degree)^degree over the flanked interval, or 1 if flat or of one site."""
    if shape == "flat":
        return F.lit(1.0)
    inner = F.greatest(last - first, F.lit(1))
    a, b = first - inner * flank, last + inner * flank
    half = F.greatest(b - a, F.lit(1.0)) / 2
    far = F.least(F.lit(1.0), F.abs(pos - (a + half)) / half)
    return F.when(first == last, F.lit(1.0)).otherwise(F.pow(F.lit(1.0) - F.pow(far, F.lit(degree)), F.lit(degree)))


@dataclass(frozen=True)
class Simulation:
    regions: int = 3000
    delta: float = 0.3
    jitter: float = 1 / 3
    max_gap: int = 500
    min_sites: int = 5
    max_sites: int = 500
    truth_delta: float = 0.05
    degree: int = 4
    flank: float = 0.2
    shape: str = "triweight"
    resample: bool = True
    seed: int = 42


def loci(counts: DataFrame, max_gap: int) -> DataFrame:
    """chr, pos, cluster: distinct loci, a new cluster (chr:first position) after a gap of more than max_gap."""
    x = counts.select("chr", "pos").distinct()
    w = Window.partitionBy("chr").orderBy("pos")
    new = F.when(F.coalesce(F.col("pos") - F.lag("pos").over(w) > max_gap, F.lit(True)), F.col("pos"))
    x = x.withColumn("first_", new).withColumn("first_", F.last("first_", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.select("chr", "pos", F.concat_ws(":", "chr", F.col("first_").cast("string")).alias("cluster"))


def picked_clusters(counts: DataFrame, how: Simulation) -> DataFrame:
    """cluster, first, last, sites and mid of the chosen clusters.

    Weight max(0, 1 - sqrt 2 * sqrt|0.5 - p|) of the cluster's median share p; the
    `regions` smallest of -log(u) / weight are chosen, one draw u per cluster.
    """
    site = counts.groupBy("chr", "pos").agg(F.avg(share(F.col("m"), F.col("cov"))).alias("p"))
    x = site.join(loci(counts, how.max_gap), ["chr", "pos"]).groupBy("cluster", "chr")
    x = x.agg(F.count(F.lit(1)).alias("sites"), F.median("p").alias("mid"), F.min("pos").alias("first"), F.max("pos").alias("last")).where(F.col("sites").between(how.min_sites, how.max_sites))
    weight = F.greatest(F.lit(0.0), 1 - F.sqrt(F.lit(2.0)) * F.sqrt(F.abs(0.5 - F.col("mid"))))
    key = F.when(F.coalesce(weight, F.lit(0.0)) > 0, -F.log(draw(how.seed, "cluster")) / weight).otherwise(F.lit(1e300))
    return x.withColumn("key_", key).orderBy("key_", "cluster").limit(how.regions).drop("key_")


def simulate(counts: DataFrame, cases: list, how: Simulation) -> tuple[DataFrame, DataFrame]:
    """(counts with effects, truth).

    Cases of a chosen cluster move by the profile times a shift on the logit scale;
    the shift goes up or down by a draw, but never past the ends. truth: cluster,
    chr, start, end, num_sites, delta_beta, intended_delta_beta, direction.
    """
    is_case = F.col("sample").isin(*cases)
    counts = counts.groupBy("chr", "pos", "sample").agg(F.sum("m").alias("m"), F.sum("cov").alias("cov"))
    chosen = picked_clusters(counts, how)
    member = loci(counts, how.max_gap).join(chosen, ["chr", "cluster"])
    inside = counts.join(member, ["chr", "pos"]).withColumn("eta", logit(share(F.col("m"), F.col("cov"))))
    # the mean of three draws stands for a symmetric beta draw with the parameters 2 and 2
    wobble = sum((draw(how.seed + k, "cluster") for k in (1, 2, 3)), F.lit(0.0)) / 3 - 0.5
    move = inside.groupBy("cluster").agg(F.coalesce(F.median(F.when(is_case, expit(F.col("eta")))), F.median(expit(F.col("eta"))), F.lit(0.5)).alias("base"))
    move = move.withColumn("size", F.least(F.lit(0.95), F.greatest(F.lit(0.01), how.delta + wobble * how.jitter)))
    up = draw(how.seed + 4, "cluster") < 0.5
    way = F.when(up & (F.col("base") > 1 - F.col("size")), -1.0).when(~up & (F.col("base") < F.col("size")), 1.0).otherwise(F.when(up, 1.0).otherwise(-1.0))
    move = move.withColumn("way", way).withColumn("shift", logit(F.col("base") + F.col("way") * F.col("size")) - logit(F.col("base"))).drop("base")
    moved = inside.join(move, "cluster").withColumn("new_eta", F.when(is_case, F.col("eta") + profile(F.col("pos"), F.col("first"), F.col("last"), how.degree, how.flank, how.shape) * F.col("shift")).otherwise(F.col("eta")))
    moved = moved.withColumn("p_", F.coalesce(expit(F.col("new_eta")), F.lit(0.5)))
    if how.resample:  # a binomial draw by quantile: exact, from the row's own number
        fields = ", ".join(f"`{c}` {t}" for c, t in moved.dtypes if c != "m")

        def redrawn(batches):
            for b in batches:
                yield b.drop(columns=["u_"]).assign(m=binomial_at(b["u_"].to_numpy(), b["cov"].to_numpy(np.int64), b["p_"].to_numpy()))

        moved = moved.drop("m").withColumn("u_", draw(how.seed + 5, "chr", "pos", "sample")).mapInPandas(redrawn, f"{fields}, m long")
    else:
        moved = moved.withColumn("m", F.round(F.col("cov") * F.col("p_")).cast("long"))
    out = counts.join(moved.select("chr", "pos", "sample", F.col("m").alias("new_m")), ["chr", "pos", "sample"], "left").select("chr", "pos", "sample", F.coalesce("new_m", "m").alias("m"), "cov")
    seen = share(F.col("m"), F.col("cov"))
    site = moved.groupBy("cluster", "chr", "pos", "way").agg(
        F.avg(F.when(is_case, seen)).alias("case_"), F.avg(F.when(~is_case, seen)).alias("control_"),
        (F.avg(F.when(is_case, expit(F.col("new_eta")))) - F.avg(F.when(is_case, expit(F.col("eta"))))).alias("meant"),
    )
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.abs("meant")), "pos"))
    strong = F.sum(F.when(F.abs("meant") >= how.truth_delta, 1).otherwise(0)).over(Window.partitionBy("cluster"))
    site = site.withColumn("meant", F.coalesce("meant", F.lit(0.0))).withColumn("rank", rank).withColumn("strong", strong)
    held = site.where(((F.col("strong") >= how.min_sites) & (F.abs("meant") >= how.truth_delta)) | ((F.col("strong") < how.min_sites) & (F.col("rank") <= how.min_sites)))
    truth = held.groupBy("cluster", "chr").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("num_sites"), F.median(F.col("case_") - F.col("control_")).alias("delta_beta"), F.median("meant").alias("intended_delta_beta"))
    return out, truth.withColumn("direction", F.when(F.col("delta_beta") >= 0, "hyper").otherwise("hypo"))


def binomial_at(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Smallest k with P(X <= k) >= u, X binomial; from the log density of all rows at once, k by k."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    log_term, odds = n * np.log1p(-p), np.log(p) - np.log1p(-p)
    reach, k, out = np.exp(log_term), 0, np.zeros(len(u), dtype=np.int64)
    open_ = (reach < u) & (n > 0)
    while open_.any():
        with np.errstate(divide="ignore", invalid="ignore"):
            log_term = np.where(open_, log_term + np.log(np.maximum(n - k, 0)) - np.log(k + 1) + odds, log_term)
        k += 1
        reach = np.where(open_, reach + np.exp(log_term), reach)
        out[open_] = k
        open_ &= (reach < u) & (k < n)
    return out


def new_samples(counts: DataFrame, names: list[str], min_samples: int = 2, length: float = 350.0, seed: int = 42, block: int = 100_000) -> DataFrame:
    """Counts of added samples: per site the moments of the given ones, along a chromosome a Gaussian chain with correlation exp(-gap / length).

    Sites with fewer than min_samples covered samples get no counts. A site's share is
    drawn by the quantile of a normal on the logit scale with its mean and spread
    (coverage: on the log scale). Chains are cut into blocks of `block` positions, so
    no task holds a whole chromosome.
    """
    p = share(F.col("m"), F.col("cov"))
    site = counts.groupBy("chr", "pos").agg(F.avg(logit(p)).alias("mu"), F.coalesce(F.stddev_samp(logit(p)), F.lit(0.0)).alias("sd"), F.avg(F.log1p("cov")).alias("cm"), F.coalesce(F.stddev_samp(F.log1p("cov")), F.lit(0.0)).alias("cs"), F.count(p).alias("n"))
    site = site.where(F.col("n") >= min_samples).withColumn("block", F.floor(F.col("pos") / block))

    def chain(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        pos, parts = rows["pos"].to_numpy(float), []
        keep = np.exp(-np.diff(pos) / length)
        for name in names:
            rng = np.random.default_rng(list(f"{seed}|{key[0]}|{key[1]}|{name}".encode()))
            z, zc = rng.standard_normal(len(pos)), rng.standard_normal(len(pos))
            for i in range(1, len(pos)):
                z[i] = keep[i - 1] * z[i - 1] + np.sqrt(1 - keep[i - 1] ** 2) * z[i]
            share_ = 1 / (1 + np.exp(-(rows["mu"].to_numpy() + rows["sd"].to_numpy() * z)))
            cov = np.maximum(1, np.rint(np.expm1(rows["cm"].to_numpy() + rows["cs"].to_numpy() * zc))).astype(np.int64)
            parts.append(pd.DataFrame({"chr": rows["chr"], "pos": rows["pos"], "sample": name, "m": binomial_at(rng.random(len(pos)), cov, share_), "cov": cov}))
        return pd.concat(parts)

    kinds = dict(counts.dtypes)
    return site.groupBy("chr", "block").applyInPandas(chain, f"chr {kinds['chr']}, pos {kinds['pos']}, sample string, m long, cov long")


def augmented(counts: DataFrame, names: list[str], **how) -> DataFrame:
    """The given and the added samples."""
    return counts.select("chr", "pos", F.col("sample").cast("string").alias("sample"), F.col("m").cast("long").alias("m"), F.col("cov").cast("long").alias("cov")).unionByName(new_samples(counts, names, **how))
