"""Empirical p-values of correlations: permutations or draws, with a random stream per edge and group so that results don't depend on partitions."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = float(np.sqrt(np.finfo(float).eps))


@dataclass(frozen=True)
class Empirical:
    strategy: str = "auto"  # permutations, montecarlo, or auto: draws from six samples on, else permutations
    tries: int = 200  # 0: at most 500
    mid_p: bool = False
    max_pval: float = 0.05
    seed: int = 42


@cache
def orders(m: int) -> np.ndarray:
    """All orders of m samples."""
    return np.array(list(itertools.permutations(range(m))))


def empirical_p(x: np.ndarray, y: np.ndarray, how: Empirical, key: str, low: float, high: float) -> float:
    """Add-one p of |r| of x and y; NaN where one is constant; 1 where permutations can't reach max_pval."""
    m = len(x)
    cx, cy = x - x.mean(), y - y.mean()
    size = math.sqrt(cx @ cx) * math.sqrt(cy @ cy)
    if not size > 0:
        return math.nan
    shuffled = how.strategy == "permutations" or (how.strategy == "auto" and m < 6)
    rng = np.random.default_rng([how.seed, zlib.crc32(key.encode())])
    if shuffled:
        ways = math.factorial(m)
        if 1 / (1 + ways) > how.max_pval:
            return 1.0
        tries = how.tries or min(500, ways)
        order = orders(m) if ways <= tries else rng.permuted(np.tile(np.arange(m), (tries, 1)), axis=1)
        r = cy[order] @ cx / size
    else:
        drawn = rng.uniform(low, high, (how.tries or 500, m))
        drawn -= drawn.mean(1, keepdims=True)
        r = drawn @ cx / np.sqrt((cx @ cx) * (drawn * drawn).sum(1))
    r, seen = np.abs(r[np.isfinite(r)]), abs(cx @ cy / size)
    equal = int((np.abs(r - seen) <= TOLERANCE).sum())
    more = int((r > seen + TOLERANCE).sum())
    tries = len(order) if shuffled else len(drawn)
    return (more + (0.5 if how.mid_p else 1) * equal + 1) / (tries + 1)


def empirical_pvalues(pairs: DataFrame, how: Empirical) -> DataFrame:
    """Adds `pval` (pairs: chr, site, grp, x, y as arrays without nulls).

    The range of the draws is that of y over its chromosome and group.
    """
    span = pairs.groupBy("chr", "grp").agg(F.min(F.array_min("y")).alias("low"), F.max(F.array_max("y")).alias("high"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [empirical_p(np.asarray(r.x, float), np.asarray(r.y, float), how, f"{r.chr}|{r.site}|{r.grp}", r.low, r.high) for r in b.itertuples(index=False)]
            p = pd.Series(p, dtype=float).astype(object).where(lambda s: s.notna(), None)
            yield b.drop(columns=["low", "high"]).assign(pval=p)

    ranged = pairs.join(span, ["chr", "grp"]).select(*pairs.columns, "low", "high")
    fields = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    return ranged.mapInPandas(run, f"{fields}, pval double")


def assumptions(pairs: DataFrame, group: str = "grp", limit: int = 2000) -> DataFrame:
    """Per group from at most `limit` pairs (smallest hashes of the site): q10 of the sizes, median shifts of the correlation when
    ranked and when winsorised, median |skewness| and excess kurtosis, and whether the closed-form test suits (`parametric`)."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.xxhash64("chr", "site"), "site")
    few = pairs.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= limit).drop("k_")

    def corr(a, b):
        a, b = a - a.mean(), b - b.mean()
        size = math.sqrt((a @ a) * (b @ b))
        return a @ b / size if size > 0 else math.nan

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        got = []
        for x, y in zip(rows["x"], rows["y"], strict=True):
            x, y = np.asarray(x, float), np.asarray(y, float)
            r = corr(x, y)
            ranked = corr(pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy())
            clip = [np.clip(v, *np.quantile(v, [0.05, 0.95], method="median_unbiased")) for v in (x, y)]
            z = (y - y.mean()) / y.std() if y.std() > 0 else np.full(len(y), np.nan)
            got.append((len(x), abs(r - ranked), abs(r - corr(*clip)), abs((z**3).mean()), (z**4).mean() - 3))
        a = np.array(got, float)
        mid = [float(np.nanmedian(c)) if np.isfinite(c).any() else math.nan for c in a.T[1:]]
        n = float(np.quantile(a[:, 0], 0.1))
        fine = n >= 10 and mid[0] <= 0.10 and mid[1] <= 0.10 and mid[2] <= 2 and mid[3] <= 7
        return pd.DataFrame([[key[0], n, *mid, bool(fine)]], columns=["grp", "n_q10", "rank_shift", "winsor_shift", "skewness", "kurtosis", "parametric"])

    kind = dict(pairs.dtypes)[group]
    return few.groupBy(group).applyInPandas(one, f"grp {kind}, n_q10 double, rank_shift double, winsor_shift double, skewness double, kurtosis double, parametric boolean")
