"""Scores of regions and blocks of high scores along a chromosome.

Both need a numeric routine per group (a kernel machine per region, a segmentation
per chromosome), so they run in Arrow batches grouped by region or chromosome. A
region's group holds one row per sample and site, a chromosome's one row per region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(far, 0))


def fit_machine(k: np.ndarray, y: np.ndarray, cost: float = 1.0, tol: float = 1e-3, rounds: int = 100_000) -> tuple[np.ndarray, float]:
    """Dual weights a*y and offset of a support-vector machine on kernel k; pairs that violate most are optimised first."""
    n = len(y)
    alpha, grad = np.zeros(n), -np.ones(n)
    q = k * np.outer(y, y)
    for _ in range(rounds):
        up = ((y > 0) & (alpha < cost)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < cost))
        rise = -y * grad
        i, j = np.where(up, rise, -np.inf).argmax(), np.where(low, rise, np.inf).argmin()
        if rise[i] - rise[j] < tol:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = (rise[i] - rise[j]) / curve
        step = min(step, cost - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += step * (y[i] * q[:, i] - y[j] * q[:, j])
    rise = -y * grad
    free = (alpha > 0) & (alpha < cost)
    if free.any():
        offset = rise[free].mean()
    else:
        up = ((y > 0) & (alpha < cost)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < cost))
        offset = (rise[up].max() + rise[low].min()) / 2 if up.any() and low.any() else 0.0
    return alpha * y, float(offset)


def cross_score(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[float, float]:
    """(score, accuracy) of samples x (rows) with labels +1/-1 over folds.

    Features are scaled on the training rows, gamma is one over their number. The
    score is exp(-mean logistic loss) of the held-out decision values.
    """
    decision = np.full(len(y), np.nan)
    for f in np.unique(fold):
        test, train = fold == f, fold != f
        if len(np.unique(y[train])) < 2:
            continue
        mid, sd = x[train].mean(0), x[train].std(0, ddof=1)
        varies = sd > 0
        a, b = ((x[p][:, varies] - mid[varies]) / sd[varies] for p in (train, test))
        gamma = 1 / max(1, x.shape[1])
        weight, offset = fit_machine(_kernel(a, a, gamma), y[train])
        decision[test] = _kernel(b, a, gamma) @ weight + offset
    known = np.isfinite(decision)
    if not known.any():
        return 0.0, 0.0
    accuracy = float((np.where(decision >= 0, 1, -1)[known] == y[known]).sum() / len(y))
    return float(np.exp(-np.logaddexp(0, -y[known] * decision[known]).mean())), accuracy


def score_regions(members: DataFrame) -> DataFrame:
    """region, score, cv_accuracy (members: region, site, sample, value, is_case, fold; null values count as 0).

    A region whose samples are of one class scores null.
    """

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="sample", columns="site", values="value", aggfunc="first", dropna=False).fillna(0.0)
        about = rows.drop_duplicates("sample").set_index("sample").loc[wide.index]
        y = np.where(about["is_case"].to_numpy(bool), -1.0, 1.0)
        s, a = cross_score(wide.to_numpy(float), y, about["fold"].to_numpy()) if len(np.unique(y)) > 1 else (None, None)
        return pd.DataFrame({"region": [key[0]], "score": [s], "cv_accuracy": [a]})

    kind = dict(members.dtypes)["region"]
    return members.groupBy("region").applyInPandas(one, f"region {kind}, score double, cv_accuracy double")


def smooth(x: np.ndarray, y: np.ndarray, k: int = 5) -> np.ndarray:
    """Gaussian mean over each point's k nearest (ties: earlier first); the width is 0.75 of the farthest, at least the least gap."""
    n = len(x)
    k = min(max(1, k), n)
    gaps = np.diff(np.unique(x))
    least = gaps.min() if len(gaps) else 1.0
    out = np.empty(n)
    for i in range(n):
        lo = int(np.searchsorted(x, x[i], "left"))
        lo, hi = max(0, min(lo, i) - k), min(n, max(int(np.searchsorted(x, x[i], "right")), i + 1) + k)
        d = np.abs(x[lo:hi] - x[i])
        near = np.argsort(d, kind="stable")[:k]
        h = d[near].max() or least
        w = np.exp(-0.5 * (d[near] / max(0.75 * h, least)) ** 2)
        out[i] = (w @ y[lo:hi][near]) / w.sum()
    return out


@dataclass(frozen=True)
class Segments:
    starts: np.ndarray
    ends: np.ndarray  # inclusive
    slopes: np.ndarray

    def ids(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), self.ends - self.starts + 1)


def segment(x: np.ndarray, y: np.ndarray, least: int = 2, penalty: float | None = None) -> Segments:
    """Piecewise linear segmentation of least cost plus penalty per segment (default log(n)/n * variance), with pruned change points."""
    n = len(x)
    if penalty is None:
        spread = y.var(ddof=1) if n > 1 else 0.0
        penalty = math.log(max(n, 2)) / max(n, 2) * (spread if spread > 0 else 1e-8)
    sums = np.vstack([np.zeros(5), np.cumsum(np.column_stack([x, y, x * x, x * y, y * y]), axis=0)])
    best, origin = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    open_at = np.array([0])
    for t in range(1, n + 1):
        ready = open_at[open_at <= t - least]
        waiting = open_at[open_at > t - least]
        if len(ready) and np.isfinite(best[ready]).any():
            m = t - ready
            sx, sy, sxx, sxy, syy = (sums[t] - sums[ready]).T
            total = np.maximum(syy - sy * sy / m, 0)
            across = sxx - sx * sx / m
            flat = np.abs(across) <= 1e-12
            rest = np.where(flat, total, total - (sxy - sx * sy / m) ** 2 / np.where(flat, 1, across))
            cost = best[ready] + np.where(m > 1, np.maximum(rest, 0), 0) + penalty
            at = int(cost.argmin())
            best[t], origin[t] = cost[at], ready[at]
            ready = ready[cost <= best[t]]
        open_at = np.concatenate([ready, waiting, [t]])
    cuts, t = [n], n
    while np.isfinite(best[t]) and origin[t] > 0:
        t = int(origin[t])
        cuts.append(t)
    ends = np.array(cuts[::-1]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    slopes = []
    for a, b in zip(starts, ends, strict=True):
        cx, cy = x[a : b + 1] - x[a : b + 1].mean(), y[a : b + 1] - y[a : b + 1].mean()
        slopes.append(cx @ cy / (cx @ cx) if cx @ cx > 1e-12 else 0.0)
    return Segments(starts, ends, np.array(slopes))


@dataclass(frozen=True)
class Gap:
    """How far apart two neighbours of one block may lie: none, fixed, or adaptive (clamped quantile of type 8 times a factor)."""

    mode: str = "adaptive"
    fixed: float | None = None
    quantile: float = 0.95
    factor: float = 1.5
    low: float = 2_500
    high: float = 50_000

    def limit(self, x: np.ndarray) -> float:
        if self.mode == "none":
            return math.inf
        if self.mode == "fixed":
            if self.fixed is None:
                raise ValueError("a fixed gap needs its size")
            return self.fixed
        gaps = np.diff(x)
        gaps = gaps[gaps > 0]
        if not len(gaps):
            return self.low
        return float(min(max(np.quantile(gaps, self.quantile, method="median_unbiased") * self.factor, self.low), self.high))


def _rises_and_falls(slopes: np.ndarray, d: float) -> Iterator[tuple[int, int]]:
    """Ranges of segments that rise, stay level any number of times and fall; ranges don't share segments."""
    kind = np.where(slopes > d, 1, np.where(slopes < -d, -1, 0))
    i = 0
    while i < len(kind):
        if kind[i] == 1:
            j = i + 1
            while j < len(kind) and kind[j] == 0:
                j += 1
            if j < len(kind) and kind[j] == -1:
                yield i, j
                i = j
        i += 1


def block_numbers(x: np.ndarray, y: np.ndarray, gap: Gap, k: int = 5, least: int = 2) -> dict[str, np.ndarray]:
    """Smoothed scores, segment (from 1), its slope and block number (0: none) of points sorted by x."""
    level = smooth(x, y, k)
    seg = segment(x, level, least)
    ids = seg.ids()
    d = 1.4826 * float(np.median(np.abs(seg.slopes - np.median(seg.slopes))))
    limit, number, block = gap.limit(x), 0, np.zeros(len(x), dtype=int)
    for first, last in _rises_and_falls(seg.slopes, d):
        members = np.flatnonzero((ids >= first) & (ids <= last))
        for part in np.split(members, np.flatnonzero(np.diff(x[members]) > limit) + 1):
            held = np.unique(ids[part])
            up, down = held[seg.slopes[held] > d], held[seg.slopes[held] < -d]
            if len(up) and len(down) and up.min() < down.max():
                number += 1
                block[part] = number
    return {"score_smoothed": level, "segment_id": ids + 1, "segment_slope": seg.slopes[ids], "block": block}


def blocks(regions: DataFrame, gap: Gap | None = None, k: int = 5, least: int = 2) -> DataFrame:
    """id, chr, midpoint, score, score_smoothed, segment_id, segment_slope, block_id (chr_blockN, null: none).

    regions: id, chr, start, end, score. Scores that are null or not finite, and
    chromosomes with fewer than three others, get nulls.
    """
    gap = gap or Gap()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["midpoint", "id"], kind="stable").reset_index(drop=True)
        rows = rows.assign(score_smoothed=np.nan, segment_id=pd.array([None] * len(rows), dtype="Int64"), segment_slope=np.nan, block_id=None)
        ok = np.flatnonzero(np.isfinite(rows["score"].to_numpy(float, na_value=np.nan)))
        if len(ok) >= 3:
            got = block_numbers(rows["midpoint"].to_numpy(float)[ok], rows["score"].to_numpy(float)[ok], gap, k, least)
            for c in ("score_smoothed", "segment_id", "segment_slope"):
                rows.loc[ok, c] = got[c]
            rows.loc[ok, "block_id"] = [f"{rows['chr'].iat[0]}_block{b}" if b else None for b in got["block"]]
        return rows

    kind = dict(regions.dtypes)
    x = regions.select("id", "chr", F.floor((F.col("start") + F.col("end")) / 2).cast("long").alias("midpoint"), F.col("score").cast("double").alias("score"))
    return x.groupBy("chr").applyInPandas(one, f"id {kind['id']}, chr {kind['chr']}, midpoint long, score double, score_smoothed double, segment_id long, segment_slope double, block_id string")
