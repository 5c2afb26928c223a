"""Numeric routines against plain versions."""

import itertools
import math

import numpy as np
import pytest

from strandline.operators.graph import aligned_similarity
from strandline.operators.resampling import Empirical, empirical_p
from strandline.operators.scoring import Gap, block_numbers, cross_score, fit_machine, segment, smooth
from strandline.operators.simulate import binomial_at


def test_smooth_against_all_pairs():
    rng = np.random.default_rng(1)
    x, y = np.sort(rng.integers(0, 60, 40)).astype(float), rng.random(40)
    least = np.diff(np.unique(x)).min()
    want = []
    for i in range(40):
        near = sorted(range(40), key=lambda j: (abs(x[j] - x[i]), j))[:5]
        d = np.abs(x[near] - x[i])
        w = np.exp(-0.5 * (d / max(0.75 * (d.max() or least), least)) ** 2)
        want.append((w * y[near]).sum() / w.sum())
    assert np.allclose(smooth(x, y), want)


def test_segments_have_the_least_cost():
    rng = np.random.default_rng(2)
    x = np.arange(9.0)
    y = np.concatenate([x[:5], 8 - 2 * x[5:]]) + rng.normal(0, 0.05, 9)

    def cost(ends, penalty):
        total, a = -penalty, 0
        for b in ends:
            fit = np.polyfit(x[a:b], y[a:b], 1) if b - a > 1 else [0, y[a]]
            total += ((y[a:b] - np.polyval(fit, x[a:b])) ** 2).sum() + penalty
            a = b
        return total

    penalty = math.log(9) / 9 * y.var(ddof=1)
    ways = (list(c) + [9] for k in range(5) for c in itertools.combinations(range(1, 9), k) if all(b - a >= 2 for a, b in zip((0, *c), (*c, 9), strict=True)))
    best = min(ways, key=lambda e: cost(e, penalty))
    assert (segment(x, y).ends + 1).tolist() == best


def test_blocks_and_gaps():
    x = np.arange(30) * 1000.0
    y = np.concatenate([np.linspace(0, 1, 10), np.ones(10), np.linspace(1, 0, 10)])
    assert block_numbers(x, y, Gap("none"))["block"].max() >= 1
    assert block_numbers(x, y, Gap("fixed", 10.0))["block"].max() == 0
    dense, sparse = (np.arange(100) * s for s in (10_000.0, 500_000.0))
    limits = {m: Gap(m, 123456.0, low=250_000, high=5_000_000) for m in ("adaptive", "fixed", "none")}
    assert limits["adaptive"].limit(sparse) > limits["adaptive"].limit(dense)
    assert limits["fixed"].limit(dense) == 123456 and limits["none"].limit(dense) == math.inf


def test_machine_meets_its_conditions_and_separates():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (10, 3)), rng.normal(3, 1, (10, 3))])
    y = np.repeat([1.0, -1.0], 10)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 3)
    w, b = fit_machine(k, y)
    assert abs(w.sum()) < 1e-9 and (w * y >= -1e-12).all() and (w * y <= 1 + 1e-12).all()
    margin = y * (k @ w + b)
    free = (w * y > 1e-6) & (w * y < 1 - 1e-6)
    assert np.allclose(margin[free], 1, atol=5e-3) and (margin[w * y < 1e-6] > 1 - 5e-3).all()
    score, accuracy = cross_score(x, y, np.tile(np.arange(5), 4))
    assert accuracy >= 0.9 and 0.5 < score <= 1


def test_permutations():
    x, y = np.array([1.0, 2, 3, 4]), np.array([1.0, 2.1, 2.9, 4.2])
    r = [abs(np.corrcoef(x, y[list(p)])[0, 1]) for p in itertools.permutations(range(4))]
    seen = abs(np.corrcoef(x, y)[0, 1])
    assert empirical_p(x, y, Empirical(), "k", 0, 1) == pytest.approx((sum(v >= seen - 1e-9 for v in r) + 1) / 25)
    assert empirical_p(x, y, Empirical(max_pval=0.01), "k", 0, 1) == 1.0
    assert math.isnan(empirical_p(x, np.ones(4), Empirical(), "k", 0, 1))
    long = np.arange(8.0)
    a, b = (empirical_p(long, long + 0.1, Empirical(), "k", 0, 8) for _ in range(2))
    assert a == b < 0.05


def test_binomial_and_alignment():
    got = binomial_at(np.array([0.001, 0.5, 0.999, 0.5]), np.array([10, 10, 10, 0]), np.array([0.5, 0.5, 0.5, 0.3]))
    assert got.tolist() == [1, 5, 9, 0]
    eye = np.eye(4)
    assert aligned_similarity(eye, np.vstack([eye[2:], eye])) == pytest.approx(1, abs=1e-6)
