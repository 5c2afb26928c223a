"""Edges between neighbouring sites: packed matrix, pairwise tests per group, combination of groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.stats import correlation_p, dot, let, m_value, unit
from strandline.operators.lineage import checkpointed


@dataclass(frozen=True)
class Test:
    """Options of the pairwise test."""

    max_pval: float = 0.05
    mode: str = "strong"  # strong: every group must pass; weak: one is enough
    max_distance: int = 10_000
    rescue_delta: float | None = None
    statistic: str = "mean"  # of cases and of controls in the delta of the rescue


def pack(cells: DataFrame, sites: DataFrame, samples: list) -> DataFrame:
    """One row per site with its values in the order of `samples` (null: missing); sites: site, chr, pos."""
    values = F.array(*(F.max(F.when(F.col("sample") == s, F.col("beta"))) for s in samples))
    packed = cells.groupBy("site").agg(values.alias("beta"))
    return sites.join(packed, "site", "left").withColumn("beta", F.coalesce("beta", F.array(*(F.lit(None).cast("double") for _ in samples))))


def group_values(packed: Column, places: list[int]) -> Column:
    """M values of a group's samples; a missing value counts as 0."""
    return F.array(*(F.coalesce(m_value(F.get(packed, F.lit(i))), F.lit(0.0)) for i in places))


def delta_beta(packed: Column, case: list[int], control: list[int], statistic: str = "mean") -> Column:
    """Mean or median of the cases minus that of the controls, missing values left out."""

    def mid(places: list[int]) -> Column:
        got = F.filter(F.array(*(F.get(packed, F.lit(i)) for i in places)), lambda x: x.isNotNull())
        if statistic == "mean":
            return F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda s, x: s + x) / F.size(got))
        middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
        return F.when(F.size(got) > 0, let(F.array_sort(got), middle))

    return mid(case) - mid(control)


def units(packed: DataFrame, groups: dict[str, list[int]], basis: list[list[float]] | None = None) -> DataFrame:
    """Adds unit_<group>: the group's M values as a unit vector, worked out once per site rather than per pair.

    With the basis of a design (see `design_basis`) its effect is taken out of the M
    values first; a site with a missing value then counts as 0 throughout.
    """
    if not basis:
        return packed.select("*", *(unit(group_values(F.col("beta"), places)).alias(f"unit_{g}") for g, places in groups.items()))
    x = packed.withColumn("left_", residual(F.transform("beta", m_value), basis))
    values = {g: F.array(*(F.coalesce(F.get("left_", F.lit(i)), F.lit(0.0)) for i in places)) for g, places in groups.items()}
    return x.select(*packed.columns, *(unit(v).alias(f"unit_{g}") for g, v in values.items()))


def adjacent(packed: DataFrame, step: int = 1) -> DataFrame:
    """Each site with the next one, or the one `step` places on, of its chromosome (next_<column>): one window over packed rows, no self join."""
    w = Window.partitionBy("chr").orderBy("pos")
    return packed.select("*", *(F.lead(c, step).over(w).alias(f"next_{c}") for c in packed.columns if c != "chr"))


def design_basis(rows: list[dict], covariates: list[str]) -> list[list[float]]:
    """Orthonormal columns that span 1 and the covariates of the samples (one dict each); texts count as the rank of their value. Empty if singular."""
    columns = [np.ones(len(rows))]
    for c in covariates:
        v = [r[c] for r in rows]
        try:
            columns.append(np.array([float(a) for a in v]))
        except (TypeError, ValueError):
            known = sorted({str(a) for a in v})
            columns.append(np.array([known.index(str(a)) for a in v], float))
    x = np.column_stack(columns)
    return np.linalg.qr(x)[0].T.tolist() if np.linalg.matrix_rank(x) == x.shape[1] else []


def residual(values: Column, basis: list[list[float]]) -> Column:
    """values less their projection on the basis; null if one is missing."""

    def without(left: Column, column: Column) -> Column:
        return let(left, lambda y: let(dot(y, column), lambda c: F.zip_with(y, column, lambda a, b: a - b * c)))

    left = values
    for q in basis:  # orthonormal, so one after the other is the same as all at once
        left = without(left, F.array(*map(F.lit, q)))
    return F.when(F.forall(values, lambda v: v.isNotNull()), left)


def edges(packed: DataFrame, groups: dict[str, list[int]], case: str | list[int], control: str | list[int], test: Test, basis: list[list[float]] | None = None, step: int = 1) -> DataFrame:
    """site, chr, pos, next_site, connected, pval, reason, failing, delta of every edge; a chromosome's last site ends it."""
    sides = [groups[s] if isinstance(s, str) else s for s in (case, control)]
    x = units(packed, groups, basis).withColumn("delta_beta", delta_beta(F.col("beta"), *sides, test.statistic)).drop("beta")
    pairs = adjacent(x, step).withColumnRenamed("next_delta_beta", "delta")
    limit = test.max_pval / len(groups) if test.mode == "strong" else test.max_pval
    reasons, pvals = [], []
    for name, places in groups.items():
        r = dot(F.col(f"unit_{name}"), F.col(f"next_unit_{name}"))
        p = correlation_p(r, len(places) - 2)
        pairs = pairs.withColumn(f"r_{name}", r).withColumn(f"p_{name}", F.when(F.col(f"r_{name}").isNotNull(), p))
        p = F.col(f"p_{name}")
        why = F.when(F.lit(len(places) < 3), "").when(F.col(f"r_{name}").isNull(), "na r").when(p > limit, "pval>max_pval").otherwise("")
        reasons.append(F.struct(F.lit(name).alias("name"), why.alias("why")))
        pvals.append(p)
    pairs = pairs.withColumn("failed", F.filter(F.array(*reasons), lambda x: x["why"] != ""))
    passed = F.size("failed") == 0 if test.mode == "strong" else F.size("failed") < len(groups)
    rescue = F.abs(F.col("delta")) >= test.rescue_delta if test.rescue_delta is not None else F.lit(False)
    last, far = F.col("next_site").isNull(), F.col("next_pos") - F.col("pos") > test.max_distance
    rescue = F.coalesce(rescue, F.lit(False))
    reason = F.when(last, "end-of-input").when(far, "exceeded max distance").when(rescue, "abs(delta_beta)>=force_connect_delta_beta").when(passed, "").otherwise(F.col("failed")[0]["why"])
    pval = F.when(~last & ~far & ~rescue, F.greatest(*pvals) if len(pvals) > 1 else pvals[0])
    names = F.transform("failed", lambda x: x["name"])
    failing = F.when(~last & ~far & ~rescue & ~passed, names[0] if test.mode == "strong" else F.array_join(names, ";"))
    return pairs.select("site", "chr", "pos", "next_site", F.coalesce(~last & ~far & (rescue | passed), F.lit(False)).alias("connected"), pval.alias("pval"), reason.alias("reason"), failing.alias("failing"), "delta")


def bridge(edge: DataFrame, spans: dict[int, DataFrame]) -> DataFrame:
    """Connects runs over gaps where the pair across the gap passes the test; spans: by gap, `edges` with that step.

    For every allowance from 1 to the largest gap, passes over the gaps up to it are repeated until nothing changes.  A pass
    first tests, for every run that begins at site s, the pair (s - gap, s), then, for every run that ends at site e, the pair
    (e, e + gap).  A pair that passes connects all edges between its sites; the edge at its first site takes the pair's
    p-value and reason, the others that were not connected the reason `bridged`.  A gap of 1 asks a failed edge again.
    """
    w = Window.partitionBy("chr").orderBy("pos")
    now = edge
    for gap, span in spans.items():
        now = now.join(span.select("site", F.struct("connected", "pval", "reason").alias(f"span_{gap}")), "site")

    def joined(x: DataFrame, gap: int, hit: Column) -> DataFrame:
        x = x.withColumn("hit", F.coalesce(hit & F.col(f"span_{gap}.connected"), F.lit(False)))
        inside = F.max("hit").over(w.rowsBetween(1 - gap, 0))
        new = inside & ~F.col("connected")
        x = x.withColumn("new", new).withColumn("changed", F.col("changed") | F.col("new"))
        reason = F.when(F.col("hit"), F.col(f"span_{gap}.reason")).when(F.col("new"), "bridged").otherwise(F.col("reason"))
        pval = F.when(F.col("hit"), F.col(f"span_{gap}.pval")).otherwise(F.col("pval"))
        failing = F.when(F.col("hit") | F.col("new"), F.lit(None).cast("string")).otherwise(F.col("failing"))
        return x.withColumns({"pval": pval, "reason": reason, "failing": failing, "connected": F.col("connected") | F.col("new")}).drop("hit", "new")

    def cycle(x: DataFrame, most: int) -> DataFrame:
        for gap in range(1, most + 1):
            begins = F.col("connected") & ~F.coalesce(F.lag("connected").over(w), F.lit(False))
            x = x.withColumn("begins", begins)
            x = joined(x, gap, F.lead("begins", gap).over(w)).drop("begins")
            ended = F.lag("connected").over(w) & ~F.col("connected")  # the run's last site
            x = joined(x, gap, ended)
        return x

    for most in range(1, max(spans) + 1):
        while True:
            now = checkpointed(cycle(now.drop("changed").withColumn("changed", F.lit(False)), most))
            if now.where("changed").isEmpty():
                break
    return now.drop("changed", *(f"span_{g}" for g in spans))
