"""Sequence motifs: orientation, position weight matrices, consensus, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def oriented(seq: Column, flank: int) -> Column:
    """A window with its centre on C: complement if the centre is G, then reverse-complement if the centre is no C but G follows."""
    at = lambda s, k: F.substring(s, k, 1)
    one = F.when(at(seq, flank + 1) == "G", F.translate(seq, "ACGT", "TGCA")).otherwise(seq)
    return F.when((at(one, flank + 1) != "C") & (at(one, flank + 2) == "G"), reverse_complement(one)).otherwise(one)


def windows(seq: Column, flank: int, pairs: tuple[str, ...]) -> Column:
    """All windows of 2 flank + 2 letters whose middle two are one of the pairs, in order; overlapping ones too."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{flank}}}(?:{'|'.join(pairs)}).{{{flank}}}))"), F.lit(1))


def pwm(windows: DataFrame, key: str, seq: str, width: int) -> DataFrame:
    """key, place (from 1), share of A, C, G, T at the place, and the first most frequent base."""
    x = windows.select(key, F.posexplode(F.array(*(F.substring(F.col(seq), k, 1) for k in range(1, width + 1)))).alias("p", "base"))
    share = [F.sum(F.when(F.col("base") == b, 1).otherwise(0)).cast("double").alias(b) for b in BASES]
    x = x.where(F.col("base").isin(*BASES)).groupBy(key, (F.col("p") + 1).cast("long").alias("place")).agg(*share)
    n = sum((F.col(b) for b in BASES[1:]), F.col("A"))
    top = F.greatest(*(F.col(b) for b in BASES))
    best = F.when(F.col("A") == top, "A").when(F.col("C") == top, "C").when(F.col("G") == top, "G").otherwise("T")
    return x.select(key, "place", *((F.col(b) / n).alias(f"f_{b.lower()}") for b in BASES), best.alias("base"))
