"""Calibrated probabilities (I10): isotonic regression on the hold-out.

Boosted margins rank well but their logistic is no probability.  Hold-out scores
are counted by bin (one aggregate, at most ``BINS`` rows whatever the input), and
pooling adjacent violators over the bins gives the monotone map from score to
observed share.  The map is a table that is applied as a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1000


def score_bin(score: F.Column, bins: int = BINS) -> F.Column:
    """0 .. bins - 1 for scores of 0 .. 1 (1 counts to the last bin)."""
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def binned(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, n, positives, mean_score) of rows (label, score); null scores are left out."""
    return rows.where("score IS NOT NULL").groupBy(score_bin(F.col("score"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"), F.avg("score").alias("mean_score"))


def pool(counts: list[tuple[int, int]]) -> list[float]:
    """Isotonic shares of (n, positives) in order: neighbours that fall are pooled."""
    blocks: list[list[int]] = []  # n, positives, bins
    for n, pos in counts:
        blocks.append([n, pos, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, pos, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + pos, blocks[-1][2] + k]
    return [pos / n for n, pos, k in blocks for _ in range(k)]


@dataclass
class Calibration:
    """The calibrated probability of each score bin, never falling."""
    shares: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: DataFrame, bins: int = BINS) -> "Calibration":
        """From rows (label, score); without any the map leaves scores as they are."""
        seen = sorted(tuple(r) for r in binned(rows, bins).select("bin", "n", "positives").collect())
        at = dict(zip((b for b, _, _ in seen), pool([(n, p) for _, n, p in seen])))
        shares, share = [], seen and at[seen[0][0]]
        for b in range(bins if seen else 0):
            share = at.get(b, share)   # an empty bin has the share of the one below
            shares.append(share)
        return cls(shares)

    def column(self, score: F.Column) -> F.Column:
        if not self.shares:
            return score
        table = F.array(*[F.lit(float(s)) for s in self.shares])
        return F.get(table, score_bin(score, len(self.shares)))


def calibration_table(rows: DataFrame) -> DataFrame:
    """(bin, n, positives, calibrated) of the bins that rows (label, score) fill."""
    fit = Calibration.fit(rows)
    return binned(rows).select("bin", "n", "positives", fit.column((F.col("bin") + 0.5) / BINS).alias("calibrated"))


def calibration_error(rows: DataFrame, bins: int = 10) -> float:
    """Mean gap between score and observed share by bin, weighted by rows."""
    gap = F.abs(F.col("mean_score") - F.col("positives") / F.col("n"))
    return binned(rows, bins).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("e")).first()["e"] or 0.0
