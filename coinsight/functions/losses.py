"""Losses as column expressions: value, gradient and hessian per row.

``w_fn`` and ``w_fp`` weigh missed positives and false alarms. The gradient of
the value-weighted loss is that of a sample-weighted log loss in the logit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-15
LEAST_HESSIAN = 1e-8


def sigmoid(x: Column) -> Column:
    """Stable in both directions."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clipped(p: Column) -> Column:
    """A probability kept off 0 and 1."""
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def exact_median(df: DataFrame, column: str) -> float | None:
    """Median of a column; equal values are counted before they meet."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).count()
    return counts.agg(F.expr("percentile(v, 0.5, count)")).first()[0]


@dataclass(frozen=True)
class ValueWeighted:
    """Missed positives cost their amount, false alarms a fixed cost.

    Both are relative to the median of positive amounts (``scope`` 'all'), or
    of all amounts of positives ('fraud').
    """

    fp_cost: float = 100.0
    scope: str = "all"

    def weigh(self, df: DataFrame, y: str = "y", amount: str | None = "amount") -> DataFrame:
        """``df`` with w_fn and w_fp; both 1 without amounts."""
        if amount is None:
            return df.withColumns({"w_fn": F.lit(1.0), "w_fp": F.lit(1.0)})
        seen = df.filter(F.col(amount) > 0) if self.scope == "all" else df.filter(F.col(y) > 0)
        median = exact_median(seen, amount) or 1.0
        return df.withColumns({"w_fn": F.col(amount) / median, "w_fp": F.lit(self.fp_cost / median)})

    def value(self, y: Column, p: Column) -> Column:
        p = clipped(p)
        return -(y * F.col("w_fn") * F.log(p) + (1 - y) * F.col("w_fp") * F.log(1 - p))

    def gradient(self, y: Column, p: Column) -> Column:
        p = clipped(p)
        return -y * F.col("w_fn") * (1 - p) + (1 - y) * F.col("w_fp") * p

    def hessian(self, y: Column, p: Column) -> Column:
        p = clipped(p)
        return F.greatest(p * (1 - p) * (y * F.col("w_fn") + (1 - y) * F.col("w_fp")), F.lit(LEAST_HESSIAN))


@dataclass(frozen=True)
class Focal:
    """Down-weighs easy rows. The gradient leaves out the focusing term's own."""

    alpha: float = 0.25
    gamma: float = 2.0

    def weigh(self, df: DataFrame, y: str = "y", amount: str | None = None) -> DataFrame:
        return df

    def _scale(self, y: Column, p: Column) -> Column:
        hit = F.when(y == 1, p).otherwise(1 - p)
        return F.when(y == 1, self.alpha).otherwise(1 - self.alpha) * F.pow(1 - hit, F.lit(self.gamma))

    def value(self, y: Column, p: Column) -> Column:
        p = clipped(p)
        return -self._scale(y, p) * F.log(F.when(y == 1, p).otherwise(1 - p))

    def gradient(self, y: Column, p: Column) -> Column:
        p = clipped(p)
        return self._scale(y, p) * (p - y)

    def hessian(self, y: Column, p: Column) -> Column:
        p = clipped(p)
        return F.greatest(self._scale(y, p) * p * (1 - p), F.lit(LEAST_HESSIAN))


@dataclass(frozen=True)
class LogLoss:
    """Log loss with optional sample weights; the mean is not weighted."""

    def weigh(self, df: DataFrame, y: str = "y", amount: str | None = "amount") -> DataFrame:
        return df.withColumn("w", F.lit(1.0) if amount is None else F.col(amount).cast("double"))

    def value(self, y: Column, p: Column) -> Column:
        p = clipped(p)
        return -F.col("w") * (y * F.log(p) + (1 - y) * F.log(1 - p))

    def gradient(self, y: Column, p: Column) -> Column:
        return F.col("w") * (clipped(p) - y)

    def hessian(self, y: Column, p: Column) -> Column:
        p = clipped(p)
        return F.greatest(F.col("w") * p * (1 - p), F.lit(LEAST_HESSIAN))


LOSSES = {"value_weighted": ValueWeighted, "focal": Focal, "logloss": LogLoss}


def loss_of(loss, fp_cost: float = 100.0):
    """A loss by name, or an object with the four methods as it is."""
    if isinstance(loss, str):
        if loss not in LOSSES:
            raise ValueError(f"unknown loss: {loss}")
        return ValueWeighted(fp_cost) if loss == "value_weighted" else LOSSES[loss]()
    return loss


def mean_loss(df: DataFrame, loss, y: str = "y", p: str = "p", amount: str | None = "amount") -> DataFrame:
    """One row: the mean loss."""
    return loss.weigh(df, y, amount).agg(F.avg(loss.value(F.col(y), F.col(p))).alias("loss"))


def with_derivatives(df: DataFrame, loss, y: str = "y", p: str = "p", amount: str | None = "amount") -> DataFrame:
    """``df`` with gradient g and hessian h."""
    out = loss.weigh(df, y, amount)
    return out.withColumns({"g": loss.gradient(F.col(y), F.col(p)), "h": loss.hessian(F.col(y), F.col(p))})
