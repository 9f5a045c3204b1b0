"""Pareto frontier over a threshold sweep, and recommended thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

OBJECTIVES = ("precision", "recall", "vdr", "net_savings", "roi")
#: Strategy and the metric that it takes the greatest value of.
STRATEGIES = (("max_vdr", "vdr"), ("max_savings", "net_savings"), ("min_fps", "precision"), ("balanced", "f1"), ("max_roi", "roi"))


def finite(c: Column) -> Column:
    """NaN and null as 0, infinities as plus or minus a million."""
    inf = F.lit(float("inf"))
    return F.when(c.isNull() | F.isnan(c), 0.0).when(c == inf, 1e6).when(c == -inf, -1e6).otherwise(c)


def frontier(swept: DataFrame) -> DataFrame:
    """The rows of a sweep that no other row dominates; equal rows all stay.

    A sweep has a few hundred rows at any size of data, so all are compared.
    They are gathered, so the sweep is computed once: sums of doubles may differ
    in their last digits when they are added anew, and a row must not lose
    against another sum of itself.
    """
    rows = swept.select(F.struct(*swept.columns).alias("row"), F.struct(*[F.round(finite(F.col(o).cast("double")), 9).alias(o) for o in OBJECTIVES]).alias("key"))
    every = rows.agg(F.collect_list(F.struct("row", "key")).alias("all")).select("all", F.explode("all").alias("one"))

    def dominates(other: Column) -> Column:
        as_good = better = None
        for o in OBJECTIVES:
            a, b = other["key"][o], F.col(f"one.key.{o}")
            as_good, better = (a >= b, a > b) if as_good is None else (as_good & (a >= b), better | (a > b))
        return as_good & better

    return every.filter(~F.exists("all", dominates)).select("one.row.*")


def recommendations(front: DataFrame) -> DataFrame:
    """strategy and the row of the frontier it takes, the lowest threshold of equal ones.

    One aggregation takes all strategies.
    """
    best = []
    for name, metric in STRATEGIES:
        row = F.struct(F.lit(name).alias("strategy"), *front.columns)
        allowed = ~F.col(metric).isin(float("inf"), float("-inf")) if name == "max_roi" else F.lit(True)
        # Rows left out have a null key, which max_by passes over.
        best.append(F.max_by(row, F.when(allowed & F.col(metric).isNotNull(), F.struct(F.round(metric, 9), -F.col("t")))))
    return front.agg(F.array(*best).alias("b")).select(F.explode("b").alias("b")).filter("b is not null and b.t is not null").select("b.*")


def fit(df: DataFrame, cost: float = 100.0, thresholds: DataFrame | None = None, tidy: Callable[[DataFrame], DataFrame] = lambda swept: swept, **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sweep, frontier and recommendations; ``tidy`` may round the sweep, before rows are compared."""
    swept = tidy(metrics.sweep(df, metrics.default_grid(df.sparkSession) if thresholds is None else thresholds, cost, **more))
    front = frontier(swept)
    return swept, front, recommendations(front)


def recommend(recommended: DataFrame, strategy: str = "max_savings") -> DataFrame:
    """One recommendation by name."""
    if strategy not in dict(STRATEGIES):
        raise ValueError(f"unknown strategy: {strategy}")
    return recommended.filter(F.col("strategy") == strategy)


def at_index(swept: DataFrame, index: int) -> DataFrame:
    """The metrics of one threshold, by its number."""
    return swept.filter(F.col("t_id") == index)


def report(recommended: DataFrame) -> DataFrame:
    """A line of text per strategy."""
    line = F.format_string("%s: threshold %.2f, precision %.3f, recall %.3f, net savings %.2f, flagged cases %d", "strategy", "t", "precision", "recall", "net_savings", F.col("tp") + F.col("fp"))
    return recommended.select("strategy", line.alias("line"))
