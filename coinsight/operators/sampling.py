"""Sampling and splitting: exact sizes, stratified, the same on every run.

Rows are taken by the key, or by a hash of it, in each class. The row where a
class is cut is found from counts per slice of that order, so the rows
themselves are only compared with it: no class is gathered or sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordering


def _sliced(df: DataFrame, key: str, seed: int | None) -> tuple[DataFrame, list[str]]:
    """``df`` with the slice __s of its order, and the columns of that order."""
    if seed is None:
        return df.withColumn("__s", ordering.range_slice(df, key)), [key]
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    return hashed.withColumn("__s", ordering.hash_slice(F.col("__h"))), ["__h", key]


def class_rank(df: DataFrame, y: str, key: str, seed: int | None = None) -> DataFrame:
    """``df`` with __r, the row's rank in its class from 1, and __n, its size."""
    sliced, order = _sliced(df, key, seed)
    per = sliced.groupBy(y, "__s").agg(F.count("*").alias("__c"))
    # One row per class and slice.
    w = Window.partitionBy(y)
    offset = per.select(F.col(y).alias("__y"), F.col("__s").alias("__t"), (F.sum("__c").over(w.orderBy("__s")) - F.col("__c")).alias("__b"), F.sum("__c").over(w).alias("__n"))
    ranked = sliced.withColumn("__k", F.row_number().over(Window.partitionBy(y, "__s").orderBy(*order)))
    joined = ranked.join(F.broadcast(offset), F.col(y).eqNullSafe(F.col("__y")) & (F.col("__s") == F.col("__t")))
    return joined.withColumn("__r", F.col("__b") + F.col("__k")).drop("__h", "__s", "__t", "__y", "__b", "__k")


def class_cut(df: DataFrame, y: str, key: str, seed: int | None, wanted: Callable[[object, int], int]) -> DataFrame:
    """``df`` with __in: whether a row is among the first ``wanted(class, size)`` of its class."""
    sliced, order = _sliced(df, key, seed)
    asked: dict = {}

    def ranks(c, size: int) -> list[int]:
        asked[c] = (wanted(c, size), size)
        return [asked[c][0]] if 0 < asked[c][0] < size else []

    found = ordering.rows_at(sliced, order, ranks, y)
    inside = F.lit(False)
    for c, (want, size) in asked.items():
        own = F.col(y).eqNullSafe(F.lit(c))
        if want >= size:
            inside = F.when(own, True).otherwise(inside)
        elif want > 0:
            inside = F.when(own, ordering.up_to(sliced, order, found[c, want])).otherwise(inside)
    return sliced.withColumn("__in", inside).drop("__h", "__s")


def natural_rate(df: DataFrame, n: int, y: str, key: str, seed: int | None = None) -> DataFrame:
    """``n`` rows at the share of positives that ``df`` has."""
    size, hits = df.agg(F.count("*"), F.sum(y)).first()
    n_hits = int(n * ((hits or 0) / size)) if size else 0
    return class_cut(df, y, key, seed, lambda c, _: n_hits if c == 1 else n - n_hits).filter("__in").drop("__in")


def natural_rate_replaced(df: DataFrame, n: int, rate: float, y: str, key: str, seed: int | None = None) -> DataFrame:
    """As above at a given rate; too few positives are repeated in turn."""
    n_hits, size = int(n * rate), df.filter(F.col(y) == 1).count()
    cut = class_cut(df, y, key, seed, lambda c, k: n_hits % k if c == 1 else n - n_hits)
    times = F.col("__in").cast("int") + F.when(F.col(y) == 1, n_hits // max(1, size)).otherwise(0)
    return cut.withColumn("__t", times).filter("__t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__t").cast("long")))).drop("__in", "__t")


def keep_positives(df: DataFrame, most: int, y: str, key: str, seed: int | None = None) -> DataFrame:
    """All positives and at most ``most`` others."""
    return class_cut(df.filter(F.col(y).isin(0, 1)), y, key, seed, lambda c, size: size if c == 1 else most).filter("__in").drop("__in")


def stratified_split(df: DataFrame, share: float, y: str, key: str, seed: int | None = None) -> DataFrame:
    """``df`` with is_test for the first round(share * class size) of a class."""
    return class_cut(df, y, key, seed, lambda _, size: math.floor(size * share + 0.5)).withColumnRenamed("__in", "is_test")


def early_stop_split(df: DataFrame, share: float, y: str, key: str, seed: int | None = None) -> DataFrame:
    """``df`` with is_val: int(share * n) rows, of which max(1, int(share * positives)) are positive."""
    n, hits = df.agg(F.count("*"), F.sum(y)).first()
    n_val = int(n * share)
    n_hits = min(hits or 0, max(1, int((hits or 0) * share)))
    return class_cut(df, y, key, seed, lambda c, _: n_hits if c == 1 else n_val - n_hits).withColumnRenamed("__in", "is_val")


def folds(df: DataFrame, k: int, y: str, key: str, seed: int | None = None) -> DataFrame:
    """``df`` with fold, dealt in turn within each class."""
    return class_rank(df, y, key, seed).withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k))).drop("__r", "__n")


def time_splits(df: DataFrame, k: int, ts: str, key: str) -> DataFrame:
    """fold, role and row for k expanding windows over time.

    Each test part has n div (k + 1) rows; all earlier rows train. Rows are
    compared with the last row before each boundary.
    """
    sliced = df.withColumn("__s", F.coalesce(ordering.range_slice(df, ts), F.lit(-1)))
    bounds: list[int] = []

    def ranks(_, n: int) -> list[int]:
        size = n // (k + 1)
        bounds.extend(n - (k - fold) * size for fold in range(k + 1))
        return bounds

    found = ordering.rows_at(sliced, [ts, key], ranks)
    if not bounds:
        return df.withColumn("fold", F.lit(0)).withColumn("role", F.lit("train")).limit(0)
    before = [ordering.up_to(sliced, [ts, key], found[None, b]) if b > 0 else F.lit(False) for b in bounds]
    roles = F.array(*[F.when(before[f], "train").when(before[f + 1], "test") for f in range(k)])
    return sliced.select("*", F.posexplode(roles).alias("fold", "role")).filter("role is not null").drop("__s")


def exact_share(df: DataFrame, share: float, key: str, seed: int) -> DataFrame:
    """int(share * n) rows chosen by a hash of the key.

    The hash of the last row is found from counts per slice of it; rows are
    only compared with that.
    """
    order = ["__h", key]
    marked = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    asked: list[int] = []

    def ranks(_, n: int) -> list[int]:
        asked.extend((int(share * n), n))
        return [asked[0]]

    found = ordering.rows_at(marked.select(*order).withColumn("__s", ordering.hash_slice(F.col("__h"))), order, ranks)
    if not asked or asked[0] >= asked[1]:
        return df
    return marked.filter(ordering.up_to(marked, order, found[None, asked[0]]) if asked[0] else F.lit(False)).drop("__h")


def feature_subset(features: list[str], share: float, seed: int) -> list[str]:
    """max(1, int(share * k)) features, in their own order."""
    import random

    return sorted(random.Random(seed).sample(features, max(1, int(share * len(features)))), key=features.index)
