"""Synthetic labelled sets, generated on the executors from row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_features(spark: SparkSession, n: int, k: int, rate: float, seed: int = 42) -> DataFrame:
    """id, f0..f{k-1} uniform on [-1, 1], y and amount.

    Labels are drawn at ``rate``; the first k rows are positive and shifted by
    2 on f0. Amounts are 500 or 100 times a uniform on [0.5, 2].
    """
    df = spark.range(n).withColumn("y", ((F.col("id") < k) | (F.rand(seed) < rate)).cast("int"))
    for j in range(k):
        df = df.withColumn(f"f{j}", F.rand(seed + 1 + j) * 2 - 1)
    df = df.withColumn("f0", F.col("f0") + F.when(F.col("id") < k, 2.0).otherwise(0.0))
    return df.withColumn("amount", F.when(F.col("y") == 1, 500.0).otherwise(100.0) * (F.rand(seed + 1000) * 1.5 + 0.5))


def normal_features(spark: SparkSession, n: int, rate: float, seed: int = 42, k: int = 20, value_ratio: float = 1.0, heavy: bool = False) -> DataFrame:
    """id, k normal features (the first five shifted for positives), y, amount.

    Amounts are lognormal; positives are multiplied by ``value_ratio`` times a
    uniform on [3, 8], with ``heavy`` a tenth of them by one on [5, 15] more.
    """
    df = spark.range(n).withColumn("y", (F.rand(seed) < rate).cast("int"))
    for j in range(k):
        df = df.withColumn(f"f{j}", F.randn(seed + 1 + j) + (F.col("y") * 1.5 if j < 5 else 0.0))
    times = F.when(F.col("y") == 1, value_ratio * (F.rand(seed + 501) * 5 + 3)).otherwise(1.0)
    if heavy:
        times = times * F.when((F.col("y") == 1) & (F.rand(seed + 502) < 0.1), F.rand(seed + 503) * 10 + 5).otherwise(1.0)
    return df.withColumn("amount", F.exp(F.randn(seed + 500) + 4) * times)
