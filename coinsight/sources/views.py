"""Labelled, scored views over the test tables, and the CSV source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, rows: int | None = None) -> DataFrame:
    """A CSV file with header; the schema is given, so no pass infers it."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df if rows is None else df.limit(rows)


def without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN becomes null, the one form of a missing number here."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with label, amount, a fixed rational score and a group."""
    score = 0.4 * F.col("l_quantity") / 50.0 + 0.3 * F.col("l_discount") / 0.1 + 0.3 * F.col("l_tax") / 0.08
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), score.alias("p"), F.col("l_extendedprice").alias("amount"), F.col("l_linestatus").alias("grp"))


SCORED = """(SELECT CAST(l_returnflag = 'R' AS INT) AS y, 0.4e0 * l_quantity / 50e0 + 0.3e0 * l_discount / 0.1e0 + 0.3e0 * l_tax / 0.08e0 AS p,
  l_extendedprice AS amount, l_linestatus AS grp FROM lineitem)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a unique id, label, amount and time."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))


ORDERS = """(SELECT o_orderkey AS id, CAST(o_orderpriority = '1-URGENT' AS INT) AS y, o_totalprice AS amount, o_orderdate AS ts, o_custkey AS cust, o_orderstatus AS status FROM orders)"""


def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small training set with gradients; f1 has missing values."""
    li = table(spark, sf_dir, "lineitem")
    y = (F.col("l_returnflag") == "R").cast("double")
    return li.select(
        F.col("l_quantity").alias("f0"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("f1"),
        F.col("l_tax").alias("f2"),
        y.cast("int").alias("y"),
        F.col("l_extendedprice").alias("amount"),
        (0.25 - y).alias("g"),
        F.lit(0.1875).alias("h"),
    )


TREE_ROWS = """(SELECT l_quantity AS f0, CASE WHEN l_linenumber <> 3 THEN l_discount END AS f1, l_tax AS f2, CAST(l_returnflag = 'R' AS INT) AS y,
  l_extendedprice AS amount, 0.25e0 - CAST(l_returnflag = 'R' AS INT) AS g, 0.1875e0 AS h FROM lineitem)"""
