"""Feature engineering over transaction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def hour(ts: Column) -> Column:
    """Hour of day."""
    return F.hour(ts)


def weekday(ts: Column) -> Column:
    """Day of week, Monday 0."""
    return F.weekday(ts)


def age_years(ts: Column, birth: Column) -> Column:
    """Whole days since birth over 365.25."""
    return F.datediff(ts, birth) / 365.25


def age_at(year: int, birth: Column) -> Column:
    """A year less the birth year."""
    return F.lit(year) - F.year(birth)


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    return F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere, by the arc sine."""
    return 2 * EARTH_KM * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def haversine_atan(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same, by the two-argument arc tangent."""
    h = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """column and code: rank of each distinct value, from 0, in order.

    One task ranks the distinct values, which are few for a category.
    """
    return df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)


def label_encode(df: DataFrame, column: str, name: str, codes: DataFrame | None = None) -> DataFrame:
    """``df`` with the code of a column; values not in ``codes`` get null."""
    codes = label_codes(df, column) if codes is None else codes
    return df.join(codes.withColumnRenamed("code", name), column, "left")


def is_value(column: Column, value: str) -> Column:
    """1 for the value, 0 for others and null."""
    return F.coalesce((column == value).cast("int"), F.lit(0))


def fit_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; no spread counts as 1."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """``df`` with each fitted column turned into its z-score."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in fitted.items()})


def meta_features(p1: Column, p2: Column, amount: Column) -> list[Column]:
    """Features of the second level of a stack."""
    return [p1.alias("p1"), p2.alias("p2"), amount.alias("amount"), F.log1p(amount).alias("log_amount")]


def card_features(df: DataFrame, category_codes: DataFrame | None = None) -> DataFrame:
    """All features of the card schema in one projection and one small join."""
    ts = F.col("trans_date_trans_time")
    out = label_encode(df, "category", "category_code", category_codes)
    return out.select(
        F.col("amt"),
        F.log1p("amt").alias("log_amt"),
        hour(ts).alias("hour"),
        weekday(ts).alias("weekday"),
        age_years(ts, F.col("dob")).alias("age"),
        F.col("city_pop"),
        haversine_asin(F.col("lat"), F.col("long"), F.col("merch_lat"), F.col("merch_long")).alias("distance_km"),
        F.col("category_code"),
        is_value(F.col("gender"), "M").alias("is_male"),
        *[F.col(c) for c in ("lat", "long", "merch_lat", "merch_long", "is_fraud")],
    ).fillna(0)
