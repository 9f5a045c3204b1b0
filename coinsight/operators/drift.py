"""Population drift: reference histograms, stability index, decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .ordering import SLICES

FLOOR = 1e-8
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


@dataclass(frozen=True)
class DriftParams:
    """Thresholds of the decisions."""

    psi_threshold: float = 0.2
    performance_threshold: float = 0.05
    min_samples: int = 1000
    time_decay: float = 0.95


def unpivot(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, v: one row per row and feature, missing values left out."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    return df.select(F.expr(f"stack({len(features)}, {pairs}) as (feature, v)")).filter("v is not null and not isnan(v)")


def reference_edges(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, edges and the moments of each feature.

    Up to ten distinct values: each value less a half, and the last plus a
    half. Else 21 percentiles without repeats; if fewer than three remain, the
    range cut in two. Percentiles are exact: values are counted, ranked within
    slices of the feature's range, and only those at a wanted rank are kept.
    """
    counted = unpivot(df, features).groupBy("feature", "v").agg(F.count("*").alias("c"))
    stats = _stats(counted, df, features)
    edges = F.when(F.col("distinct") <= 10, F.concat(F.transform("few", lambda x: x - 0.5), F.array(F.element_at("few", -1) + 0.5)))
    dedup = F.array_distinct("p")
    edges = edges.otherwise(F.when(F.size(dedup) < 3, F.array(F.col("lo"), (F.col("lo") + F.col("hi")) / 2, F.col("hi"))).otherwise(dedup))
    return stats.withColumn("edges", edges).select("feature", "n", "mean", "std", "quantiles", "edges")


def _stats(counted: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    """Moments, percentiles and the first values of each feature."""
    cuts = df.agg(*[F.percentile_approx(F.col(f).cast("double"), [k / SLICES for k in range(1, SLICES)], 10 * SLICES).alias(f) for f in features]).first()
    known = df.sparkSession.createDataFrame([(f, sorted(set(x for x in cuts[f] or [] if x == x))) for f in features], "feature string, cuts array<double>")
    # Rising cuts of a feature: how many lie below a value, by halving steps.
    steps = [1 << k for k in reversed(range(SLICES.bit_length()))]
    place = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda i, x: F.when((i + x <= F.size("cuts")) & (F.get("cuts", i + x - 1) < F.col("v")), i + x).otherwise(i))
    sliced = counted.join(F.broadcast(known), "feature").select("feature", "v", "c", place.alias("s"))
    # One row per feature and slice from here on.
    per = sliced.groupBy("feature", "s").agg(F.sum("c").alias("sc"), F.count("*").alias("sd"), F.sum(F.col("v") * F.col("c")).alias("sv"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    w, whole = Window.partitionBy("feature").orderBy("s").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    offset = per.select(
        "feature", "s", F.coalesce(F.sum("sc").over(w), F.lit(0)).alias("before"), F.sum("sc").over(whole).alias("n"), F.sum("sd").over(whole).alias("distinct"),
        (F.sum("sv").over(whole) / F.sum("sc").over(whole)).alias("mean"), F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"),
    )
    inside = Window.partitionBy("feature", "s").orderBy("v")
    ranked = sliced.withColumn("upto", F.sum("c").over(inside)).join(F.broadcast(offset), ["feature", "s"]).withColumn("last", F.col("before") + F.col("upto"))
    first = F.col("last") - F.col("c")  # ranks first..last - 1 hold the value
    shares = [*[k / 20.0 for k in range(21)], *QUANTILES]
    ends = [(F.floor if low else F.ceil)(F.lit(q) * (F.col("n") - 1)) for q in shares for low in (True, False)]
    found = ranked.groupBy("feature").agg(
        F.first("n").alias("n"), F.first("distinct").alias("distinct"), F.first("mean").alias("mean"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.sqrt(F.sum(F.col("c") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))) / F.first("n")).alias("std"),
        F.sort_array(F.collect_list(F.when(F.col("distinct") <= 10, F.col("v")))).alias("few"),
        F.array(*[F.max(F.when((first <= r) & (r < F.col("last")), F.col("v"))) for r in ends]).alias("e"),
    )
    between = lambda i, q: F.get("e", F.lit(2 * i)) + (F.get("e", F.lit(2 * i + 1)) - F.get("e", F.lit(2 * i))) * (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)))
    points = [between(i, q) for i, q in enumerate(shares)]
    return found.withColumn("p", F.array(*points[:21])).withColumn("quantiles", F.array(*points[21:]))


def _binned(df: DataFrame, reference: DataFrame, features: list[str]) -> DataFrame:
    """feature, bin (null: outside), and the sums of each feature's values there.

    Values go straight into their bin, so what is shuffled is a row per bin.
    """
    placed = unpivot(df, features).join(F.broadcast(reference.select("feature", "edges", F.col("mean").alias("m0"))), "feature")
    inside = (F.col("v") >= F.element_at("edges", 1)) & (F.col("v") <= F.element_at("edges", -1))
    b = F.when(inside, F.least(F.size(F.filter("edges", lambda e: e <= F.col("v"))), F.size("edges") - 1) - 1)
    gap = F.col("v") - F.col("m0")  # from the reference's mean, which keeps squares small
    return placed.groupBy("feature", b.alias("bin")).agg(F.count("*").alias("c"), F.sum(gap).alias("s1"), F.sum(gap * gap).alias("s2"))


def _features(reference: DataFrame) -> list[str]:
    return sorted(r["feature"] for r in reference.select("feature").collect())


def histogram(df: DataFrame, reference: DataFrame, features: list[str] | None = None) -> DataFrame:
    """feature, bin, c: values in each bin; the last bin is closed, values outside are left out."""
    return _binned(df, reference, features or _features(reference)).filter("bin is not null").select("feature", "bin", "c")


def _shares(hist: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    bins = reference.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    total = hist.groupBy("feature").agg(F.sum("c").alias("t"))
    full = bins.join(hist, ["feature", "bin"], "left").join(total, "feature", "left")
    return full.select("feature", "bin", F.when(F.col("t") > 0, F.greatest(F.coalesce("c", F.lit(0)) / F.col("t"), F.lit(FLOOR))).alias(name))


def _psi(r: DataFrame, c: DataFrame, reference: DataFrame) -> DataFrame:
    both = _shares(r, reference, "r").join(_shares(c, reference, "c"), ["feature", "bin"])
    return both.groupBy("feature").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def held(found: DataFrame) -> DataFrame:
    """A small result, a row per feature and bin at most, kept by the driver."""
    return found.sparkSession.createDataFrame(found.collect(), found.schema)


def stability(reference: DataFrame, base: DataFrame, current: DataFrame) -> DataFrame:
    """feature and psi; null where no current value is in range."""
    reference = held(reference)
    return _psi(histogram(base, reference), histogram(current, reference), reference)


def summary(reference: DataFrame, base: DataFrame, current: DataFrame) -> DataFrame:
    """feature, psi, mean_shift and std_ratio, each table read once."""
    reference = held(reference)
    features = _features(reference)
    now = held(_binned(current, reference, features))
    psi = _psi(held(histogram(base, reference, features)), now.filter("bin is not null").select("feature", "bin", "c"), reference)
    moments = now.groupBy("feature").agg(F.sum("c").alias("k"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("k") - (F.col("s1") / F.col("k")) ** 2, F.lit(0.0)))
    return psi.join(reference.join(moments, "feature", "left"), "feature").select("feature", "psi", (F.col("s1") / F.col("k")).alias("mean_shift"), (spread / F.greatest("std", F.lit(FLOOR))).alias("std_ratio"))


def detect(found: DataFrame, params: DriftParams = DriftParams()) -> DataFrame:
    """One row: drifted features, mean psi, overall flag."""
    over = F.col("psi") > params.psi_threshold
    return found.agg(
        F.array_join(F.array_sort(F.collect_list(F.when(over, F.col("feature")))), ",").alias("drifted"),
        F.count(F.when(over, 1)).alias("n_drifted"),
        F.avg("psi").alias("mean_psi"),
        (F.avg("psi") > params.psi_threshold).alias("overall"),
    )


def performance(base: DataFrame, current: DataFrame, params: DriftParams = DriftParams(), y: str = "y", p: str = "p") -> DataFrame:
    """metric, reference, current, drop and significant for precision, recall and AUC."""
    rows = base.select(y, p, F.lit("reference").alias("part")).unionByName(current.select(y, p, F.lit("current").alias("part")))
    flagged = rows.withColumn("flag", (F.col(p) >= 0.5).cast("int")).withColumn("amount", F.lit(0.0))
    label = metrics.label_metrics(flagged, ["precision", "recall"], y=y, by=["part"])
    wide = label.join(metrics.roc_auc(rows, y, p, ["part"]), "part")
    long = wide.select("part", F.expr("stack(3, 'precision', precision, 'recall', recall, 'auc', auc) as (metric, v)"))
    out = long.groupBy("metric").agg(F.max(F.when(F.col("part") == "reference", F.col("v"))).alias("reference"), F.max(F.when(F.col("part") == "current", F.col("v"))).alias("current"))
    return out.withColumn("drop", F.col("reference") - F.col("current")).withColumn("significant", F.col("drop") > params.performance_threshold)


def prediction_stats(df: DataFrame, p: str = "p") -> DataFrame:
    """Mean, deviation, share of confident scores and mean entropy."""
    c = F.col(p)
    q = F.least(F.greatest(c, F.lit(FLOOR)), F.lit(1 - FLOOR))
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.avg(((c > 0.9) | (c < 0.1)).cast("double")).alias("confident"), F.avg(-(q * F.log(q) + (1 - q) * F.log(1 - q))).alias("entropy"))


def recommendation(decision: DataFrame, degraded: bool = False) -> DataFrame:
    """What to do about a decision row."""
    action = F.when(F.lit(degraded), "retrain_immediately").when(F.col("overall") & (F.col("n_drifted") >= 3), "retrain_soon").when(F.col("mean_psi") > 0.1, "monitor_closely").otherwise("monitor")
    return decision.withColumn("action", action)


def decay_weight(days, params: DriftParams = DriftParams()):
    """Weight of a row that is so many days old."""
    return F.pow(F.lit(params.time_decay), days)


def history(reports: DataFrame, n: int = 10, at: str = "at") -> DataFrame:
    """The last reports, newest first."""
    return reports.orderBy(F.desc(at)).limit(n)
