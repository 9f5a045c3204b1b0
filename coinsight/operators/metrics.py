"""Money-based and ranking metrics.

Label metrics are functions of six conditional sums, so any set of them is one
aggregation. Sweeps read the data once: rows are counted per number of
thresholds they reach, and sums over at most a few hundred buckets follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import reached, running


def counts(y: Column, flag: Column, amount: Column) -> dict[str, Column]:
    """The conditional sums that label metrics are made of."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    money = lambda c: F.coalesce(F.sum(F.when(c, amount).otherwise(0.0)), F.lit(0.0))
    hit, fraud = flag == 1, y == 1
    return {"tp": one(fraud & hit), "fp": one(~fraud & hit), "fn": one(fraud & ~hit), "tn": one(~fraud & ~hit), "amt_tp": money(fraud & hit), "amt_fn": money(fraud & ~hit)}


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, ``empty`` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def derived(cost: float | Column, flat_value: float = 50.0, fn_cost_rate: float = 1.0) -> dict[str, Column]:
    """Metrics as expressions over columns tp, fp, fn, tn, amt_tp, amt_fn."""
    tp, fp, fn, tn, caught, lost = (F.col(c) for c in ("tp", "fp", "fn", "tn", "amt_tp", "amt_fn"))
    cost = F.lit(cost) if isinstance(cost, float) else cost
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    savings = caught - fp * cost
    spent = (tp + fp) * cost
    return {
        "vdr": ratio(caught, caught + lost),
        "net_savings": savings,
        "roi": ratio(savings + spent, spent),
        "roi_net": ratio(savings, spent),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "fpr": ratio(fp, fp + tn),
        "flat_savings": tp * flat_value - fp * cost,
        "prevented": caught,
        "investigation": (tp + fp) * cost,
        "losses": lost * fn_cost_rate,
        "net_benefit": caught - (tp + fp) * cost - lost * fn_cost_rate,
        "benefit_ratio": ratio(caught, (tp + fp) * cost + lost * fn_cost_rate, float("inf")),
    }


def label_metrics(df: DataFrame, names: list[str], y: str = "y", flag: str = "flag", amount: str = "amount", cost: float = 100.0, by: list[str] | None = None, **more) -> DataFrame:
    """The named metrics, in one aggregation, for all rows or per group."""
    sums = df.groupBy(*(by or [])).agg(*[v.alias(k) for k, v in counts(F.col(y), F.col(flag), F.col(amount)).items()])
    made = derived(cost, **more)
    return sums.select(*(by or []), *[(made[n] if n in made else F.col(n)).alias(n) for n in names])


REPORT = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "vdr", "net_savings", "roi", "prevented", "investigation", "losses", "fpr"]


def report(df: DataFrame, cost: float = 100.0, **columns) -> DataFrame:
    """The 14 fields of the report in one row."""
    return label_metrics(df, REPORT, cost=cost, **columns)


def report_text(row: DataFrame) -> DataFrame:
    """A report row as lines of text."""
    parts = [F.format_string(f"{c}: %s", F.format_number(c, 4)) for c in row.columns]
    return row.select(F.array_join(F.array(*parts), "\n").alias("report"))


def precision_above(df: DataFrame, least: float, y: str = "y", p: str = "p", amount: str = "amount") -> DataFrame:
    """Precision at score .5 among rows of at least an amount."""
    flagged = (F.col(amount) >= least) & (F.col(p) >= 0.5)
    return df.agg(ratio(F.sum(F.when(flagged, F.col(y)).otherwise(0)), F.sum(F.when(flagged, 1).otherwise(0))).alias("precision"))


def grid(spark, start: float, step: float, n: int) -> DataFrame:
    """t_id and t = start + t_id * step."""
    return spark.range(n).select(F.col("id").cast("int").alias("t_id"), (F.lit(start) + F.col("id") * F.lit(step)).alias("t"))


def default_grid(spark) -> DataFrame:
    """.01 to .99 in steps of .01."""
    return grid(spark, 0.01, 0.01, 99)


def line_grid(spark, low: float, high: float, n: int) -> DataFrame:
    """n equally spaced thresholds with both ends."""
    step = (high - low) / (n - 1)
    return spark.range(n).select(F.col("id").cast("int").alias("t_id"), F.when(F.col("id") == n - 1, F.lit(high)).otherwise(F.lit(low) + F.col("id") * F.lit(step)).alias("t"))


def sweep_sums(df: DataFrame, thresholds: DataFrame, y: str = "y", p: str = "p", amount: str = "amount", by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """t_id, t and the conditional sums for each threshold (and group).

    ``thresholds`` has t_id rising with t, a few hundred rows. The data is
    aggregated once per bucket of scores; null scores reach no threshold.
    """
    by = by or []
    ts = [r["t"] for r in thresholds.orderBy("t").collect()]
    score = F.coalesce(F.col(p), F.lit(float("-inf")))
    buckets = df.withColumn("k", reached(score, ts, strict)).groupBy(*by, "k").agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"), F.sum(F.when(F.col(y) == 1, F.col(amount)).otherwise(0.0)).alias("amt")
    )
    all_ks = buckets.sparkSession.range(len(ts) + 1).select(F.col("id").cast("int").alias("k"))
    full = (buckets.select(*by).distinct().join(F.broadcast(all_ks)) if by else all_ks).join(buckets, [*by, "k"], "left").fillna(0, ["pos", "neg"]).fillna(0.0, ["amt"])
    w = Window.partitionBy(*by).orderBy(F.desc("k")) if by else Window.orderBy(F.desc("k"))
    total = Window.partitionBy(*by) if by else Window.partitionBy()
    full = full.select(
        *by, (F.col("k") - 1).alias("t_id"),
        F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("amt").over(w).alias("amt_tp"),
        F.sum("pos").over(total).alias("ap"), F.sum("neg").over(total).alias("an"), F.sum("amt").over(total).alias("aa"),
    ).filter("t_id >= 0")
    sums = full.withColumn("fn", F.col("ap") - F.col("tp")).withColumn("tn", F.col("an") - F.col("fp")).withColumn("amt_fn", F.col("aa") - F.col("amt_tp"))
    return sums.join(F.broadcast(thresholds), "t_id").select(*by, "t_id", "t", "tp", "fp", "fn", "tn", "amt_tp", "amt_fn")


SWEEP = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "vdr", "net_savings", "roi"]


def sweep(df: DataFrame, thresholds: DataFrame, cost: float = 100.0, names: list[str] | None = None, **more) -> DataFrame:
    """Ten metrics for each threshold."""
    sums = sweep_sums(df, thresholds, **more)
    made = derived(cost)
    keys = [c for c in sums.columns if c not in ("tp", "fp", "fn", "tn", "amt_tp", "amt_fn")]
    return sums.select(*keys, *[(made[n] if n in made else F.col(n)).alias(n) for n in (names or SWEEP)])


def best_threshold(swept: DataFrame, metric: str, by: list[str] | None = None) -> DataFrame:
    """The threshold with the greatest metric, the lowest of equal ones."""
    best = swept.groupBy(*(by or [])).agg(F.max_by(F.struct("t", metric), F.struct(F.round(metric, 9), -F.col("t"))).alias("b"))
    return best.select(*(by or []), "b.*")


def optimal_threshold(df: DataFrame, metric: str = "f1", **more) -> DataFrame:
    """Best of 100 thresholds for f1, precision or recall; .5 if none is over 0."""
    if metric not in ("f1", "precision", "recall"):
        raise ValueError(f"unknown metric: {metric}")
    found = best_threshold(sweep(df, line_grid(df.sparkSession, 0.01, 0.99, 100), **more), metric)
    return found.select(F.when(F.col(metric) > 0, F.col("t")).otherwise(0.5).alias("t"), metric)


def cost_sensitivity(df: DataFrame, costs: list[float], scores: list[str], thresholds: DataFrame, **more) -> DataFrame:
    """Per cost the best net savings of two scores, and which wins."""
    a, b = scores
    rows = []
    for s in scores:
        sums = sweep_sums(df, thresholds, p=s, **more).crossJoin(F.broadcast(df.sparkSession.createDataFrame([(c,) for c in costs], "cost double")))
        rows.append(sums.groupBy("cost").agg(F.max(F.col("amt_tp") - F.col("fp") * F.col("cost")).alias(f"best_{s}")))
    both = rows[0].join(rows[1], "cost")
    return both.withColumn("winner", F.when(F.col(f"best_{a}") > F.col(f"best_{b}"), a).otherwise(b))


def score_levels(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(*(by or []), F.col(p).alias("p")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; .5 with one class only."""
    by = by or []
    below = running(df.select(F.col(p).alias("p")), score_levels(df, y, p, by), "p", ["neg"], by)
    out = below.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return out.select(*by, ratio(F.col("u"), F.col("np").cast("double") * F.col("nn"), 0.5).alias("auc"))


def curve_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """threshold, tp, fp, tpr (recall), fpr, precision for each distinct score."""
    below = running(df.select(F.col(p).alias("p")), score_levels(df, y, p), "p", ["pos", "neg"])
    cum = below.select(F.col("p").alias("threshold"), (F.col("pos_all") - F.col("pos_before")).alias("tp"), (F.col("neg_all") - F.col("neg_before")).alias("fp"), F.col("pos_all").alias("np"), F.col("neg_all").alias("nn"))
    return cum.select("threshold", "tp", "fp", ratio(F.col("tp"), F.col("np")).alias("tpr"), ratio(F.col("fp"), F.col("nn")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def precision_at_recall(df: DataFrame, target: float, **columns) -> DataFrame:
    """Precision and recall at the point nearest a recall, lowest threshold first."""
    return curve_points(df, **columns).orderBy(F.round(F.abs(F.col("tpr") - target), 12), "threshold").limit(1).select("precision", F.col("tpr").alias("recall"))


def calibration_bins(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, closed: str = "right") -> DataFrame:
    """bin, n, confidence and accuracy of each non-empty bin.

    ``right``: bins (lo, hi], so a score of 0 is in none. ``left``: bins
    [lo, hi) with 1 in the last.
    """
    edges = [k * (1.0 / bins) for k in range(bins + 1)]
    edges[-1] = 1.0
    col, b = F.col(p), F.lit(None).cast("int")
    for k in range(bins - 1, -1, -1):
        inside = (col > edges[k]) & (col <= edges[k + 1]) if closed == "right" else (col >= edges[k]) & ((col < edges[k + 1]) if k < bins - 1 else (col <= 1.0))
        b = F.when(inside, k).otherwise(b)
    return df.withColumn("bin", b).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Expected calibration error, weighted by bin size over all rows."""
    total = df.select(F.count("*").alias("total"))
    return calibration_bins(df, y, p, bins).join(F.broadcast(total)).agg(F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n") / F.col("total")).alias("ece"))


def winner(table: DataFrame, metric: str = "net_savings") -> DataFrame:
    """``table`` (model and metrics) with is_winner for the greatest metric, first model of equal ones."""
    w = Window.orderBy(F.desc(metric), "model")
    return table.withColumn("is_winner", F.row_number().over(w) == 1)


def ranked(table: DataFrame, metric: str = "net_savings") -> DataFrame:
    """``table`` with its rank by a metric, falling."""
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), "model")))


def fold_summary(table: DataFrame, metric: str) -> DataFrame:
    """Per model mean and population deviation over folds."""
    return table.groupBy("model").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def fold_wins(table: DataFrame, metric: str) -> DataFrame:
    """Per model in how many folds it has the greatest metric."""
    w = Window.partitionBy("fold").orderBy(F.desc(metric), "model")
    return table.withColumn("r", F.row_number().over(w)).groupBy("model").agg(F.sum((F.col("r") == 1).cast("long")).alias("wins"))


def paired_t(table: DataFrame, a: str, b: str) -> DataFrame:
    """t statistic of the paired differences of two columns, and n."""
    d = F.col(a) - F.col(b)
    return table.agg(ratio(F.avg(d) * F.sqrt(F.count("*").cast("double")), F.stddev_samp(d), None).alias("t"), F.count("*").alias("n"))


def t_probability(t: float, n: int) -> float:
    """Two-sided p of Student's t with n - 1 degrees of freedom, by Simpson's rule."""
    import math

    df = n - 1
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    f = lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2)
    m, top = 20_000, abs(t)
    h = top / m
    area = (f(0) + f(top) + 4 * sum(f((2 * k + 1) * h) for k in range(m // 2)) + 2 * sum(f(2 * k * h) for k in range(1, m // 2))) * h / 3
    return max(0.0, 1 - 2 * area)
