"""Queries: metrics, threshold sweeps, Pareto selection and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import metrics as mt
from ..operators import pareto as pa
from ..sources import views
from ..sources.views import ORDERS, SCORED
from .catalog import register, rounded

S = views.scored_items


def flagged(spark, d):
    """Scored rows with the label at .5."""
    return S(spark, d).withColumn("flag", (F.col("p") >= 0.5).cast("int"))


def _sums(source: str, flag: str, by: str = "") -> str:
    """Conditional sums in SQL."""
    cols = {"tp": f"y = 1 AND {flag}", "fp": f"y <> 1 AND {flag}", "fn": f"y = 1 AND NOT ({flag})", "tn": f"y <> 1 AND NOT ({flag})"}
    parts = [f"count(CASE WHEN {c} THEN 1 END) AS {k}" for k, c in cols.items()]
    parts += [f"coalesce(sum(CASE WHEN y = 1 AND {flag} THEN amount ELSE 0 END), 0) AS amt_tp", f"coalesce(sum(CASE WHEN y = 1 AND NOT ({flag}) THEN amount ELSE 0 END), 0) AS amt_fn"]
    return f"(SELECT {by + ', ' if by else ''}{', '.join(parts)} FROM {source}{' GROUP BY ' + by if by else ''})"


_D = lambda a, b, e="0e0": f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), {e})"


def _expr(cost: str = "100e0") -> dict[str, str]:
    """Metrics in SQL, over the conditional sums."""
    prec, rec = _D("tp", "tp + fp"), _D("tp", "tp + fn")
    ns = f"(amt_tp - fp * {cost})"
    return {
        "vdr": _D("amt_tp", "amt_tp + amt_fn"), "net_savings": ns, "roi": _D(f"{ns} + (tp + fp) * {cost}", f"(tp + fp) * {cost}"), "roi_net": _D(ns, f"(tp + fp) * {cost}"),
        "precision": prec, "recall": rec, "f1": _D(f"2 * {prec} * {rec}", f"{prec} + {rec}"), "fpr": _D("fp", "fp + tn"), "flat_savings": f"(tp * 50e0 - fp * {cost})",
        "prevented": "amt_tp", "investigation": f"((tp + fp) * {cost})", "losses": "amt_fn", "net_benefit": f"(amt_tp - (tp + fp) * {cost} - amt_fn)", "benefit_ratio": _D("amt_tp", f"(tp + fp) * {cost} + amt_fn", "'Infinity'::DOUBLE"),
        "tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn",
    }


def _select(names: list[str], source: str, keys: str = "", cost: str = "100e0", digits: int = 6) -> str:
    e = _expr(cost)
    return f"SELECT {keys + ', ' if keys else ''}{', '.join(e[n] + ' AS ' + n if n in ('tp', 'fp', 'fn', 'tn') else f'round({e[n]}, {4 if n in _MONEY else digits}) AS {n}' for n in names)} FROM {source}"


_MONEY = {"net_savings", "flat_savings", "prevented", "investigation", "losses", "net_benefit"}


def _tidy(df):
    return df.select(*[F.round(c, 4 if c in _MONEY else 6).alias(c) if t == "double" and c != "t" else F.col(c) for c, t in df.dtypes])


def _label(name: str, names: list[str], flag_sql: str = "p >= 0.5e0"):
    @register(name, _select(names, _sums(SCORED, flag_sql)))
    def query(spark, d):
        return _tidy(mt.label_metrics(flagged(spark, d), names))


for _name, _names in {
    "MT-VDR": ["vdr"], "MT-NS": ["net_savings"], "MT-ROI": ["roi"], "MT-ROI-CV": ["roi_net"], "MT-PRF": ["precision", "recall", "f1"], "MT-ALIAS": ["vdr", "net_savings"],
    "MT-CBA": ["prevented", "investigation", "losses", "net_benefit", "benefit_ratio", "tp", "fp", "fn"], "MT-NS-FLAT": ["flat_savings"], "MT-VDR-CNT": ["recall"], "MT-REP": mt.REPORT,
}.items():
    _label(_name, _names)


@register("MT-P$", f"SELECT round({_D('sum(CASE WHEN p >= 0.5e0 THEN y ELSE 0 END)', 'count(CASE WHEN p >= 0.5e0 THEN 1 END)')}, 6) AS precision FROM {SCORED} WHERE amount >= 20000")
def mt_p_above(spark, d):
    return rounded(mt.precision_above(S(spark, d), 20000.0))


_GRID99 = "(SELECT CAST(i AS INT) AS t_id, 0.01e0 + i * 0.01e0 AS t FROM range(99) r(i))"
_GRID100 = "(SELECT CAST(i AS INT) AS t_id, CASE WHEN i = 99 THEN 0.99e0 ELSE 0.01e0 + i * ((0.99e0 - 0.01e0) / 99) END AS t FROM range(100) r(i))"
_GRID50 = "(SELECT CAST(i AS INT) AS t_id, CASE WHEN i = 49 THEN 0.9e0 ELSE 0.1e0 + i * ((0.9e0 - 0.1e0) / 49) END AS t FROM range(50) r(i))"


def _swept(names: list[str], grid: str = _GRID99, op: str = ">=", cost: str = "100e0") -> str:
    return _select(names, _sums(f"{SCORED} s CROSS JOIN {grid} g", f"p {op} t", "t_id, t"), "t_id, t", cost)


@register("MT-SWEEP", _swept(mt.SWEEP))
def mt_sweep(spark, d):
    return _tidy(mt.sweep(S(spark, d), mt.default_grid(spark)))


@register("MT-OPT-F1", f"SELECT t, f1 FROM ({_swept(['f1'], _GRID100)}) ORDER BY f1 DESC, t LIMIT 1")
def mt_opt_f1(spark, d):
    return _tidy(mt.optimal_threshold(S(spark, d), "f1"))


@register("MT-OPT-NS", f"SELECT t, net_savings FROM ({_swept(['net_savings'])}) ORDER BY net_savings DESC, t LIMIT 1")
def mt_opt_ns(spark, d):
    return _tidy(mt.best_threshold(mt.sweep(S(spark, d), mt.default_grid(spark)), "net_savings"))


@register("MT-OPT-VDR", f"SELECT t, vdr FROM ({_swept(['vdr'], _GRID50, '>')}) ORDER BY vdr DESC, t LIMIT 1")
def mt_opt_vdr(spark, d):
    return _tidy(mt.best_threshold(mt.sweep(S(spark, d), mt.line_grid(spark, 0.1, 0.9, 50), strict=True), "vdr"))


_TWO = f"(SELECT y, p, amount, 'a' AS model FROM {SCORED} UNION ALL SELECT y, p * p AS p, amount, 'b' AS model FROM {SCORED})"


def _two(spark, d):
    rows = S(spark, d).select("y", "p", "amount")
    return rows.withColumn("model", F.lit("a")).unionByName(rows.withColumn("p", F.col("p") * F.col("p")).withColumn("model", F.lit("b")))


@register("MT-GRID", _select(["flat_savings"], _sums(f"{_TWO} s CROSS JOIN {_GRID100} g", "p >= t", "model, t_id, t"), "model, t_id, t"))
def mt_grid(spark, d):
    return _tidy(mt.sweep(_two(spark, d), mt.line_grid(spark, 0.01, 0.99, 100), names=["flat_savings"], by=["model"]))


_COSTS = [10.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0]


@register("MT-SENS", f"""WITH s AS {_sums(f"{_TWO} s CROSS JOIN {_GRID99} g", "p >= t", "model, t_id, t")},
  c AS (SELECT unnest([{', '.join(map(str, _COSTS))}])::DOUBLE AS cost),
  b AS (SELECT cost, model, max(amt_tp - fp * cost) AS v FROM s CROSS JOIN c GROUP BY 1, 2)
  SELECT x.cost, round(x.v, 4) AS best_p, round(z.v, 4) AS best_q, CASE WHEN x.v > z.v THEN 'p' ELSE 'q' END AS winner FROM b x JOIN b z ON x.cost = z.cost AND x.model = 'a' AND z.model = 'b'""")
def mt_sens(spark, d):
    return rounded(mt.cost_sensitivity(S(spark, d).withColumn("q", F.col("p") * F.col("p")), _COSTS, ["p", "q"], mt.default_grid(spark)), 4)


_LEVELS = f"(SELECT p, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y <> 1 THEN 1 END) AS neg FROM {SCORED} GROUP BY p)"
_AUC = lambda source, by="": f"""SELECT {by + ', ' if by else ''}round(sum(pos * (below + neg / 2e0)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER ({'PARTITION BY ' + by if by else ''} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
  (SELECT {by + ', ' if by else ''}p, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y <> 1 THEN 1 END) AS neg FROM {source} GROUP BY {by + ', ' if by else ''}p)){' GROUP BY ' + by if by else ''}"""  # noqa: E731


@register("MT-AUC", _AUC(SCORED))
def mt_auc(spark, d):
    return rounded(mt.roc_auc(S(spark, d)))


@register("MT-AUC-D", _AUC(SCORED, "grp"))
def mt_auc_d(spark, d):
    return rounded(mt.roc_auc(S(spark, d), by=["grp"]))


_CURVE = f"""(SELECT p AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (sum(pos) OVER w)::DOUBLE / sum(pos) OVER () AS tpr, (sum(neg) OVER w)::DOUBLE / sum(neg) OVER () AS fpr,
  (sum(pos) OVER w)::DOUBLE / (sum(pos) OVER w + sum(neg) OVER w) AS precision FROM {_LEVELS} WINDOW w AS (ORDER BY p DESC))"""


@register("MT-ROC", f"SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM {_CURVE}")
def mt_roc(spark, d):
    return rounded(mt.curve_points(S(spark, d)).select("threshold", "tpr", "fpr"))


@register("MT-PR", f"SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS recall, round(precision, 6) AS precision FROM {_CURVE}")
def mt_pr(spark, d):
    return rounded(mt.curve_points(S(spark, d)).select("threshold", F.col("tpr").alias("recall"), "precision"))


@register("MT-P@R", f"SELECT round(precision, 6) AS precision, round(tpr, 6) AS recall FROM {_CURVE} ORDER BY round(abs(tpr - 0.8e0), 12), threshold LIMIT 1")
def mt_p_at_r(spark, d):
    return rounded(mt.precision_at_recall(S(spark, d), 0.8))


_EDGES = "(SELECT CAST(i AS INT) AS bin, i * 0.1e0 AS lo, CASE WHEN i = 9 THEN 1e0 ELSE (i + 1) * 0.1e0 END AS hi FROM range(10) r(i))"
_BINS = f"(SELECT bin, count(*) AS n, avg(p) AS confidence, avg(y::DOUBLE) AS accuracy FROM {SCORED} JOIN {_EDGES} e ON p > lo AND p <= hi GROUP BY bin)"
_LEFT = f"(SELECT bin, count(*) AS n, avg(p) AS confidence, avg(y::DOUBLE) AS accuracy FROM {SCORED} JOIN {_EDGES} e ON p >= lo AND (p < hi OR (bin = 9 AND p <= 1)) GROUP BY bin)"


@register("MT-ECE", f"SELECT round(sum(abs(confidence - accuracy) * n / (SELECT count(*) FROM {SCORED})), 6) AS ece FROM {_BINS}")
def mt_ece(spark, d):
    return rounded(mt.calibration_error(S(spark, d)))


@register("MT-CAL", f"SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM {_LEFT}")
def mt_cal(spark, d):
    return rounded(mt.calibration_bins(S(spark, d), closed="left"))


@register("MT-ECE-U", f"SELECT round(avg(abs(confidence - accuracy)), 6) AS ece FROM {_LEFT}")
def mt_ece_u(spark, d):
    return rounded(mt.calibration_bins(S(spark, d), closed="left").agg(F.avg(F.abs(F.col("confidence") - F.col("accuracy"))).alias("ece")))


_PARTS = f"(SELECT y, p, amount, CASE WHEN amount < 20000 THEN 'train' WHEN amount < 40000 THEN 'val' ELSE 'test' END AS part FROM {SCORED})"


def _parts(spark, d):
    a = F.col("amount")
    return S(spark, d).withColumn("part", F.when(a < 20000, "train").when(a < 40000, "val").otherwise("test"))


_PIVOT = f"(SELECT max(CASE WHEN part = 'train' THEN auc END) AS train, max(CASE WHEN part = 'val' THEN auc END) AS val, max(CASE WHEN part = 'test' THEN auc END) AS test FROM ({_AUC(_PARTS, 'part')}))"


def _overfit(spark, d):
    auc = rounded(mt.roc_auc(_parts(spark, d), by=["part"]))
    return auc.agg(*[F.max(F.when(F.col("part") == p, F.col("auc"))).alias(p) for p in ("train", "val", "test")])


@register("MT-OVER", f"SELECT train, val, test, round(train - val, 6) AS train_val, round(val - test, 6) AS val_test FROM {_PIVOT}")
def mt_over(spark, d):
    return rounded(_overfit(spark, d).withColumn("train_val", F.col("train") - F.col("val")).withColumn("val_test", F.col("val") - F.col("test")))


@register("MT-OVERFLAG", f"SELECT train - val > 0.05e0 AS overfit FROM {_PIVOT}")
def mt_overflag(spark, d):
    return _overfit(spark, d).select((F.col("train") - F.col("val") > 0.05).alias("overfit"))


_BYMODEL = _sums(_TWO, "p >= 0.5e0", "model")


def _models(spark, d):
    return _tidy(mt.label_metrics(_two(spark, d).withColumn("flag", (F.col("p") >= 0.5).cast("int")), ["precision", "recall", "net_savings"], by=["model"]))


_MODELS = _select(["precision", "recall", "net_savings"], _BYMODEL, "model")


@register("MT-WINNER", f"SELECT *, row_number() OVER (ORDER BY net_savings DESC, model) = 1 AS is_winner FROM ({_MODELS})")
def mt_winner(spark, d):
    return mt.winner(_models(spark, d))


@register("MT-RANK", f"SELECT *, CAST(row_number() OVER (ORDER BY net_savings DESC, model) AS INT) AS rank FROM ({_MODELS})")
def mt_rank(spark, d):
    return mt.ranked(_models(spark, d))


_FOLDS = f"(SELECT *, CAST(floor(amount) AS BIGINT) % 5 AS fold FROM {_TWO})"
_FOLDED = _select(["net_savings"], _sums(_FOLDS, "p >= 0.5e0", "model, fold"), "model, fold")


def _folded(spark, d):
    rows = _two(spark, d).withColumn("fold", F.floor("amount").cast("long") % 5).withColumn("flag", (F.col("p") >= 0.5).cast("int"))
    return _tidy(mt.label_metrics(rows, ["net_savings"], by=["model", "fold"]))


@register("MT-CVSUM", f"""SELECT m.model, round(mean, 2) AS mean, round(std, 2) AS std, wins FROM (SELECT model, avg(net_savings) AS mean, stddev_pop(net_savings) AS std FROM ({_FOLDED}) GROUP BY 1) m
  JOIN (SELECT model, count(CASE WHEN r = 1 THEN 1 END) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY net_savings DESC, model) AS r FROM ({_FOLDED})) GROUP BY 1) w ON m.model = w.model""")
def mt_cvsum(spark, d):
    t = _folded(spark, d)
    return rounded(mt.fold_summary(t, "net_savings").join(mt.fold_wins(t, "net_savings"), "model"), 2)


@register("MT-TTEST", f"""SELECT round(avg(a - b) * sqrt(count(*)) / stddev_samp(a - b), 4) AS t, count(*) AS n FROM
  (SELECT fold, max(CASE WHEN model = 'a' THEN net_savings END) AS a, max(CASE WHEN model = 'b' THEN net_savings END) AS b FROM ({_FOLDED}) GROUP BY fold)""")
def mt_ttest(spark, d):
    wide = _folded(spark, d).groupBy("fold").agg(*[F.max(F.when(F.col("model") == m, F.col("net_savings"))).alias(m) for m in ("a", "b")])
    return rounded(mt.paired_t(wide, "a", "b"), 4)


@register("MT-SUMMARY", f"SELECT model, round(avg(net_savings), 2) AS net_savings FROM ({_FOLDED}) GROUP BY model")
def mt_summary(spark, d):
    return rounded(_folded(spark, d).groupBy("model").agg(F.avg("net_savings").alias("net_savings")), 2)


# ---- Pareto

_SWEPT = f"({_swept(mt.SWEEP)})"
_FRONT = f"""(SELECT * FROM {_SWEPT} a WHERE NOT EXISTS (SELECT 1 FROM {_SWEPT} b WHERE {' AND '.join(f'b.{o} >= a.{o}' for o in pa.OBJECTIVES)} AND ({' OR '.join(f'b.{o} > a.{o}' for o in pa.OBJECTIVES)})))"""
_BEST = " UNION ALL ".join(f"(SELECT '{n}' AS strategy, * FROM {_FRONT} ORDER BY {m} DESC, t LIMIT 1)" for n, m in pa.STRATEGIES)


def _front(spark, d):
    return pa.frontier(_tidy(mt.sweep(S(spark, d), mt.default_grid(spark))))


register("PA-FRONT", f"SELECT * FROM {_FRONT}")(_front)
register("PA-POINTS", f"SELECT t, precision, recall, f1, vdr, net_savings, roi, tp, fp FROM {_FRONT}")(lambda spark, d: _front(spark, d).select("t", "precision", "recall", "f1", "vdr", "net_savings", "roi", "tp", "fp"))
register("PA-REC", _BEST)(lambda spark, d: pa.recommendations(_front(spark, d)))
register("PA-FIT", _BEST)(lambda spark, d: pa.fit(S(spark, d), tidy=_tidy)[2])
register("PA-GET", f"SELECT * FROM ({_BEST}) WHERE strategy = 'max_savings'")(lambda spark, d: pa.recommend(pa.recommendations(_front(spark, d))))
register("PA-ATIDX", f"SELECT * FROM {_SWEPT} WHERE t_id = 49")(lambda spark, d: pa.at_index(_tidy(mt.sweep(S(spark, d), mt.default_grid(spark))), 49))
_LINE = "printf('%s: threshold %.2f, precision %.3f, recall %.3f, net savings %.2f, flagged cases %d', strategy, t, precision, recall, net_savings, CAST(tp + fp AS BIGINT))"
register("PA-REPORT", f"SELECT strategy, {_LINE} AS line FROM ({_BEST})")(lambda spark, d: pa.report(pa.recommendations(_front(spark, d))))


# ---- drift

_FEATURES = ["amount", "y", "day"]
_DRIFT = f"(SELECT id, amount, y::DOUBLE AS y, dayofyear(ts)::DOUBLE AS day, ts < TIMESTAMP '1997-01-01' AS old FROM {ORDERS})"
_LONG = f"(SELECT old, unnest(['amount', 'y', 'day']) AS feature, unnest([amount, y, day]) AS v FROM {_DRIFT})"


def _drift_rows(spark, d):
    rows = views.orders(spark, d).select("id", "amount", F.col("y").cast("double").alias("y"), F.dayofyear("ts").cast("double").alias("day"), (F.col("ts") < F.lit("1997-01-01").cast("timestamp")).alias("old"))
    return rows.filter("old"), rows.filter("not old")


_PCTS = ", ".join(f"{k / 20}" for k in range(21))
_REF = f"""(SELECT feature, n, mean, std, quantiles, CASE WHEN dist <= 10 THEN list_append(list_transform(few, lambda x: x - 0.5e0), few[len(few)] + 0.5e0)
  WHEN len(list_distinct(p)) < 3 THEN [lo, (lo + hi) / 2, hi] ELSE list_sort(list_distinct(p)) END AS edges FROM
  (SELECT feature, count(*) AS n, count(DISTINCT v) AS dist, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi, quantile_cont(v, [{_PCTS}]) AS p, quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS quantiles,
   list_sort(list_distinct(list(v)))[1:10] AS few FROM {_LONG} WHERE old GROUP BY feature))"""
_HIST = lambda old: f"""(SELECT r.feature, CAST(least(len(list_filter(edges, lambda e: e <= v)), len(edges) - 1) - 1 AS INT) AS bin, count(*) AS c FROM {_LONG} l JOIN {_REF} r ON l.feature = r.feature
  WHERE {'' if old else 'NOT '}old AND v >= edges[1] AND v <= edges[len(edges)] GROUP BY 1, 2)"""  # noqa: E731
_SHARE = lambda h: f"""(SELECT b.feature, b.bin, greatest(coalesce(c, 0)::DOUBLE / sum(coalesce(c, 0)) OVER (PARTITION BY b.feature), 1e-8) AS s FROM
  (SELECT feature, CAST(unnest(range(len(edges) - 1)) AS INT) AS bin FROM {_REF}) b LEFT JOIN {h} h ON b.feature = h.feature AND b.bin = h.bin)"""  # noqa: E731
_PSI = f"(SELECT r.feature, sum((c.s - r.s) * ln(c.s / r.s)) AS psi FROM {_SHARE(_HIST(True))} r JOIN {_SHARE(_HIST(False))} c ON r.feature = c.feature AND r.bin = c.bin GROUP BY 1)"
_SUMM = f"""(SELECT p.feature, psi, m - mean AS mean_shift, s / greatest(std, 1e-8) AS std_ratio FROM {_PSI} p JOIN {_REF} r ON p.feature = r.feature
  JOIN (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM {_LONG} WHERE NOT old GROUP BY 1) n ON p.feature = n.feature)"""
_DECISION = f"""(SELECT coalesce(string_agg(CASE WHEN psi > 0.2e0 THEN feature END, ',' ORDER BY feature), '') AS drifted, count(CASE WHEN psi > 0.2e0 THEN 1 END) AS n_drifted, round(avg(psi), 6) AS mean_psi, avg(psi) > 0.2e0 AS overall FROM {_SUMM})"""


@register("DR-HIST", f"SELECT * FROM {_HIST(True)}")
def dr_hist(spark, d):
    base, _ = _drift_rows(spark, d)
    return dr.histogram(base, dr.reference_edges(base, _FEATURES))


@register("DR-REF", f"SELECT feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(quantiles[3], 6) AS median, CAST(len(edges) AS INT) AS n_edges, round(edges[2], 6) AS edge FROM {_REF}")
def dr_ref(spark, d):
    base, _ = _drift_rows(spark, d)
    return rounded(dr.reference_edges(base, _FEATURES).select("feature", "n", "mean", "std", F.col("quantiles")[2].alias("median"), F.size("edges").alias("n_edges"), F.col("edges")[1].alias("edge")))


def _summary(spark, d):
    base, now = _drift_rows(spark, d)
    return dr.summary(dr.reference_edges(base, _FEATURES), base, now)


register("DR-PSI", f"SELECT feature, round(psi, 6) AS psi FROM {_PSI}")(lambda spark, d: rounded(_summary(spark, d).select("feature", "psi")))
register("DR-SUMM", f"SELECT feature, round(psi, 6) AS psi, round(mean_shift, 4) AS mean_shift, round(std_ratio, 6) AS std_ratio FROM {_SUMM}")(
    lambda spark, d: _summary(spark, d).select("feature", F.round("psi", 6).alias("psi"), F.round("mean_shift", 4).alias("mean_shift"), F.round("std_ratio", 6).alias("std_ratio"))
)
register("DR-DETECT", f"SELECT * FROM {_DECISION}")(lambda spark, d: rounded(dr.detect(_summary(spark, d))))
register("DR-REC", f"SELECT *, CASE WHEN overall AND n_drifted >= 3 THEN 'retrain_soon' WHEN mean_psi > 0.1e0 THEN 'monitor_closely' ELSE 'monitor' END AS action FROM {_DECISION}")(lambda spark, d: dr.recommendation(rounded(dr.detect(_summary(spark, d)))))


@register("DR-PERF", f"""WITH x AS (SELECT *, CASE WHEN grp = 'F' THEN 'reference' ELSE 'current' END AS part FROM {SCORED}),
  l AS ({_select(['precision', 'recall'], _sums('x', 'p >= 0.5e0', 'part'), 'part')}), a AS ({_AUC('x', 'part')}),
  w AS (SELECT l.part, precision, recall, auc FROM l JOIN a ON l.part = a.part), m AS (SELECT part, unnest(['precision', 'recall', 'auc']) AS metric, unnest([precision, recall, auc]) AS v FROM w),
  z AS (SELECT metric, max(CASE WHEN part = 'reference' THEN v END) AS reference, max(CASE WHEN part = 'current' THEN v END) AS current FROM m GROUP BY 1)
  SELECT metric, reference, current, round(reference - current, 5) AS "drop", reference - current > 0.05e0 AS significant FROM z""")
def dr_perf(spark, d):
    rows = S(spark, d)
    out = dr.performance(rows.filter("grp = 'F'"), rows.filter("grp <> 'F'"))
    return out.select("metric", F.round("reference", 6).alias("reference"), F.round("current", 6).alias("current"), F.round(F.round("reference", 6) - F.round("current", 6), 5).alias("drop"), "significant")


_Q = "least(greatest(p, 1e-8), 1 - 1e-8)"


@register("DR-PRED", f"SELECT round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(avg(CASE WHEN p > 0.9e0 OR p < 0.1e0 THEN 1e0 ELSE 0e0 END), 6) AS confident, round(avg(-({_Q} * ln({_Q}) + (1 - {_Q}) * ln(1 - {_Q}))), 6) AS entropy FROM {SCORED}")
def dr_pred(spark, d):
    return rounded(dr.prediction_stats(S(spark, d)))


@register("DR-TIME", f"SELECT id, round(pow(0.95e0, dayofyear(ts)), 9) AS w FROM {ORDERS}")
def dr_time(spark, d):
    return views.orders(spark, d).select("id", F.round(dr.decay_weight(F.dayofyear("ts")), 9).alias("w"))


@register("DR-HISTORY", f"SELECT CAST(year(ts) AS INT) AS at, count(*) AS n, round(avg(amount), 2) AS mean FROM {ORDERS} GROUP BY 1 ORDER BY 1 DESC LIMIT 3")
def dr_history(spark, d):
    per = views.orders(spark, d).groupBy(F.year("ts").alias("at")).agg(F.count("*").alias("n"), F.round(F.avg("amount"), 2).alias("mean"))
    return dr.history(per, 3)
