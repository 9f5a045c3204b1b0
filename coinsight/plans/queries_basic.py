"""Queries: sources, sampling, splitting, features and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses
from ..operators import features as fe
from ..operators import sampling as sm
from ..sources import synthetic, views
from ..sources.views import ORDERS, SCORED
from .catalog import ORACLES, QUERIES, register, rounded
from .reporting import markdown_lines

O = views.orders


@register("SRC-CSV", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(spark, d):
    import uuid

    from .storage import scratch

    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}"
    schema = "n_nationkey int, n_name string, n_regionkey int"
    views.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True)
    return views.read_csv(spark, path, schema)


@register("SRC-NP", "SELECT i AS id, i * 0.5e0 AS x FROM range(5) t(i)")
def src_np(spark, d):
    import numpy as np
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"id": np.arange(5), "x": np.arange(5) * 0.5}))


@register("SRC-SYN1")
def src_syn1(spark, d):
    return synthetic.uniform_features(spark, 10_000, 10, 0.02)


@register("SRC-SYN2")
def src_syn2(spark, d):
    return synthetic.normal_features(spark, 10_000, 0.02)


@register("SRC-SYN3")
def src_syn3(spark, d):
    return synthetic.normal_features(spark, 10_000, 0.02, value_ratio=2.0, heavy=True)


@register("SNK-MD")
def snk_md(spark, d):
    from ..operators import metrics

    flagged = views.scored_items(spark, d).withColumn("flag", (F.col("p") >= 0.5).cast("int"))
    return markdown_lines(metrics.report(flagged).withColumn("model", F.lit("rule")))


@register("SNK-PNG")
def snk_png(spark, d):
    from ..operators import metrics

    return rounded(metrics.curve_points(views.scored_items(spark, d)).select("threshold", "tpr", "fpr"))


@register("FLT-DATE", f"SELECT id, y FROM {ORDERS} WHERE ts >= TIMESTAMP '1996-04-01'")
def flt_date(spark, d):
    return O(spark, d).filter(F.col("ts") >= F.lit("1996-04-01").cast("timestamp")).select("id", "y")


@register("FLT-QTR", f"SELECT id, y FROM {ORDERS} WHERE NOT (year(ts) = 1996 AND quarter(ts) = 1)")
def flt_qtr(spark, d):
    return O(spark, d).filter(~((F.year("ts") == 1996) & (F.quarter("ts") == 1))).select("id", "y")


@register("AGG-QTR", f"SELECT CAST(year(ts) AS INT) AS year, CAST(quarter(ts) AS INT) AS quarter, count(*) AS n, CAST(sum(y) AS BIGINT) AS fraud, round(avg(y), 4) AS rate FROM {ORDERS} GROUP BY 1, 2")
def agg_qtr(spark, d):
    return O(spark, d).groupBy(F.year("ts").alias("year"), F.quarter("ts").alias("quarter")).agg(F.count("*").alias("n"), F.sum("y").alias("fraud"), F.round(F.avg("y"), 4).alias("rate"))


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY y ORDER BY id) AS r, count(*) OVER (PARTITION BY y) AS n, count(*) OVER () AS n_all, sum(y) OVER () AS hits FROM {ORDERS})"


@register("SMP-NAT", f"SELECT id, y FROM {_RANKED} WHERE r <= CASE WHEN y = 1 THEN floor(500 * (hits::DOUBLE / n_all)) ELSE 500 - floor(500 * (hits::DOUBLE / n_all)) END")
def smp_nat(spark, d):
    return sm.natural_rate(O(spark, d), 500, "y", "id").select("id", "y")


@register("SMP-NAT-R", f"""SELECT id, y, count(*) AS copies FROM (SELECT id, y, unnest(range(CAST(CASE WHEN y = 1 THEN floor((9000 - r)::DOUBLE / n) + 1 ELSE CASE WHEN r <= 1000 THEN 1 ELSE 0 END END AS BIGINT))) AS c
  FROM {_RANKED}) GROUP BY 1, 2""")
def smp_nat_r(spark, d):
    return sm.natural_rate_replaced(O(spark, d), 10_000, 0.9, "y", "id").groupBy("id", "y").agg(F.count("*").alias("copies"))


@register("SMP-KEEP", f"SELECT id, y FROM {_RANKED} WHERE y = 1 OR r <= 2000")
def smp_keep(spark, d):
    return sm.keep_positives(O(spark, d), 2000, "y", "id").select("id", "y")


@register("SPL-STRAT", f"SELECT id, y, r <= round(n * 0.2e0) AS is_test FROM {_RANKED}")
def spl_strat(spark, d):
    return sm.stratified_split(O(spark, d), 0.2, "y", "id").select("id", "y", "is_test")


@register("SPL-ES", f"""SELECT id, y, r <= CASE WHEN y = 1 THEN greatest(1, floor(hits * 0.1e0)) ELSE floor(n_all * 0.1e0) - greatest(1, floor(hits * 0.1e0)) END AS is_val FROM {_RANKED}""")
def spl_es(spark, d):
    return sm.early_stop_split(O(spark, d), 0.1, "y", "id").select("id", "y", "is_val")


@register("SPL-KFOLD", f"SELECT id, y, CAST((r - 1) % 5 AS INT) AS fold FROM {_RANKED}")
def spl_kfold(spark, d):
    return sm.folds(O(spark, d), 5, "y", "id").select("id", "y", F.col("fold").cast("int").alias("fold"))


@register("SPL-TS", f"""WITH r AS (SELECT id, row_number() OVER (ORDER BY ts, id) - 1 AS k, count(*) OVER () AS n FROM {ORDERS}),
  f AS (SELECT *, unnest(range(4)) AS fold FROM r)
  SELECT id, CAST(fold AS INT) AS fold, CASE WHEN k < n - (4 - fold) * (n // 5) THEN 'train' ELSE 'test' END AS role FROM f WHERE k < n - (4 - fold) * (n // 5) + n // 5""")
def spl_ts(spark, d):
    return sm.time_splits(O(spark, d), 4, "ts", "id").select("id", "fold", "role")


@register("SMP-ROW")
def smp_row(spark, d):
    return sm.exact_share(O(spark, d), 0.8, "id", 3).select("id", "y")


@register("SMP-COL")
def smp_col(spark, d):
    return spark.createDataFrame([(f,) for f in sm.feature_subset([f"f{k}" for k in range(10)], 0.8, 1)], "feature string")


# ---- features

_FE = "FROM orders JOIN customer ON o_custkey = c_custkey"


def _joined(spark, d):
    return views.table(spark, d, "orders").join(views.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def _fe(name: str, sql: str, column):
    @register(name, f"SELECT o_orderkey AS id, {sql} AS v {_FE}")
    def query(spark, d):
        return _joined(spark, d).select(F.col("o_orderkey").alias("id"), column().alias("v"))


_LAT, _LON = "(o_custkey % 180 - 90)", "(o_custkey % 360 - 180)"
_LAT2, _LON2 = "(o_orderkey % 180 - 90)", "(o_orderkey % 360 - 180)"
_CHORD = f"(pow(sin((radians({_LAT2}) - radians({_LAT})) / 2), 2) + cos(radians({_LAT})) * cos(radians({_LAT2})) * pow(sin((radians({_LON2}) - radians({_LON})) / 2), 2))"
_place = lambda: [F.expr(x) for x in (_LAT, _LON, _LAT2, _LON2)]
_birth = lambda: F.expr("make_date(1940 + int(c_custkey % 60), 6, 15)")
_BIRTH = "make_date(1940 + CAST(c_custkey % 60 AS INT), 6, 15)"
_fe("FE-HOUR", "CAST(hour(o_orderdate) AS INT)", lambda: fe.hour(F.col("o_orderdate")))
_fe("FE-DOW", "CAST(isodow(o_orderdate) - 1 AS INT)", lambda: fe.weekday(F.col("o_orderdate")))
_fe("FE-AGE-A", f"round(date_diff('day', {_BIRTH}, CAST(o_orderdate AS DATE)) / 365.25e0, 6)", lambda: F.round(fe.age_years(F.col("o_orderdate"), _birth()), 6))
_fe("FE-AGE-B", f"CAST(2024 - year({_BIRTH}) AS INT)", lambda: fe.age_at(2024, _birth()))
_fe("FE-LOGAMT", "round(ln(1 + o_totalprice), 6)", lambda: F.round(F.log1p("o_totalprice"), 6))
_fe("FE-HAV-A", f"round(2 * 6371e0 * asin(sqrt({_CHORD})), 3)", lambda: F.round(fe.haversine_asin(*_place()), 3))
_fe("FE-HAV-B", f"round(2 * 6371e0 * atan2(sqrt({_CHORD}), sqrt(1 - {_CHORD})), 3)", lambda: F.round(fe.haversine_atan(*_place()), 3))
_fe("FE-BIN", "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END", lambda: fe.is_value(F.col("c_mktsegment"), "BUILDING"))
_fe("FE-FILL0", "CASE WHEN o_custkey % 7 = 3 THEN 0e0 ELSE o_totalprice END", lambda: F.coalesce(F.when(F.col("o_custkey") % 7 != 3, F.col("o_totalprice")), F.lit(0.0)))


@register("FE-LABEL", f"SELECT o_orderkey AS id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS v {_FE}")
def fe_label(spark, d):
    return fe.label_encode(_joined(spark, d), "c_mktsegment", "v").select(F.col("o_orderkey").alias("id"), "v")


_CARD = f"""SELECT o_totalprice AS amt, round(ln(1 + o_totalprice), 6) AS log_amt, CAST(hour(o_orderdate) AS INT) AS hour, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday,
  round(date_diff('day', {_BIRTH}, CAST(o_orderdate AS DATE)) / 365.25e0, 6) AS age, CAST(c_nationkey AS INT) AS city_pop, round(2 * 6371e0 * asin(sqrt({_CHORD})), 3) AS distance_km,
  CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS category_code, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_male {_FE}"""


def _card(spark, d):
    lat, lon, lat2, lon2 = _place()
    rows = _joined(spark, d).select(
        F.col("o_orderdate").alias("trans_date_trans_time"), _birth().alias("dob"), F.col("o_totalprice").alias("amt"), F.col("c_mktsegment").alias("category"), F.when(F.col("o_orderstatus") == "O", "M").otherwise("F").alias("gender"),
        F.col("c_nationkey").cast("int").alias("city_pop"), lat.cast("double").alias("lat"), lon.cast("double").alias("long"), lat2.cast("double").alias("merch_lat"), lon2.cast("double").alias("merch_long"), F.lit(0).alias("is_fraud"),
    )
    out = fe.card_features(rows)
    return out.select("amt", F.round("log_amt", 6).alias("log_amt"), "hour", "weekday", F.round("age", 6).alias("age"), "city_pop", F.round("distance_km", 3).alias("distance_km"), "category_code", "is_male")


register("FE-ALL", _CARD)(_card)


@register("FE-SELECT", f"SELECT amt, hour, weekday, city_pop, is_male FROM ({_CARD})")
def fe_select(spark, d):
    return _card(spark, d).select("amt", "hour", "weekday", "city_pop", "is_male")


@register("FE-SCALE", f"SELECT id, round((amount - avg(amount) OVER ()) / stddev_pop(amount) OVER (), 6) AS amount FROM {ORDERS}")
def fe_scale(spark, d):
    o = O(spark, d).select("id", "amount")
    return rounded(fe.scale(o, fe.fit_scale(o, ["amount"])))


@register("FE-META", f"SELECT round(p, 6) AS p1, round(p * p, 6) AS p2, amount, round(ln(1 + amount), 6) AS log_amount FROM {SCORED}")
def fe_meta(spark, d):
    return rounded(views.scored_items(spark, d).select(*fe.meta_features(F.col("p"), F.col("p") * F.col("p"), F.col("amount"))))


@register("FE-HSTACK", f"SELECT id, amount, c_acctbal AS extra FROM {ORDERS} LEFT JOIN customer ON cust = c_custkey")
def fe_hstack(spark, d):
    extra = views.table(spark, d, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("extra"))
    return O(spark, d).join(extra, "cust", "left").select("id", "amount", "extra")


# ---- losses

_P = "least(greatest(p, 1e-15), 1 - 1e-15)"
_MED = f"(SELECT median(amount) FROM {SCORED} WHERE amount > 0)"
_MEDF = f"(SELECT median(amount) FROM {SCORED} WHERE y > 0)"
_FOC = f"(CASE WHEN y = 1 THEN 0.25e0 ELSE 0.75e0 END * pow(1 - CASE WHEN y = 1 THEN {_P} ELSE 1 - {_P} END, 2))"
_GROUPS = "count(*) AS n, round(sum(v), 3) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high"


def _summed(df):
    return df.groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


def _loss(name: str, sql: str, loss, part: str):
    """Mean of the loss, or per label the sum and range of a derivative."""
    if part == "value":

        @register(name, f"SELECT round(avg({sql}), 6) AS loss FROM {SCORED}")
        def query(spark, d):
            return rounded(losses.mean_loss(views.scored_items(spark, d), loss))

    else:

        @register(name, f"SELECT y, {_GROUPS} FROM (SELECT y, {sql} AS v FROM {SCORED}) GROUP BY y")
        def query(spark, d):
            rows = losses.with_derivatives(views.scored_items(spark, d), loss)
            return _summed(rows.withColumn("v", F.col("g" if part == "gradient" else "h")))


def _value_weighted(med: str) -> dict[str, str]:
    w_fn, w_fp = f"(amount / {med})", f"(100e0 / {med})"
    return {
        "value": f"-(y * {w_fn} * ln({_P}) + (1 - y) * {w_fp} * ln(1 - {_P}))",
        "gradient": f"-y * {w_fn} * (1 - {_P}) + (1 - y) * {w_fp} * {_P}",
        "hessian": f"greatest({_P} * (1 - {_P}) * (y * {w_fn} + (1 - y) * {w_fp}), 1e-8)",
    }


_SQL = {
    "LS-VW": (losses.ValueWeighted(), _value_weighted(_MED)),
    "LS-RS": (losses.ValueWeighted(scope="fraud"), _value_weighted(_MEDF)),
    "LS-FO": (losses.Focal(), {"value": f"-{_FOC} * ln(CASE WHEN y = 1 THEN {_P} ELSE 1 - {_P} END)", "gradient": f"{_FOC} * ({_P} - y)", "hessian": f"greatest({_FOC} * {_P} * (1 - {_P}), 1e-8)"}),
    "LS-LL": (losses.LogLoss(), {"value": f"-amount * (y * ln({_P}) + (1 - y) * ln(1 - {_P}))", "gradient": f"amount * ({_P} - y)", "hessian": f"greatest(amount * {_P} * (1 - {_P}), 1e-8)"}),
}
for _name, (_object, _parts) in _SQL.items():
    for _part, _short in (("value", "L"), ("gradient", "G"), ("hessian", "H")):
        _loss(f"{_name}-{_short}", _parts[_part], _object, _part)


@register("LS-SIG", f"SELECT y, {_GROUPS} FROM (SELECT y, 1 / (1 + exp(-(p - 0.5e0) * 20)) AS v FROM {SCORED}) GROUP BY y")
def ls_sig(spark, d):
    return _summed(views.scored_items(spark, d).withColumn("v", losses.sigmoid((F.col("p") - 0.5) * 20)))


@register("LS-VW-W", f"SELECT y, {_GROUPS} FROM (SELECT y, amount / {_MED} + 100e0 / {_MED} AS v FROM {SCORED}) GROUP BY y")
def ls_vw_w(spark, d):
    return _summed(losses.ValueWeighted().weigh(views.scored_items(spark, d)).withColumn("v", F.col("w_fn") + F.col("w_fp")))


@register("LS-RS-API", f"SELECT y, {_GROUPS} FROM (SELECT y, ({_value_weighted(_MEDF)['gradient']}) + {_value_weighted(_MEDF)['hessian']} AS v FROM {SCORED}) GROUP BY y")
def ls_rs_api(spark, d):
    rows = losses.with_derivatives(views.scored_items(spark, d), losses.ValueWeighted(scope="fraud"))
    return _summed(rows.withColumn("v", F.col("g") + F.col("h")))


# The loss of the second backend under its own id.
register("LS-RS", ORACLES["LS-RS-L"])(QUERIES["LS-RS-L"])
