"""Queries: trees, boosting, pipelines and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses
from ..operators import boosting, ensemble, metrics, ordering, pipeline, trees
from ..sources import views
from ..sources.views import SCORED, TREE_ROWS
from .catalog import register, rounded

FEATURES = ["f0", "f1", "f2"]
PARAMS = trees.TreeParams()
T = views.tree_rows

# ---- split search, in SQL over one node


def _candidates(source: str) -> str:
    """Every allowed split of each node of a relation with node, f0..f2, g, h."""
    long = f"(SELECT node, unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS v, g, h FROM {source})"
    return f"""(SELECT node, f, (v + nxt) / 2 AS threshold, nl, n_ok - nl AS nr,
      0.5e0 * (gl * gl / (hl + 1) + (g_ok - gl) * (g_ok - gl) / (h_ok - hl + 1) - g_all * g_all / (h_all + 1)) AS gain FROM
      (SELECT node, f, v, lead(v) OVER w AS nxt, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER k AS g_ok, sum(h) OVER k AS h_ok, sum(n) OVER k AS n_ok, g_all, h_all FROM
       (SELECT node, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {long} WHERE v IS NOT NULL GROUP BY 1, 2, 3)
       JOIN (SELECT node, sum(g) AS g_all, sum(h) AS h_all FROM {source} GROUP BY 1) USING (node)
       WINDOW w AS (PARTITION BY node, f ORDER BY v), k AS (PARTITION BY node, f))
      WHERE nxt IS NOT NULL AND nl >= 10 AND n_ok - nl >= 10)"""


def _best(source: str) -> str:
    return f"(SELECT * FROM {_candidates(source)} WHERE gain >= 1e-7 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, f, threshold) = 1)"


_ROOT = f"(SELECT 0 AS node, * FROM {TREE_ROWS})"
_VALUE = "CASE f WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END"
_ROUTE = f"CASE WHEN f IS NULL THEN x.node WHEN {_VALUE} IS NULL THEN CASE WHEN nl > nr THEN 2 * x.node + 1 ELSE 2 * x.node + 2 END WHEN {_VALUE} <= threshold THEN 2 * x.node + 1 ELSE 2 * x.node + 2 END"
_CTES = f"""b0 AS MATERIALIZED (SELECT * FROM {_best(_ROOT)}), l1 AS MATERIALIZED (SELECT {_ROUTE} AS node, f0, f1, f2, y, amount, g, h FROM {_ROOT} x LEFT JOIN b0 ON x.node = b0.node),
  b1 AS MATERIALIZED (SELECT * FROM {_best('l1')}), l2 AS MATERIALIZED (SELECT {_ROUTE} AS node, f0, f1, f2, y, amount, g, h FROM l1 x LEFT JOIN b1 ON x.node = b1.node),
  s AS (SELECT node, count(*) AS n, -sum(g) / (sum(h) + 1) AS value FROM (SELECT 0 AS node, g, h FROM l2 UNION ALL SELECT node, g, h FROM l1 UNION ALL SELECT node, g, h FROM l2 WHERE node > 2) GROUP BY 1)"""


def _root(spark, d):
    return T(spark, d).withColumn("node", F.lit(0))


def _tree(spark, d, depth: int = 2) -> trees.Tree:
    return trees.grow(T(spark, d), FEATURES, trees.TreeParams(max_depth=depth))


def _named(df):
    return df.withColumn("f", F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("f") + 1))


@register("TR-LEAF", f"SELECT round(-sum(g) / (sum(h) + 1), 6) AS value FROM {TREE_ROWS}")
def tr_leaf(spark, d):
    return rounded(trees.node_stats(_root(spark, d)).select(trees.leaf_value(F.col("g"), F.col("h")).alias("value")))


@register("TR-STOP", f"SELECT CAST(f0 AS INT) AS node, count(*) AS n, count(*) < 20 OR count(*) <= 10 AS stops FROM {TREE_ROWS} GROUP BY 1")
def tr_stop(spark, d):
    stats = trees.node_stats(T(spark, d).withColumn("node", F.col("f0").cast("int")))
    return stats.select("node", "n", ((F.col("n") < PARAMS.min_split) | (F.col("n") <= PARAMS.min_leaf)).alias("stops"))


_TAG = "CASE f WHEN 0 THEN 'f0' WHEN 1 THEN 'f1' ELSE 'f2' END AS f"


@register("TR-THR", f"SELECT {_TAG}, round(threshold, 6) AS threshold FROM {_candidates(_ROOT)}")
def tr_thr(spark, d):
    return rounded(_named(trees.candidates(_root(spark, d), FEATURES, PARAMS)).select("f", "threshold"))


@register("TR-GAIN", f"SELECT {_TAG}, round(threshold, 6) AS threshold, CAST(nl AS BIGINT) AS nl, CAST(nr AS BIGINT) AS nr, round(gain, 6) AS gain FROM {_candidates(_ROOT)}")
def tr_gain(spark, d):
    return rounded(_named(trees.candidates(_root(spark, d), FEATURES, PARAMS)).select("f", "threshold", "nl", "nr", "gain"))


@register("TR-SPLIT", f"SELECT {_TAG}, round(threshold, 6) AS threshold, CAST(nl AS BIGINT) AS nl, CAST(nr AS BIGINT) AS nr, round(gain, 6) AS gain FROM {_best(_ROOT)}")
def tr_split(spark, d):
    return rounded(trees.best_splits(_root(spark, d), FEATURES, PARAMS).select(F.col("feature").alias("f"), "threshold", "nl", "nr", "gain"))


@register("TR-MINGAIN", f"SELECT {_TAG}, count(*) AS n FROM {_candidates(_ROOT)} WHERE gain >= 1e-7 GROUP BY 1")
def tr_mingain(spark, d):
    return _named(trees.candidates(_root(spark, d), FEATURES, PARAMS).filter(F.col("gain") >= PARAMS.min_gain)).groupBy("f").agg(F.count("*").alias("n"))


@register("TR-MISS", f"SELECT {_TAG}, count(CASE WHEN nl > nr THEN 1 END) AS left_ways, count(CASE WHEN nl <= nr THEN 1 END) AS right_ways FROM {_candidates(_ROOT)} GROUP BY 1")
def tr_miss(spark, d):
    left = F.col("nl") > F.col("nr")
    return _named(trees.candidates(_root(spark, d), FEATURES, PARAMS)).groupBy("f").agg(F.count(F.when(left, 1)).alias("left_ways"), F.count(F.when(~left, 1)).alias("right_ways"))


@register("TR-PART", f"WITH {_CTES} SELECT CAST(node AS INT) AS node, count(*) AS n, round(sum(amount), 2) AS amount FROM l1 GROUP BY 1")
def tr_part(spark, d):
    t = _tree(spark, d, 1)
    return T(spark, d).groupBy(t.leaf().alias("node")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


_NODES = """SELECT CAST(s.node AS INT) AS node, CASE b.f WHEN 0 THEN 'f0' WHEN 1 THEN 'f1' WHEN 2 THEN 'f2' END AS feature, round(b.threshold, 6) AS threshold, s.n, round(s.value, 6) AS value
  FROM s LEFT JOIN (SELECT node, f, threshold FROM b0 UNION ALL SELECT node, f, threshold FROM b1) b ON s.node = b.node"""


def _nodes(spark, d):
    return rounded(_tree(spark, d).table(spark).select("node", "feature", "threshold", "n", "value"))


register("TR-BUILD", f"WITH {_CTES} {_NODES}")(_nodes)
register("TR-RS-BUILD", f"WITH {_CTES} {_NODES}")(_nodes)


@register("TR-PRED", f"WITH {_CTES} SELECT round(value, 6) AS value, y, count(*) AS n FROM l2 JOIN s ON l2.node = s.node GROUP BY 1, 2")
def tr_pred(spark, d):
    return T(spark, d).withColumn("value", F.round(_tree(spark, d).predict(), 6)).groupBy("value", "y").agg(F.count("*").alias("n"))


@register("TR-IMP", f"WITH {_CTES}, i AS (SELECT f, sum(gain) AS gain FROM (SELECT f, gain FROM b0 UNION ALL SELECT f, gain FROM b1) GROUP BY 1) SELECT {_TAG.replace(' AS f', '')} AS feature, round(gain / sum(gain) OVER (), 5) AS importance FROM i")
def tr_imp(spark, d):
    return rounded(trees.importance_table(_tree(spark, d).table(spark)), 5)


@register("TR-LEAVES", f"WITH {_CTES} SELECT round(value, 6) AS value, n FROM s WHERE node NOT IN (SELECT node FROM b0) AND node NOT IN (SELECT node FROM b1)")
def tr_leaves(spark, d):
    return rounded(_tree(spark, d).table(spark).filter("feature is null").select("value", "n"))


# The same operators under the ids of the second backend, whose semantics follow the first.
for _alias, _of in (("TR-RS-SPLIT", "TR-SPLIT"), ("TR-RS-FEAT", "TR-THR"), ("TR-RS-GAIN", "TR-GAIN"), ("TR-RS-PART", "TR-PART"), ("TR-RS-PRED", "TR-PRED"), ("TR-RS-API", "TR-LEAF")):
    from .catalog import ORACLES, QUERIES

    register(_alias, ORACLES[_of])(QUERIES[_of])


@register("TR-RS-IMP", f"WITH {_CTES} SELECT {_TAG.replace(' AS f', '').replace('CASE f', 'CASE b.f')} AS feature, CAST(sum(s.n) AS BIGINT) AS n FROM (SELECT node, f FROM b0 UNION ALL SELECT node, f FROM b1) b JOIN s ON s.node = b.node GROUP BY 1")
def tr_rs_imp(spark, d):
    return _tree(spark, d).table(spark).filter("feature is not null").groupBy("feature").agg(F.sum("n").alias("n"))


# ---- boosting

ONE = boosting.BoostParams(n_estimators=1, max_depth=1, subsample=1.0, colsample=1.0, early_stopping_rounds=None, mode="exact", loss="logloss")
FEW = boosting.BoostParams(n_estimators=3, max_depth=2, early_stopping_rounds=2, random_state=4)


def _orders(spark, d):
    """Orders with numeric features."""
    return views.orders(spark, d).select("id", "y", "amount", F.dayofyear("ts").cast("double").alias("f0"), F.when(F.col("cust") % 7 != 0, F.col("cust") % 50).cast("double").alias("f1"), F.weekday("ts").cast("double").alias("f2"), "ts", "cust", "status")


_BASE = f"(SELECT ln(avg(y) / (1 - avg(y))) FROM {TREE_ROWS})"
_GH = f"(SELECT 0 AS node, f0, f1, f2, y, 1 / (1 + exp(-{_BASE})) - y AS g, (1 / (1 + exp(-{_BASE}))) * (1 - 1 / (1 + exp(-{_BASE}))) AS h FROM {TREE_ROWS})"
_STUMP = f"""b AS MATERIALIZED (SELECT * FROM {_best(_GH)}), r AS MATERIALIZED (SELECT {_ROUTE} AS node, y, g, h FROM {_GH} x LEFT JOIN b ON x.node = b.node),
  v AS (SELECT node, -sum(g) / (sum(h) + 1) AS value FROM r GROUP BY 1), q AS (SELECT y, {_BASE} + 0.1e0 * value AS raw FROM r JOIN v ON r.node = v.node)"""


def _stump(spark, d):
    rows = T(spark, d).withColumn("id", F.monotonically_increasing_id())
    return rows, boosting.fit(rows, FEATURES, ONE, amount=None)


@register("GB-BASE", f"SELECT round({_BASE}, 6) AS base")
def gb_base(spark, d):
    return spark.createDataFrame([(round(boosting.base_score(T(spark, d)), 6),)], "base double")


def _scored(name: str, column: str, sql: str):
    @register(name, f"WITH {_STUMP} SELECT {sql} AS v, y, count(*) AS n FROM q GROUP BY 1, 2")
    def query(spark, d):
        rows, model = _stump(spark, d)
        out = model.with_raw(rows).withColumn("proba", losses.sigmoid(F.col("raw"))).withColumn("pred", (F.col("proba") >= 0.33).cast("int"))
        v = F.col(column) if column == "pred" else F.round(column, 6)
        return out.groupBy(v.alias("v"), "y").agg(F.count("*").alias("n"))


_scored("GB-RAW", "raw", "round(raw, 6)")
_scored("GB-FIT", "raw", "round(raw, 6)")
_scored("GB-RS", "raw", "round(raw, 6)")
_scored("GB-PROBA", "proba", "round(1 / (1 + exp(-raw)), 6)")
_scored("GB-PRED", "pred", "CASE WHEN 1 / (1 + exp(-raw)) >= 0.33e0 THEN 1 ELSE 0 END")


@register("GB-ES")
def gb_es(spark, d):
    model = boosting.fit(_orders(spark, d), FEATURES, FEW)
    return spark.createDataFrame([(k, a, b, k == model.best_iteration) for k, (a, b) in enumerate(zip(model.train_loss, model.val_loss, strict=True))], "round int, train double, val double, best boolean")


@register("GB-IMP")
def gb_imp(spark, d):
    return spark.createDataFrame(list(boosting.fit(_orders(spark, d), FEATURES, FEW).importance().items()), "feature string, importance double")


@register("GB-TOPK")
def gb_topk(spark, d):
    return gb_imp(spark, d).orderBy(F.desc("importance"), "feature").limit(2)


@register("GB-VAL", f"SELECT count(*) AS n FROM {TREE_ROWS}")
def gb_val(spark, d):
    return spark.createDataFrame([(boosting.validate(T(spark, d), FEATURES),)], "n long")


@register("GB-LOSS", "SELECT unnest(['focal', 'logloss', 'value_weighted']) AS name")
def gb_loss(spark, d):
    return spark.createDataFrame([(n,) for n in losses.LOSSES if losses.loss_of(n)], "name string")


@register("GB-BACK", "SELECT unnest(['exact', 'hist']) AS mode, 2 AS leaves")
def gb_back(spark, d):
    found = [(m, len(trees.grow(T(spark, d), FEATURES, trees.TreeParams(max_depth=1, mode=m)).leaf_values())) for m in ("exact", "hist")]
    return spark.createDataFrame(found, "mode string, leaves int")


@register("GB-PARAMS", "SELECT 100 AS n_estimators, 0.1e0 AS learning_rate, 6 AS max_depth")
def gb_params(spark, d):
    p = boosting.BoostParams()
    return spark.createDataFrame([(p.n_estimators, p.learning_rate, p.max_depth)], "n_estimators int, learning_rate double, max_depth int")


register("GB-CTOR", "SELECT 100 AS n_estimators, 0.1e0 AS learning_rate, 6 AS max_depth")(gb_params)


@register("GB-RSGET")
def gb_rsget(spark, d):
    model = boosting.fit(_orders(spark, d), FEATURES, FEW)
    return spark.createDataFrame([(model.base, len(model.trees))], "base double, n_trees int")


# ---- cascades and stacks over given scores

_P12 = f"(SELECT y, amount, p AS p1, p * p AS p2 FROM {SCORED})"


def _p12(spark, d):
    return views.scored_items(spark, d).select("y", "amount", F.col("p").alias("p1"), (F.col("p") * F.col("p")).alias("p2"))


def _combined(name: str, sql: str, column):
    @register(name, f"SELECT round(v, 6) AS v, y, count(*) AS n FROM (SELECT y, {sql} AS v FROM {_P12}) GROUP BY 1, 2")
    def query(spark, d):
        return _p12(spark, d).withColumn("v", F.round(column(F.col("p1"), F.col("p2")), 6)).groupBy("v", "y").agg(F.count("*").alias("n"))


_combined("CA-PROBA", "CASE WHEN p1 >= 0.5e0 THEN p2 ELSE 0 END", lambda a, b: ensemble.cascade_proba(a, b, 0.5))
_combined("CA-PROBA-N", "CASE WHEN p1 >= 0.5e0 THEN p2 ELSE p1 END", lambda a, b: ensemble.cascade_proba_keep(a, b, 0.5))

_META = "1 / (1 + exp(-(0.5e0 * p1 + 1.5e0 * p2 + 0.1e0 * ln(1 + amount) - 2e0)))"


@register("ST-PROBA", f"SELECT y, count(*) AS n, round(avg({_META}), 6) AS p FROM {_P12} GROUP BY y")
def st_proba(spark, d):
    raw = 0.5 * F.col("p1") + 1.5 * F.col("p2") + 0.1 * F.log1p("amount") - 2.0
    return rounded(_p12(spark, d).groupBy("y").agg(F.count("*").alias("n"), F.avg(losses.sigmoid(raw)).alias("p")))


_STATS = f"(SELECT count(*) AS n, count(CASE WHEN p1 >= 0.5e0 THEN 1 END) AS flagged, count(CASE WHEN p1 >= 0.5e0 AND y = 1 THEN 1 END) AS caught, count(CASE WHEN y = 1 THEN 1 END) AS fraud FROM {_P12})"


@register("CA-STATS", f"SELECT flagged, caught, round(caught::DOUBLE / fraud, 6) AS recall, round(caught::DOUBLE / flagged, 6) AS precision, round(1 - flagged::DOUBLE / n, 6) AS reduction, round(n::DOUBLE / flagged, 6) AS speedup FROM {_STATS}")
def ca_stats(spark, d):
    return rounded(ensemble.cascade_stats(_p12(spark, d), 0.5))


@register("CA-SPEED", f"SELECT round(n::DOUBLE / flagged, 6) AS speedup FROM {_STATS}")
def ca_speed(spark, d):
    return rounded(ensemble.cascade_stats(_p12(spark, d), 0.5).select("speedup"))


@register("CA-BREAK", f"SELECT CASE WHEN p1 < 0.5e0 THEN 'passed_stage1' WHEN p2 >= 0.5e0 THEN 'flagged' ELSE 'cleared_stage2' END AS way, count(*) AS n, CAST(sum(y) AS BIGINT) AS fraud FROM {_P12} GROUP BY 1")
def ca_break(spark, d):
    return ensemble.cascade_breakdown(_p12(spark, d), 0.5)


from .queries_metrics import _select, _sums, _tidy  # noqa: E402

_EVAL = ["tp", "fp", "fn", "tn", "precision", "recall", "vdr", "net_savings"]


def _evaluated(name: str, sql: str, flag):
    @register(name, _select(_EVAL, _sums(_P12, sql)))
    def query(spark, d):
        return _tidy(metrics.label_metrics(_p12(spark, d).withColumn("flag", flag().cast("int")), _EVAL))


_evaluated("CA-PRED", "(CASE WHEN p1 >= 0.5e0 THEN p2 ELSE 0 END) >= 0.4e0", lambda: ensemble.cascade_proba(F.col("p1"), F.col("p2"), 0.5) >= 0.4)
_evaluated("CA-EVAL", "(CASE WHEN p1 >= 0.5e0 THEN p2 ELSE 0 END) >= 0.5e0", lambda: ensemble.cascade_proba(F.col("p1"), F.col("p2"), 0.5) >= 0.5)
_evaluated("ST-PRED", f"{_META} >= 0.4e0", lambda: losses.sigmoid(0.5 * F.col("p1") + 1.5 * F.col("p2") + 0.1 * F.log1p("amount") - 2.0) >= 0.4)
_evaluated("ST-EVAL", f"{_META} >= 0.5e0", lambda: losses.sigmoid(0.5 * F.col("p1") + 1.5 * F.col("p2") + 0.1 * F.log1p("amount") - 2.0) >= 0.5)


@register("WT-SPW", f"SELECT round((count(*) - sum(y))::DOUBLE / sum(y), 6) AS weight FROM {SCORED}")
def wt_spw(spark, d):
    return rounded(ensemble.positive_weight(views.scored_items(spark, d)))


# ---- fitted models

SMALL = boosting.BoostParams(n_estimators=2, max_depth=2, early_stopping_rounds=None)


def _baseline(name: str, kind: str):
    @register(name)
    def query(spark, d):
        rows = _orders(spark, d)
        return ensemble.Baseline(kind, FEATURES).fit(rows, trees=3, depth=3).with_proba(rows).select("id", "p")


_baseline("BL-XGB", "gbt")
_baseline("BL-LGB", "gbt")
_baseline("BL-RF", "forest")
_baseline("BL-LR", "logistic")


@register("CA-FIT")
def ca_fit(spark, d):
    rows = _orders(spark, d)
    return ensemble.Cascade(FEATURES, 0.5, SMALL).fit(rows).with_proba(rows).select("id", "p1", "p")


@register("ST-OOF")
def st_oof(spark, d):
    return ensemble.Stack(FEATURES, 2, SMALL).out_of_fold(_orders(spark, d)).select("id", "fold", "p1", "p2")


@register("ST-FIT")
def st_fit(spark, d):
    rows = _orders(spark, d)
    return ensemble.Stack(FEATURES, 2, SMALL).fit(rows).with_proba(rows).select("id", "p1", "p2", "p")


@register("ST-COEF")
def st_coef(spark, d):
    return spark.createDataFrame(list(ensemble.Stack(FEATURES, 2, SMALL).fit(_orders(spark, d)).coefficients().items()), "name string, weight double")


def _pipeline(spark, d, cv=None):
    rows = _orders(spark, d)
    return rows, pipeline.RiskPipeline(FEATURES, cv=cv, folds=2, params=SMALL).fit(rows, ts="ts")


@register("PL-FIT")
def pl_fit(spark, d):
    _, p = _pipeline(spark, d)
    return spark.createDataFrame([(p.threshold, len(p.model.trees))], "threshold double, n_trees int")


@register("PL-PRED")
def pl_pred(spark, d):
    rows, p = _pipeline(spark, d)
    return p.predict(rows).select("id", "p", "flag")


@register("PL-EVAL")
def pl_eval(spark, d):
    rows, p = _pipeline(spark, d)
    return p.evaluate(rows)


@register("PL-DRIFT")
def pl_drift(spark, d):
    rows, p = _pipeline(spark, d)
    return p.drift(rows.filter("ts >= '1997-01-01'"))


@register("PL-PREP", f"SELECT o_orderkey AS id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS f0 FROM (SELECT o_orderkey, dayofyear(o_orderdate)::DOUBLE AS x FROM orders)")
def pl_prep(spark, d):
    from ..operators import features as fe

    rows = _orders(spark, d).select("id", "f0")
    return rounded(pipeline.RiskPipeline(["f0"], scaled=fe.fit_scale(rows, ["f0"])).prepare(rows))


@register("PL-CV")
def pl_cv(spark, d):
    _, p = _pipeline(spark, d, "time")
    return spark.createDataFrame([(k, r["vdr"], r["net_savings"]) for k, r in enumerate(p.cv_results)], "fold int, vdr double, net_savings double")


@register("PL-SUM")
def pl_sum(spark, d):
    _, p = _pipeline(spark, d, "stratified")
    return spark.createDataFrame([(m, *v) for m, v in p.summary()["cv"].items()], "metric string, mean double, std double")


@register("STREAM-DRIFT")
def stream_drift(spark, d):
    """Drift reports of a stream of all events against those up to the median time."""
    import uuid

    from ..operators import drift
    from ..streaming import monitor
    from .storage import scratch

    path = f"{d}/events.parquet"
    events = spark.read.parquet(path)
    at = ordering.number(events, "ts")
    middle = events.agg(F.percentile_approx(at, 0.5)).first()[0]
    base = events.filter(at <= F.lit(middle))
    reference = drift.reference_edges(base, ["value"])
    at = f"{scratch(spark)}/drift-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if _is_folder(spark, path) else f"{path}*")
    monitor.watch(stream, reference, base, f"{at}/history", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/history").select("drifted", "n_drifted", "mean_psi", "overall", "action", "batch")


def _is_folder(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


@register("EN-AVG", f"SELECT y, count(*) AS n, round(sum((p1 + p2) / 2), 4) AS total, round(max((p1 + p2) / 2), 6) AS high FROM {_P12} GROUP BY y")
def en_avg(spark, d):
    rows = _p12(spark, d).withColumn("v", ensemble.average(F.col("p1"), F.col("p2")))
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.max("v"), 6).alias("high"))
