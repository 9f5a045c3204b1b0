"""Values worked out by hand, and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coinsight.functions import losses
from coinsight.operators import boosting, drift, graph, metrics, pareto, sampling, trees


@pytest.fixture(scope="module")
def ten(spark):
    y, flag = [0] * 8 + [1, 1], [0, 0, 1, 0, 0, 1, 0, 0, 1, 0]
    amount = [float(10 * k) for k in range(1, 9)] + [1000.0, 5000.0]
    p = [0.1, 0.2, 0.8, 0.3, 0.4, 0.9, 0.15, 0.25, 0.95, 0.05]
    return spark.createDataFrame(list(zip(y, flag, amount, p, strict=True)), "y int, flag int, amount double, p double")


def test_report(ten):
    r = metrics.label_metrics(ten, ["tp", "fp", "fn", "tn", "vdr", "net_savings", "roi", "precision", "recall", "f1", "prevented", "investigation", "losses", "net_benefit", "benefit_ratio"]).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 2, 1, 6)
    assert r.vdr == pytest.approx(1 / 6) and r.net_savings == 800 and r.roi == pytest.approx(11 / 3)
    assert (r.precision, r.recall, r.f1) == pytest.approx((1 / 3, 0.5, 0.4))
    assert (r.prevented, r.investigation, r.losses, r.net_benefit) == (1000, 300, 5000, -4300)
    assert metrics.label_metrics(ten, ["net_savings"], cost=500.0).first()[0] == 0


def test_sweep(spark, ten):
    grid = spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 0.9)], "t_id int, t double")
    got = {r.t: (r.tp, r.fp, r.fn, r.tn, r.net_savings) for r in metrics.sweep(ten, grid).collect()}
    assert got == {0.1: (1, 8, 1, 0, 200.0), 0.5: (1, 2, 1, 6, 800.0), 0.9: (1, 1, 1, 7, 900.0)}


def test_empty_and_one_class(spark, ten):
    none = metrics.label_metrics(ten.limit(0), ["vdr", "net_savings", "roi", "precision"]).first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0)
    assert metrics.roc_auc(ten.filter("y = 0")).first()[0] == 0.5
    assert metrics.sweep(ten.limit(0), metrics.default_grid(spark)).count() == 99


def test_precision_above(spark):
    df = spark.createDataFrame([(0, 0.2, 50.0), (1, 0.8, 100.0), (0, 0.3, 200.0), (1, 0.9, 500.0), (0, 0.1, 1000.0), (1, 0.7, 2000.0)], "y int, p double, amount double")
    assert metrics.precision_above(df, 200.0).first()[0] == 1.0 and metrics.precision_above(df, 10000.0).first()[0] == 0.0


def test_weights_and_logit_gradient(spark):
    df = spark.createDataFrame([(1, 0.5, 100.0), (1, 0.5, 200.0)], "y int, p double, amount double")
    got = losses.with_derivatives(df, losses.ValueWeighted()).orderBy("amount").collect()
    assert [r.w_fn for r in got] == pytest.approx([2 / 3, 4 / 3]) and [r.g for r in got] == pytest.approx([-1 / 3, -2 / 3])
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 1), rnd.uniform(-3, 3), rnd.lognormvariate(4, 1)) for _ in range(50)]
    base = spark.createDataFrame(rows, "y int, raw double, amount double")
    for loss in (losses.ValueWeighted(), losses.LogLoss()):
        w = loss.weigh(base)
        at = lambda d, loss=loss: loss.value(F.col("y"), losses.sigmoid(F.col("raw") + d))
        for r in w.select(((at(1e-5) - at(-1e-5)) / 2e-5).alias("num"), loss.gradient(F.col("y"), losses.sigmoid(F.col("raw"))).alias("g")).collect():
            assert r.num == pytest.approx(r.g, rel=1e-4, abs=1e-6)


def test_tiny_tree(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.1, 0.5), (3.0, 4.0, -0.2, 0.4), (5.0, 6.0, 0.3, 0.6)], "f0 double, f1 double, g double, h double")
    root = trees.grow(df, ["f0", "f1"], trees.TreeParams(min_leaf=1))
    assert root.leaf_values() == pytest.approx([-0.08])
    t = trees.grow(df, ["f0", "f1"], trees.TreeParams(max_depth=1, min_leaf=1, min_split=2))
    assert (t.nodes[0].feature, t.nodes[0].threshold, t.nodes[0].missing_left) == ("f0", 4.0, True)
    assert t.nodes[0].gain == pytest.approx(0.0227565789, abs=1e-9)


def brute_tree(x, g, h, depth, params):
    """Leaf value per row, grown by trying every split."""
    out = np.zeros(len(g))

    def grow(rows, d):
        out[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        if d == depth or len(rows) < params.min_split or len(rows) <= params.min_leaf:
            return
        best = (params.min_gain, None)
        for f in range(x.shape[1]):
            ok = rows[~np.isnan(x[rows, f])]
            v = np.unique(x[ok, f])
            for t in (v[1:] + v[:-1]) / 2:
                a, b = ok[x[ok, f] <= t], ok[x[ok, f] > t]
                if min(len(a), len(b)) < params.min_leaf:
                    continue
                part = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
                gain = 0.5 * (part(a) + part(b) - part(rows))
                if gain > best[0] + 1e-12:
                    best = (gain, (f, t, len(a) > len(b)))
        if best[1]:
            f, t, missing_left = best[1]
            left = np.where(np.isnan(x[rows, f]), missing_left, x[rows, f] <= t)
            grow(rows[left], d + 1)
            grow(rows[~left], d + 1)

    grow(np.arange(len(g)), 0)
    return out


def test_tree_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 12, (200, 3)).astype(float)
    x[rnd.random(x.shape) < 0.15] = np.nan
    g, h = rnd.normal(size=200), rnd.uniform(0.1, 0.5, 200)
    rows = [(i, *(None if math.isnan(v) else float(v) for v in x[i]), float(g[i]), float(h[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, g double, h double")
    params = trees.TreeParams(max_depth=3)
    got = trees.grow(df, ["a", "b", "c"], params)
    mine = [r.v for r in df.withColumn("v", got.predict()).orderBy("id").collect()]
    assert mine == pytest.approx(brute_tree(x, g, h, 3, params).tolist(), abs=1e-9)
    flat = boosting._walk(boosting._flatten(got, ["a", "b", "c"]), x)
    assert flat.tolist() == pytest.approx(mine)
    assert sum(got.importance().values()) == pytest.approx(1.0)


def test_boosting_lowers_the_loss(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, float(v), None if i % 9 == 0 else float(rnd.normal()), int(v + 0.3 * rnd.normal() > 0.8), float(rnd.lognormal(4, 1))) for i, v in enumerate(rnd.normal(size=400))]
    df = spark.createDataFrame(rows, "id long, f0 double, f1 double, y int, amount double")
    model = boosting.fit(df, ["f0", "f1"], boosting.BoostParams(n_estimators=3, max_depth=2, early_stopping_rounds=None))
    assert model.train_loss[-1] < model.train_loss[0]
    assert all(0 < r.p < 1 for r in model.with_proba(df).collect())
    with pytest.raises(ValueError):
        boosting.fit(df.withColumn("y", F.lit(3)), ["f0"])
    with pytest.raises(ValueError):
        losses.loss_of("nothing")


def test_frontier_compares_one_computation_of_the_sweep(spark):
    anew = F.udf(lambda v: v + random.random() * 1e-3, "double").asNondeterministic()  # as sums in another order
    rows = [(i, i / 40, float(i), 0.0, 0.0, float(-i), 0.0) for i in range(40)]
    swept = spark.createDataFrame(rows, "t_id int, t double, precision double, recall double, vdr double, net_savings double, roi double")
    swept = swept.withColumn("net_savings", anew("net_savings"))
    assert sorted(r.t_id for r in pareto.frontier(swept).collect()) == list(range(40))


def test_frontier_is_not_dominated(spark, ten):
    _, front, best = pareto.fit(ten)
    rows = front.collect()
    for a in rows:
        for b in rows:
            assert not (all(b[o] >= a[o] for o in pareto.OBJECTIVES) and any(b[o] > a[o] + 1e-9 for o in pareto.OBJECTIVES))
    assert {r.strategy for r in best.collect()} == dict(pareto.STRATEGIES).keys()
    with pytest.raises(ValueError):
        pareto.recommend(best, "other")


def test_drift_edges_and_no_drift(spark):
    df = spark.createDataFrame([(float(k % 2), float(k)) for k in range(100)], "a double, b double")
    reference = drift.reference_edges(df, ["a", "b"])
    edges = {r.feature: r.edges for r in reference.collect()}
    assert edges["a"] == [-0.5, 0.5, 1.5] and len(edges["b"]) == 21
    assert all(r.psi == pytest.approx(0) for r in drift.stability(reference, df, df).collect())
    moved = drift.summary(reference, df, df.withColumn("b", F.col("b") / 3))
    assert drift.recommendation(drift.detect(moved)).first().action in ("monitor_closely", "retrain_soon", "monitor")


def test_small_graph(spark):
    df = spark.createDataFrame([(1, "A", "x"), (1, "B", "x"), (2, "A", "y"), (2, "C", None)], "customer int, merchant string, device string")
    two = graph.edges(df.select("customer", "merchant"), ["customer", "merchant"])
    assert {r.node: r.degree for r in graph.degrees(two).collect()} == {"customer:1": 2, "customer:2": 2, "merchant:A": 2, "merchant:B": 1, "merchant:C": 1}
    assert {r.src for r in graph.with_least_degree(two).collect()} == {"customer:1", "customer:2", "merchant:A"}
    assert all(r.clustering == 0 for r in graph.clustering(two).collect())
    three = graph.edges(df, df.columns)
    assert {r.node: r.clustering for r in graph.clustering(three).collect()}["merchant:B"] == 1.0
    assert graph.pagerank(two).agg(F.sum("rank")).first()[0] == pytest.approx(1.0)
    values, vectors = graph.spectrum(three, 3)
    assert values[0] == pytest.approx(0, abs=1e-9) and vectors.count() == 7


def test_sampling_sizes(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    assert sampling.exact_share(df, 0.333, "id", 3).count() == 333
    split = sampling.early_stop_split(df, 0.1, "y", "id", 1).filter("is_val").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in split} == {0: 90, 1: 10}
    assert sampling.natural_rate_replaced(df, 500, 0.5, "y", "id").groupBy("y").count().orderBy("y").collect()[1][1] == 250
