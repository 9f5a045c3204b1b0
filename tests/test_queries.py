"""A cross-section of the registered queries against DuckDB."""

import os
import random

import pytest
from pyspark.sql import functions as F

from coinsight.operators import graph
from coinsight.plans import catalog

from .oracles import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["SRC-CSV", "FLT-QTR", "AGG-QTR", "SMP-NAT-R", "SPL-ES", "SPL-TS", "FE-ALL", "LS-VW-G", "LS-FO-H", "LS-RS-L", "MT-REP", "MT-SWEEP", "MT-SENS", "MT-AUC", "MT-P@R", "MT-ECE", "MT-CVSUM", "PA-REC", "DR-REF", "DR-SUMM", "DR-PERF", "TR-SPLIT", "TR-BUILD", "TR-IMP", "GB-RAW", "CA-STATS", "GR-EDGES", "GR-CC", "GR-PR", "GR-MAP"]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, SF, catalog.queries()[name], catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["PA-FRONT", "PA-POINTS", "PA-REC", "PA-FIT", "PA-REPORT"])
def test_ties_of_rounded_metrics_go_as_in_sql(spark, tmp_path, name):
    # Savings differ by 0.00001, the SQL compares four digits.
    rows = "(VALUES ('R', 50e0, 0.1e0, 0.08e0, 1000e0), ('R', 25e0, 0e0, 0e0, -0.00001e0), ('N', 0e0, 0e0, 0e0, 5e0)) v(l_returnflag, l_quantity, l_discount, l_tax, l_extendedprice)"
    connect(tmp_path).execute(f"COPY (SELECT *, 'F' AS l_linestatus FROM {rows}) TO '{tmp_path}/lineitem.parquet'")
    assert compare(spark, connect(tmp_path), str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_stream_of_reports(spark):
    assert catalog.queries()["STREAM-DRIFT"](spark, SF).count() >= 1


def _shuffled(spark) -> int:
    """Bytes that all stages so far wrote for shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_clustering_shuffles_no_wedges(spark, monkeypatch):
    # 300 nodes, all linked: 44,850 edges, 4.5 million wedges; the lists are sent in three turns.
    ring = spark.range(300).select(F.col("id").cast("string").alias("src"))
    whole = ring.crossJoin(ring.withColumnRenamed("src", "dst")).filter("src <> dst").withColumn("w", F.lit(1.0))
    monkeypatch.setattr(graph, "SENT_EDGES", 15_000)
    before = _shuffled(spark)
    found = graph.clustering(whole).collect()
    assert len(found) == 300 and all(r.clustering == 1.0 for r in found)
    assert _shuffled(spark) - before < 5_000_000


@pytest.mark.parametrize("most", [50, 6_000_000])
def test_clustering_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "SENT_EDGES", most)
    monkeypatch.setattr(graph, "SENT_NODES", most)
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(250)] + [("a", "b"), ("b", "a"), ("c", "c")]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {x: sum(b in near[a] for a in k for b in k) / (len(k) * (len(k) - 1)) if len(k) > 1 else 0.0 for x, k in near.items()}
    found = {r.node: r.clustering for r in graph.clustering(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert found == pytest.approx(want)
    assert graph.clustering(spark.createDataFrame([], "src string, dst string")).count() == 0
