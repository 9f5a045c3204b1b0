"""The spectrum of graphs beyond the dense size, and the rows of its queries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from coinsight.operators import graph
from coinsight.plans import catalog, queries_graph

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = np.random.default_rng(4)
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(rnd.integers(0, 60, 150), rnd.integers(0, 25, 150), strict=True)], "a long, b long")


@pytest.mark.parametrize("held", [True, False])
def test_large_and_dense_paths_agree(spark, pairs, monkeypatch, held):
    whole = graph.edges(pairs, pairs.columns)
    want, _ = graph.spectrum(whole, 5)
    monkeypatch.setattr(graph, "DENSE_NODES", 0)
    monkeypatch.setattr(graph, "HELD_NODES", graph.HELD_NODES if held else 0)
    values, vectors = graph.spectrum(whole, 5)
    assert np.allclose(values, want, atol=1e-8)
    x = {r.node: np.array(r.vector) for r in vectors.collect()}
    at = {name: i for i, name in enumerate(x)}
    matrix = np.eye(len(x))
    for r in graph.laplacian(whole).collect():
        matrix[at[r.src], at[r.dst]] += r.v
    x = np.array(list(x.values()))
    assert np.allclose(matrix @ x, x * values, atol=1e-5)  # each vector beside its own value
    assert np.allclose(x.T @ x, np.eye(5), atol=1e-8)


def test_no_convergence_raises(pairs, monkeypatch):
    monkeypatch.setattr(graph, "DENSE_NODES", 0)
    monkeypatch.setattr(graph, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        graph.spectrum(graph.edges(pairs, pairs.columns), 5)


def test_queries_take_every_customer(spark):
    orders = queries_graph.views.table(spark, SF, "orders")
    want = orders.filter("o_custkey is not null").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))).distinct()
    assert {r[0] for r in want.collect()} <= {r.node for r in queries_graph.gr_eig(spark, SF).collect()}


def test_few_hubs_give_the_spectrum(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(rnd.integers(0, 25, 3000), rnd.integers(0, 5, 3000), strict=True))], "customer long, nation long, segment long")
    whole = graph.edges(rows, rows.columns)
    want, _ = graph.spectrum(whole, 10)  # all 3,030 nodes on the driver
    monkeypatch.setattr(graph, "DENSE_NODES", 60)
    monkeypatch.setattr(graph, "ROUNDS", 0)  # no iteration, which takes too many rounds for values this close
    values, vectors = graph.spectrum(whole, 10)
    assert np.allclose(values, want, atol=1e-10)
    x = {r.node: np.array(r.vector) for r in vectors.collect()}
    at = {name: i for i, name in enumerate(x)}
    x = np.array(list(x.values()))
    moved = x.copy()
    for r in graph.laplacian(whole).collect():
        moved[at[r.src]] += r.v * x[at[r.dst]]
    assert len(x) == 3030
    assert np.allclose(moved, x * values, atol=1e-9)
    assert np.allclose(x.T @ x, np.eye(10), atol=1e-9)


@pytest.mark.parametrize("name", ["GR-EIG", "GR-BAND", "GR-HET", "GR-SUM"])
def test_spectral_queries_need_no_iteration(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "DENSE_NODES", 60)
    monkeypatch.setattr(graph, "ROUNDS", 0)
    assert catalog.queries()[name](spark, SF).count() >= 1
