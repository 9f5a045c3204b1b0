"""Cuts, ranks and running sums against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from coinsight.operators import ordering, sampling
from coinsight.plans.reporting import markdown_lines, save_markdown, thinned


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [(k * 7 % 5003, rnd.choice([0, 0, 0, 1]), rnd.choice([0.1, 0.5, rnd.random()]), f"2020-01-{rnd.randint(1, 28):02d} 00:00:00") for k in range(3000)]
    frame = spark.createDataFrame(data, "id long, y int, p double, at string").withColumn("at", F.col("at").cast("timestamp")).repartition(5)
    return data, frame


@pytest.mark.parametrize("seed", [None, 3])
def test_classes_are_cut_and_ranked_exactly(rows, seed):
    data, frame = rows
    cut = sampling.class_cut(frame, "y", "id", seed, lambda c, n: 100 if c else n // 3)
    ranked = {r.id: (r["__r"], r["__n"]) for r in sampling.class_rank(frame, "y", "id", seed).collect()}
    for c in (0, 1):
        own = [x for x in data if x[1] == c]
        places = sorted(ranked[x[0]][0] for x in own)
        assert places == list(range(1, len(own) + 1)) and {ranked[x[0]][1] for x in own} == {len(own)}
        if seed is None:
            assert [ranked[x[0]][0] for x in sorted(own)] == places
    kept = {r.id for r in cut.filter("__in").collect()}
    assert kept == {i for i, y, *_ in data if ranked[i][0] <= (100 if y else ranked[i][1] // 3)}
    assert sampling.class_cut(frame.limit(0), "y", "id", seed, lambda c, n: 1).count() == 0


def test_shares_and_time_splits(rows):
    data, frame = rows
    assert sampling.exact_share(frame, 0.37, "id", 5).count() == int(0.37 * 3000)
    assert sampling.exact_share(frame, 1.0, "id", 5).count() == 3000 and sampling.exact_share(frame, 0.0, "id", 5).count() == 0
    order = {i: k for k, (_, i) in enumerate(sorted((at, i) for i, _, _, at in data))}
    got = {(r.id, r.fold): r.role for r in sampling.time_splits(frame, 4, "at", "id").collect()}
    want = {(i, f): "train" if k < 600 * (f + 1) else "test" for i, k in order.items() for f in range(4) if k < 600 * (f + 2)}
    assert got == want
    plan = sampling.early_stop_split(frame, 0.1, "y", "id", 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1  # that of the fixture


def test_running_sums(rows):
    data, frame = rows
    levels = frame.groupBy("p").agg(F.count("*").alias("c"))
    got = {r.p: (r.c_before, r.c_all) for r in ordering.running(frame, levels, "p", ["c"]).collect()}
    values = sorted(x[2] for x in data)
    assert got == {p: (sum(v < p for v in values), len(values)) for p in set(values)}


def test_charts_are_thinned_over_their_whole_range(spark, tmp_path):
    points = spark.range(50_000).select((F.col("id") / 50_000).alias("x"), F.col("id").alias("y"))
    kept = sorted(r.x for r in thinned(points, "x", 200).collect())
    assert kept[0] == 0 and kept[-1] == 49_999 / 50_000 and 150 < len(kept) < 250
    assert max(b - a for a, b in zip(kept, kept[1:], strict=False)) < 0.02
    table = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, v double")
    save_markdown(table, str(tmp_path / "table"))
    assert [r.value for r in spark.read.text(str(tmp_path / "table")).collect()] == [r.text for r in markdown_lines(table).orderBy("line").collect()]
