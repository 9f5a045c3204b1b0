"""Queries: features of the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..sources import views
from .catalog import register, rounded

ENTITIES = ["customer", "supplier", "part"]


def _txn(spark, d):
    li, o = views.table(spark, d, "lineitem"), views.table(spark, d, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier"), F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("part"), F.col("l_extendedprice").alias("amount"))


_TXN = "(SELECT o_custkey AS customer, l_suppkey AS supplier, CASE WHEN l_linenumber <> 3 THEN l_partkey END AS part, l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_NAMED = f"(SELECT 'customer:' || customer AS c, 'supplier:' || supplier AS s, 'part:' || part AS p, amount FROM {_TXN})"
_ONE = lambda w: f"""(SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT c AS src, s AS dst, {w} AS w FROM {_NAMED} UNION ALL SELECT c, p, {w} FROM {_NAMED} UNION ALL SELECT s, p, {w} FROM {_NAMED})
  WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2)"""  # noqa: E731
_EDGES = lambda w="1e0": f"(SELECT * FROM {_ONE(w)} UNION ALL SELECT dst, src, w FROM {_ONE(w)})"
_DEG = f"(SELECT src AS node, sum(w) AS degree, count(*) AS neighbours FROM {_EDGES()} GROUP BY 1)"


def _segments(spark, d):
    """Customers, nations and market segments of all orders."""
    o, c = views.table(spark, d, "orders"), views.table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("customer"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))


@register("GR-NODES", f"SELECT DISTINCT node FROM (SELECT unnest([c, s, p]) AS node FROM {_NAMED}) WHERE node IS NOT NULL")
def gr_nodes(spark, d):
    return gr.nodes(_txn(spark, d), ENTITIES)


@register("GR-CAP")
def gr_cap(spark, d):
    return gr.capped(gr.nodes(_txn(spark, d), ENTITIES), 500)


@register("GR-EDGES", f"SELECT src, dst, round(w, 2) AS w FROM {_EDGES('amount')}")
def gr_edges(spark, d):
    return rounded(gr.edges(_txn(spark, d), ENTITIES, "amount"), 2)


@register("GR-MINDEG", f"SELECT e.src, e.dst, e.w FROM {_EDGES()} e JOIN {_DEG} a ON e.src = a.node JOIN {_DEG} b ON e.dst = b.node WHERE a.degree >= 60 AND b.degree >= 60")
def gr_mindeg(spark, d):
    return gr.with_least_degree(gr.edges(_txn(spark, d), ENTITIES), 60)


@register("GR-LAP", f"SELECT e.src, e.dst, round(-e.w / sqrt(a.degree * b.degree), 6) AS v FROM {_EDGES()} e JOIN {_DEG} a ON e.src = a.node JOIN {_DEG} b ON e.dst = b.node")
def gr_lap(spark, d):
    return rounded(gr.laplacian(gr.edges(_txn(spark, d), ENTITIES)))


@register("GR-DEG", f"SELECT node, round(degree / greatest(max(degree) OVER (), 1), 6) AS degree FROM {_DEG}")
def gr_deg(spark, d):
    return rounded(gr.degree_feature(gr.edges(_txn(spark, d), ENTITIES)))


@register("GR-CC", f"""WITH e AS (SELECT DISTINCT src, dst FROM {_EDGES()}), k AS (SELECT src AS node, count(*) AS k FROM e GROUP BY 1),
  up AS (SELECT e.src, e.dst FROM e JOIN k a ON e.src = a.node JOIN k b ON e.dst = b.node WHERE a.k < b.k OR (a.k = b.k AND e.src < e.dst)),
  tri AS (SELECT x.src AS a, x.dst AS b, z.dst AS c FROM up x JOIN up z ON x.src = z.src JOIN up y ON y.src = x.dst AND y.dst = z.dst),
  t AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1)
  SELECT k.node, round(CASE WHEN k >= 2 THEN 2e0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM k LEFT JOIN t ON k.node = t.node""")
def gr_cc(spark, d):
    return rounded(gr.clustering(gr.links(_txn(spark, d), ENTITIES)))


@register("GR-PR", f"""WITH RECURSIVE e AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM {_EDGES()}), n AS (SELECT DISTINCT src AS node FROM e), m AS (SELECT count(*) AS m FROM n),
  r0 AS (SELECT node, 1e0 / m AS r FROM n, m),
  r1 AS (SELECT dst AS node, 0.15e0 / max(m) + 0.85e0 * sum(s * r) AS r FROM e JOIN r0 ON src = node, m GROUP BY dst),
  r2 AS (SELECT dst AS node, 0.15e0 / max(m) + 0.85e0 * sum(s * r) AS r FROM e JOIN r1 ON src = node, m GROUP BY dst),
  r3 AS (SELECT dst AS node, 0.15e0 / max(m) + 0.85e0 * sum(s * r) AS r FROM e JOIN r2 ON src = node, m GROUP BY dst)
  SELECT node, round(r, 9) AS rank FROM r3""")
def gr_pr(spark, d):
    return rounded(gr.pagerank(gr.edges(_txn(spark, d), ENTITIES), iterations=3, tolerance=None), 9)


def _solved(spark, d):
    graph = gr.with_least_degree(gr.edges(_segments(spark, d), ["customer", "nation", "segment"]))
    return graph, *gr.spectrum(graph, 10)


@register("GR-EIG")
def gr_eig(spark, d):
    return _solved(spark, d)[2]


@register("GR-BAND")
def gr_band(spark, d):
    _, values, vectors = _solved(spark, d)
    return gr.bands(vectors, len(values))


@register("GR-HET")
def gr_het(spark, d):
    graph, _, vectors = _solved(spark, d)
    return gr.heterogeneity(graph, vectors)


@register("GR-SUM")
def gr_sum(spark, d):
    graph, values, _ = _solved(spark, d)
    return spark.createDataFrame([tuple(gr.spectrum_summary(values, gr.degrees(graph).count()).values())], "n_nodes long, n_components long, total double, variance double, gap double, largest double, smallest double")


@register("GR-MAP", f"""SELECT customer, supplier, part, round(coalesce(a.d, 0), 6) AS customer_degree, round(coalesce(b.d, 0), 6) AS supplier_degree, round(coalesce(q.d, 0), 6) AS part_degree FROM
  (SELECT customer, supplier, part, 'customer:' || customer AS c, 'supplier:' || supplier AS s, 'part:' || part AS p FROM {_TXN}) t
  LEFT JOIN (SELECT node, degree / max(degree) OVER () AS d FROM {_DEG}) a ON t.c = a.node LEFT JOIN (SELECT node, degree / max(degree) OVER () AS d FROM {_DEG}) b ON t.s = b.node
  LEFT JOIN (SELECT node, degree / max(degree) OVER () AS d FROM {_DEG}) q ON t.p = q.node""")
def gr_map(spark, d):
    txn = _txn(spark, d).select(*ENTITIES)
    return rounded(gr.map_to_rows(txn, gr.degree_feature(gr.edges(txn, ENTITIES)), ENTITIES))


@register("GR-NAMES", "SELECT unnest(['customer_degree', 'nation_degree', 'segment_degree']) AS name")
def gr_names(spark, d):
    rows = _segments(spark, d)
    mapped = gr.map_to_rows(rows, gr.degree_feature(gr.edges(rows, rows.columns)), rows.columns)
    return spark.createDataFrame([(c,) for c in mapped.columns if c.endswith("_degree")], "name string")


@register("GR-FITX")
def gr_fitx(spark, d):
    rows = _segments(spark, d)
    return gr.map_to_rows(rows, gr.node_features(rows, rows.columns, k=5), rows.columns)
