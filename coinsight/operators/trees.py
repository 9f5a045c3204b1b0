"""Regression trees on gradients, grown level by level.

One aggregation per level serves all nodes: gradient sums per (node, feature,
value), prefix sums over the values, and the best split per node, which also
gives the sums of its children. In ``hist`` mode values are first cut into
quantile bins, so what one (node, feature) holds is bounded whatever the size
of the data. Only the splits of a level, at most one row per node, come to the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import reached


@dataclass(frozen=True)
class TreeParams:
    """Limits of a tree; gains below ``min_gain`` make no split."""

    max_depth: int = 6
    min_leaf: int = 10
    min_split: int = 20
    min_gain: float = 1e-7
    reg_lambda: float = 1.0
    mode: str = "exact"  # or "hist"
    bins: int = 64


@dataclass
class Node:
    """A node by its number: children of k are 2k + 1 and 2k + 2."""

    value: float
    n: int
    feature: str | None = None
    threshold: float | None = None
    missing_left: bool = False
    gain: float = 0.0


@dataclass
class Tree:
    """Nodes of a grown tree."""

    nodes: dict[int, Node] = field(default_factory=dict)

    def _column(self, leaf, k: int = 0) -> Column:
        node = self.nodes[k]
        if node.feature is None:
            return F.lit(leaf(k, node))
        f = F.col(node.feature)
        left, right = self._column(leaf, 2 * k + 1), self._column(leaf, 2 * k + 2)
        return F.when(f.isNull(), left if node.missing_left else right).when(f <= node.threshold, left).otherwise(right)

    def predict(self) -> Column:
        """The leaf value of a row."""
        return self._column(lambda k, n: n.value)

    def leaf(self) -> Column:
        """The number of the row's node."""
        return self._column(lambda k, n: k)

    def importance(self) -> dict[str, float]:
        """Share of the total gain per feature; empty without splits."""
        out: dict[str, float] = {}
        for n in self.nodes.values():
            if n.feature:
                out[n.feature] = out.get(n.feature, 0.0) + n.gain
        total = sum(out.values())
        return {f: g / total for f, g in out.items()} if total > 0 else {}

    def leaf_values(self) -> list[float]:
        """Values of the leaves, left to right."""

        def walk(k: int) -> list[float]:
            n = self.nodes[k]
            return [n.value] if n.feature is None else walk(2 * k + 1) + walk(2 * k + 2)

        return walk(0) if self.nodes else []

    def table(self, spark) -> DataFrame:
        """One row per node."""
        rows = [(k, n.feature, n.threshold, n.missing_left, n.value, n.gain, n.n) for k, n in sorted(self.nodes.items())]
        return spark.createDataFrame(rows, "node int, feature string, threshold double, missing_left boolean, value double, gain double, n long")


def leaf_value(g: Column, h: Column, reg_lambda: float = 1.0) -> Column:
    """Newton step of a node from its sums."""
    return -g / (h + reg_lambda)


def split_gain(gl: Column, hl: Column, gr: Column, hr: Column, g: Column, h: Column, reg_lambda: float = 1.0) -> Column:
    """Gain of a split; the parent's sums include rows with a missing value."""
    part = lambda a, b: a * a / (b + reg_lambda)
    return 0.5 * (part(gl, hl) + part(gr, hr) - part(g, h))


def node_stats(df: DataFrame) -> DataFrame:
    """n, g and h of each node."""
    return df.groupBy("node").agg(F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def _long(df: DataFrame, features: list[str]) -> DataFrame:
    """node, f, v, g, h: one row per row and feature."""
    pairs = ", ".join(f"{i}, cast(`{f}` as double)" for i, f in enumerate(features))
    return df.select("node", "g", "h", F.expr(f"stack({len(features)}, {pairs}) as (f, v)"))


def quantile_bins(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Inner edges of at most ``bins`` quantile bins for each feature."""
    row = df.agg(*[F.percentile_approx(f, [k / bins for k in range(1, bins)], 10_000).alias(f) for f in features]).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def binned(df: DataFrame, features: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """``df`` with each value replaced by the upper edge of its bin."""
    columns = {}
    for f in features:
        e = edges[f]
        upper = F.array(*[F.lit(float(x)) for x in [*e, e[-1] + 1.0]]) if e else None
        columns[f] = F.when(F.col(f).isNotNull(), F.element_at(upper, reached(F.col(f), e, strict=True) + 1)) if e else F.lit(None).cast("double")
    return df.withColumns(columns)


#: Sums of a node over all rows, over rows with a value, and over those to the left.
SUMS = ["n_all", "g_all", "h_all", "n_ok", "g_ok", "h_ok", "gl", "hl"]


def candidates(df: DataFrame, features: list[str], params: TreeParams) -> DataFrame:
    """Every allowed split: node, f, threshold, nl, nr, gain, and sums of the node.

    Thresholds lie midway between neighbouring values of a feature, or at the
    edge of a bin. Rows with a missing value count in the parent's sums only.
    """
    values = _long(df, features).groupBy("node", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    w = Window.partitionBy("node", "f").orderBy("v")
    group = Window.partitionBy("node", "f")
    valid = F.col("v").isNotNull()
    out = values
    for c in ("g", "h", "n"):
        out = out.withColumn(f"{c}_all", F.sum(c).over(group)).withColumn(f"{c}_ok", F.sum(F.when(valid, F.col(c))).over(group))
        out = out.withColumn(f"{c}l", F.sum(F.when(valid, F.col(c)).otherwise(F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("next", F.lead("v").over(w)).filter(valid & F.col("next").isNotNull())
    out = out.withColumn("nr", F.col("n_ok") - F.col("nl")).filter((F.col("nl") >= params.min_leaf) & (F.col("nr") >= params.min_leaf))
    gain = split_gain(F.col("gl"), F.col("hl"), F.col("g_ok") - F.col("gl"), F.col("h_ok") - F.col("hl"), F.col("g_all"), F.col("h_all"), params.reg_lambda)
    threshold = F.col("v") if params.mode == "hist" else (F.col("v") + F.col("next")) / 2
    return out.select("node", "f", threshold.alias("threshold"), "nl", "nr", gain.alias("gain"), *SUMS)


def best_splits(df: DataFrame, features: list[str], params: TreeParams) -> DataFrame:
    """The best split of each node; of equal gains the first feature, lowest threshold."""
    key = F.struct(F.round("gain", 12).alias("gain"), (-F.col("f")).alias("f"), (-F.col("threshold")).alias("threshold"))
    best = candidates(df, features, params).groupBy("node").agg(F.max_by(F.struct("f", "threshold", "nl", "nr", "gain", *SUMS), key).alias("b")).select("node", "b.*")
    names = F.array(*[F.lit(f) for f in features])
    return best.filter(F.col("gain") >= params.min_gain).select("node", F.element_at(names, F.col("f") + 1).alias("feature"), "threshold", "nl", "nr", "gain", (F.col("nl") > F.col("nr")).alias("missing_left"), *SUMS)


def grow(df: DataFrame, features: list[str], params: TreeParams = TreeParams(), is_binned: bool = False) -> Tree:
    """A tree on columns g and h of ``df``, one job for the root and one a level.

    ``is_binned``: the features hold bin edges already.
    """
    tree, source = Tree(), df
    if params.mode == "hist" and not is_binned:
        source = binned(df, features, quantile_bins(df, features, params.bins))
    root = source.agg(F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).first()
    level = {0: (root["n"], root["g"] or 0.0, root["h"] or 0.0)}
    for depth in range(params.max_depth + 1):
        for k, (n, g, h) in level.items():
            tree.nodes[k] = Node(-g / (h + params.reg_lambda) if n else 0.0, n)
        able = sorted(k for k, (n, _, _) in level.items() if depth < params.max_depth and n >= params.min_split and n > params.min_leaf)
        if not able:
            break
        placed = source.withColumn("node", tree.leaf()).filter(F.col("node").isin(able))
        level = {}
        for r in best_splits(placed, features, params).collect():
            node, k = tree.nodes[r["node"]], r["node"]
            node.feature, node.threshold, node.gain, node.missing_left = r["feature"], r["threshold"], r["gain"], r["missing_left"]
            lost = (r["n_all"] - r["n_ok"], r["g_all"] - r["g_ok"], r["h_all"] - r["h_ok"])
            left = [x + (y if node.missing_left else 0) for x, y in zip((r["nl"], r["gl"], r["hl"]), lost, strict=True)]
            level[2 * k + 1] = tuple(left)
            level[2 * k + 2] = (r["n_all"] - left[0], r["g_all"] - left[1], r["h_all"] - left[2])
    return tree


def importance_table(nodes: DataFrame) -> DataFrame:
    """feature and share of the gain, from a node table."""
    gains = nodes.filter("feature is not null").groupBy("feature").agg(F.sum("gain").alias("gain"))
    total = gains.agg(F.sum("gain").alias("t"))
    return gains.join(F.broadcast(total)).select("feature", (F.col("gain") / F.col("t")).alias("importance"))
