"""Features of the graph that links entities seen in one transaction."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from itertools import combinations, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Rewritten, checkpointed, released

DENSE_NODES = 4000  # spectra of graphs up to this size, or of matrices from half as many hubs, are taken on the driver
HELD_NODES, HELD_EDGES = 200_000, 2_000_000  # larger graphs are iterated on tables
SENT_NODES = 3_000_000  # of 16 bytes; more are shuffled
SENT_EDGES = 6_000_000  # of 8 bytes; more are sent in turns
ROUNDS = 60  # rounds of subspace iteration before it counts as failed
DEGREE = 8  # of the polynomial between two rounds
RESIDUAL = 1e-6  # length of Lx - vx at which a vector x with value v is found


def node(column: str) -> Column:
    """Name of an entity: column and value; null stays null."""
    return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{column}:"), F.col(column).cast("string")))


def nodes(df: DataFrame, entities: list[str]) -> DataFrame:
    """Distinct entities."""
    return df.select(F.explode(F.array(*[node(c) for c in entities])).alias("node")).filter("node is not null").distinct()


def capped(names: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most so many nodes, chosen by a hash."""
    return names.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(most)


def edges(df: DataFrame, entities: list[str], weight: str | None = None) -> DataFrame:
    """src, dst, w in both directions, weights of repeated pairs added."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.when(~F.isnan(weight), F.col(weight)), F.lit(1.0))
    pairs = F.array(*[F.struct(node(a).alias("src"), node(b).alias("dst")) for a, b in combinations(entities, 2)])
    one = df.select(F.explode(pairs).alias("e"), w.alias("w")).select("e.src", "e.dst", "w").filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def links(df: DataFrame, entities: list[str]) -> DataFrame:
    """src and dst in one direction, repeated pairs repeated."""
    pairs = F.array(*[F.struct(node(a).alias("src"), node(b).alias("dst")) for a, b in combinations(entities, 2)])
    return df.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").filter("src is not null and dst is not null")


def degrees(graph: DataFrame) -> DataFrame:
    """node, weighted degree and number of neighbours."""
    return graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"), F.count("*").alias("neighbours"))


def with_least_degree(graph: DataFrame, least: float = 2) -> DataFrame:
    """Edges between nodes of at least a weighted degree, in one pass."""
    kept = degrees(graph).filter(F.col("degree") >= least).select("node")
    return graph.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "w")


def degree_feature(graph: DataFrame) -> DataFrame:
    """node and weighted degree over the greatest one, at least 1."""
    d = degrees(graph)
    top = d.agg(F.greatest(F.max("degree"), F.lit(1.0)).alias("top"))
    return d.join(F.broadcast(top)).select("node", (F.col("degree") / F.col("top")).alias("degree"))


def laplacian(graph: DataFrame) -> DataFrame:
    """src, dst, v of the normalised Laplacian, off the diagonal."""
    d = degrees(graph)
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), d.select(F.col("node").alias("dst"), F.col("degree").alias("dd"))
    return graph.join(a, "src").join(b, "dst").select("src", "dst", (-F.col("w") / F.sqrt(F.greatest("ds", F.lit(1e-12)) * F.greatest("dd", F.lit(1e-12)))).alias("v"))


def _numbered(d: DataFrame) -> DataFrame:
    """``d`` (node, k) with id: a 64-bit number of the order of k, all distinct.

    Below the degree stands the row's place: its partition's offset and its
    place there. The table is checkpointed, so places stay.
    """
    kept = checkpointed(d.withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33).cast("int")
    before, offsets = 0, []
    for r in sorted(kept.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    offset = F.broadcast(d.sparkSession.createDataFrame(offsets, "part int, offset long"))
    place = F.col("offset") + F.col("m").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("part", part).join(offset, "part").select("node", "k", (F.shiftleft(F.least("k", F.lit(1 << 22)).cast("long"), 40) + place).alias("id"))


def _code(column: str, seed: int) -> Column:
    return F.xxhash64(column, F.lit(seed))


def clustering(graph: DataFrame) -> DataFrame:
    """node and clustering coefficient, 0 with fewer than two neighbours.

    Directions and repeated pairs do not matter. Nodes travel as hashes, drawn
    anew until no two share one. They are numbered in the order of their
    degrees, and edges turned from the smaller to the larger, which bounds a
    node's list of larger neighbours by the square root of the edges. An edge's
    triangles are what the lists of its ends have in common. The lists are sent
    to where edges point to them, up to SENT_EDGES numbers in one turn, so
    wedges are neither made nor shuffled.
    """
    with ExitStack() as done:

        def kept(df: DataFrame) -> Rewritten:
            table = Rewritten(df)
            done.callback(table.close)
            released(df.sparkSession)
            return table

        return checkpointed(_clustering(graph, kept))


def _clustering(graph: DataFrame, kept: Callable[[DataFrame], Rewritten]) -> DataFrame:
    """The coefficients; ``kept`` writes a table that stands until they are taken."""
    spark = graph.sparkSession
    graph = graph.filter("src <> dst").select("src", "dst")
    names = checkpointed(graph.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = names.count()
    seed = next(s for s in count() if names.select(_code("node", s)).distinct().count() == n)
    released(spark)
    names = names.withColumn("code", _code("node", seed))
    ends = graph.select(_code("src", seed).alias("src"), _code("dst", seed).alias("dst"))
    if n <= SENT_NODES:  # places, which are small numbers, take half of the disk
        place = _numbered(names.select(F.col("code").alias("node"), F.lit(0).alias("k"))).select("id", F.col("node").alias("code"))
        names = names.join(place, "code").select("node", F.col("id").alias("code"))
        for end in ("src", "dst"):
            ends = ends.join(F.broadcast(place), ends[end] == place["code"]).withColumn(end, F.col("id")).drop("id", "code")
    ends = ends.select(F.array("src", "dst").alias("e"))
    # Rows of one x meet in few tasks, so most of the counting needs no shuffle.
    apart = ends.select(F.array_min("e").alias("x"), F.array_max("e").alias("y")).withColumn("s", F.pmod("y", F.lit(8))).repartition("x", "s").distinct()
    plain = kept(apart.select("x", "y"))
    number = _numbered(plain.df.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("k")))
    ids = number.select("node", "id")
    ids = F.broadcast(ids) if n <= SENT_NODES else ids
    turned = plain.df.join(ids.select(F.col("node").alias("x"), F.col("id").alias("a")), "x").join(ids.select(F.col("node").alias("y"), F.col("id").alias("b")), "y")
    lists = kept(turned.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a").agg(F.collect_list("b").alias("above")))
    plain.close()
    turns = max(1, -(-lists.df.agg(F.sum(F.size("above"))).first()[0] // SENT_EDGES)) if n else 0
    parts = []
    for turn in range(turns):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(turns)) == turn  # noqa: B023, E731
        sent = F.broadcast(lists.df.filter(mine("a")).select(F.col("a").alias("b"), F.col("above").alias("further")))
        met = lists.df.select("a", "above", F.explode(F.filter("above", mine)).alias("b")).join(sent, "b").select("a", "b", F.array_intersect("above", "further").alias("c")).filter(F.size("c") > 0)
        one = met.select(F.explode(F.concat(F.transform("c", lambda c: F.struct(c.alias("id"), F.lit(1).alias("t"))), F.array(*[F.struct(F.col(e).alias("id"), F.size("c").alias("t")) for e in "ab"]))).alias("o"))
        parts.append(kept(one.groupBy("o.id").agg(F.sum("o.t").alias("t"))))
    credited = spark.createDataFrame([], "id long, t long")
    for part in parts:
        credited = credited.unionByName(part.df)
    both = number.join(credited.groupBy("id").agg(F.sum("t").alias("t")), "id", "left").withColumnRenamed("node", "code").join(names, "code")
    return both.select("node", F.when(F.col("k") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def pagerank(graph: DataFrame, damping: float = 0.85, iterations: int = 50, tolerance: float | None = 1e-6) -> DataFrame:
    """node and rank; with a tolerance, the vector before the first small step.

    Edge shares are computed once; ranks are checkpointed each round, so plans
    do not grow.
    """
    total = degrees(graph)
    share = checkpointed(graph.join(total.select(F.col("node").alias("src"), "degree"), "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("s")))
    n = total.count()
    rank = checkpointed(total.select("node", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(iterations if n else 0):
        flow = share.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("s") * F.col("rank")).alias("f"))
        new = checkpointed(rank.join(flow, "node", "left").select("node", F.col("rank").alias("old"), ((1 - damping) / n + damping * F.coalesce("f", F.lit(0.0))).alias("rank")))
        if tolerance is not None:
            step = new.agg(F.sqrt(F.sum((F.col("rank") - F.col("old")) ** 2))).first()[0]
            if step < tolerance:
                return rank
        rank = new.select("node", "rank")
    return rank


def _moved(off: DataFrame, x: DataFrame, p: int) -> DataFrame:
    """``x`` with z: (identity less Laplacian) times each column of x."""
    flow = off.join(x.select(F.col("node").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(-F.col("v") * F.get("x", F.lit(j))).alias(f"z{j}") for j in range(p)])
    return x.join(flow, "node", "left").select(*x.columns, F.array(*[F.coalesce(f"z{j}", F.lit(0.0)) for j in range(p)]).alias("z"))


def _products(x: DataFrame, p: int) -> list[np.ndarray]:
    """xx, xz and zz of the columns x and z, added up over the nodes."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((3, p, p))
        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy().reshape(-1, p) for i in (0, 1))
            total += [a.T @ a, a.T @ b, b.T @ b]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    parts = x.select("x", "z").mapInArrow(run, "m array<double>").toLocalIterator()
    return list(sum((np.array(r["m"]) for r in parts), np.zeros(3 * p * p)).reshape(3, p, p))


def _turned(column: str, by: np.ndarray) -> Column:
    """A vector column times a small matrix."""
    return F.transform(F.lit(by.T.tolist()), lambda w: F.aggregate(F.zip_with(F.col(column), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


class _Spread:
    """A block of vectors x, with z to be filled, as a table of nodes."""

    def __init__(self, off: DataFrame, names: DataFrame, p: int):
        self.off, self.p = off, p
        self.x = checkpointed(names.select("node", F.array(*[F.xxhash64("node", F.lit(j)) / F.lit(2.0**63) for j in range(p)]).alias("x")))

    def products(self) -> list[np.ndarray]:
        self.x = checkpointed(_moved(self.off, self.x, self.p))
        return _products(self.x, self.p)

    def turn(self, by: np.ndarray) -> None:
        self.x, self.p = self.x.select("node", _turned("x", by).alias("x"), _turned("z", by).alias("z")), by.shape[1]

    def filter(self, middle: float, half: float) -> None:
        now = checkpointed(self.x.select("node", F.col("x").alias("old"), F.zip_with("z", "x", lambda z, x: (z - middle * x) / half).alias("x")))
        for _ in range(DEGREE - 1):
            step = F.transform("z", lambda z, j: 2 * (z - middle * F.get("x", j)) / half - F.get("old", j))
            now = checkpointed(_moved(self.off, now, self.p).select("node", F.col("x").alias("old"), step.alias("x")))
        self.x = now.select("node", "x")

    def vectors(self, k: int) -> DataFrame:
        return checkpointed(self.x.select("node", F.slice("x", 1, k).alias("vector")))


class _Held:
    """The same block on the driver."""

    def __init__(self, off: DataFrame, names: DataFrame, p: int):
        self.spark = off.sparkSession
        self.names = sorted(r["node"] for r in names.collect())
        at = {x: i for i, x in enumerate(self.names)}
        rows = off.select("src", "dst", "v").toArrow()
        self.src, self.dst = (np.array([at[x] for x in rows[c].to_pylist()], np.int64) for c in ("src", "dst"))
        self.v = -rows["v"].to_numpy()
        self.x = np.random.default_rng(0).normal(size=(len(at), p))

    def _times(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.src, self.v * c[self.dst], len(x)) for c in x.T], 1)

    def products(self) -> list[np.ndarray]:
        self.z = self._times(self.x)
        return [self.x.T @ self.x, self.x.T @ self.z, self.z.T @ self.z]

    def turn(self, by: np.ndarray) -> None:
        self.x, self.z = self.x @ by, self.z @ by

    def filter(self, middle: float, half: float) -> None:
        old, self.x = self.x, (self.z - middle * self.x) / half
        for _ in range(DEGREE - 1):
            old, self.x = self.x, 2 * (self._times(self.x) - middle * self.x) / half - old

    def vectors(self, k: int) -> DataFrame:
        return self.spark.createDataFrame(list(zip(self.names, self.x[:, :k].tolist(), strict=True)), "node string, vector array<double>")


def _filtered(block: _Spread | _Held, k: int) -> tuple[np.ndarray, DataFrame]:
    """Smallest eigenvalues and vectors by Chebyshev-filtered iteration.

    A block of twice as many vectors as asked for is filtered by a polynomial
    that is small where the unwanted values lie, then turned to the best
    vectors that it spans (Rayleigh-Ritz), until all residuals are small.
    """
    for _ in range(ROUNDS):
        xx, xz, zz = block.products()
        scale = 1 / np.sqrt(np.diag(xx))
        size, basis = np.linalg.eigh(xx * np.outer(scale, scale))
        basis = (scale[:, None] * basis / np.sqrt(np.maximum(size, 1e-300)))[:, size > 1e-11]
        if basis.shape[1] < k:
            raise RuntimeError(f"{basis.shape[1]} of {k} eigenvectors stay apart")
        values, turn = np.linalg.eigh(basis.T @ ((xz + xz.T) / 2) @ basis)
        turn, values = (basis @ turn)[:, ::-1], values[::-1]
        left = np.sqrt(np.maximum(0, np.einsum("ji,jk,ki->i", turn, zz, turn) - values**2))[:k]
        block.turn(turn)
        if left.max() < RESIDUAL:
            return 1 - values[:k], block.vectors(k)
        # Chebyshev polynomial: the values from -1 to the last of the block stay small.
        top = min(max(float(values[-1]), -0.9), 1 - 1e-6)
        block.filter((top - 1) / 2, (top + 1) / 2)
    raise RuntimeError(f"no spectrum after {ROUNDS} rounds, greatest residual {left.max():.1e}")


def _covered(off: DataFrame, k: int) -> tuple[np.ndarray, DataFrame] | None:
    """The spectrum by way of hubs that every edge touches; None if they are many.

    A node that comes before all its neighbours in the order of their number
    and name is a leaf, the others are hubs, so no edge joins two leaves. Let A
    be the part of (identity less Laplacian) among hubs and B that from hubs to
    leaves. Its values other than 0 are those of [[A, C], [C, 0]] with C the
    root of BB', and a vector is y at the hubs and B'y / value at the leaves.
    Spark adds up BB'. None also if fewer than k values lie above 0.
    """
    spark = off.sparkSession
    n = off.groupBy("src").agg(F.count("*").alias("n"))
    least = off.join(n.select(F.col("src").alias("dst"), "n"), "dst").groupBy("src").agg(F.count("*").alias("own"), F.min(F.struct("n", F.col("dst").alias("node"))).alias("least"))
    hubs = sorted(r["src"] for r in least.filter(F.struct(F.col("own").alias("n"), F.col("src").alias("node")) >= F.col("least")).select("src").limit(DENSE_NODES // 2 + 1).collect())
    h = len(hubs)
    if h > DENSE_NODES // 2:
        return None
    at = spark.createDataFrame(list(enumerate(hubs)), "i int, node string")
    into = off.join(F.broadcast(at.withColumnRenamed("node", "dst")), "dst").select("src", "i", (-F.col("v")).alias("b"))
    among = into.join(F.broadcast(at.select(F.col("i").alias("j"), F.col("node").alias("src"))), "src").select("i", "j", "b")
    out = checkpointed(into.join(F.broadcast(at.select(F.col("node").alias("src"))), "src", "left_anti"))
    ends = out.groupBy("src").agg(F.collect_list(F.struct("i", "b")).alias("e")).select("e", F.explode("e").alias("f"))
    squares = ends.select("f", F.explode("e").alias("g")).filter("f.i <= g.i").groupBy(F.col("f.i").alias("i"), F.col("g.i").alias("j")).agg(F.sum(F.col("f.b") * F.col("g.b")).alias("b"))
    a, bb = np.zeros((h, h)), np.zeros((h, h))
    for matrix, part in ((a, among), (bb, squares)):
        rows = part.toArrow()
        np.add.at(matrix, (rows["i"].to_numpy(), rows["j"].to_numpy()), rows["b"].to_numpy())
    size, basis = np.linalg.eigh(bb + np.triu(bb, 1).T)
    c = (basis * np.sqrt(np.maximum(size, 0))) @ basis.T
    values, y = np.linalg.eigh(np.block([[a, c], [c, np.zeros((h, h))]]))
    values, y = values[::-1][:k], y[:h, ::-1][:, :k]
    if len(values) < k or values[-1] < RESIDUAL:
        return None
    own = spark.createDataFrame([(i, x, y[i].tolist(), (y[i] / values).tolist()) for i, x in enumerate(hubs)], "i int, node string, vector array<double>, share array<double>")
    leaves = out.join(F.broadcast(own.select("i", "share")), "i").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("b") * F.get("share", F.lit(j))).alias(f"x{j}") for j in range(k)])
    return 1 - values, checkpointed(own.select("node", "vector").unionByName(leaves.select("node", F.array(*[f"x{j}" for j in range(k)]).alias("vector"))))


def spectrum(graph: DataFrame, k: int = 10) -> tuple[np.ndarray, DataFrame]:
    """Smallest eigenvalues of the Laplacian, and node with its vector.

    Small graphs are solved on the driver, under a checked number of nodes, and
    larger ones too if few hubs touch all edges; others by subspace iteration,
    on the driver up to a bound of nodes and edges, beyond it on tables, where
    the driver holds matrices of 2k x 2k only. Values rise, vectors stand in the
    order of their values, and iteration that does not converge raises.
    """
    spark = graph.sparkSession
    names = degrees(graph).select("node")
    n = names.count()
    k = min(k, n - 1)
    if k < 1:
        return np.zeros(0), spark.createDataFrame([], "node string, vector array<double>")
    off = laplacian(graph)
    if n <= DENSE_NODES:
        order = [r["node"] for r in names.orderBy("node").collect()]
        at = {x: i for i, x in enumerate(order)}
        matrix = np.eye(n)
        for r in off.toLocalIterator():
            matrix[at[r["src"]], at[r["dst"]]] += r["v"]
        values, vectors = np.linalg.eigh(matrix)
        return values[:k], spark.createDataFrame([(x, vectors[i, :k].tolist()) for x, i in at.items()], "node string, vector array<double>")
    off = checkpointed(off)
    found = _covered(off, k)
    if found is not None:
        return found
    held = n <= HELD_NODES and off.count() <= HELD_EDGES
    return _filtered((_Held if held else _Spread)(off, names, min(2 * k, n)), k)


def bands(vectors: DataFrame, k: int) -> DataFrame:
    """node and energy in up to five bands of eigenvectors."""
    size = max(1, k // 5)
    n = min(5, k // size)
    return vectors.select("node", *[F.aggregate(F.slice("vector", b * size + 1, size), F.lit(0.0), lambda s, v: s + v * v).alias(f"band_{b}") for b in range(n)])


def heterogeneity(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """node and mean distance to its neighbours in the first five eigenvectors."""
    v = vectors.select("node", F.slice("vector", 1, 5).alias("x"))
    both = graph.join(v.select(F.col("node").alias("src"), "x"), "src").join(v.select(F.col("node").alias("dst"), F.col("x").alias("z")), "dst")
    far = F.sqrt(F.aggregate(F.zip_with("x", "z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    return both.groupBy(F.col("src").alias("node")).agg(F.avg(far).alias("heterogeneity"))


def spectrum_summary(values: np.ndarray, n_nodes: int) -> dict[str, float]:
    """Counts and moments of the eigenvalues."""
    gap = float(values[1] - values[0]) if len(values) > 1 else 0.0
    return {"n_nodes": n_nodes, "n_components": len(values), "total": float(values.sum()), "variance": float(values.var()) if len(values) else 0.0, "gap": gap, "largest": float(values.max(initial=0)), "smallest": float(values.min()) if len(values) else 0.0}


def node_features(df: DataFrame, entities: list[str], weight: str | None = None, k: int = 10, least_degree: float = 2, most_nodes: int = 50_000, seed: int = 0) -> DataFrame:
    """node and all features of it."""
    graph = edges(df, entities, weight)
    names = nodes(df, entities)
    if names.count() > most_nodes:
        kept = capped(names, most_nodes, seed)
        graph = graph.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "w")
    graph = checkpointed(with_least_degree(graph, least_degree))
    values, vectors = spectrum(graph, k)
    out = degree_feature(graph)
    for part in (bands(vectors, len(values)) if len(values) else None, heterogeneity(graph, vectors), pagerank(graph), clustering(graph)):
        out = out if part is None else out.join(part, "node", "left")
    return checkpointed(out.fillna(0.0))


def map_to_rows(df: DataFrame, features: DataFrame, entities: list[str]) -> DataFrame:
    """``df`` with <entity>_<feature> columns; unknown and missing entities get 0."""
    names = [c for c in features.columns if c != "node"]
    for e in entities:
        own = features.select(F.col("node").alias(f"__{e}"), *[F.col(c).alias(f"{e}_{c}") for c in names])
        df = df.withColumn(f"__{e}", node(e)).join(own, f"__{e}", "left").drop(f"__{e}").fillna(0.0, [f"{e}_{c}" for c in names])
    return df
