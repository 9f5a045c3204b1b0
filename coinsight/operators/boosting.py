"""Gradient boosting of trees for labels in {0, 1}."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import losses
from ..plans.storage import Rewritten
from . import sampling
from .trees import Tree, TreeParams, binned, grow, quantile_bins

CASE_TREES = 5  # up to so many trees are scored as one expression


@dataclass(frozen=True)
class BoostParams:
    """Hyperparameters; ``reg_alpha`` is accepted and has no effect."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    min_leaf: int = 10
    min_split: int = 20
    subsample: float = 0.8
    colsample: float = 0.8
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_gain: float = 1e-7
    loss: object = "value_weighted"
    fp_cost: float = 100.0
    early_stopping_rounds: int | None = 10
    validation_fraction: float = 0.1
    random_state: int = 0
    mode: str = "hist"
    bins: int = 64


def validate(df: DataFrame, features: list[str], y: str = "y", amount: str | None = "amount") -> int:
    """Row count of valid input; raises on missing columns and bad values."""
    missing = [c for c in [*features, y, *([amount] if amount else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    bad = F.sum(F.when(F.col(y).isNull() | ~F.col(y).isin(0, 1), 1).otherwise(0))
    low = F.sum(F.when(F.col(amount) < 0, 1).otherwise(0)) if amount else F.lit(0)
    n, b, a = df.agg(F.count("*"), bad, low).first()
    if b:
        raise ValueError(f"{b} labels are not 0 or 1")
    if a:
        raise ValueError(f"{a} amounts are negative")
    return n


def base_score(df: DataFrame, y: str = "y") -> float:
    """Log odds of the positives; 0 if there are none or nothing else."""
    r = df.agg(F.avg(y)).first()[0]
    return float(np.log(r / (1 - r))) if r and r < 1 else 0.0


@dataclass
class Booster:
    """A fitted ensemble."""

    features: list[str]
    base: float
    learning_rate: float
    trees: list[Tree] = field(default_factory=list)
    train_loss: list[float] = field(default_factory=list)
    val_loss: list[float] = field(default_factory=list)
    best_iteration: int = 0

    def raw(self) -> Column:
        """Log odds as an expression, for few shallow trees."""
        out = F.lit(self.base)
        for t in self.trees[: self.best_iteration + 1]:
            out = out + self.learning_rate * t.predict()
        return out

    def with_raw(self, df: DataFrame, name: str = "raw") -> DataFrame:
        """``df`` with the log odds.

        Larger ensembles run over Arrow batches with flat node arrays, as one
        expression of all trees would outgrow generated code.
        """
        used = self.trees[: self.best_iteration + 1]
        if len(used) <= CASE_TREES:
            return df.withColumn(name, self.raw())
        from pyspark.sql.types import DoubleType

        flat = [_flatten(t, self.features) for t in used]
        base, rate = self.base, self.learning_rate

        @F.arrow_udf(DoubleType())
        def score(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in it:
                columns = columns if isinstance(columns, tuple) else (columns,)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
                out = np.full(len(x), base)
                for tree in flat:
                    out += rate * _walk(tree, x)
                yield pa.array(out)

        return df.withColumn(name, score(*[F.col(f).cast("double") for f in self.features]))

    def with_proba(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the probability of a positive."""
        return self.with_raw(df, "__raw").withColumn(name, losses.sigmoid(F.col("__raw"))).drop("__raw")

    def with_prediction(self, df: DataFrame, threshold: float = 0.5, name: str = "pred") -> DataFrame:
        """``df`` with probability p and the label at a threshold."""
        return self.with_proba(df).withColumn(name, (F.col("p") >= threshold).cast("int"))

    def importance(self, kind: str = "gain") -> dict[str, float]:
        """Normalised gain per feature, summed over normalised trees."""
        if kind != "gain":
            raise NotImplementedError(kind)
        out = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in t.importance().items():
                out[f] += g
        total = sum(out.values())
        return {f: g / total for f, g in out.items()} if total else out


def _flatten(tree: Tree, features: list[str]):
    """Arrays of a tree: feature (-1: leaf), threshold, missing left, value, left child."""
    keys = sorted(tree.nodes)
    at = {k: i for i, k in enumerate(keys)}
    nodes = [tree.nodes[k] for k in keys]
    return (
        np.array([features.index(n.feature) if n.feature else -1 for n in nodes]),
        np.array([n.threshold or 0.0 for n in nodes]),
        np.array([n.missing_left for n in nodes]),
        np.array([n.value for n in nodes]),
        np.array([at.get(2 * k + 1, 0) for k in keys]),
        np.array([at.get(2 * k + 2, 0) for k in keys]),
    )


def _walk(tree, x: np.ndarray) -> np.ndarray:
    """Leaf values of rows, all rows one level at a time."""
    feature, threshold, missing, value, left, right = tree
    at = np.zeros(len(x), int)
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        k = at[rows]
        v = x[rows, feature[k]]
        go = np.where(np.isnan(v), missing[k], v <= threshold[k])
        at[rows] = np.where(go, left[k], right[k])
    return value[at]


def fit(df: DataFrame, features: list[str], params: BoostParams = BoostParams(), y: str = "y", amount: str | None = "amount", key: str = "id") -> Booster:
    """Fit an ensemble; ``key`` identifies rows for splits and subsamples.

    Bins are found once. The rows are written with their running log odds once
    every few trees; between, those of the last trees are an expression, so
    plans stay short and little is rewritten. Without amounts every amount is 1.
    """
    validate(df, features, y, amount)
    loss = losses.loss_of(params.loss, params.fp_cost)
    data = df.select(key, *[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("int").alias("y"), (F.col(amount).cast("double") if amount else F.lit(1.0)).alias("amount"))
    stop = params.early_stopping_rounds
    if stop and params.validation_fraction > 0:
        data = sampling.early_stop_split(data, params.validation_fraction, "y", key, params.random_state)
    else:
        data = data.withColumn("is_val", F.lit(False))
    if params.mode == "hist":
        data = binned(data, features, quantile_bins(data.filter("not is_val"), features, params.bins))
    table = Rewritten(loss.weigh(data, "y", "amount").withColumn("raw", F.lit(0.0)))
    base = base_score(table.df.filter("not is_val"))
    model = Booster(features, base, params.learning_rate)
    tree_params = TreeParams(params.max_depth, params.min_leaf, params.min_split, params.min_gain, params.reg_lambda, params.mode, params.bins)
    best, waited, raw, pending = float("inf"), 0, F.lit(base), 0
    for k in range(params.n_estimators):
        p = losses.sigmoid(F.col("raw"))
        rows = table.df.filter("not is_val").withColumn("raw", raw).withColumns({"g": loss.gradient(F.col("y"), p), "h": loss.hessian(F.col("y"), p)})
        if params.subsample < 1:
            rows = sampling.exact_share(rows, params.subsample, key, params.random_state + k)
        chosen = sampling.feature_subset(features, params.colsample, params.random_state + k)
        tree = grow(rows, chosen, tree_params, is_binned=True)
        model.trees.append(tree)
        raw, pending = raw + params.learning_rate * tree.predict(), pending + 1
        if pending == CASE_TREES and k + 1 < params.n_estimators:
            table.write(table.df.withColumn("raw", raw))
            raw, pending = F.col("raw"), 0
        value = loss.value(F.col("y"), losses.sigmoid(F.col("raw")))
        found = {r["is_val"]: r["v"] for r in table.df.withColumn("raw", raw).groupBy("is_val").agg(F.avg(value).alias("v")).collect()}
        model.train_loss.append(found.get(False, 0.0))
        if True not in found:
            model.best_iteration = k
            continue
        model.val_loss.append(found[True])
        if found[True] < best:
            best, waited, model.best_iteration = found[True], 0, k
        else:
            waited += 1
            if stop and waited >= stop:
                break
    table.close()
    return model
