"""Cascades, stacks, averages and baseline models."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting, features, metrics, sampling


def cascade_proba(p1: Column, p2: Column, t1: float = 0.1) -> Column:
    """The second score where the first reaches its threshold, else 0."""
    return F.when(p1 >= t1, p2).otherwise(0.0)


def cascade_proba_keep(p1: Column, p2: Column, t1: float = 0.1) -> Column:
    """The second score where the first reaches its threshold, else the first."""
    return F.when(p1 >= t1, p2).otherwise(p1)


def cascade_stats(df: DataFrame, t1: float = 0.1, y: str = "y", p1: str = "p1") -> DataFrame:
    """Rows flagged by the first stage, frauds caught, recall, precision, reduction."""
    on = F.col(p1) >= t1
    s = df.agg(F.count("*").alias("n"), F.sum(on.cast("long")).alias("flagged"), F.sum((on & (F.col(y) == 1)).cast("long")).alias("caught"), F.sum((F.col(y) == 1).cast("long")).alias("fraud"))
    return s.select("flagged", "caught", metrics.ratio(F.col("caught"), F.col("fraud")).alias("recall"), metrics.ratio(F.col("caught"), F.col("flagged")).alias("precision"), (1 - metrics.ratio(F.col("flagged"), F.col("n"))).alias("reduction"), metrics.ratio(F.col("n"), F.col("flagged"), None).alias("speedup"))


def cascade_breakdown(df: DataFrame, t1: float = 0.1, t: float = 0.5, y: str = "y") -> DataFrame:
    """Rows and frauds per way through the cascade."""
    way = F.when(F.col("p1") < t1, "passed_stage1").when(F.col("p2") >= t, "flagged").otherwise("cleared_stage2")
    return df.groupBy(way.alias("way")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("fraud"))


def average(p1: Column, p2: Column) -> Column:
    """Mean of two scores."""
    return (p1 + p2) / 2


def positive_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """Negatives over positives; 1 without positives."""
    pos, n = F.sum(F.col(y)), F.count("*")
    return df.agg(F.when(pos > 0, (n - pos) / pos).otherwise(1.0).alias("weight"))


def with_class_weight(df: DataFrame, kind: str, y: str = "y", name: str = "weight") -> DataFrame:
    """``df`` with a weight column: 'positive' scales positives, 'balanced' both classes."""
    n, pos = df.agg(F.count("*"), F.sum(y)).first()
    pos = pos or 0
    if kind == "positive":
        return df.withColumn(name, F.when(F.col(y) == 1, (n - pos) / pos if pos else 1.0).otherwise(1.0))
    return df.withColumn(name, F.when(F.col(y) == 1, n / (2 * pos) if pos else 1.0).otherwise(n / (2 * (n - pos)) if n > pos else 1.0))


def _assembled(df: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol="__x", handleInvalid="keep").transform(df.fillna(0.0, names))


@dataclass
class Baseline:
    """A library model: gbt, forest or logistic with class weights, or plain.

    ``plain`` is logistic regression without weights and on unscaled inputs.
    """

    kind: str
    names: list[str]
    model: object = None
    scaled: dict | None = None

    def fit(self, df: DataFrame, y: str = "y", trees: int = 20, depth: int = 5, c: float = 1.0) -> Baseline:
        from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

        named = df.withColumn("__y", F.col(y).cast("double"))
        weighed = named.withColumn("__w", F.lit(1.0)) if self.kind == "plain" else with_class_weight(named, "positive" if self.kind == "gbt" else "balanced", y, "__w")
        if self.kind == "plain":
            rows = weighed
            learner = LogisticRegression(regParam=1.0 / (c * max(1, rows.count())), standardization=False, maxIter=1000)
        elif self.kind == "logistic":
            self.scaled = features.fit_scale(weighed, self.names)
            rows = features.scale(weighed, self.scaled)
            learner = LogisticRegression(regParam=1.0 / (c * max(1, rows.count())), standardization=False)
        else:
            rows = weighed
            learner = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1) if self.kind == "gbt" else RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=1)
        self.model = learner.setFeaturesCol("__x").setLabelCol("__y").setWeightCol("__w").fit(_assembled(rows, self.names))
        return self

    def with_proba(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the score of a positive."""
        from pyspark.ml.functions import vector_to_array

        rows = df.withColumns({f"__keep_{c}": F.col(c) for c in self.names})
        rows = features.scale(rows, self.scaled) if self.scaled else rows
        scored = self.model.transform(_assembled(rows, self.names)).withColumn(name, vector_to_array("probability")[1])
        kept = [F.col(f"__keep_{c}").alias(c) if c in self.names else F.col(c) for c in df.columns if c != name]
        return scored.select(*kept, name)


@dataclass
class Cascade:
    """A wide first stage; the money-weighted second stage scores what it lets through."""

    names: list[str]
    t1: float = 0.1
    params: boosting.BoostParams = boosting.BoostParams(n_estimators=10, max_depth=3)
    first: Baseline | None = None
    second: boosting.Booster | None = None

    def fit(self, df: DataFrame, y: str = "y", amount: str = "amount", key: str = "id") -> Cascade:
        self.first = Baseline("gbt", self.names).fit(df, y)
        self.second = boosting.fit(df, self.names, self.params, y, amount, key)
        return self

    def with_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with p1 and p; rows below the threshold skip the second model."""
        one = self.first.with_proba(df, "p1")
        on = self.second.with_proba(one.filter(F.col("p1") >= self.t1), "p")
        return on.unionByName(one.filter(~(F.col("p1") >= self.t1)).withColumn("p", F.lit(0.0)).select(*on.columns))


@dataclass
class Stack:
    """Logistic regression over out-of-fold scores of two models."""

    names: list[str]
    k: int = 3
    params: boosting.BoostParams = boosting.BoostParams(n_estimators=5, max_depth=3)
    meta: Baseline | None = None
    first: Baseline | None = None
    second: boosting.Booster | None = None

    def out_of_fold(self, df: DataFrame, y: str = "y", amount: str = "amount", key: str = "id") -> DataFrame:
        """``df`` with p1 and p2 from models that did not see the row."""
        dealt = sampling.folds(df, self.k, y, key, 7)
        out = None
        for k in range(self.k):
            train, test = dealt.filter(F.col("fold") != k), dealt.filter(F.col("fold") == k)
            a = Baseline("gbt", self.names).fit(train, y)
            b = boosting.fit(train, self.names, replace(self.params, early_stopping_rounds=None), y, amount, key)
            part = b.with_proba(a.with_proba(test, "p1"), "p2")
            out = part if out is None else out.unionByName(part)
        return out

    def fit(self, df: DataFrame, y: str = "y", amount: str = "amount", key: str = "id") -> Stack:
        oof = self.out_of_fold(df, y, amount, key).withColumn("log_amount", F.log1p(amount))
        self.meta = Baseline("plain", ["p1", "p2", amount, "log_amount"]).fit(oof, y)
        self.first = Baseline("gbt", self.names).fit(df, y)
        self.second = boosting.fit(df, self.names, replace(self.params, early_stopping_rounds=None), y, amount, key)
        return self

    def with_proba(self, df: DataFrame, amount: str = "amount") -> DataFrame:
        """``df`` with p1, p2 and the score p of the stack."""
        base = self.second.with_proba(self.first.with_proba(df, "p1"), "p2").withColumn("log_amount", F.log1p(amount))
        return self.meta.with_proba(base, "p")

    def coefficients(self) -> dict[str, float]:
        """Weights of the second level."""
        m = self.meta.model
        return dict(zip([*self.meta.names, "intercept"], [*map(float, m.coefficients), float(m.intercept)], strict=True))
