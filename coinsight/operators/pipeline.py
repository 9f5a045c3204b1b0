"""The whole scoring pipeline: graph features, scaling, folds, model, threshold, drift."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import checkpointed
from . import boosting, drift, features, graph, metrics, pareto, sampling


@dataclass
class RiskPipeline:
    """Options and, after ``fit``, the fitted parts."""

    names: list[str]
    entities: list[str] = field(default_factory=list)
    scale: bool = True
    cv: str | None = "stratified"  # or "time" or None
    folds: int = 3
    cost: float = 100.0
    strategy: str = "max_savings"
    params: boosting.BoostParams = boosting.BoostParams(n_estimators=10, max_depth=3)
    drift_params: drift.DriftParams = drift.DriftParams()
    nodes: DataFrame | None = None
    scaled: dict | None = None
    model: boosting.Booster | None = None
    threshold: float = 0.5
    reference: DataFrame | None = None
    base: DataFrame | None = None
    cv_results: list[dict] = field(default_factory=list)
    used: list[str] = field(default_factory=list)

    def prepare(self, df: DataFrame) -> DataFrame:
        """``df`` with the fitted transforms applied."""
        out = graph.map_to_rows(df, self.nodes, self.entities) if self.nodes is not None else df
        return features.scale(out, self.scaled) if self.scaled else out

    def fit(self, df: DataFrame, y: str = "y", amount: str = "amount", key: str = "id", ts: str | None = None) -> RiskPipeline:
        boosting.validate(df, self.names, y, amount)
        if self.entities:
            self.nodes = graph.node_features(df, self.entities)
        rows = self.prepare(df)
        extra = [f"{e}_{c}" for e in self.entities for c in self.nodes.columns if c != "node"] if self.entities else []
        self.used = [*self.names, *extra]
        if self.scale:
            self.scaled = features.fit_scale(rows, self.used)
            rows = features.scale(rows, self.scaled)
        rows = checkpointed(rows)
        if self.cv:
            self.cv_results = self.cross_validate(rows, y, amount, key, ts)
        self.model = boosting.fit(rows, self.used, self.params, y, amount, key)
        scored = checkpointed(self.model.with_proba(rows))
        _, _, best = pareto.fit(scored, self.cost, y=y, amount=amount)
        found = pareto.recommend(best, self.strategy).first()
        self.threshold = found["t"] if found else 0.5
        self.reference, self.base = checkpointed(drift.reference_edges(scored, self.used)), scored
        return self

    def cross_validate(self, rows: DataFrame, y: str, amount: str, key: str, ts: str | None = None) -> list[dict]:
        """Label metrics at score .5 of each fold."""
        out = []
        dealt = sampling.time_splits(rows, self.folds, ts, key) if self.cv == "time" else sampling.folds(rows, self.folds, y, key, 5)
        for k in range(self.folds):
            mine = dealt.filter(F.col("fold") == k)
            train, test = (mine.filter("role = 'train'"), mine.filter("role = 'test'")) if self.cv == "time" else (dealt.filter(F.col("fold") != k), mine)
            model = boosting.fit(train, self.used, replace(self.params, early_stopping_rounds=None), y, amount, key)
            scored = model.with_prediction(test, 0.5, "flag")
            out.append(metrics.label_metrics(scored, ["precision", "recall", "vdr", "net_savings", "roi_net"], y=y, amount=amount, cost=self.cost).first().asDict())
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` prepared, with p and the flag at the chosen threshold."""
        return self.model.with_prediction(self.prepare(df), self.threshold, "flag")

    def evaluate(self, df: DataFrame, y: str = "y", amount: str = "amount") -> DataFrame:
        """The report on labelled rows."""
        return metrics.report(self.predict(df), self.cost, y=y, amount=amount)

    def drift(self, df: DataFrame) -> DataFrame:
        """The drift decision on prepared rows."""
        found = drift.summary(self.reference, self.base, self.prepare(df))
        return drift.recommendation(drift.detect(found, self.drift_params))

    def summary(self) -> dict:
        """Configuration, and mean and deviation over folds."""
        import statistics as st

        cv = {m: (st.fmean(r[m] for r in self.cv_results), st.pstdev([r[m] for r in self.cv_results])) for m in (self.cv_results[0] if self.cv_results else {})}
        return {"features": self.used, "threshold": self.threshold, "trees": len(self.model.trees), "cv": cv}
