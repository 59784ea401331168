"""Blends and stacks of base model probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions import scoring as S
from fcverify.operators.thresholds import best_blend, best_threshold
from fcverify.plans.ladder import calibrated, detached, fit_calibrator
from fcverify.schema import LEADS_H
from fcverify.session import kept

MIN_LEAD_ROWS = 50


def align_probabilities(points: DataFrame, models: dict[str, DataFrame], fallback: str,
                        keys: Sequence[str] = ("icao", "t0", "valid_time")) -> DataFrame:
    """Points with one probability column per model; a missing one takes the
    fallback model's. Each model is a frame of the keys and ``p``."""
    out = points
    for name, rows in models.items():
        out = out.join(rows.select(*keys, F.col("p").alias(f"_p_{name}")), list(keys), "left")
    return out.withColumns({name: F.coalesce(f"_p_{name}", f"_p_{fallback}") for name in models}).drop(
        *[f"_p_{name}" for name in models])


def blend(df: DataFrame, first: str, second: str, weight: Column) -> DataFrame:
    return df.withColumn("p_blend", weight * F.col(first) + (1 - weight) * F.col(second))


def binary_report(df: DataFrame, p: str, event: str, threshold: Column) -> DataFrame:
    """n, BSS and contingency skill of a probability at a threshold."""
    outcome = S.outcome(F.col(p) >= threshold, F.col(event) == 1)
    return df.withColumn("category_outcome", outcome).agg(
        S.brier_skill(F.col(p), F.col(event)).alias("bss"), *S.outcome_counts()).withColumns(S.skill_ratios())


def blend_report(validation: DataFrame, test: DataFrame, first: str, second: str, event: str = "event") -> DataFrame:
    """Weight by validation Brier score, threshold by validation HSS, test metrics."""
    weight = best_blend(validation, first, second, event).select("w").scalar()
    tuned = blend(validation, first, second, weight)
    threshold = best_threshold(tuned, "p_blend", event).select("threshold").scalar()
    rows = blend(test, first, second, weight).withColumn("_t", threshold)
    report = binary_report(rows, "p_blend", event, F.col("_t"))
    return report.withColumns({"w": weight, "threshold": threshold})


class Stack:
    """Logistic regression over base probabilities, recalibrated by isotonic fit."""

    def __init__(self, bases: Sequence[str]):
        self.bases = list(bases)
        self.model = self.calibrator = None
        self.threshold = 0.5

    def fit(self, validation: DataFrame, event: str = "event") -> Stack:
        n = validation.count()
        self.model = detached(Pipeline(stages=[
            VectorAssembler(inputCols=self.bases, outputCol="_bases"),
            LogisticRegression(featuresCol="_bases", labelCol=event, maxIter=1000, regParam=1.0 / max(n, 1),
                               standardization=False),
        ]).fit(validation))
        self.calibrator, self.threshold = fit_calibrator(self._raw(validation), "p_raw", event)
        return self

    def _raw(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df)
        return scored.withColumn("p_raw", vector_to_array("probability")[1]).drop(
            "_bases", "rawPrediction", "probability", "prediction")

    def predict(self, df: DataFrame) -> DataFrame:
        return calibrated(self._raw(df), self.calibrator, self.threshold)


class LeadStack(Stack):
    """One logistic regression per lead, each with its own unpenalised intercept.

    A lead of which ``min_rows`` rows or fewer are known, or one class only, cannot be
    fitted on its own; it takes the pooled regression over all leads. ``pooled`` lists those
    leads after fitting. One isotonic fit serves all leads.
    """

    def __init__(self, bases: Sequence[str], min_rows: int = MIN_LEAD_ROWS):
        super().__init__(bases)
        self.min_rows = min_rows

    def fit(self, validation: DataFrame, event: str = "event", lead: str = "lead_h") -> LeadStack:
        self.lead = lead
        validation = kept(validation.select(lead, event, *self.bases))
        rows = validation.filter(F.col(lead).isin(*LEADS_H))
        counts = rows.groupBy(lead).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(event).alias("k")).collect()
        own = {r[lead] for r in counts if r["n"] > self.min_rows and r["k"] > 1}
        self.pooled = sorted(set(LEADS_H) - own)
        self.models = {h: self._regression(rows.filter(F.col(lead) == h), event) for h in sorted(own)}
        if self.pooled and rows.agg(F.countDistinct(event)).first()[0] > 1:
            self.models[None] = self._regression(rows, event)
        self.calibrator, self.threshold = fit_calibrator(self._raw(validation), "p_raw", event)
        return self

    def _regression(self, rows: DataFrame, event: str) -> tuple[float, list[float]]:
        ready = VectorAssembler(inputCols=self.bases, outputCol="_bases").transform(rows)
        model = LogisticRegression(featuresCol="_bases", labelCol=event, maxIter=1000, regParam=1.0 / max(rows.count(), 1),
                                   standardization=False).fit(ready)
        return float(model.intercept), [float(x) for x in model.coefficients]

    def _raw(self, df: DataFrame) -> DataFrame:
        """Probability as a column expression; 0 where no regression could be fitted at all."""
        def probability(model):
            intercept, weights = model
            score = sum((F.col(b) * w for b, w in zip(self.bases, weights)), F.lit(intercept))
            return 1 / (1 + F.exp(-score))

        p = probability(self.models[None]) if None in self.models else F.lit(0.0)
        for h, model in self.models.items():
            if h is not None:
                p = F.when(F.col(self.lead) == h, probability(model)).otherwise(p)
        return df.withColumn("p_raw", p)


def stack_report(stack: Stack, test: DataFrame, event: str = "event") -> DataFrame:
    rows = stack.predict(test)
    return binary_report(rows, "p_adverse", event, F.lit(stack.threshold))


def subsets(bases: Sequence[str]) -> list[tuple[str, ...]]:
    """Singles, pairs, all but one, and all; each set once."""
    wanted = [(b,) for b in bases] + list(combinations(bases, 2))
    wanted += [tuple(b for b in bases if b != left_out) for left_out in bases] + [tuple(bases)]
    seen, out = set(), []
    for subset in wanted:
        key = tuple(sorted(subset))
        if key and key not in seen:
            seen.add(key)
            out.append(subset)
    return out


def ablation(validation: DataFrame, test: DataFrame, bases: Sequence[str], event: str = "event") -> DataFrame:
    """Stack of every subset, ranked by BSS on the test rows."""
    validation, test = (kept(rows.select(event, *bases)) for rows in (validation, test))
    rows = None
    for subset in subsets(bases):
        row = stack_report(Stack(subset).fit(validation, event), test, event)
        row = row.select(F.lit("+".join(subset)).alias("bases"), "bss", "HSS", "n")
        rows = row if rows is None else rows.unionByName(row)
    return rows.orderBy(F.coalesce("bss", F.lit(-1.0)).desc(), "bases")
