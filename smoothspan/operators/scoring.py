"""Fitted models as JSON, and scoring as column expressions: scores, probabilities, classes and diagnostics."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smoothspan.errors import DataValidationError
from smoothspan.functions.arrays import dot, entropy, ranking, softmax
from smoothspan.operators.design import Design
from smoothspan.sources.sinks import write_json_atomic
from smoothspan.sources.tables import with_row_index


@dataclass
class AdditiveModel:
    """A design and one score for each class (the first is zero if there are two classes)."""

    design: Design
    classes: list[str]
    intercepts: np.ndarray
    coefficients: np.ndarray

    @property
    def components(self) -> list[str]:
        return ["intercept", *self.design.names]

    def parameters(self) -> np.ndarray:
        """Classes by components, the intercept first."""
        return np.hstack([self.intercepts[:, None], self.coefficients])

    def scores(self, vector: Column) -> Column:
        return F.array(*[dot(vector, self.coefficients[k].tolist()) + F.lit(float(self.intercepts[k])) for k in range(len(self.classes))])

    def to_dict(self) -> dict[str, Any]:
        return {
            "kind": "additive_model",
            "design": self.design.to_dict(),
            "classes": self.classes,
            "intercepts": self.intercepts.tolist(),
            "coefficients": self.coefficients.tolist(),
        }

    def save(self, path: str | Path) -> None:
        write_json_atomic(path, self.to_dict())

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> AdditiveModel:
        lacking = {"design", "classes", "intercepts", "coefficients"} - set(data)
        if lacking:
            raise DataValidationError(f"not a model file: it lacks {sorted(lacking)}")
        model = cls(Design.from_dict(data["design"]), list(data["classes"]), np.array(data["intercepts"]), np.array(data["coefficients"]))
        if model.coefficients.shape != (len(model.classes), len(model.design.names)) or len(model.intercepts) != len(model.classes):
            raise DataValidationError("model file: the parameters don't go with the classes and the design")
        return model

    @classmethod
    def load(cls, path: str | Path) -> AdditiveModel:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))


def with_scenario_id(df: DataFrame) -> DataFrame:
    """``scenario_id`` from 1 in input order as the first column, unless there is one."""
    if "scenario_id" in df.columns:
        return df
    numbered = with_row_index(df, "scenario_id")
    return numbered.select((F.col("scenario_id") + 1).alias("scenario_id"), *[f"`{c}`" for c in df.columns])


def scored(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """``df`` with the arrays design_, scores_, probabilities_ and the 0-based class ranking rank_."""
    model.design.check(df)
    staged = df.withColumn("design_", model.design.vector())
    staged = staged.withColumn("scores_", model.scores(F.col("design_")))
    staged = staged.withColumn("probabilities_", softmax(F.col("scores_")))
    return staged.withColumn("rank_", ranking(F.col("probabilities_")))


def check_probabilities(df: DataFrame) -> None:
    """Raises unless probabilities are finite, within bounds and sum to one."""
    p = F.col("probabilities_")
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    row = df.agg(F.min(F.array_min(p)), F.max(F.array_max(p)), F.max(F.abs(total - 1)), F.count_if(F.exists(p, F.isnan))).first()
    if row[0] is not None and (row[0] < -1e-12 or row[1] > 1 + 1e-12 or row[2] > 1e-10 or row[3]):
        raise DataValidationError(f"probabilities out of bounds: least {row[0]}, most {row[1]}, error of sums {row[2]}, not numbers {row[3]}")


def diagnostics(classes: list[str]) -> dict[str, Column]:
    p, rank = F.col("probabilities_"), F.col("rank_")
    names = F.array(*[F.lit(c) for c in classes])
    first, second = F.get(p, F.get(rank, 0)), F.get(p, F.get(rank, 1))
    spread = entropy(p)
    return {
        "predicted_class": F.get(names, F.get(rank, 0)),
        "maximum_probability": first,
        "second_highest_class": F.get(names, F.get(rank, 1)),
        "second_highest_probability": second,
        "confidence_margin": first - second,
        "prediction_entropy": spread,
        "normalized_entropy": spread / float(np.log(len(classes))),
        "probability_sum": F.aggregate(p, F.lit(0.0), lambda a, b: a + b),
    }


def predict(df: DataFrame, model: AdditiveModel, check: bool = True) -> DataFrame:
    """All input columns, score_<class>, probability_<class> and diagnostics; scenario_id first."""
    full = scored(with_scenario_id(df), model)
    if check:
        check_probabilities(full)
    kept = [F.col(f"`{c}`") for c in full.columns if c not in ("design_", "scores_", "probabilities_", "rank_")]
    scores = [F.get("scores_", k).alias(f"score_{c}") for k, c in enumerate(model.classes)]
    chances = [F.get("probabilities_", k).alias(f"probability_{c}") for k, c in enumerate(model.classes)]
    return full.select(*kept, *scores, *chances, *[v.alias(k) for k, v in diagnostics(model.classes).items()])


def predict_scenarios(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """The short form: a new scenario_id, the predictors, the class and the probabilities."""
    if "scenario_id" in model.design.predictors:
        raise DataValidationError("scenario_id is a predictor; the short form can't number the rows")
    full = predict(df.drop("scenario_id"), model)
    return full.select("scenario_id", *[f"`{c}`" for c in model.design.predictors], "predicted_class", *[f"`probability_{c}`" for c in model.classes])


def transform(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """scenario_id, the columns that are no predictors, and one column for each component."""
    model.design.check(df)
    numbered = with_scenario_id(df)
    metadata = [F.col(f"`{c}`") for c in numbered.columns if c not in model.design.predictors]
    return numbered.select(*metadata, *[c.alias(n) for c, n in zip(model.design.columns(), model.design.names, strict=True)])


def predicted_class_counts(predicted: DataFrame, classes: list[str]) -> DataFrame:
    """(class, n) for every class, zero where none is predicted."""
    spine = predicted.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    counts = predicted.groupBy(F.col("predicted_class").alias("class")).agg(F.count("*").alias("n"))
    return spine.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def component_counts(model: AdditiveModel) -> dict[str, int]:
    kinds = {"smooth": "main_spline__", "linear": "main_linear__", "categorical": "main_categorical__", "interaction": "interaction__"}
    return {k: sum(n.startswith(p) for n in model.design.names) for k, p in kinds.items()}
