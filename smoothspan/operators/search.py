"""Nested cross-validation and final fits.

The grouped backend gives one Python task an outer fold of a model: the inner folds, the designs and the path of C run inside
it, so the data is copied once for each model, repeat and fold, and a design serves every C. The distributed backend fits every
model with MLlib over the whole cluster, for data whose training part would not fit one worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothspan.contract import Contract, Feature, Model, candidates
from smoothspan.errors import SmoothspanError
from smoothspan.operators.design import Design
from smoothspan.operators.folds import assign_folds, task_seed
from smoothspan.operators.metrics import CLIP, best_candidate
from smoothspan.operators.scoring import AdditiveModel, scored
from smoothspan.operators.solver import Fit, fit_mllib, fit_numpy, softmax_rows

#: Most values (rows times design columns) of an outer training part that one task fits.
GROUPED_MOST = 20_000_000
RESULT = "kind string, model_id string, repeat long, fold long, row_index long, row_id string, observed string, predicted string, p_true double, probabilities array<double>, payload string"


@dataclass(frozen=True)
class FoldTask:
    model_id: str
    repeat: int
    fold: int

    def __str__(self) -> str:
        return f"model {self.model_id}, repeat {self.repeat}, fold {self.fold}"


def inner_folds(y: np.ndarray, row_id: np.ndarray, splits: int, seed: int) -> np.ndarray:
    """The folds that ``assign_folds`` gives for one repeat, counted from 0: ranked by hash within a class, classes in order."""
    keys = np.array([hashlib.md5(f"{seed}-1-{i}".encode()).hexdigest() for i in row_id], dtype=object)
    order = np.lexsort((row_id.astype(str), keys.astype(str), y.astype(str)))
    folds = np.empty(len(y), np.int64)
    folds[order] = np.arange(len(y)) % splits
    return folds


def _design(features: dict[str, Feature], pairs: list, candidate: dict[str, Any]) -> Design:
    return Design(features, candidate["n_knots"], candidate["degree"], list(pairs), candidate["interaction_scale"])


def _need_converged(fit: Fit, strict: bool, where: str) -> Fit:
    if strict and not fit.converged:
        raise SmoothspanError(f"no convergence after {fit.iterations} iterations: {where}")
    return fit


def search_numpy(data: pd.DataFrame, features: dict[str, Feature], pairs: list, grid: list[dict], splits: int, seed: int, classes: list[str], strict: bool) -> list[dict]:
    """Mean and deviation of the log loss of every candidate over the same inner folds."""
    y = data["y"].to_numpy(dtype=object)
    folds = inner_folds(y, data["row_id"].to_numpy(dtype=object), splits, seed)
    losses: dict[int, list[float]] = {c["ordinal"]: [] for c in grid}
    for fold in range(splits):
        train, test = data[folds != fold], data[folds == fold]
        position = {c: i for i, c in enumerate(classes)}
        at = np.array([position[v] for v in test["y"]])
        made: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for c in grid:
            key = (c["n_knots"], c["degree"], c["interaction_scale"])
            if key not in made:
                design = _design(features, pairs, c).fit_numpy(train)
                made[key] = design.matrix(train), design.matrix(test)
            x, x_test = made[key]
            fit = _need_converged(fit_numpy(x, train["y"].to_numpy(dtype=object), classes, c["C"]), strict, f"candidate {c}")
            b, w = fit.normal_form()
            p = softmax_rows(x_test @ w.T + b)[np.arange(len(at)), at]
            losses[c["ordinal"]].append(float(-np.log(np.maximum(p, CLIP)).mean()))
    spread = {k: float(np.std(v, ddof=1)) if len(v) > 1 else 0.0 for k, v in losses.items()}
    return [{**c, "mean_log_loss": float(np.mean(losses[c["ordinal"]])), "std_log_loss": spread[c["ordinal"]]} for c in grid]


def first_best(trials: list[dict]) -> dict:
    return min(trials, key=lambda t: (t["mean_log_loss"], t["ordinal"]))


def fold_tasks(contract: Contract, model: Model) -> list[FoldTask]:
    v = contract.validation
    return [FoldTask(model.id, r, f) for r in range(1, v.outer_repeats + 1) for f in range(1, v.outer_splits + 1)]


def run_grouped(bound: DataFrame, assigned: DataFrame, contract: Contract, features: dict[str, Feature], tasks: list[FoldTask], classes: list[str]) -> DataFrame:
    """Results (RESULT) of outer-fold tasks: predictions of the test rows, trials and parameters.

    ``assigned``: (row_index, repeat, fold). Group keys are the tasks, so data is shuffled once for each of them.
    """
    spark = bound.sparkSession
    models = {m.id: m for m in contract.models}
    v, strict = contract.validation, contract.execution.stop_on_convergence_warning
    settings = {
        m: (candidates(contract.search, models[m].interactions != "none"), contract.pairs(models[m])) for m in {t.model_id for t in tasks}
    }
    wanted = F.broadcast(spark.createDataFrame([(t.model_id, t.repeat, t.fold) for t in tasks], "model_id string, repeat long, of long"))
    rows = bound.join(assigned.select("row_index", "repeat", "fold"), "row_index").join(wanted, "repeat")
    rows = rows.withColumn("tested_", F.col("fold") == F.col("of")).drop("fold").withColumnRenamed("of", "fold")

    def one(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("row_index")
        task = FoldTask(str(data["model_id"].iloc[0]), int(data["repeat"].iloc[0]), int(data["fold"].iloc[0]))
        try:
            grid, pairs = settings[task.model_id]
            train, test = data[~data["tested_"]], data[data["tested_"]]
            seed = task_seed(v.random_state, task.repeat, task.fold, v.outer_splits)
            trials = search_numpy(train, features, pairs, grid, v.inner_splits, seed, classes, strict)
            best = first_best(trials)
            design = _design(features, pairs, best).fit_numpy(train)
            fit = _need_converged(fit_numpy(design.matrix(train), train["y"].to_numpy(dtype=object), classes, best["C"]), strict, "the refit")
        except SmoothspanError as error:
            raise SmoothspanError(f"{task}: {error}") from error
        b, w = fit.normal_form()
        p = softmax_rows(design.matrix(test) @ w.T + b)
        at = np.array([classes.index(c) for c in test["y"]])
        key = {"model_id": task.model_id, "repeat": task.repeat, "fold": task.fold}
        out = pd.DataFrame({"kind": "prediction", **key, "row_index": test["row_index"].to_numpy(), "row_id": test["row_id"].to_numpy(), "observed": test["y"].to_numpy()})
        out["predicted"] = [classes[k] for k in p.argmax(axis=1)]
        out["p_true"] = p[np.arange(len(at)), at]
        out["probabilities"] = list(p)
        out["payload"] = None
        more = [{"kind": "trial", **key, "payload": json.dumps(t)} for t in trials]
        more.append({"kind": "model", **key, "payload": json.dumps(AdditiveModel(design, classes, b, w).to_dict())})
        more = pd.DataFrame(more)
        for name in ("row_id", "observed", "predicted", "probabilities"):
            more[name] = pd.Series([None] * len(more), dtype=object)
        whole = pd.concat([out.astype({"row_index": "Int64"}), more], ignore_index=True)
        return whole[[c.split()[0] for c in RESULT.split(", ")]]

    return rows.groupBy("model_id", "repeat", "fold").applyInPandas(one, RESULT)


def _score(df: DataFrame, model: AdditiveModel) -> DataFrame:
    names = F.array(*[F.lit(c) for c in model.classes])
    full = scored(df, model)
    true = F.get("probabilities_", F.array_position(names, F.col("y")).cast("int") - 1)
    return full.select(
        "row_index", "row_id", F.col("y").alias("observed"), F.get(names, F.get("rank_", 0)).alias("predicted"), true.alias("p_true"), F.col("probabilities_").alias("probabilities")
    )


def _fit_distributed(train: DataFrame, features: dict, pairs: list, candidate: dict, classes: list[str], strict: bool) -> AdditiveModel:
    design = _design(features, pairs, candidate).fit(train)
    fit = _need_converged(fit_mllib(train, design.vector(), "y", classes, candidate["C"]), strict, f"candidate {candidate}")
    b, w = fit.normal_form()
    return AdditiveModel(design, classes, b, w)


def search_distributed(data: DataFrame, features: dict, pairs: list, grid: list[dict], splits: int, seed: int, classes: list[str], strict: bool, workers: int = 1) -> list[dict]:
    """The same search with cluster-wide fits, ``workers`` jobs at a time."""
    inner = assign_folds(data, "y", "row_id", splits, 1, seed).drop("repeat").withColumnRenamed("fold", "inner_")
    inner.persist()
    try:

        def loss(job: tuple[dict, int]) -> float:
            candidate, fold = job
            model = _fit_distributed(inner.where(F.col("inner_") != fold), features, pairs, candidate, classes, strict)
            tested = _score(inner.where(F.col("inner_") == fold), model)
            return tested.agg(F.avg(-F.ln(F.greatest("p_true", F.lit(CLIP))))).first()[0]

        jobs = [(c, f) for c in grid for f in range(1, splits + 1)]
        with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
            values = list(pool.map(loss, jobs))
    finally:
        inner.unpersist()
    out = []
    for i, c in enumerate(grid):
        part = values[i * splits : (i + 1) * splits]
        out.append({**c, "mean_log_loss": float(np.mean(part)), "std_log_loss": float(np.std(part, ddof=1)) if splits > 1 else 0.0})
    return out


def run_distributed(bound: DataFrame, assigned: DataFrame, contract: Contract, features: dict, tasks: list[FoldTask], classes: list[str]) -> Iterator[tuple[FoldTask, DataFrame, list[dict], AdditiveModel]]:
    """(task, predictions, trials, model) one outer fold after the other."""
    models = {m.id: m for m in contract.models}
    v, strict = contract.validation, contract.execution.stop_on_convergence_warning
    for task in tasks:
        model = models[task.model_id]
        folds = assigned.where(F.col("repeat") == task.repeat).select("row_index", F.col("fold").alias("of"))
        rows = bound.join(folds, "row_index")
        train, test = rows.where(F.col("of") != task.fold).drop("of"), rows.where(F.col("of") == task.fold).drop("of")
        grid, pairs = candidates(contract.search, model.interactions != "none"), contract.pairs(model)
        seed = task_seed(v.random_state, task.repeat, task.fold, v.outer_splits)
        trials = search_distributed(train, features, pairs, grid, v.inner_splits, seed, classes, strict, contract.execution.workers)
        fitted = _fit_distributed(train, features, pairs, first_best(trials), classes, strict)
        yield task, _score(test, fitted), trials, fitted


def design_cells(rows: int, contract: Contract, features: dict[str, Feature]) -> int:
    """Values in the largest design that the search may build."""
    most = 0
    for model in contract.models:
        for c in candidates(contract.search, model.interactions != "none"):
            most = max(most, len(_design(features, contract.pairs(model), c).names))
    return rows * most


def fits_one_task(bound: DataFrame, contract: Contract, features: dict[str, Feature]) -> bool:
    return design_cells(bound.count(), contract, features) <= GROUPED_MOST


def run_predictions(bound: DataFrame, assigned: DataFrame, contract: Contract, features: dict[str, Feature], tasks: list[FoldTask], classes: list[str]) -> DataFrame:
    """The out-of-fold predictions (model_id, repeat, fold and the columns of a prediction) by the backend that the size calls for."""
    if fits_one_task(bound, contract, features):
        found = run_grouped(bound, assigned, contract, features, tasks, classes).where("kind = 'prediction'")
        return found.drop("kind", "payload")
    parts = []
    for task, predictions, _, _ in run_distributed(bound, assigned, contract, features, tasks, classes):
        parts.append(predictions.select(F.lit(task.model_id).alias("model_id"), F.lit(task.repeat).cast("long").alias("repeat"), F.lit(task.fold).cast("long").alias("fold"), *predictions.columns))
    return reduce(DataFrame.unionByName, parts)


def final_fit(bound: DataFrame, contract: Contract, features: dict[str, Feature], model: Model, classes: list[str], grouped: bool | None = None) -> tuple[AdditiveModel, list[dict]]:
    """Inner search on all rows with the seed random_state, then the fit of the best candidate on all rows. The backends differ
    in speed only; unless told, the one is taken that the size of the design calls for."""
    if grouped is None:
        grouped = fits_one_task(bound, contract, features)
    v, strict = contract.validation, contract.execution.stop_on_convergence_warning
    grid, pairs = candidates(contract.search, model.interactions != "none"), contract.pairs(model)
    if not grouped:
        trials = search_distributed(bound, features, pairs, grid, v.inner_splits, v.random_state, classes, strict, contract.execution.workers)
        return _fit_distributed(bound, features, pairs, first_best(trials), classes, strict), trials

    def one(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("row_index")
        trials = search_numpy(data, features, pairs, grid, v.inner_splits, v.random_state, classes, strict)
        best = first_best(trials)
        design = _design(features, pairs, best).fit_numpy(data)
        fit = _need_converged(fit_numpy(design.matrix(data), data["y"].to_numpy(dtype=object), classes, best["C"]), strict, f"final fit of {model.id}")
        b, w = fit.normal_form()
        return pd.DataFrame({"payload": [json.dumps({"trials": trials, "model": AdditiveModel(design, classes, b, w).to_dict()})]})

    found = json.loads(bound.groupBy().applyInPandas(one, "payload string").first()[0])
    return AdditiveModel.from_dict(found["model"]), found["trials"]


__all__ = ["FoldTask", "best_candidate", "design_cells", "final_fit", "first_best", "fold_tasks", "run_distributed", "run_grouped", "run_predictions"]
