"""Run directories: creation, locking, control markers, checkpoints, aggregation, execution and comparison."""

from __future__ import annotations

import contextlib
import os
import platform
import secrets
import socket
import sys
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smoothspan import __version__
from smoothspan.contract import Contract, Model, from_dict, to_dict
from smoothspan.errors import CheckpointError, DataValidationError, SmoothspanError
from smoothspan.operators.design import bind, resolve_categories
from smoothspan.operators.folds import assign_folds, check_class_counts, check_manifest, split_manifest
from smoothspan.operators.metrics import METRICS, class_metrics, class_summary, compare, compare_summary, fold_metrics, metric_summary, specificity_columns
from smoothspan.operators.scoring import AdditiveModel
from smoothspan.operators.search import GROUPED_MOST, FoldTask, design_cells, final_fit, first_best, fold_tasks, run_distributed, run_grouped
from smoothspan.sources.sinks import append_jsonl, format_duration, utc_now, write_directory_atomic, write_json_atomic, write_parquet, write_small_csv, write_yaml_atomic
from smoothspan.sources.tables import load_table, read_json, sha256_file, stable_hash

FOLDERS = ("control", "checkpoints", "results", "models", "plots", "reports", "logs")
END_STATES = ("completed", "failed", "cancelled", "paused")


def stop_reason(value: Any) -> str | None:
    """What a stop callback returned: nothing, its text, or just "stop"."""
    if not value:
        return None
    return value if isinstance(value, str) else "stop"


class RunStore:
    def __init__(self, root: str | Path):
        self.root = Path(root)

    def create(self) -> RunStore:
        for name in FOLDERS:
            (self.root / name).mkdir(parents=True, exist_ok=True)
        return self

    def update_status(self, **values: Any) -> None:
        path = self.root / "status.json"
        old = read_json(path) if path.exists() else {}
        write_json_atomic(path, {**old, **values, "updated_at_utc": utc_now()})

    def status(self) -> dict[str, Any]:
        return read_json(self.root / "status.json")

    def event(self, event: str, level: str = "INFO", **values: Any) -> None:
        append_jsonl(self.root / "logs" / "events.jsonl", {"level": level, "event": event, **values})

    # Control markers.

    def request(self, marker: str) -> None:
        (self.root / "control").mkdir(parents=True, exist_ok=True)
        (self.root / "control" / marker).touch()

    def clear_requests(self) -> None:
        for marker in ("PAUSE", "CANCEL"):
            (self.root / "control" / marker).unlink(missing_ok=True)

    def requested(self) -> str | None:
        for marker in ("CANCEL", "PAUSE"):
            if (self.root / "control" / marker).exists():
                return marker.lower()
        return None

    # The lock is created exclusively; one left by a process of this host that has ended is taken over.

    @contextlib.contextmanager
    def locked(self) -> Iterator[None]:
        path = self.root / "run.lock"
        for _ in range(2):
            try:
                handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                break
            except FileExistsError:
                held = read_json(path) if path.stat().st_size else {}
                same_host = held.get("host") == socket.gethostname()
                if same_host and held.get("pid") and not _alive(held["pid"]):
                    path.unlink(missing_ok=True)
                    continue
                raise CheckpointError(f"the run is locked by process {held.get('pid')} on {held.get('host')}") from None
        else:
            raise CheckpointError("the run's lock could not be taken")
        with os.fdopen(handle, "w") as stream:
            stream.write(f'{{"pid": {os.getpid()}, "host": "{socket.gethostname()}"}}')
        try:
            yield
        finally:
            path.unlink(missing_ok=True)

    # Checkpoints of outer folds.

    def checkpoint(self, task: FoldTask) -> Path:
        return self.root / "checkpoints" / task.model_id / f"repeat-{task.repeat:02d}_fold-{task.fold:02d}"

    def is_complete(self, task: FoldTask, data_hash: str, config_hash: str) -> bool:
        path = self.checkpoint(task)
        if not (path / "COMPLETE").exists():
            return False
        meta = read_json(path / "checkpoint.json")
        if meta.get("data_hash") != data_hash or meta.get("config_hash") != config_hash:
            raise CheckpointError(f"the checkpoint of {task} belongs to other data or another contract")
        return True

    def checkpoint_tables(self, spark: SparkSession, model_id: str, table: str) -> DataFrame:
        """One scan over a table of all complete checkpoints of a model."""
        paths = [str(p.parent / f"{table}.parquet") for p in sorted((self.root / "checkpoints" / model_id).glob("*/COMPLETE"))]
        if not paths:
            raise CheckpointError(f"model {model_id} has no complete folds")
        return spark.read.parquet(*paths)


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


def create_run(contract: Contract, workspace: str | Path) -> RunStore:
    run_id = f"run-{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}-{secrets.token_hex(4)}"
    store = RunStore(Path(workspace) / run_id).create()
    settings = to_dict(contract)
    write_yaml_atomic(store.root / "config.yaml", settings)
    write_json_atomic(
        store.root / "run.json",
        {
            "schema_version": contract.schema_version,
            "run_id": run_id,
            "created_at_utc": utc_now(),
            "data_hash": sha256_file(contract.data_path),
            "config_hash": stable_hash(settings),
            "application_version": __version__,
        },
    )
    write_json_atomic(store.root / "environment.json", {"python": sys.version, "platform": platform.platform(), "pyspark": pyspark.__version__})
    store.update_status(state="created")
    return store


def load_run_contract(store: RunStore) -> Contract:
    import yaml

    return from_dict(yaml.safe_load((store.root / "config.yaml").read_text(encoding="utf-8")))


def execute_run(spark: SparkSession, store: RunStore, say: Callable[[str], None] = print) -> str:
    """Run or resume; returns the state. Failures are recorded in the status and raised again."""
    with store.locked():
        try:
            return _execute(spark, store, say)
        except BaseException as error:
            store.update_status(state="failed", error=str(error))
            store.event("run_failed", level="ERROR", error=str(error))
            raise


def _execute(spark: SparkSession, store: RunStore, say: Callable[[str], None]) -> str:
    began = time.time()
    contract, run = load_run_contract(store), read_json(store.root / "run.json")
    if sha256_file(contract.data_path) != run["data_hash"]:
        raise CheckpointError("the data file has changed since the run was created")
    store.update_status(state="running", phase="evaluation", started_at_utc=utc_now(), error=None)
    store.event("run_started")
    v = contract.validation
    raw = load_table(spark, contract.data_path, need_rows=True)
    features = resolve_categories(raw, contract)
    bound = bind(raw, contract).persist()
    assigned = None
    try:
        counts = {r["y"]: r["count"] for r in bound.groupBy("y").count().collect()}
        check_class_counts(counts, v.outer_splits, v.inner_splits)
        classes, rows = sorted(counts), sum(counts.values())
        write_json_atomic(
            store.root / "data_manifest.json",
            {"path": contract.data_path, "sha256": run["data_hash"], "rows": rows, "predictors": contract.active(), "target": contract.target, "class_counts": counts},
        )
        manifest = store.root / "results" / "fold_assignment.parquet"
        if not (manifest / "_SUCCESS").exists():
            made = assign_folds(bound.select("row_index", "row_id", "y"), "y", "row_id", v.outer_splits, v.outer_repeats, v.random_state)
            write_parquet(made.drop("y"), manifest)
        assigned = spark.read.parquet(str(manifest)).persist()
        check_manifest(split_manifest(assigned, "row_id", v.outer_splits), bound, v.outer_splits, v.outer_repeats)
        grouped = design_cells(rows, contract, features) <= GROUPED_MOST
        for model in contract.models:
            store.update_status(phase="nested_cross_validation", model_id=model.id)
            state = _run_model(store, contract, run, features, bound, assigned, model, classes, grouped, say)
            if state:
                store.update_status(state=state)
                store.event(f"run_{state}")
                return state
            aggregate_model(spark, store, model.id, classes)
            fitted, trials = final_fit(bound, contract, features, model, classes, grouped)
            save_final_model(spark, store, model.id, fitted, trials, rows, len(contract.active()), classes)
        store.update_status(phase="reporting")
        from smoothspan.plans.report import write_report

        for model in contract.models:
            write_report(spark, store, model.id)
        store.update_status(state="completed", completed_at_utc=utc_now())
        store.event("run_completed")
        say(f"completed in {format_duration(time.time() - began)}")
        return "completed"
    finally:
        bound.unpersist()
        if assigned is not None:
            assigned.unpersist()


def _run_model(store, contract, run, features, bound, assigned, model: Model, classes, grouped, say) -> str | None:
    tasks = fold_tasks(contract, model)
    pending = [t for t in tasks if not store.is_complete(t, run["data_hash"], run["config_hash"])]
    say(f"{model.id}: {len(tasks) - len(pending)} folds restored, {len(pending)} pending")
    size = contract.execution.workers
    done, began = len(tasks) - len(pending), time.time()

    def stopped() -> str | None:
        reason = stop_reason(store.requested())
        if reason:
            store.event(f"{reason}_requested", model_id=model.id)
        return {"pause": "paused", "cancel": "cancelled"}.get(reason, reason)

    for at in range(0, len(pending), size):
        if state := stopped():
            return state
        part = pending[at : at + size]
        for t in part:
            store.event("fold_started", model_id=t.model_id, repeat=t.repeat, fold=t.fold)
        if grouped:
            results = _collect_grouped(run_grouped(bound, assigned, contract, features, part, classes), part)
        else:
            results = run_distributed(bound, assigned, contract, features, part, classes)
        for task, predictions, trials, fitted in results:
            loss = save_fold(store, run, task, predictions, trials, fitted, classes)
            done += 1
            store.update_status(repeat=task.repeat, fold=task.fold, completed_outer_folds=done, total_outer_folds=len(tasks))
            store.event("fold_completed", model_id=task.model_id, repeat=task.repeat, fold=task.fold, log_loss=loss)
            say(f"{task}: log loss {loss:.6f}, {done}/{len(tasks)}, {format_duration(time.time() - began)}")
    return stopped()


def _collect_grouped(found: DataFrame, tasks: list[FoldTask]):
    import json

    found = found.persist()
    try:
        small = found.where("kind <> 'prediction'").select("kind", "repeat", "fold", "payload").collect()
        for task in tasks:
            of = (F.col("repeat") == task.repeat) & (F.col("fold") == task.fold)
            mine = [r for r in small if (r["repeat"], r["fold"]) == (task.repeat, task.fold)]
            trials = sorted((json.loads(r["payload"]) for r in mine if r["kind"] == "trial"), key=lambda t: t["ordinal"])
            model = AdditiveModel.from_dict(json.loads(next(r["payload"] for r in mine if r["kind"] == "model")))
            yield task, found.where(of & (F.col("kind") == "prediction")), trials, model
    finally:
        found.unpersist()


def save_fold(store: RunStore, run: dict, task: FoldTask, predictions: DataFrame, trials: list[dict], fitted: AdditiveModel, classes: list[str]) -> float:
    spark = predictions.sparkSession
    key = {"model_id": task.model_id, "repeat": task.repeat, "fold": task.fold}
    by = list(key)
    tagged = predictions.select(
        *[F.lit(v).alias(k) for k, v in key.items()], "row_id", F.col("observed").alias("observed_class"), F.col("predicted").alias("predicted_class"), "p_true",
        *[F.get("probabilities", i).alias(f"probability_{c}") for i, c in enumerate(classes)],
    )
    best = first_best(trials)
    loss: list[float] = []

    def fill(part: Path) -> None:
        tagged.write.parquet(str(part / "predictions.parquet"))
        saved = spark.read.parquet(str(part / "predictions.parquet")).withColumnsRenamed({"observed_class": "observed", "predicted_class": "predicted"})
        table = class_metrics(saved, classes, by)
        table.write.parquet(str(part / "class_metrics.parquet"))
        row = fold_metrics(saved, classes, by).join(specificity_columns(table, classes, by), by).first().asDict()
        chosen = {f"best_{k}": best[k] for k in ("n_knots", "degree", "C", "interaction_scale", "mean_log_loss", "std_log_loss")}
        write_json_atomic(part / "metrics.json", {**row, **chosen})
        spark.createDataFrame([{k: float(v) for k, v in t.items()} for t in trials]).write.parquet(str(part / "trials.parquet"))
        fitted.save(part / "model.json")
        write_json_atomic(part / "checkpoint.json", {**key, "data_hash": run["data_hash"], "config_hash": run["config_hash"], "completed_at_utc": utc_now()})
        loss.append(row["log_loss"])

    write_directory_atomic(store.checkpoint(task), fill)
    return loss[0]


def aggregate_model(spark: SparkSession, store: RunStore, model_id: str, classes: list[str]) -> None:
    """Result tables of a model from its checkpoints; all folds must be complete."""
    contract = load_run_contract(store)
    tasks = fold_tasks(contract, next(m for m in contract.models if m.id == model_id))
    lacking = [str(t) for t in tasks if not (store.checkpoint(t) / "COMPLETE").exists()]
    if lacking:
        raise CheckpointError(f"{len(lacking)} folds are not complete, the first is {lacking[0]}")
    rows = [read_json(store.checkpoint(t) / "metrics.json") for t in tasks]
    folds = spark.createDataFrame(rows).select(*rows[0])
    out = store.root / "results" / model_id
    write_small_csv(folds.orderBy("repeat", "fold"), out / "fold_metrics.csv")
    write_small_csv(metric_summary(folds, []).orderBy("metric"), out / "summary.csv")
    table = store.checkpoint_tables(spark, model_id, "class_metrics")
    write_small_csv(table.orderBy("repeat", "fold", "class"), out / "class_metrics.csv")
    write_small_csv(class_summary(table, []).orderBy("class"), out / "class_summary.csv")
    write_parquet(store.checkpoint_tables(spark, model_id, "predictions"), out / "predictions.parquet")


def save_final_model(spark: SparkSession, store: RunStore, model_id: str, model: AdditiveModel, trials: list[dict], rows: int, predictors: int, classes: list[str] | None = None) -> None:
    from smoothspan.operators.explain import components

    folder = store.root / "models" / model_id
    folder.mkdir(parents=True, exist_ok=True)
    if classes is not None and list(model.classes) != list(classes):
        raise SmoothspanError(f"the final model has the classes {list(model.classes)}, the training target {list(classes)}")
    if any(len(model.classes) != n for n in (len(model.intercepts), len(model.coefficients))):
        raise SmoothspanError("the final model's parameters don't go with its classes")
    model.save(folder / "model.json")
    write_json_atomic(folder / "best_parameters.json", first_best(trials))
    spark.createDataFrame([{k: float(v) for k, v in t.items()} for t in trials]).write.mode("overwrite").parquet(str(folder / "search_trials.parquet"))
    write_small_csv(components(spark, model).orderBy("class_index", "position").select("class", "component", "coefficient"), folder / "components.csv")
    write_json_atomic(
        folder / "model_metadata.json",
        {
            "model_id": model_id,
            "fitted_at_utc": utc_now(),
            "training_rows": rows,
            "predictor_count": predictors,
            "transformed_feature_count": len(model.design.names),
            "classification_type": "binary" if len(model.classes) == 2 else "multinomial",
            "class_count": len(model.classes),
            "classes": model.classes,
        },
    )


def resume_run(spark: SparkSession, store: RunStore, say: Callable[[str], None] = print) -> str:
    store.clear_requests()
    return execute_run(spark, store, say)


def follow_status(store: RunStore, say: Callable[[str], None] = print, every: float = 2.0) -> dict:
    while True:
        status = store.status()
        say(str(status))
        if status["state"] in END_STATES:
            return status
        time.sleep(every)


def fold_metrics_path(place: str | Path, model_id: str | None = None) -> Path:
    """The fold metrics of a model of a run; without a model, ``place`` is a CSV file itself."""
    found = Path(place) if model_id is None else Path(place) / "results" / model_id / "fold_metrics.csv"
    if not found.exists():
        raise DataValidationError(f"no fold metrics at {found}")
    return found


def compare_runs(
    spark: SparkSession, left: str | Path, right: str | Path, out: str | Path, left_model: str | None = None, right_model: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fold metrics of two models of one or two runs, joined and summarized into comparison.csv and summary.csv."""
    sides = [load_table(spark, fold_metrics_path(p, m)) for p, m in ((left, left_model), (right, right_model))]
    for side in sides:
        lacking = {"repeat", "fold", *METRICS[:4]} - set(side.columns)
        if lacking:
            raise DataValidationError(f"fold metrics lack {sorted(lacking)}")
    joined = compare(*sides)
    summary = compare_summary(joined)
    write_small_csv(joined.orderBy("repeat", "fold"), Path(out) / "comparison.csv")
    write_small_csv(summary.orderBy("metric"), Path(out) / "summary.csv")
    return joined, summary
