"""HTML reports with inline SVG heat maps, from aggregated results."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smoothspan.errors import CheckpointError, DataValidationError
from smoothspan.operators.explain import components, contrasts, equations, verification_text, verify_link
from smoothspan.operators.metrics import class_summary, confusion, oof_counters
from smoothspan.operators.scoring import AdditiveModel, scored
from smoothspan.plans.runs import RunStore, load_run_contract
from smoothspan.sources.sinks import write_small_csv
from smoothspan.sources.tables import load_table, read_json

STYLE = "body{font-family:sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #999;padding:.3em .6em;text-align:right}th{background:#eee}"


def html_table(df: DataFrame) -> str:
    rows = df.collect()  # aggregated results only

    def text(v: object) -> str:
        return f"{v:.6g}" if isinstance(v, float) else escape(str(v))

    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{text(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def heat_map(matrix: dict[tuple[str, str], float], classes: list[str], title: str, form: str) -> str:
    """A square heat map: observed classes as rows, predicted ones as columns."""
    cell, left, top = 64, 120, 60
    most = max([*matrix.values(), 1e-12])
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{left + cell * len(classes) + 20}" height="{top + cell * len(classes) + 20}" font-family="sans-serif" font-size="12">']
    out.append(f'<text x="8" y="18" font-size="14">{escape(title)}</text>')
    for i, o in enumerate(classes):
        out.append(f'<text x="{left - 8}" y="{top + cell * i + cell / 2 + 4}" text-anchor="end">{escape(o)}</text>')
        out.append(f'<text x="{left + cell * i + cell / 2}" y="{top - 8}" text-anchor="middle">{escape(o)}</text>')
        for j, p in enumerate(classes):
            value = matrix.get((o, p), 0)
            shade = value / most
            ink = "#fff" if shade > 0.55 else "#000"
            out.append(f'<rect x="{left + cell * j}" y="{top + cell * i}" width="{cell}" height="{cell}" fill="rgb({round(247 - 239 * shade)},{round(251 - 203 * shade)},{round(255 - 148 * shade)})"/>')
            out.append(f'<text x="{left + cell * j + cell / 2}" y="{top + cell * i + cell / 2 + 4}" text-anchor="middle" fill="{ink}">{format(value, form)}</text>')
    return "".join(out) + "</svg>"


def check_labels(predictions: DataFrame, classes: list[str]) -> None:
    """Raises if labels of the predictions are not among the model's classes."""
    seen = predictions.select(F.col("observed_class").alias("c")).union(predictions.select("predicted_class")).distinct()
    odd = [r["c"] for r in seen.where(~F.col("c").isin(classes) | F.col("c").isNull()).limit(10).collect()]
    if odd:
        raise DataValidationError(f"labels {odd} are not among the model's classes {classes}")


def inspect_model(spark: SparkSession, store: RunStore, model_id: str, reference: str | None = None) -> Path:
    """components.csv, equations.txt and reference_equations.csv of a final model."""
    model = AdditiveModel.load(store.root / "models" / model_id / "model.json")
    reference = reference or model.classes[0]
    if reference not in model.classes:
        raise DataValidationError(f"{reference} is not a class of the model: {model.classes}")
    out = store.root / "reports" / model_id / "inspection"
    table = components(spark, model).persist()
    write_small_csv(table.orderBy("class_index", "position").select("class", "component", "coefficient"), out / "components.csv")
    write_small_csv(contrasts(table, reference).orderBy("comparison", "component"), out / "reference_equations.csv")
    (out / "equations.txt").write_text(equations(model), encoding="utf-8")
    table.unpersist()
    return out


def verify_model_link(spark: SparkSession, store: RunStore, model_id: str) -> float:
    """Scores, probabilities and rebuilt probabilities of the training data, and their largest difference."""
    contract = load_run_contract(store)
    model = AdditiveModel.load(store.root / "models" / model_id / "model.json")
    data = load_table(spark, contract.data_path)
    long = verify_link(data, model).persist()
    out = store.root / "reports" / model_id / "verification"
    for name, column in (("scores", "score"), ("probabilities", "probability"), ("reconstructed_probabilities", "reconstructed")):
        wide = long.groupBy("row_index").pivot("class", model.classes).agg(F.first(column)).orderBy("row_index")
        wide.drop("row_index").write.mode("overwrite").csv(str(out / name), header=True)
    worst = long.agg(F.max("error")).first()[0] or 0.0
    long.unpersist()
    out.mkdir(parents=True, exist_ok=True)
    (out / "verification.txt").write_text(verification_text(model, worst), encoding="utf-8")
    return worst


def write_report(spark: SparkSession, store: RunStore, model_id: str) -> Path:
    results, final = store.root / "results" / model_id, store.root / "models" / model_id
    for needed in (results / "summary.csv", results / "predictions.parquet", final / "model_metadata.json"):
        if not needed.exists():
            raise CheckpointError(f"the report of {model_id} needs {needed.name}; is the run complete?")
    meta, run, manifest = read_json(final / "model_metadata.json"), read_json(store.root / "run.json"), read_json(store.root / "data_manifest.json")
    classes = meta["classes"]
    predictions = spark.read.parquet(str(results / "predictions.parquet"))
    check_labels(predictions, classes)
    pooled = confusion(predictions.select(F.col("observed_class").alias("observed"), F.col("predicted_class").alias("predicted")), classes).collect()
    counts = {(r["observed"], r["predicted"]): r["n"] for r in pooled}
    shares = {(r["observed"], r["predicted"]): r["share"] for r in pooled}
    plots = {"confusion_counts": heat_map(counts, classes, "Confusion matrix, counts", "d"), "confusion_normalized": heat_map(shares, classes, "Confusion matrix, shares of rows", ".3f")}
    for name, svg in plots.items():
        path = store.root / "plots" / f"{model_id}_{name}.svg"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(svg, encoding="utf-8")
    total = sum(manifest["class_counts"].values())
    distribution = spark.createDataFrame([(c, n, round(100 * n / total, 2)) for c, n in sorted(manifest["class_counts"].items())], "class string, rows long, percent double")
    best = read_json(final / "best_parameters.json")
    table = spark.read.csv(str(results / "class_metrics.csv"), header=True, inferSchema=True)
    items = "".join(f"<li>{escape(str(k))}: {escape(str(v))}</li>" for k, v in meta.items())
    chosen = "".join(f"<li>{escape(k)}: {escape(str(v))}</li>" for k, v in best.items() if k != "ordinal")
    folder = store.root / "reports" / model_id
    links = "".join(f'<li><a href="{p.relative_to(folder)}">{p.relative_to(folder)}</a></li>' for p in sorted(folder.rglob("*")) if p.suffix in (".csv", ".txt"))
    page = [
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(model_id)}</title><style>{STYLE}</style></head><body><h1>{escape(model_id)}</h1>",
        f"<h2>Overview</h2><p>Run {escape(run['run_id'])}; {total} rows, target {escape(manifest['target'])}, data {escape(manifest['sha256'])}</p>",
        f"<h2>Class distribution</h2>{html_table(distribution)}",
        f"<h2>Final model</h2><ul>{items}</ul><h2>Selected hyper-parameters</h2><ul>{chosen}</ul>",
        f"<h2>Metrics over outer folds</h2>{html_table(spark.read.csv(str(results / 'summary.csv'), header=True, inferSchema=True))}",
        f"<h2>Metrics of classes</h2>{html_table(class_summary(table, []).orderBy('class'))}",
        *plots.values(),
        f"<h2>Out-of-fold predictions</h2>{html_table(oof_counters(predictions))}",
        f"<h2>Files</h2><ul>{links}</ul></body></html>",
    ]
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "report.html").write_text("\n".join(page), encoding="utf-8")
    return folder / "report.html"


__all__ = ["check_labels", "heat_map", "inspect_model", "scored", "verify_model_link", "write_report"]
