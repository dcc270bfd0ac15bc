"""The command line: one sub-command for each query of the engine."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from smoothspan import contract as contracts
from smoothspan.errors import ConfigurationError
from smoothspan.operators import explain, scoring
from smoothspan.operators.profile import profile
from smoothspan.plans import report, runs
from smoothspan.session import get_session
from smoothspan.sources import sinks, tables


def _profile(args) -> None:
    df = tables.load_table(get_session(), args.data)
    found = {"path": str(args.data), "sha256": tables.sha256_file(args.data), **profile(df, args.target)}
    out = Path(args.output)
    sinks.write_json_atomic(out / "profile.json", found)
    plain = [{"column": c, **{k: v for k, v in p.items() if not isinstance(v, dict)}} for c, p in found["column_profiles"].items()]
    names = list(dict.fromkeys(k for p in plain for k in p))
    import pandas as pd

    pd.DataFrame(plain, columns=names).to_csv(out / "columns.csv", index=False)
    for c, p in found["column_profiles"].items():
        print(f"{c}: {p['recommended_role']} ({p['reason']})")


def _ask(prompt: str, default: str) -> str:
    return input(f"{prompt} [{default}]: ").strip() or default


def _configure(args) -> None:
    """Roles from the profile (asked for unless --non-interactive), declared categories from the data, two models."""
    spark = get_session()
    df = tables.load_table(spark, args.data)
    tables.check_columns(df, [args.target])
    found = profile(df, args.target)["column_profiles"]
    asks = not args.non_interactive and sys.stdin is not None and sys.stdin.isatty()  # nobody answers without a terminal
    features = {}
    for name, p in found.items():
        if name in (args.target, args.row_id):
            continue
        role = _ask(f"role of {name}", p["recommended_role"]) if asks else p["recommended_role"]
        features[name] = {"role": role, "missing": "error"}
    words = [n for n, f in features.items() if f["role"] == "categorical"]
    if words:
        row = df.agg(*[F.array_sort(F.collect_set(F.col(f"`{n}`").cast("string"))).alias(n) for n in words]).first()
        for n in words:
            features[n]["categories"] = list(row[n])
    validation, search = contracts.preset(args.preset)
    smooth = sum(f["role"] == "smooth" for f in features.values())
    made = contracts.from_dict(
        {
            "experiment": {"name": args.name},
            "data": {"path": str(Path(args.data).resolve()), "target": args.target, "row_id": args.row_id},
            "features": features,
            "models": [{"id": "main_effects", "interactions": "none"}, {"id": "pairwise", "interactions": "all_eligible" if smooth > 1 else "none"}],
            "validation": vars(validation),
            "search": vars(search),
            "execution": {"workers": args.workers},
        }
    )
    sinks.write_yaml_atomic(args.output, contracts.to_dict(made))


def _plan(args) -> None:
    for model, n, fits in contracts.plan_rows(contracts.load(args.config)):
        print(f"{model}: {n} candidates, {fits} fits")


def _run(args) -> None:
    store = runs.create_run(contracts.load(args.config), args.workspace)
    print(store.root)
    runs.execute_run(get_session(), store)


def _resume(args) -> None:
    runs.resume_run(get_session(), runs.RunStore(args.run))


def _status(args) -> None:
    store = runs.RunStore(args.run)
    if args.follow:
        runs.follow_status(store)
    else:
        print(store.status())


def _inspect(args) -> None:
    spark, store = get_session(), runs.RunStore(args.run)
    print(report.inspect_model(spark, store, args.model, args.reference))
    report.write_report(spark, store, args.model)


def _verify_link(args) -> None:
    spark, store = get_session(), runs.RunStore(args.run)
    print(f"maximum absolute error: {report.verify_model_link(spark, store, args.model):.3g}")
    report.write_report(spark, store, args.model)


def _compare(args) -> None:
    runs.compare_runs(get_session(), args.left, args.right, args.output, args.left_model, args.right_model)[1].show(truncate=False)


def _scenarios(args):
    spark = get_session()
    return spark, scoring.AdditiveModel.load(args.model), tables.load_table(spark, args.input, need_rows=True)


def _predict(args) -> None:
    _, model, df = _scenarios(args)
    found = (scoring.predict_scenarios if args.short else scoring.predict)(df, model).persist()
    sinks.write_csv_file(found, args.output)
    found.limit(20).show(truncate=False)
    scoring.predicted_class_counts(found, model.classes).show()


def _transform(args) -> None:
    _, model, df = _scenarios(args)
    found = scoring.transform(df, model)
    sinks.write_csv_file(found, args.output)
    print(scoring.component_counts(model))
    found.select(*[f"`{c}`" for c in found.columns[:20]]).limit(20).show(truncate=False)


def _contributions(args) -> None:
    spark, model, df = _scenarios(args)
    long = explain.contributions(df, model).persist()
    summary = explain.score_summary(long).persist()
    explain.check_score_summary(summary)
    stem = str(Path(args.output).with_suffix(""))
    sinks.write_csv_file(long, args.output)
    sinks.write_csv_file(summary, f"{stem}_score_summary.csv")
    metadata = [f"`{c}`" for c in df.columns if c not in model.design.predictors]
    sinks.write_csv_file(scoring.with_scenario_id(df).select("scenario_id", *[c for c in metadata if c != "`scenario_id`"]), f"{stem}_scenario_metadata.csv")
    explain.top_contributions(long, args.top).orderBy("observation_index", "class", "rank").show(60, truncate=False)


def _demo(args) -> None:
    sinks.write_small_csv(tables.demo_table(get_session(), args.rows, args.seed), args.output)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="smoothspan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, run, *options: tuple) -> None:
        sub = commands.add_parser(name)
        sub.set_defaults(run_command=run)
        for flag, settings in options:
            sub.add_argument(flag, **settings)

    need, run_dir, model_id = {"required": True}, ("--run", {"required": True}), ("--model", {"required": True})
    add("profile", _profile, ("--data", need), ("--target", {"default": None}), ("--output", need))
    add("configure", _configure, ("--data", need), ("--target", need), ("--row-id", {"default": None}), ("--name", {"default": "experiment"}), ("--preset", {"default": "standard", "choices": list(contracts.PRESETS)}), ("--workers", {"type": int, "default": 1}), ("--non-interactive", {"action": "store_true"}), ("--output", need))
    add("plan", _plan, ("--config", need))
    add("run", _run, ("--config", need), ("--workspace", {"default": "workspace"}))
    add("status", _status, run_dir, ("--follow", {"action": "store_true"}))
    add("resume", _resume, run_dir)
    add("pause", lambda a: runs.RunStore(a.run).request("PAUSE"), run_dir)
    add("cancel", lambda a: runs.RunStore(a.run).request("CANCEL"), run_dir)
    add("inspect", _inspect, run_dir, model_id, ("--reference-class", {"default": None, "dest": "reference"}))
    add("verify-link", _verify_link, run_dir, model_id)
    add("compare", _compare, ("--left", need), ("--left-model", need), ("--right", need), ("--right-model", need), ("--output", need))
    files = (model_id, ("--input", need), ("--output", need))
    add("predict", _predict, *files, ("--short", {"action": "store_true"}))
    add("transform", _transform, *files)
    add("contributions", _contributions, *files, ("--top", {"type": int, "default": 10}))
    add("demo", _demo, ("--rows", {"type": int, "default": 300}), ("--seed", {"type": int, "default": 42}), ("--output", need))
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    try:
        args.run_command(args)
    except ConfigurationError as error:
        print(f"ERROR: contract: {error}", file=sys.stderr)
        return 1
    except Exception as error:  # noqa: BLE001  the command line reports every failure in one form
        print(f"ERROR: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
