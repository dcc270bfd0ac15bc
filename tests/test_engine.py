import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from smoothspan.contract import Contract, Execution, Feature, Model, Search, Validation
from smoothspan.errors import CheckpointError, ConfigurationError, DataValidationError, SmoothspanError
from smoothspan.functions.arrays import ranking, softmax, spline_basis
from smoothspan.operators import explain, folds, metrics, profile, scoring, search, solver
from smoothspan.operators.design import Design, basis_numpy, bind, resolve_categories
from smoothspan.plans import runs
from smoothspan.sources import sinks, tables


def frame(n=120, seed=7):
    r = np.random.default_rng(seed)
    x1, x2 = r.normal(size=n), r.uniform(-1, 1, n)
    s = x1 + 0.5 * x2
    return pd.DataFrame({"x1": x1, "x2": x2, "x3": r.choice(["low", "high"], n), "target": np.where(s > 0.6, "C", np.where(s < -0.6, "A", "B"))})


def de_boor(x, lo, hi, n_knots, degree):
    h = (hi - lo) / (n_knots - 1)
    t = lo + h * np.arange(-degree, n_knots + degree)
    b = [((t[i] <= x) & (x < t[i + 1])).astype(float) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        b = [(x - t[i]) / (t[i + d] - t[i]) * b[i] + (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * b[i + 1] for i in range(len(t) - 1 - d)]
    return np.array(b).T


@pytest.mark.parametrize(("knots", "degree"), [(3, 2), (5, 3), (2, 1), (6, 3)])
def test_splines(spark, knots, degree):
    x = np.linspace(-1.0, 2.999, 41)
    want = de_boor(x, -1.0, 3.0, knots, degree)
    assert np.allclose(want.sum(axis=1), 1)
    assert np.allclose(basis_numpy(x, -1.0, 3.0, knots, degree), want[:, :-1], atol=1e-12)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = np.array([r[0] for r in df.select(F.array(*spline_basis(F.col("x"), -1.0, 3.0, knots, degree))).collect()])
    assert np.allclose(got, want[:, :-1], atol=1e-12)


def test_array_functions(spark):
    row = spark.range(1).select(softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0))), ranking(F.array(F.lit(0.4), F.lit(0.2), F.lit(0.4)))).first()
    assert row[0] == [0.5, 0.5, 0.0] and row[1] == [0, 2, 1]


def test_sources_and_sinks(spark, tmp_path):
    pdf = frame(10)
    pdf.to_csv(tmp_path / "a.CSV", index=False)
    pdf.to_csv(tmp_path / "b.tsv", sep="\t", index=False)
    pdf.to_parquet(tmp_path / "c.pq")
    for name in ("a.CSV", "b.tsv", "c.pq"):
        assert tables.load_table(spark, tmp_path / name).count() == 10
    with pytest.raises(DataValidationError):
        tables.load_table(spark, tmp_path / "a.xlsx")
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(DataValidationError):
        tables.load_table(spark, tmp_path / "e.csv", need_rows=True)
    assert tables.stable_hash({"b": 1, "a": (1, 2)}) == tables.stable_hash({"a": [1, 2], "b": 1})
    df = tables.with_row_index(spark.createDataFrame(pdf))
    assert sorted(r[0] for r in df.select("row_index").collect()) == list(range(10))
    sinks.append_jsonl(tmp_path / "e.jsonl", {"event": "x"})
    assert json.loads((tmp_path / "e.jsonl").read_text())["event"] == "x"
    with pytest.raises(RuntimeError):
        sinks.write_directory_atomic(tmp_path / "d", lambda p: (_ for _ in ()).throw(RuntimeError()))
    assert not (tmp_path / "d").exists() and not (tmp_path / "d.tmp").exists()
    assert [sinks.format_duration(x) for x in (-1, 59.6, 3661)] == ["00:00:00", "00:01:00", "01:01:01"]


def test_steel_plates(spark, tmp_path):
    r = np.random.default_rng(1)
    lines = []
    for i in range(7):
        values = r.uniform(1, 2, 27).round(3).tolist()
        values[11], values[12] = i % 2, 1 - i % 2
        lines.append("\t".join(map(str, [*values, *(int(k == i) for k in range(7))])))
    (tmp_path / "raw.nna").write_text("\n".join(lines) + "\n")
    out = tables.prepare_steel_plates(spark, tmp_path / "raw.nna")
    assert len(out.columns) == 27 and {r["Y"] for r in out.collect()} == set(tables.STEEL_FAULTS)
    assert {r["Steel_Type"] for r in out.collect()} == {"A300", "A400"}
    (tmp_path / "bad.nna").write_text(lines[0][:-1] + "1\n")
    with pytest.raises(DataValidationError):
        tables.prepare_steel_plates(spark, tmp_path / "bad.nna")


def test_profile_rules(spark):
    rows = [(i, float(i) / 3, "k" if i % 2 else "m", f"id{i}", i % 3, True, None) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b double, c string, d string, e int, f boolean, g string")
    found = profile.profile(df.unionByName(df.limit(2)), "c")
    roles = {k: v["recommended_role"] for k, v in found["column_profiles"].items()}
    assert roles == {"a": "smooth", "b": "smooth", "c": "target", "d": "categorical", "e": "categorical", "f": "exclude", "g": "exclude"}
    assert found["duplicate_rows"] == 2 and found["target_counts"] == {"k": 31, "m": 31}
    assert profile.infer_role(df.schema["a"].dataType, 60, 60)[0] == "exclude"


def test_class_count_rules():
    folds.check_class_counts({"A": 20, "B": 10}, 5, 2)
    for counts, outer, inner in (({"A": 3}, 2, 2), ({"A": 20, "B": 3}, 5, 2), ({"A": 20, "B": 5}, 5, 5)):
        with pytest.raises(DataValidationError):
            folds.check_class_counts(counts, outer, inner)


def test_folds_and_manifest(spark):
    df = spark.createDataFrame([(i, str(i), "ab"[i % 3 == 0]) for i in range(50)], "row_index long, row_id string, y string")
    assigned = folds.assign_folds(df, "y", "row_id", 5, 2, 1)
    counts = assigned.groupBy("repeat", "fold", "y").count().toPandas()
    for _, part in counts.groupby(["repeat", "y"]):
        assert part["count"].max() - part["count"].min() <= 1
    manifest = folds.split_manifest(assigned, "row_id", 5)
    folds.check_manifest(manifest, df, 5, 2)
    broken = manifest.where("not (fold = 1 and row_index = 3)").unionByName(manifest.where("row_index = 4 and partition = 'test'"))
    found = {r["violation"] for r in folds.manifest_violations(broken, df, 5, 2).collect()}
    assert {"missing row", "row twice in test part"} <= found
    with pytest.raises(DataValidationError):
        folds.check_manifest(broken, df, 5, 2)


def test_design(spark):
    pdf = pd.DataFrame({"lin1": [10.0, 20, 30, None, 50], "smooth1": [1.0, 2, 3, 4, 5], "c": ["low", "high", None, "low", "high"]})
    features = {"smooth1": Feature("smooth"), "lin1": Feature("linear", "median"), "c": Feature("categorical", "most_frequent", ("high", "low", "medium"))}
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "lin1 double, smooth1 double, c string")
    design = Design(features, 3, 2).fit(df)
    assert design.stats["lin1"]["fill"] == 25 and design.stats["c"]["fill"] == "high"
    assert len(design.names) == len(set(design.names)) == 3 + 1 + 2
    got = np.array([r[0] for r in df.select(design.vector()).collect()])
    filled = np.array([10, 20, 30, 25, 50.0])
    assert np.allclose(got[:, 3], (filled - filled.mean()) / filled.std(), atol=1e-10)
    twin = Design(features, 3, 2).fit_numpy(pdf)
    assert np.allclose(twin.matrix(pdf), got, atol=1e-12)
    again = Design.from_dict(json.loads(json.dumps(design.to_dict())))
    assert np.allclose([r[0] for r in df.select(again.vector()).collect()], got, atol=1e-12)
    unseen = spark.createDataFrame([(1.0, 1.0, "medium")], "lin1 double, smooth1 double, c string")
    assert unseen.select(design.vector()).first()[0][-1] == 1.0
    with pytest.raises(DataValidationError, match="vocabulary"):
        design.check(spark.createDataFrame([(1.0, 1.0, "odd")], "lin1 double, smooth1 double, c string"))
    with pytest.raises(DataValidationError):
        design.check(spark.createDataFrame([(1.0, None, "low")], "lin1 double, smooth1 double, c string"))
    with pytest.raises(ConfigurationError):
        Design(features, pairs=[("smooth1", "lin1")])
    with pytest.raises(DataValidationError):
        Design({"smooth1": Feature("smooth")}).fit(df.withColumn("smooth1", F.lit(1.0)))


@pytest.mark.parametrize("k", [2, 3])
def test_solvers_agree(spark, k):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 3))
    classes = ["A", "B", "C"][:k]
    y = np.array(classes, dtype=object)[np.argmax(x @ r.normal(size=(3, k)) + r.gumbel(size=(300, k)), axis=1)]
    ours = solver.fit_numpy(x, y, classes, 0.5)
    df = spark.createDataFrame([(list(map(float, v)), c) for v, c in zip(x, y, strict=True)], "v array<double>, y string")
    theirs = solver.fit_mllib(df, F.col("v"), "y", classes, 0.5)
    assert ours.converged
    assert np.allclose(ours.normal_form()[1], theirs.normal_form()[1], atol=1e-4)
    assert np.allclose(ours.normal_form()[0], theirs.normal_form()[0], atol=1e-4)
    large = solver.NEWTON_MOST
    try:
        solver.NEWTON_MOST = 0
        quasi = solver.fit_numpy(x, y, classes, 0.5, tol=1e-7)
    finally:
        solver.NEWTON_MOST = large
    assert np.allclose(quasi.coefficients, ours.coefficients, atol=1e-3)


def fitted(spark, pdf=None, classes=("A", "B", "C"), pairs=()):
    pdf = frame() if pdf is None else pdf
    features = {"x1": Feature("smooth"), "x2": Feature("smooth"), "x3": Feature("categorical", categories=("high", "low"))}
    design = Design(features, 3, 2, list(pairs), 0.5).fit_numpy(pdf)
    fit = solver.fit_numpy(design.matrix(pdf), pdf["target"].to_numpy(dtype=object), list(classes), 1.0)
    b, w = fit.normal_form()
    return scoring.AdditiveModel(design, list(classes), b, w), pdf


def test_predict_transform_contributions(spark, tmp_path):
    model, pdf = fitted(spark, pairs=[("x1", "x2")])
    model.save(tmp_path / "m.json")
    model = scoring.AdditiveModel.load(tmp_path / "m.json")
    scenarios = spark.createDataFrame(pdf.drop(columns="target").head(9).assign(unused_note="n"))
    out = scoring.predict(scenarios, model).orderBy("scenario_id").toPandas()
    x = model.design.matrix(pdf.head(9))
    p = solver.softmax_rows(x @ model.coefficients.T + model.intercepts)
    assert np.allclose(out[[f"probability_{c}" for c in model.classes]], p, atol=1e-12)
    assert list(out.columns[:1]) == ["scenario_id"] and "unused_note" in out and (out["probability_sum"] - 1).abs().max() < 1e-12
    assert list(out["predicted_class"]) == [model.classes[i] for i in p.argmax(axis=1)]
    assert np.allclose(out["prediction_entropy"], -(p * np.log(p)).sum(axis=1))
    wide = scoring.transform(scenarios, model)
    assert wide.columns[:2] == ["scenario_id", "unused_note"] and len(wide.columns) == 2 + len(model.design.names)
    long = explain.contributions(scenarios, model)
    assert long.count() == 9 * 3 * (len(model.design.names) + 1) and long.where("component = 'intercept'").count() == 27
    assert explain.check_score_summary(explain.score_summary(long)) < 1e-10
    assert explain.top_contributions(long, 2).count() == 9 * 3 * 2
    assert explain.verify_link(scenarios, model).agg(F.max("error")).first()[0] < 1e-10
    assert scoring.predict_scenarios(scenarios, model).columns[0] == "scenario_id"
    assert sum(r["n"] for r in scoring.predicted_class_counts(scoring.predict(scenarios, model), model.classes).collect()) == 9
    assert explain.equations(model).count("\n") == 3
    with pytest.raises(DataValidationError):
        scoring.AdditiveModel.from_dict({"design": {}})
    with pytest.raises(DataValidationError):
        scoring.predict(scenarios.drop("x1"), model)


def test_binary_normal_form(spark):
    pdf = frame()
    pdf["target"] = np.where(pdf["target"] == "A", "M", "O")
    model, _ = fitted(spark, pdf, ("M", "O"))
    assert not model.coefficients[0].any() and model.intercepts[0] == 0
    out = scoring.predict(spark.createDataFrame(pdf.head(4)), model).toPandas()
    assert (out["score_M"] == 0).all() and np.allclose(out["probability_O"], 1 / (1 + np.exp(-out["score_O"])))


def test_metrics_by_hand(spark):
    rows = [("N", "N"), ("N", "P"), ("N", "N"), ("P", "P"), ("P", "N")]
    df = spark.createDataFrame([(1, o, p, 0.5) for o, p in rows], "fold long, observed string, predicted string, p_true double")
    table = {r["class"]: r for r in metrics.class_metrics(df, ["N", "P"], ["fold"]).collect()}
    assert table["P"]["specificity"] == pytest.approx(2 / 3) and table["N"]["specificity"] == 0.5
    row = metrics.fold_metrics(df, ["N", "P"], ["fold"]).first()
    assert row["macro_specificity"] == pytest.approx(7 / 12) and row["accuracy"] == 0.6 and row["log_loss"] == pytest.approx(np.log(2))


def contract(path, **changes):
    features = {"x1": Feature("smooth"), "x2": Feature("smooth"), "x3": Feature("categorical")}
    base = {
        "models": (Model("main"), Model("pairs", "all_eligible")),
        "validation": Validation(2, 1, 2, 3),
        "search": Search((3,), (2,), (0.1, 1.0), (1.0,)),
        "execution": Execution(2),
    }
    return Contract("t", str(path), "target", features, **(base | changes)).validate()


def test_run_pause_resume_report(spark, tmp_path):
    frame().to_csv(tmp_path / "d.csv", index=False)
    store = runs.create_run(contract(tmp_path / "d.csv"), tmp_path / "w")
    store.request("PAUSE")
    assert runs.execute_run(spark, store, lambda s: None) == "paused"
    assert runs.resume_run(spark, store, lambda s: None) == "completed"
    assert store.status()["state"] == "completed" and runs.follow_status(store, lambda s: None)["state"] == "completed"
    page = (store.root / "reports" / "main" / "report.html").read_text()
    assert "<svg" in page and "Class distribution" in page
    folds_csv = pd.read_csv(store.root / "results" / "main" / "fold_metrics.csv")
    assert len(folds_csv) == 2 and {"log_loss", "best_C", "specificity_A"} <= set(folds_csv)
    from smoothspan.plans import report

    assert (report.inspect_model(spark, store, "main") / "equations.txt").exists()
    assert report.verify_model_link(spark, store, "main") < 1e-10
    joined, _ = runs.compare_runs(spark, store.root / "results/main/fold_metrics.csv", store.root / "results/pairs/fold_metrics.csv", tmp_path / "cmp")
    assert joined.count() == 2 and (tmp_path / "cmp" / "summary.csv").exists()
    # A foreign lock blocks, a changed file is noticed.
    (store.root / "run.lock").write_text('{"pid": 1, "host": "elsewhere"}')
    with pytest.raises(CheckpointError):
        runs.execute_run(spark, store, lambda s: None)
    (store.root / "run.lock").unlink()
    frame(50).to_csv(tmp_path / "d.csv", index=False)
    with pytest.raises(CheckpointError):
        runs.execute_run(spark, store, lambda s: None)
    assert store.status()["state"] == "failed"
    with pytest.raises(CheckpointError):
        store.is_complete(search.FoldTask("main", 1, 1), "other", "hash")
    assert [runs.stop_reason(x) for x in (None, "", "pause", True)] == [None, None, "pause", "stop"]


def test_distributed_backend_agrees(spark):
    pdf = frame(90)
    c = contract("none", models=(Model("main"),), search=Search((3,), (2,), (1.0,), (1.0,)))
    raw = spark.createDataFrame(pdf)
    bound = bind(raw, c).persist()
    features = resolve_categories(raw, c)
    small, _ = search.final_fit(bound, c, features, c.models[0], ["A", "B", "C"], True)
    large, trials = search.final_fit(bound, c, features, c.models[0], ["A", "B", "C"], False)
    assert np.allclose(small.coefficients, large.coefficients, atol=1e-3) and len(trials) == 1


def test_no_convergence_is_an_error():
    fit = solver.Fit(["A"], np.zeros(1), np.zeros((1, 1)), False, 3)
    with pytest.raises(SmoothspanError):
        search._need_converged(fit, True, "here")
    assert search._need_converged(fit, False, "here") is fit


def test_command_line(spark, tmp_path, capsys):
    from smoothspan.cli import main

    assert main(["demo", "--rows", "60", "--output", str(tmp_path / "d.csv")]) == 0
    assert main(["profile", "--data", str(tmp_path / "d.csv"), "--target", "Y", "--output", str(tmp_path / "p")]) == 0
    assert (tmp_path / "p" / "columns.csv").exists()
    assert main(["configure", "--data", str(tmp_path / "d.csv"), "--target", "Y", "--preset", "quick", "--output", str(tmp_path / "c.yaml")]) == 0
    assert main(["plan", "--config", str(tmp_path / "c.yaml")]) == 0
    assert "main_effects: 3 candidates, 36 fits" in capsys.readouterr().out
    assert main(["plan", "--config", str(tmp_path / "absent.yaml")]) == 1
    assert capsys.readouterr().err.startswith("ERROR")
    model, pdf = fitted(spark)
    model.save(tmp_path / "m.json")
    pdf.head(3).to_csv(tmp_path / "s.csv", index=False)
    for command in ("predict", "transform", "contributions"):
        assert main([command, "--model", str(tmp_path / "m.json"), "--input", str(tmp_path / "s.csv"), "--output", str(tmp_path / f"{command}.csv")]) == 0
    for command in ("predict", "transform", "contributions"):
        found = pd.read_csv(tmp_path / f"{command}.csv")  # one file, not a folder of parts
        assert (tmp_path / f"{command}.csv").is_file() and len(found) >= 3


def test_one_csv_file_of_many_parts(spark, tmp_path):
    from smoothspan.sources.sinks import write_csv_file

    df = spark.range(1000).repartition(7).selectExpr("id", "concat('a,\"', id) AS `b,c`")
    for _ in range(2):  # replaces a file and a folder alike
        write_csv_file(df, tmp_path / "out.csv")
    found = pd.read_csv(tmp_path / "out.csv", escapechar="\\")
    assert sorted(found["id"]) == list(range(1000)) and list(found.columns) == ["id", "b,c"]
    write_csv_file(df.limit(0), tmp_path / "none.csv")
    assert len(pd.read_csv(tmp_path / "none.csv")) == 0 and not list(tmp_path.glob(".*"))


def test_demo_rows_depend_on_the_seed_only(spark):
    from smoothspan.sources.tables import demo_table

    def rows(df):
        return sorted(map(tuple, df.collect()))

    one = rows(demo_table(spark, 500, 3))
    assert rows(demo_table(spark, 500, 3).repartition(3)) == one and rows(demo_table(spark, 500, 4)) != one
    pdf = demo_table(spark, 4000, 1).toPandas()
    assert abs(pdf["X1"].mean()) < 0.08 and abs(pdf["X4"].std() - 1) < 0.06 and pdf["X2"].between(-2, 2).all()
    assert set(pdf["X3"]) == {"low", "standard", "high"} and set(pdf["Y"]) == set("ABCD")


def test_row_numbers_behind_an_exchange(spark):
    from smoothspan.sources.tables import with_row_index

    df = spark.range(300).repartition(5).groupBy("id").count()
    numbered = with_row_index(df)
    assert sorted(r["row_index"] for r in numbered.collect()) == list(range(300))
    assert "Python" not in numbered._jdf.queryExecution().executedPlan().toString()
    ordered = with_row_index(spark.range(50).selectExpr("50 - id AS k"), order_by=["k"])
    assert [r["k"] for r in ordered.orderBy("row_index").collect()] == list(range(1, 51))


def test_unknown_categories_are_named(spark):
    from smoothspan.operators.design import Design

    design = Design({"w": Feature("categorical", categories=("a", "b"))}, 3, 2, [], 1.0)
    with pytest.raises(DataValidationError, match=r"3: 'x', 'y'\)"):
        design.check(spark.createDataFrame([("a",), ("y",), ("x",), ("y",), (None,)], "w string"))


def test_inner_folds_are_those_of_the_cluster(spark):
    from smoothspan.operators.folds import assign_folds

    pdf = pd.DataFrame({"y": list("abcab" * 11), "row_id": [f"r{i * 7 % 55}" for i in range(55)]})
    want = {r["row_id"]: r["fold"] - 1 for r in assign_folds(spark.createDataFrame(pdf), "y", "row_id", 4, 1, 99).collect()}
    got = search.inner_folds(pdf["y"].to_numpy(dtype=object), pdf["row_id"].to_numpy(dtype=object), 4, 99)
    assert dict(zip(pdf["row_id"], got.tolist())) == want


def test_backends_agree_on_several_candidates(spark):
    c = contract("none", models=(Model("main"),), search=Search((3, 4), (2,), (0.1, 1.0), (1.0,)))
    raw = spark.createDataFrame(frame(90))
    bound = bind(raw, c).persist()
    features = resolve_categories(raw, c)
    small, few = search.final_fit(bound, c, features, c.models[0], ["A", "B", "C"], True)
    large, many = search.final_fit(bound, c, features, c.models[0], ["A", "B", "C"], False)
    assert len(few) == len(many) == 4
    assert np.allclose([t["mean_log_loss"] for t in few], [t["mean_log_loss"] for t in many], atol=1e-4)
    assert search.first_best(few)["ordinal"] == search.first_best(many)["ordinal"]
    assert np.allclose(small.coefficients, large.coefficients, atol=1e-3)


def test_final_model_needs_the_classes_of_the_target(spark, tmp_path):
    model, _ = fitted(spark)
    with pytest.raises(SmoothspanError, match="classes"):
        runs.save_final_model(spark, runs.RunStore(tmp_path), "main", model, [{"ordinal": 0, "mean_log_loss": 1.0}], 3, 2, ["Q", *model.classes[1:]])
    with pytest.raises(DataValidationError):
        runs.fold_metrics_path(tmp_path, "main")


def test_digest_of_a_folder(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text(f"a\n{k}\n")
    (tmp_path / "_SUCCESS").write_text("")
    by_executors = tables.sha256_file(tmp_path)
    monkeypatch.setattr(tables.SparkSession, "getActiveSession", staticmethod(lambda: None))
    assert tables.sha256_file(tmp_path) == by_executors
    (tmp_path / "part-1.csv").write_text("b\n")
    assert tables.sha256_file(tmp_path) != by_executors


def test_medians_are_exact(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": r.integers(0, 9, 1001).astype(float), "b": r.normal(size=1001), "c": np.nan, "d": 3.0})
    pdf.loc[::3, "a"] = np.nan
    rows = [tuple(None if pd.isna(v) else float(v) for v in row) for row in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6)
    got = profile.exact_medians(df, {c: F.col(c) for c in pdf})
    assert got["c"] is None and got["d"] == 3.0
    assert got["a"] == pdf["a"].median() and got["b"] == pytest.approx(pdf["b"].median(), abs=0)
    assert profile.exact_medians(df.limit(0), {"a": F.col("a")}) == {"a": None}
    assert profile.exact_medians(df.limit(1).select(F.lit(2).alias("x")), {"x": F.col("x")}) == {"x": 2.0}
