"""Components, equations, contrasts, contributions and the checks of link and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smoothspan.errors import DataValidationError
from smoothspan.operators.scoring import AdditiveModel, scored, with_scenario_id
from smoothspan.sources.tables import with_row_index

TOLERANCE = 1e-10


def component_type(name: Column) -> Column:
    return (
        F.when(name == "intercept", "intercept")
        .when(name.startswith("main_spline__"), "smooth")
        .when(name.startswith("main_linear__"), "linear")
        .when(name.startswith("main_categorical__"), "categorical")
        .when(name.startswith("interaction__"), "interaction")
        .otherwise("other")
    )


def component_group(name: Column) -> Column:
    """Without prefix and basis number; a categorical component keeps its level."""
    return F.substring_index(F.regexp_replace(name, "^(main_spline|main_linear|main_categorical|interaction)__", ""), "__basis_", 1)


def components(spark: SparkSession, model: AdditiveModel) -> DataFrame:
    """(class, class_index, position, component, coefficient), the intercept at position 0."""
    table = model.parameters()
    rows = [(c, k, j, n, float(table[k, j])) for k, c in enumerate(model.classes) for j, n in enumerate(model.components)]
    return spark.createDataFrame(rows, "class string, class_index int, position int, component string, coefficient double")


def equations(model: AdditiveModel) -> str:
    """One line for each class; terms with coefficient zero are left out."""
    lines, table = [], model.parameters()
    for k, name in enumerate(model.classes):
        text = f"eta_{name}(x) = {table[k, 0]:.12g}"
        for j, component in enumerate(model.design.names, 1):
            value = table[k, j]
            if value != 0:
                text += f" {'-' if value < 0 else '+'} {abs(value):.12g} * {component}"
        lines.append(text)
    return "\n".join(lines) + "\n"


def contrasts(table: DataFrame, reference: str) -> DataFrame:
    """(comparison, component, coefficient): every other class minus the reference class, of a component table."""
    base = table.where(F.col("class") == reference).select("component", F.col("coefficient").alias("base_"))
    other = table.where(F.col("class") != reference)
    return other.join(base, "component").select(
        F.concat("class", F.lit(f"_versus_{reference}")).alias("comparison"), "component", (F.col("coefficient") - F.col("base_")).alias("coefficient")
    )


def contributions(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """The long table: for each row and class the intercept (value 1), then each component times its coefficient."""
    numbered = with_row_index(with_scenario_id(df), "observation_index")
    full = scored(numbered, model)
    table = model.parameters()
    spine = F.array(
        *[
            F.struct(F.lit(c).alias("class"), F.lit(k).alias("k"), F.array(*[F.lit(float(v)) for v in table[k]]).alias("weights"))
            for k, c in enumerate(model.classes)
        ]
    )
    names = F.array(*[F.lit(n) for n in model.components])
    classes = F.array(*[F.lit(c) for c in model.classes])
    each = full.select(
        "scenario_id",
        "observation_index",
        F.get(classes, F.get("rank_", 0)).alias("predicted_class"),
        F.concat(F.array(F.lit(1.0)), "design_").alias("values"),
        "scores_",
        "probabilities_",
        F.explode(spine).alias("c"),
    )
    zipped = F.arrays_zip(names.alias("component"), F.col("values").alias("value"), F.col("c.weights").alias("weight"))
    long = each.select(
        "scenario_id",
        "observation_index",
        F.col("c.class").alias("class"),
        "predicted_class",
        F.get("probabilities_", F.col("c.k")).alias("class_probability"),
        F.get("scores_", F.col("c.k")).alias("class_score"),
        F.posexplode(zipped).alias("position", "t"),
    )
    value = F.col("t.value") * F.col("t.weight")
    return long.select(
        "scenario_id",
        "observation_index",
        "class",
        "predicted_class",
        "class_probability",
        "class_score",
        F.col("t.component").alias("component"),
        component_type(F.col("t.component")).alias("component_type"),
        component_group(F.col("t.component")).alias("component_group"),
        F.col("t.value").alias("transformed_value"),
        F.col("t.weight").alias("coefficient"),
        value.alias("contribution"),
        F.abs(value).alias("absolute_contribution"),
    )


def score_summary(long: DataFrame) -> DataFrame:
    """Scores put together from contributions against the expected ones, by observation and class."""
    keys = ["scenario_id", "observation_index", "class", "predicted_class", "class_probability", F.col("class_score").alias("expected_score")]
    summed = long.groupBy(*keys).agg(F.sum("contribution").alias("reconstructed_score"))
    return summed.withColumn("absolute_score_error", F.abs(F.col("reconstructed_score") - F.col("expected_score")))


def check_score_summary(summary: DataFrame, tolerance: float = TOLERANCE) -> float:
    worst = summary.agg(F.max("absolute_score_error")).first()[0] or 0.0
    if worst > tolerance:
        raise DataValidationError(f"contributions differ from scores by {worst}")
    return worst


def top_contributions(long: DataFrame, n: int) -> DataFrame:
    """The n largest contributions of each observation and class by absolute value; ties by component."""
    order = Window.partitionBy("observation_index", "class").orderBy(F.desc("absolute_contribution"), "component")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def verify_link(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """(row_index, class, score, probability, reconstructed, error): the softmax against a second, unshifted form."""
    full = scored(with_row_index(df), model)
    raised = F.transform("scores_", F.exp)
    again = F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))
    names = F.array(*[F.lit(c) for c in model.classes])
    zipped = F.arrays_zip(names.alias("class"), F.col("scores_").alias("score"), F.col("probabilities_").alias("probability"), again.alias("reconstructed"))
    long = full.select("row_index", F.explode(zipped).alias("t")).select("row_index", "t.*")
    return long.withColumn("error", F.abs(F.col("probability") - F.col("reconstructed")))


def verification_text(model: AdditiveModel, worst: float) -> str:
    kind = "binary" if len(model.classes) == 2 else "multinomial"
    return f"type: {kind}\nclass_count: {len(model.classes)}\nclasses: {', '.join(model.classes)}\nmaximum_absolute_error: {worst:.17g}\n"
