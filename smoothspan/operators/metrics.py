"""Classification metrics as aggregates over prediction tables.

A prediction table has ``observed``, ``predicted``, ``p_true`` (probability of the observed class) and grouping columns such as
model_id, repeat and fold. Class tables come from a spine of groups and classes, so classes without rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least probability in the log loss (double precision).
CLIP = 2.220446049250313e-16
METRICS = ("log_loss", "accuracy", "balanced_accuracy", "macro_f1", "macro_specificity", "weighted_specificity")
CLASS_METRICS = ("sensitivity", "specificity", "precision", "f1")


def ratio(n: Column, d: Column) -> Column:
    """n / d as a double, 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


def class_metrics(predictions: DataFrame, classes: list[str], by: list[str]) -> DataFrame:
    """One-vs-rest counts and rates: (by..., class, true_negative, false_positive, false_negative, true_positive, ...)."""
    spark = predictions.sparkSession
    counts = predictions.groupBy(*by, "observed", "predicted").agg(F.count("*").alias("n"))
    spine = F.broadcast(spark.createDataFrame([(c,) for c in classes], "class string"))
    o, p, c, n = F.col("observed"), F.col("predicted"), F.col("class"), F.col("n")
    zero = F.lit(0).cast("long")

    def total(rule: Column) -> Column:
        return F.sum(F.when(rule, n).otherwise(zero))

    table = counts.crossJoin(spine).groupBy(*by, "class").agg(
        total((o != c) & (p != c)).alias("true_negative"),
        total((o != c) & (p == c)).alias("false_positive"),
        total((o == c) & (p != c)).alias("false_negative"),
        total((o == c) & (p == c)).alias("true_positive"),
    )
    tn, fp, fn, tp = (F.col(x) for x in ("true_negative", "false_positive", "false_negative", "true_positive"))
    return (
        table.withColumn("sensitivity", ratio(tp, tp + fn))
        .withColumn("specificity", ratio(tn, tn + fp))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("support", tp + fn)
    )


def fold_metrics(predictions: DataFrame, classes: list[str], by: list[str]) -> DataFrame:
    """(by..., the six metrics). Balanced accuracy averages over observed classes, macro F1 over observed or predicted ones."""
    basic = predictions.groupBy(*by).agg(
        F.avg(-F.ln(F.greatest(F.col("p_true"), F.lit(CLIP)))).alias("log_loss"),
        F.avg((F.col("predicted") == F.col("observed")).cast("int")).alias("accuracy"),
    )
    seen = F.col("support") > 0
    either = seen | (F.col("false_positive") > 0)
    rates = class_metrics(predictions, classes, by).groupBy(*by).agg(
        F.avg(F.when(seen, F.col("sensitivity"))).alias("balanced_accuracy"),
        F.avg(F.when(either, F.col("f1"))).alias("macro_f1"),
        F.avg("specificity").alias("macro_specificity"),
        ratio(F.sum(F.col("support") * F.col("specificity")), F.sum("support")).alias("weighted_specificity"),
    )
    return basic.join(rates, by) if by else basic.crossJoin(rates)


def specificity_columns(table: DataFrame, classes: list[str], by: list[str]) -> DataFrame:
    """specificity_<class> columns of a class table."""
    return table.groupBy(*by).agg(*[F.max(F.when(F.col("class") == c, F.col("specificity"))).alias(f"specificity_{c}") for c in classes])


def _spread(prefix: str = "") -> list[Column]:
    v = F.col("value")
    return [
        F.avg(v).alias(f"{prefix}mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{prefix}std"),
        F.median(v).alias(f"{prefix}median"),
        F.min(v).alias(f"{prefix}min"),
        F.max(v).alias(f"{prefix}max"),
    ]


def metric_summary(folds: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(by..., metric, mean, std, median, min, max) over folds."""
    long = folds.unpivot(by or [F.lit(1).alias("one_")], list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(*_spread())


def class_summary(table: DataFrame, by: list[str]) -> DataFrame:
    """(by..., class, <metric>_<statistic>..., mean_fold_support, total_oof_support) over folds."""
    out = []
    for m in CLASS_METRICS:
        v = F.col(m)
        out += [F.avg(v).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{m}_std"), F.median(v).alias(f"{m}_median"), F.min(v).alias(f"{m}_min"), F.max(v).alias(f"{m}_max")]
    return table.groupBy(*by, "class").agg(*out, F.avg("support").alias("mean_fold_support"), F.sum("support").alias("total_oof_support"))


def confusion(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """(observed, predicted, n, share) for all pairs of classes; share is within the observed class, 0 if it is empty."""
    spark = predictions.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], "c string")
    spine = names.select(F.col("c").alias("observed")).crossJoin(names.select(F.col("c").alias("predicted")))
    counts = predictions.groupBy("observed", "predicted").agg(F.count("*").alias("n"))
    sizes = predictions.groupBy("observed").agg(F.count("*").alias("size"))
    full = F.broadcast(spine).join(counts, ["observed", "predicted"], "left").join(sizes, "observed", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return full.select("observed", "predicted", n.alias("n"), ratio(n, F.coalesce("size", F.lit(0).cast("long"))).alias("share"))


def oof_counters(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count_distinct("row_id").alias("unique_rows"), F.count_distinct("repeat").alias("repeats"), F.count("*").alias("prediction_rows"))


def compare(left: DataFrame, right: DataFrame, metrics: tuple[str, ...] = METRICS[:4]) -> DataFrame:
    """Fold metrics of two runs joined one to one on (repeat, fold), with right minus left for each metric."""
    from smoothspan.errors import DataValidationError

    keys = ["repeat", "fold"]
    for side in (left, right):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise DataValidationError("fold metrics must have one row for each repeat and fold")
    sides = []
    for df, suffix in ((left, "_left"), (right, "_right")):
        sides.append(df.select(*keys, *[F.col(f"`{c}`").alias(c + suffix) for c in df.columns if c not in keys]))
    joined = sides[0].join(sides[1], keys)
    return joined.select("*", *[(F.col(f"{m}_right") - F.col(f"{m}_left")).alias(f"{m}_difference") for m in metrics])


def compare_summary(compared: DataFrame, metrics: tuple[str, ...] = METRICS[:4]) -> DataFrame:
    long = compared.unpivot(["repeat", "fold"], [f"{m}_difference" for m in metrics], "metric", "value")
    v = F.col("value")
    return long.groupBy("metric").agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.median(v).alias("median"))


def best_candidate(trials: DataFrame, by: list[str]) -> DataFrame:
    """The first candidate in grid order with the smallest mean loss."""
    row = F.struct(*[c for c in trials.columns if c not in by])
    return trials.groupBy(*by).agg(F.min_by(row, F.struct("mean_log_loss", "ordinal")).alias("best_")).select(*by, "best_.*")
