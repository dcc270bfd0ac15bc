"""Deterministic stratified folds as window expressions, manifests and their checks.

Rows are ordered by class and by a hash of seed, repeat and id, and dealt round-robin. The rank is taken within each class and
shifted by the number of rows of smaller classes, so that no task sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smoothspan.errors import DataValidationError


def shuffle_key(seed: int, repeat: Column, row_id: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), repeat.cast("string"), F.lit("-"), F.col(row_id).cast("string")))


def assign_folds(df: DataFrame, target: str, row_id: str, splits: int, repeats: int = 1, seed: int = 42) -> DataFrame:
    """``df`` once for each repeat, with ``repeat`` and ``fold`` from 1: the fold in which the row is tested."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(repeats).cast("long"))))
    order = [shuffle_key(seed, F.col("repeat"), row_id), F.col(row_id).cast("string")]
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy("repeat", target).orderBy(*order)))
    sizes = df.groupBy(F.col(target).alias("class_")).agg(F.count("*").alias("n_"))
    before = Window.orderBy("class_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each class
    sizes = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    dealt = ranked.join(F.broadcast(sizes), F.col(target).eqNullSafe(F.col("class_")))
    return dealt.withColumn("fold", ((F.col("rank_") + F.col("before_") - 1) % splits + 1).cast("long")).drop("rank_", "before_", "class_")


def check_class_counts(counts: dict[str, int], outer: int, inner: int) -> None:
    """Raises unless each class can be in every outer fold and, after that, in every inner fold."""
    if len(counts) < 2:
        raise DataValidationError("the target needs at least two classes")
    least = min(counts.values())
    if least < outer:
        raise DataValidationError(f"the smallest class has {least} rows, fewer than outer_splits={outer}")
    left = least - -(-least // outer)
    if left < inner:
        raise DataValidationError(f"an outer training part may hold {left} rows of the smallest class, fewer than inner_splits={inner}")


def split_manifest(assigned: DataFrame, row_id: str, splits: int) -> DataFrame:
    """The long form (repeat, fold, row_id, row_index, partition) of test assignments with row_index."""
    folds = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(splits).cast("long"))).alias("of")
    long = assigned.select("repeat", folds, F.col(row_id).cast("string").alias("row_id"), "row_index", F.col("fold").alias("tested"))
    return long.select("repeat", F.col("of").alias("fold"), "row_id", "row_index", F.when(F.col("of") == F.col("tested"), "test").otherwise("train").alias("partition"))


def manifest_violations(manifest: DataFrame, rows: DataFrame, splits: int, repeats: int) -> DataFrame:
    """(violation, n) for every rule of a manifest that is broken; ``rows`` holds the row_index values of the data."""
    spark = manifest.sparkSession
    tasks = spark.range(1, repeats + 1).select(F.col("id").alias("repeat")).crossJoin(spark.range(1, splits + 1).select(F.col("id").alias("fold")))
    parts = manifest.groupBy("repeat", "fold").agg(
        F.count_if(F.col("partition") == "train").alias("train"), F.count_if(F.col("partition") == "test").alias("test")
    )
    each = manifest.groupBy("repeat", "fold", "row_index").agg(
        F.count_if(F.col("partition") == "train").alias("train"), F.count_if(F.col("partition") == "test").alias("test")
    )
    tested = manifest.where("partition = 'test'").groupBy("repeat", "row_index").agg(F.count("*").alias("n"))
    wanted = tasks.join(rows.select("row_index"))
    checks = {
        "unknown partition": manifest.where("partition IS NULL OR partition NOT IN ('train', 'test')"),
        "null row index": manifest.where("row_index IS NULL"),
        "repeat out of range": manifest.where(~F.col("repeat").between(1, repeats)),
        "fold out of range": manifest.where(~F.col("fold").between(1, splits)),
        "missing task": tasks.join(manifest.select("repeat", "fold").distinct(), ["repeat", "fold"], "left_anti"),
        "empty train part": parts.where("train = 0"),
        "empty test part": parts.where("test = 0"),
        "row twice in train part": each.where("train > 1"),
        "row twice in test part": each.where("test > 1"),
        "row in train and test part": each.where("train > 0 AND test > 0"),
        "missing row": wanted.join(manifest, ["repeat", "fold", "row_index"], "left_anti"),
        "unexpected row": manifest.join(rows.select("row_index"), "row_index", "left_anti"),
        "row not tested once": tested.where("n <> 1"),
    }
    out = None
    for name, found in checks.items():
        part = found.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


def check_manifest(manifest: DataFrame, rows: DataFrame, splits: int, repeats: int) -> None:
    wanted = {"repeat", "fold", "row_id", "row_index", "partition"}
    if not wanted <= set(manifest.columns):
        raise DataValidationError(f"the split manifest lacks {sorted(wanted - set(manifest.columns))}")
    if manifest.isEmpty() or rows.isEmpty():
        raise DataValidationError("the split manifest or the data is empty")
    found = manifest_violations(manifest, rows, splits, repeats).collect()
    if found:
        raise DataValidationError("split manifest: " + "; ".join(f"{r['violation']}: {r['n']}" for r in found))


def task_seed(random_state: int, repeat: int, fold: int, splits: int) -> int:
    return random_state + (repeat - 1) * splits + fold
