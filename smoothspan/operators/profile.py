"""Profiles and role recommendations from counted values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smoothspan.sources.tables import written

CATEGORICAL_MOST = 10
ID_RATIO = 0.98


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def infer_role(kind: T.DataType, rows: int, distinct: int) -> tuple[str, str]:
    """(role, reason) by ordered rules; linear is never recommended."""
    ratio = distinct / max(rows, 1)
    if distinct <= 1:
        return "exclude", "constant or empty"
    if isinstance(kind, T.BooleanType):
        return "categorical", "boolean"
    if not is_numeric(kind):
        return ("exclude", "looks like an identifier") if ratio > ID_RATIO else ("categorical", "not numeric")
    if distinct <= CATEGORICAL_MOST:
        return "categorical", "few distinct numbers"
    if isinstance(kind, T.IntegralType) and ratio > ID_RATIO:
        return "exclude", "looks like an integer identifier"
    return "smooth", "continuous number"


def exact_medians(df: DataFrame, values: dict[str, Column]) -> dict[str, float | None]:
    """The median of each value (the mean of the middle two), None without any.

    Equal values are counted first. The counts are dealt to ranges of (column, value); the sums of the ranges, one for each
    range and column, tell in which of them the middle lies, and only these are added up value by value."""
    names = list(values)
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), v.cast("double").alias("v")) for i, v in enumerate(values.values())])
    counted = df.select(F.explode(pairs).alias("s")).select("s.*").where("v IS NOT NULL").groupBy("k", "v").agg(F.count("*").alias("n"))
    ranges = written(counted.repartitionByRange("k", "v")).withColumn("part", F.spark_partition_id())
    total, sums = dict.fromkeys(range(len(names)), 0), []
    for r in sorted(ranges.groupBy("part", "k").agg(F.sum("n").alias("n")).collect()):
        sums.append((r["part"], r["k"], total[r["k"]], r["n"]))
        total[r["k"]] += r["n"]
    middle = {k: ((n - 1) // 2, n // 2) for k, n in total.items() if n}
    wanted = [(p, k, at, *middle[k]) for p, k, at, n in sums if any(at <= m < at + n for m in middle[k])]
    found: dict[int, list[float]] = {}
    if wanted:
        of = F.broadcast(df.sparkSession.createDataFrame(wanted, "part int, k int, start long, low long, high long"))
        until = Window.partitionBy("part", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        walked = ranges.join(of, ["part", "k"]).withColumn("until", F.col("start") + F.sum("n").over(until))
        hit = lambda m: (F.col(m) < F.col("until")) & (F.col(m) >= F.col("until") - F.col("n"))
        for r in walked.where(hit("low") | hit("high")).select("k", "v").collect():  # two for each column at most
            found.setdefault(r["k"], []).append(r["v"])
    return {name: sum(found[i]) / len(found[i]) if i in found else None for i, name in enumerate(names)}


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, dtype, n_rows, missing, n_unique, minimum, median, maximum, recommended_role), from counted values: equal values
    of a column meet before anything is shuffled."""
    columns = columns or df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if is_numeric(fields[c])]
    medians = exact_medians(df, {c: F.col(f"`{c}`") for c in numeric}) if numeric else {}
    cells = []
    for c in columns:
        value = F.col(f"`{c}`")
        if isinstance(fields[c], T.FractionalType) and not isinstance(fields[c], T.DecimalType):
            value = value + F.lit(0.0)  # so that 0 and -0 are one value
        cells.append(F.struct(F.lit(c).alias("column"), value.cast("string").alias("key"), (value.cast("double") if c in numeric else F.lit(None).cast("double")).alias("x")))
    counted = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").groupBy("column", "key").agg(F.count("*").alias("n"), F.max("x").alias("x"))
    found = counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("key").alias("n_unique"),
        F.min("x").alias("minimum"),
        F.max("x").alias("maximum"),
    )
    known = [
        (c, fields[c].simpleString(), medians.get(c), c in numeric, isinstance(fields[c], T.IntegralType), isinstance(fields[c], T.BooleanType)) for c in columns
    ]
    of = df.sparkSession.createDataFrame(known, "column string, dtype string, median double, numeric boolean, integral boolean, boolean boolean")
    unique = F.col("n_unique")
    ratio = unique / F.greatest(F.col("n_rows"), F.lit(1))
    role = (
        F.when(unique <= 1, "exclude")
        .when(F.col("boolean"), "categorical")
        .when(~F.col("numeric"), F.when(ratio > ID_RATIO, "exclude").otherwise("categorical"))
        .when(unique <= CATEGORICAL_MOST, "categorical")
        .when(F.col("integral") & (ratio > ID_RATIO), "exclude")
        .otherwise("smooth")
    )
    whole = F.broadcast(of).join(found, "column", "left").fillna(0, ["n_rows", "missing", "n_unique"])
    return whole.select("column", "dtype", "n_rows", "missing", "n_unique", "minimum", "median", "maximum", role.alias("recommended_role"))


def top_values(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """(column, value, n, rank) of the most frequent values, null included; ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("s"))
    counted = long.groupBy("s.column", "s.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.col("value").asc_nulls_first())
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicate_rows): rows beyond the first of each set of equal rows, nulls being equal."""
    return df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count("*").alias("n_")).agg(F.coalesce(F.sum(F.col("n_") - 1), F.lit(0)).alias("duplicate_rows"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, n, percent) of the target, null included; percent has two decimals."""
    counted = df.groupBy(F.col(f"`{target}`").cast("string").alias("class")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.withColumn("percent", F.round(F.col("n") / whole * 100, 2))


def profile(df: DataFrame, target: str | None = None) -> dict[str, Any]:
    """The whole profile as a dictionary."""
    stats = [r.asDict() for r in column_statistics(df).collect()]
    fields = {f.name: f.dataType for f in df.schema.fields}
    words = [c for c in df.columns if not is_numeric(fields[c])]
    tops: dict[str, dict] = {}
    if words:
        for r in top_values(df, words).orderBy("column", "rank").collect():
            tops.setdefault(r["column"], {})[r["value"]] = r["n"]
    columns = {}
    for s in stats:
        role, reason = infer_role(fields[s["column"]], s["n_rows"], s["n_unique"])
        if s["column"] == target:
            role, reason = "target", "the target"
        entry = {"dtype": s["dtype"], "missing": s["missing"], "unique": s["n_unique"], "recommended_role": role, "reason": reason}
        if is_numeric(fields[s["column"]]):
            if s["minimum"] is not None:
                entry |= {"minimum": s["minimum"], "median": s["median"], "maximum": s["maximum"]}
        else:
            entry["top_values"] = tops.get(s["column"], {})
        columns[s["column"]] = entry
    counts = {r["class"]: r["n"] for r in class_distribution(df, target).collect()} if target else {}
    return {
        "rows": stats[0]["n_rows"] if stats else 0,
        "columns": len(df.columns),
        "target": target,
        "target_counts": counts,
        "duplicate_rows": duplicate_rows(df).first()[0],
        "column_profiles": columns,
    }
