"""Scans: delimited text and Parquet by suffix, white-space tables, row numbers, digests and the demonstration table."""

from __future__ import annotations

import hashlib
import json
import math
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smoothspan.errors import DataValidationError

DELIMITERS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}


def load_table(spark: SparkSession, path: str | Path, need_rows: bool = False) -> DataFrame:
    """CSV, TSV / TXT (tab) or Parquet / PQ by suffix in any case."""
    suffix = Path(str(path).rstrip("/")).suffix.lower()
    if suffix in DELIMITERS:
        df = spark.read.csv(str(path), header=True, inferSchema=True, sep=DELIMITERS[suffix])
    elif suffix in (".parquet", ".pq"):
        df = spark.read.parquet(str(path))
    else:
        raise DataValidationError(f"unsupported table format {suffix!r}; use csv, tsv, txt, parquet or pq")
    if need_rows and df.isEmpty():
        raise DataValidationError(f"{path} has no rows")
    return df


def load_whitespace_table(spark: SparkSession, path: str | Path, names: list[str]) -> DataFrame:
    """A header-less table of numbers separated by white space; the number of columns must be that of ``names``."""
    lines = spark.read.text(str(path)).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("parts"))
    odd = lines.where(F.size("parts") != len(names)).select(F.size("parts").alias("n")).first()
    if odd is not None:
        raise DataValidationError(f"{path}: expected {len(names)} columns, found a row with {odd['n']}")
    return lines.select(*[F.element_at("parts", i + 1).try_cast("double").alias(c) for i, c in enumerate(names)])


def check_columns(df: DataFrame, wanted: list[str]) -> None:
    """Raises for missing and repeated column names."""
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise DataValidationError(f"missing columns: {', '.join(missing)}")
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        raise DataValidationError(f"repeated columns: {', '.join(repeated)}")


def written(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder: every later pass sees the same rows in the same partitions."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # as in tests; a cluster names a shared folder in spark.checkpoint.dir
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="rows-"))
    return df.checkpoint()


def with_row_index(df: DataFrame, name: str = "row_index", order_by: list[str] | None = None) -> DataFrame:
    """Consecutive numbers from 0, in the order given or else in file order, without a single-task sort.

    Rows per partition are counted and give the offsets. A plan without exchanges (a scan) has the same partitions each time it
    runs; other plans are written to the checkpoint folder first, so that both passes see the same partitions even if executors
    are lost. Numbers are expressions in any case.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = written(df)
    placed = df.withColumn("placed_", F.monotonically_increasing_id())
    part = F.shiftright("placed_", 33).cast("int")
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for k, n in counts:  # one for each partition
        starts.append((k, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "part_ int, start_ long"))
    numbered = placed.join(starts, part == F.col("part_"))
    return numbered.withColumn(name, F.col("start_") + F.col("placed_").bitwiseAND((1 << 33) - 1)).drop("placed_", "part_", "start_")


def sha256_file(path: str | Path) -> str:
    """Digest of a file in blocks; of a directory, of the names and digests of its data files.

    In a session, the files of a directory are read by the executors, and only names and digests come to the driver."""
    path, digest, spark = Path(path), hashlib.sha256(), SparkSession.getActiveSession()
    if not path.is_file() and spark is not None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(path))
        found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256")).collect()
        return stable_hash(sorted((r["name"], r["sha256"]) for r in found))
    if not path.is_file():
        files = sorted(p for p in path.rglob("*") if p.is_file() and not p.name.startswith(("_", ".")))
        return stable_hash(sorted((p.name, sha256_file(p)) for p in files))
    with path.open("rb") as stream:
        while block := stream.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def stable_hash(value: Any) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _uniform(seed: int, stream: int) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of a hash of seed, stream and id: the same on any cluster."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}-{stream}-"), F.col("id").cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _normal(seed: int, stream: int) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(seed, stream))) * F.cos(2 * math.pi * _uniform(seed, stream + 1))


def demo_table(spark: SparkSession, rows: int = 300, seed: int = 42) -> DataFrame:
    """Four predictors and a four-class target drawn from a softmax of nonlinear scores; a seed gives the same rows anywhere."""
    x = spark.range(rows).select(
        "id",
        _normal(seed, 1).alias("X1"),
        (_uniform(seed, 3) * 4 - 2).alias("X2"),
        F.element_at(F.array(*map(F.lit, ("low", "standard", "high"))), F.floor(_uniform(seed, 4) * 3 + 1).cast("int")).alias("X3"),
        _normal(seed, 5).alias("X4"),
        _uniform(seed, 7).alias("draw"),
    )
    level = F.when(F.col("X3") == "high", 0.8).when(F.col("X3") == "low", -0.8).otherwise(0.0)
    scores = [F.sin(2 * F.col("X1")) + level, 0.7 * F.col("X2") * F.col("X2") - 1, F.col("X1") * F.col("X4"), 0.5 * F.col("X4") - level]
    weights = [F.exp(s) for s in scores]
    total = sum(weights[1:], weights[0])
    label, passed = F.lit("D"), F.lit(0.0)
    bounds = []
    for w in weights[:3]:
        passed = passed + w / total
        bounds.append(passed)
    for name, most in zip("CBA", reversed(bounds), strict=True):
        label = F.when(F.col("draw") < most, name).otherwise(label)
    return x.withColumn("Y", label).select("X1", "X2", "X3", "X4", "Y")


# Preparation of one-hot coded class tables.


def check_indicators(df: DataFrame, columns: list[str], exactly_one: bool) -> None:
    """Raises unless the columns are 0 or 1 (and exactly one of them is 1 in each row)."""
    bad = df.where(F.expr(" OR ".join(f"`{c}` IS NULL OR `{c}` NOT IN (0, 1)" for c in columns)))
    if not bad.isEmpty():
        raise DataValidationError(f"columns {', '.join(columns)} must hold 0 or 1")
    if exactly_one:
        total = sum((F.col(f"`{c}`") for c in columns), F.lit(0))
        rows = df.withColumn("total_", total).where("total_ <> 1").limit(10).collect()
        if rows:
            raise DataValidationError(f"exactly one of {', '.join(columns)} must be 1; first offending rows: {[r.asDict() for r in rows]}")


def collapse_one_hot(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Indicator columns to the name of the first largest one; the indicators are dropped."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    return df.withColumn(out, F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))).drop(*columns)


def recode_indicator(df: DataFrame, column: str, out: str, one: str, zero: str, drop: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn(out, F.when(F.col(f"`{column}`") == 1, one).otherwise(zero)).drop(*{column, *drop})


#: The columns of the published steel-plates fault table, as they are in its description.
STEEL_NUMERIC = (
    "X_Minimum X_Maximum Y_Minimum Y_Maximum Pixels_Areas X_Perimeter Y_Perimeter Sum_of_Luminosity Minimum_of_Luminosity "
    "Maximum_of_Luminosity Length_of_Conveyer TypeOfSteel_A300 TypeOfSteel_A400 Steel_Plate_Thickness Edges_Index Empty_Index "
    "Square_Index Outside_X_Index Edges_X_Index Edges_Y_Index Outside_Global_Index LogOfAreas Log_X_Index Log_Y_Index "
    "Orientation_Index Luminosity_Index SigmoidOfAreas"
).split()
STEEL_FAULTS = "Pastry Z_Scratch K_Scatch Stains Dirtiness Bumps Other_Faults".split()


def prepare_steel_plates(spark: SparkSession, path: str | Path) -> DataFrame:
    """25 numeric columns, Steel_Type and the fault Y of the raw white-space table."""
    raw = load_whitespace_table(spark, path, STEEL_NUMERIC + STEEL_FAULTS)
    check_indicators(raw, STEEL_FAULTS, exactly_one=True)
    check_indicators(raw, ["TypeOfSteel_A300", "TypeOfSteel_A400"], exactly_one=True)
    typed = recode_indicator(raw, "TypeOfSteel_A300", "Steel_Type", "A300", "A400", drop=("TypeOfSteel_A400",))
    return collapse_one_hot(typed, STEEL_FAULTS, "Y")
