"""Sinks: tables, atomic JSON and YAML, the event log and checkpoint directories."""

from __future__ import annotations

import csv
import datetime as dt
import json
import io
import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame


def utc_now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


def write_csv(df: DataFrame, path: str | Path, single: bool = False) -> None:
    """CSV with header. ``single`` is for results known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(str(path), header=True)


def write_csv_file(df: DataFrame, path: str | Path) -> None:
    """One CSV file with header, put together from parts that are written in parallel; the parts are streamed, never held."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    parts = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        write_csv(df, parts / "rows")
        whole = parts / "whole"
        with whole.open("wb") as out:
            csv.writer(head := io.StringIO(), lineterminator="\n").writerow(df.columns)
            out.write(head.getvalue().encode())
            for part in sorted((parts / "rows").glob("part-*.csv")):
                with part.open("rb") as stream:
                    stream.readline()  # each part has the header
                    shutil.copyfileobj(stream, out)
        if path.is_dir():
            shutil.rmtree(path)
        os.replace(whole, path)
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def write_small_csv(df: DataFrame, path: str | Path) -> None:
    """One file of a result known to be small, doubles in a form that reads back exactly."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(path, index=False, float_format="%.17g", encoding="utf-8")


def write_parquet(df: DataFrame, path: str | Path, by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(str(path))


def _write_atomic(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with part.open("w", encoding="utf-8") as stream:
        stream.write(text)
        stream.flush()
        os.fsync(stream.fileno())
    os.replace(part, path)


def write_json_atomic(path: str | Path, value: Any) -> None:
    _write_atomic(path, json.dumps(value, indent=2, default=str, ensure_ascii=False) + "\n")


def write_yaml_atomic(path: str | Path, value: Any) -> None:
    _write_atomic(path, yaml.safe_dump(value, sort_keys=False, allow_unicode=True))


def append_jsonl(path: str | Path, value: dict[str, Any]) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as stream:
        stream.write(json.dumps({"time": utc_now(), **value}, default=str, ensure_ascii=False) + "\n")
        stream.flush()


def write_directory_atomic(path: str | Path, fill: Callable[[Path], None]) -> None:
    """``fill`` writes into a directory beside ``path``, which is renamed once it is marked COMPLETE; on failure nothing stays."""
    path = Path(path)
    part = path.with_name(path.name + ".tmp")
    shutil.rmtree(part, ignore_errors=True)
    part.mkdir(parents=True)
    try:
        fill(part)
        (part / "COMPLETE").touch()
        shutil.rmtree(path, ignore_errors=True)
        os.replace(part, path)
    except BaseException:
        shutil.rmtree(part, ignore_errors=True)
        raise


def format_duration(seconds: float) -> str:
    """HH:MM:SS of rounded seconds, never negative."""
    whole = max(0, round(seconds))
    return f"{whole // 3600:02d}:{whole % 3600 // 60:02d}:{whole % 60:02d}"
