"""The design matrix: a specification with learned statistics that compiles to column expressions or to a numpy matrix."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from math import comb, factorial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smoothspan.contract import Contract, Feature
from smoothspan.errors import ConfigurationError, DataValidationError
from smoothspan.functions.arrays import not_finite, number, spline_basis, tensor
from smoothspan.operators.profile import exact_medians


@dataclass
class Design:
    """Blocks in the order smooth, linear, categorical, interaction. ``stats`` is empty until :meth:`fit`."""

    features: dict[str, Feature]
    n_knots: int = 4
    degree: int = 3
    pairs: list[tuple[str, str]] = field(default_factory=list)
    interaction_scale: float = 1.0
    stats: dict[str, dict[str, Any]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        smooth = set(self.of("smooth"))
        for a, b in self.pairs:
            if a == b or not {a, b} <= smooth:
                raise ConfigurationError(f"interaction ({a}, {b}) needs two distinct smooth features")
        for name in self.of("categorical"):
            if not self.features[name].categories:
                raise ConfigurationError(f"categorical feature {name} has no declared categories")

    def of(self, role: str) -> list[str]:
        return [k for k, f in self.features.items() if f.role == role]

    @property
    def predictors(self) -> list[str]:
        return [*self.of("smooth"), *self.of("linear"), *self.of("categorical")]

    @property
    def names(self) -> list[str]:
        width = self.n_knots + self.degree - 2
        out = [f"main_spline__{f}__basis_{i}" for f in self.of("smooth") for i in range(width)]
        out += [f"main_linear__{f}" for f in self.of("linear")]
        out += [f"main_categorical__{f}_{level}" for f in self.of("categorical") for level in self.features[f].categories[1:]]
        return out + [f"interaction__{a}:{b}__basis_{i}:{j}" for a, b in self.pairs for i in range(width) for j in range(width)]

    def check(self, df: DataFrame) -> None:
        """Raises for missing values under the rule ``error`` and for undeclared categories; one aggregation."""
        absent = [c for c in self.predictors if c not in df.columns]
        if absent:
            raise DataValidationError(f"missing predictor columns: {', '.join(absent)}")
        sums, labels = [], []
        for name in self.predictors:
            f = self.features[name]
            value = self._raw(name)
            if f.missing == "error":
                sums.append(F.count_if(value.isNull()))
                labels.append(f"{name}: missing or unreadable values under the rule error")
            if f.role == "categorical":
                sums.append(F.count_if(value.isNotNull() & ~value.isin(list(f.categories))))
                labels.append(f"{name}: values outside the configured category vocabulary")
            else:
                sums.append(F.count_if(not_finite(value)))
                labels.append(f"{name}: infinite values")
        counts = df.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
        bad = []
        for label, n in zip(labels, counts, strict=True):
            if n:
                name = label.split(": values outside", 1)[0] if ": values outside" in label else None
                bad.append(f"{label} ({n}{f': {self._unknown(df, name)}' if name else ''})")
        if bad:
            raise DataValidationError("; ".join(bad))

    def _unknown(self, df: DataFrame, name: str, most: int = 10) -> str:
        """The first undeclared categories by name; looked for only when some were counted."""
        value = self._raw(name)
        odd = df.where(value.isNotNull() & ~value.isin(list(self.features[name].categories))).select(value.alias("v")).distinct()
        found = [repr(r["v"]) for r in odd.orderBy("v").limit(most + 1).collect()]
        return ", ".join(found[:most]) + (", ..." if len(found) > most else "")

    def _raw(self, name: str) -> Column:
        return F.col(f"`{name}`").cast("string") if self.features[name].role == "categorical" else number(name)

    def _filled(self, name: str) -> Column:
        fill = self.stats.get(name, {}).get("fill")
        return self._raw(name) if fill is None else F.coalesce(self._raw(name), F.lit(fill))

    def fit(self, df: DataFrame) -> Design:
        """Learn fills, then ranges, means and deviations of the filled columns."""
        self.check(df)
        self.stats = {name: {"fill": None} for name in self.predictors}
        medians = [n for n in self.predictors if self.features[n].missing == "median"]
        modes = [n for n in self.predictors if self.features[n].missing == "most_frequent"]
        fills = exact_medians(df, {n: self._raw(n) for n in medians}) if medians else {}
        if modes:  # of declared categories, which are few
            fills |= df.agg(*[F.mode(self._raw(n), True).alias(n) for n in modes]).first().asDict()
        for n, fill in fills.items():
            if fill is None:
                raise DataValidationError(f"{n}: no value to learn a fill from")
            self.stats[n]["fill"] = fill
        aggregates = [F.count(F.lit(1)).alias("rows_")]
        for i, n in enumerate(self.of("smooth")):
            aggregates += [F.min(self._filled(n)).alias(f"lo{i}"), F.max(self._filled(n)).alias(f"hi{i}")]
        for i, n in enumerate(self.of("linear")):
            aggregates += [F.avg(self._filled(n)).alias(f"mean{i}"), F.stddev_pop(self._filled(n)).alias(f"std{i}")]
        row = df.agg(*aggregates).first()
        if not row["rows_"]:
            raise DataValidationError("a design cannot be fitted without rows")
        for i, n in enumerate(self.of("smooth")):
            self._range(n, row[f"lo{i}"], row[f"hi{i}"])
        for i, n in enumerate(self.of("linear")):
            self.stats[n] |= {"mean": row[f"mean{i}"], "std": row[f"std{i}"] or 1.0}
        return self

    def _range(self, name: str, lo: float, hi: float) -> None:
        if not hi > lo:
            raise DataValidationError(f"{name}: a spline needs at least two distinct training values")
        self.stats[name] |= {"lo": float(lo), "hi": float(hi)}

    def columns(self) -> list[Column]:
        """One expression for each component, in the order of ``names``."""
        blocks = {n: spline_basis(self._filled(n), self.stats[n]["lo"], self.stats[n]["hi"], self.n_knots, self.degree) for n in self.of("smooth")}
        out = [c for n in self.of("smooth") for c in blocks[n]]
        out += [(self._filled(n) - F.lit(self.stats[n]["mean"])) / F.lit(self.stats[n]["std"]) for n in self.of("linear")]
        for n in self.of("categorical"):
            out += [F.when(self._filled(n) == level, 1.0).otherwise(0.0) for level in self.features[n].categories[1:]]
        for a, b in self.pairs:
            out += tensor(blocks[a], blocks[b], self.interaction_scale)
        return out

    def vector(self) -> Column:
        return F.array(*self.columns())

    # The same in numpy, for groups that are fitted inside one Python task.

    def fit_numpy(self, x: pd.DataFrame) -> Design:
        self.stats = {name: {"fill": None} for name in self.predictors}
        for n in self.predictors:
            values = self._values(x, n)
            rule = self.features[n].missing
            if rule == "median":
                self.stats[n]["fill"] = float(np.nanmedian(values))
            elif rule == "most_frequent":
                found = pd.Series(values).dropna().value_counts()
                self.stats[n]["fill"] = min(found[found == found.max()].index)
        for n in self.of("smooth"):
            values = self._values(x, n)
            self._range(n, values.min(), values.max())
        for n in self.of("linear"):
            values = self._values(x, n)
            self.stats[n] |= {"mean": float(values.mean()), "std": float(values.std()) or 1.0}
        return self

    def _values(self, x: pd.DataFrame, name: str) -> np.ndarray:
        fill = self.stats[name]["fill"]
        if self.features[name].role == "categorical":
            values = x[name].to_numpy(dtype=object)
            return np.array([fill if v is None or v != v else v for v in values], dtype=object) if fill is not None else values
        values = x[name].to_numpy(dtype=np.float64)
        return np.where(np.isnan(values), fill, values) if fill is not None else values

    def matrix(self, x: pd.DataFrame) -> np.ndarray:
        blocks = {n: basis_numpy(self._values(x, n), self.stats[n]["lo"], self.stats[n]["hi"], self.n_knots, self.degree) for n in self.of("smooth")}
        out = [blocks[n] for n in self.of("smooth")]
        out += [((self._values(x, n) - self.stats[n]["mean"]) / self.stats[n]["std"])[:, None] for n in self.of("linear")]
        for n in self.of("categorical"):
            values = self._values(x, n)
            out += [(values == level).astype(np.float64)[:, None] for level in self.features[n].categories[1:]]
        for a, b in self.pairs:
            product = blocks[a][:, :, None] * blocks[b][:, None, :]
            out.append(product.reshape(len(x), -1) * self.interaction_scale)
        return np.hstack(out) if out else np.zeros((len(x), 0))

    def to_dict(self) -> dict[str, Any]:
        return {
            "features": {k: asdict(f) for k, f in self.features.items()},
            "n_knots": self.n_knots,
            "degree": self.degree,
            "pairs": [list(p) for p in self.pairs],
            "interaction_scale": self.interaction_scale,
            "stats": self.stats,
        }

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Design:
        features = {k: Feature(f["role"], f["missing"], tuple(f["categories"]), f["reference"]) for k, f in data["features"].items()}
        return cls(features, data["n_knots"], data["degree"], [tuple(p) for p in data["pairs"]], data["interaction_scale"], data["stats"])


def basis_numpy(x: np.ndarray, lo: float, hi: float, n_knots: int, degree: int) -> np.ndarray:
    at = (np.clip(x, lo, hi) - lo) / ((hi - lo) / (n_knots - 1))
    out = np.zeros((len(x), n_knots + degree - 2))
    for j in range(out.shape[1]):
        for k in range(degree + 2):
            out[:, j] += (-1.0) ** k * comb(degree + 1, k) / factorial(degree) * np.maximum(at + degree - j - k, 0.0) ** degree
    return out


def resolve_categories(df: DataFrame, contract: Contract) -> dict[str, Feature]:
    """The active features; categories that are not declared are taken from the data, sorted."""
    missing = [n for n in contract.active("categorical") if not contract.features[n].categories]
    found: dict[str, tuple[str, ...]] = {}
    if missing:
        row = df.agg(*[F.array_sort(F.collect_set(F.col(f"`{n}`").cast("string"))).alias(n) for n in missing]).first()
        found = {n: tuple(row[n]) for n in missing}
    return {n: Feature(f.role, f.missing, found.get(n, f.categories), f.reference) for n, f in contract.features.items() if f.role != "exclude"}


def bind(df: DataFrame, contract: Contract) -> DataFrame:
    """(row_index, row_id, y, predictors): pruned and typed; raises for null targets, repeated ids and missing columns."""
    from smoothspan.sources.tables import check_columns, with_row_index

    wanted = [contract.target, *contract.active(), *([contract.row_id] if contract.row_id else [])]
    check_columns(df, wanted)
    columns = []
    for n in contract.active():
        raw = F.col(f"`{n}`").cast("string") if contract.features[n].role == "categorical" else number(n)
        columns.append(raw.alias(n))
    row_id = F.col(f"`{contract.row_id}`").cast("string").alias("row_id") if contract.row_id else F.lit(None).cast("string").alias("row_id")
    bound = df.select(row_id, F.col(f"`{contract.target}`").cast("string").alias("y"), *columns)
    if not bound.where("y IS NULL").isEmpty():
        raise DataValidationError(f"the target {contract.target} has missing values")
    if contract.row_id:
        repeated = bound.groupBy("row_id").count().where("count > 1 OR row_id IS NULL")
        if not repeated.isEmpty():
            raise DataValidationError(f"row ids in {contract.row_id} must be unique and not missing")
    numbered = with_row_index(bound)
    return numbered if contract.row_id else numbered.withColumn("row_id", (F.col("row_index") + 1).cast("string"))
