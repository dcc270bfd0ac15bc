"""The experiment contract: typed settings, their YAML form and their rules."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from itertools import combinations
from pathlib import Path
from typing import Any

import yaml

from smoothspan.errors import ConfigurationError

SCHEMA_VERSION = "1.0"
ROLES = ("smooth", "linear", "categorical", "exclude")
INTERACTIONS = ("none", "all_eligible", "explicit")
#: The missing-value rules that a fit accepts for each role.
MISSING = {"smooth": ("error", "median"), "linear": ("error", "median"), "categorical": ("error", "most_frequent")}
MODEL_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


@dataclass(frozen=True)
class Feature:
    role: str
    missing: str = "error"
    categories: tuple[str, ...] = ()
    reference: str | None = None


@dataclass(frozen=True)
class Model:
    id: str
    interactions: str = "none"
    pairs: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Validation:
    outer_splits: int = 5
    outer_repeats: int = 3
    inner_splits: int = 5
    random_state: int = 42


@dataclass(frozen=True)
class Search:
    n_knots: tuple[int, ...] = (3, 4, 5)
    degree: tuple[int, ...] = (2, 3)
    C: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    interaction_scale: tuple[float, ...] = (0.5, 1.0)


@dataclass(frozen=True)
class Execution:
    workers: int = 1
    checkpoint_unit: str = "outer_fold"
    stop_on_convergence_warning: bool = True


@dataclass(frozen=True)
class Contract:
    name: str
    data_path: str
    target: str
    features: dict[str, Feature]
    models: tuple[Model, ...]
    row_id: str | None = None
    validation: Validation = field(default_factory=Validation)
    search: Search = field(default_factory=Search)
    execution: Execution = field(default_factory=Execution)
    primary_metric: str = "log_loss"
    schema_version: str = SCHEMA_VERSION

    def active(self, role: str | None = None) -> list[str]:
        """Features in contract order, without excluded ones."""
        return [k for k, f in self.features.items() if f.role != "exclude" and role in (None, f.role)]

    def pairs(self, model: Model) -> list[tuple[str, str]]:
        """The interaction pairs of a model; ``all_eligible`` takes every pair of smooth features."""
        if model.interactions == "all_eligible":
            return list(combinations(self.active("smooth"), 2))
        return list(model.pairs) if model.interactions == "explicit" else []

    def validate(self) -> Contract:
        def need(ok: bool, message: str) -> None:
            if not ok:
                raise ConfigurationError(message)

        v, s = self.validation, self.search
        need(bool(self.name.strip()), "experiment.name is empty")
        need(bool(self.target.strip()), "data.target is empty")
        need(v.outer_splits >= 2 and v.inner_splits >= 2, "outer_splits and inner_splits must be 2 or more")
        need(v.outer_repeats >= 1, "outer_repeats must be 1 or more")
        need(self.execution.workers >= 1, "execution.workers must be 1 or more")
        need(bool(self.active()), "no active predictor: every feature is excluded")
        need(self.target not in self.active(), "the target is also a predictor")
        need(bool(self.models), "at least one model is needed")
        need(len({m.id for m in self.models}) == len(self.models), "model ids must be unique")
        need(all(len(x) for x in (s.n_knots, s.degree, s.C, s.interaction_scale)), "a search axis is empty")
        need(min(s.n_knots) >= 2, "n_knots must be 2 or more")
        need(min(s.degree) >= 1, "degree must be 1 or more")
        need(min(s.C) > 0, "C must be positive")
        for name, f in self.features.items():
            need(f.role in ROLES, f"feature {name}: unknown role {f.role!r}")
            need(f.role == "exclude" or f.missing in MISSING[f.role], f"feature {name}: missing={f.missing!r} does not go with role {f.role!r}")
        smooth = set(self.active("smooth"))
        for m in self.models:
            need(MODEL_ID.fullmatch(m.id) is not None, f"model id {m.id!r} must match {MODEL_ID.pattern}")
            need(m.interactions in INTERACTIONS, f"model {m.id}: unknown interactions {m.interactions!r}")
            need(m.interactions != "explicit" or bool(m.pairs), f"model {m.id}: explicit interactions need pairs")
            for pair in m.pairs:
                need(len(pair) == 2 and pair[0] != pair[1] and set(pair) <= smooth, f"model {m.id}: {pair} is not a pair of two smooth features")
        return self


def from_dict(data: dict[str, Any], base: Path | None = None) -> Contract:
    """A validated contract of the YAML structure; a relative data path is resolved against ``base``."""
    try:
        source = data["data"]
        path = Path(str(source["path"]))
        if base is not None and not path.is_absolute() and "://" not in str(source["path"]):
            path = base / path
        features = {
            str(k): Feature(f["role"], f.get("missing", "error"), tuple(str(c) for c in f.get("categories") or ()), f.get("reference"))
            for k, f in data["features"].items()
        }
        models = tuple(Model(str(m["id"]), m.get("interactions", "none"), tuple(tuple(p) for p in m.get("pairs") or ())) for m in data["models"])
        lists = {k: tuple(v) for k, v in (data.get("search") or {}).items()}
        return Contract(
            name=str(data["experiment"]["name"]),
            primary_metric=data["experiment"].get("primary_metric", "log_loss"),
            data_path=str(source["path"]) if "://" in str(source["path"]) else str(path),
            target=str(source["target"]),
            row_id=source.get("row_id"),
            features=features,
            models=models,
            validation=Validation(**(data.get("validation") or {})),
            search=Search(**lists),
            execution=Execution(**(data.get("execution") or {})),
            schema_version=str(data.get("schema_version", SCHEMA_VERSION)),
        ).validate()
    except (KeyError, TypeError, AttributeError) as error:
        raise ConfigurationError(f"the contract is incomplete or malformed: {error!r}") from error


def to_dict(contract: Contract) -> dict[str, Any]:
    """The inverse of :func:`from_dict`, of plain lists and values."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    return plain(
        {
            "schema_version": contract.schema_version,
            "experiment": {"name": contract.name, "primary_metric": contract.primary_metric},
            "data": {"path": contract.data_path, "target": contract.target, "row_id": contract.row_id},
            "features": {k: asdict(f) for k, f in contract.features.items()},
            "models": [asdict(m) for m in contract.models],
            "validation": asdict(contract.validation),
            "search": asdict(contract.search),
            "execution": asdict(contract.execution),
        }
    )


def load(path: str | Path) -> Contract:
    path = Path(path)
    return from_dict(yaml.safe_load(path.read_text(encoding="utf-8")), path.parent)


#: The grids of the three presets.
PRESETS = {
    "quick": (Validation(3, 1, 3), Search((3,), (2,), (0.1, 1.0, 10.0), (0.5, 1.0))),
    "standard": (Validation(5, 3, 5), Search((3, 4, 5), (2, 3), (0.01, 0.1, 1.0, 10.0), (0.5, 1.0))),
    "thorough": (Validation(5, 5, 5), Search((3, 4, 5, 6), (2, 3), (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), (0.5, 1.0))),
}


def preset(name: str) -> tuple[Validation, Search]:
    if name not in PRESETS:
        raise ConfigurationError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


def candidates(search: Search, interactions: bool) -> list[dict[str, Any]]:
    """The grid in nesting order with ordinals; without interactions the scale axis is 1.0 only."""
    scales = search.interaction_scale if interactions else (1.0,)
    grid = [(k, d, c, s) for k in search.n_knots for d in search.degree for c in search.C for s in scales]
    return [{"ordinal": i, "n_knots": k, "degree": d, "C": c, "interaction_scale": s} for i, (k, d, c, s) in enumerate(grid)]


def plan_rows(contract: Contract) -> list[tuple[str, int, int]]:
    """(model, candidates, fits): the fits of the inner searches of all outer folds and of the final search."""
    v, rows = contract.validation, []
    for m in contract.models:
        n = len(candidates(contract.search, m.interactions != "none"))
        rows.append((m.id, n, n * v.inner_splits * v.outer_splits * v.outer_repeats + n * v.inner_splits))
    return rows
