import pytest

from smoothspan.contract import PRESETS, Contract, Feature, Model, Search, Validation, candidates, from_dict, load, plan_rows, preset, to_dict
from smoothspan.errors import ConfigurationError
from smoothspan.sources.sinks import write_yaml_atomic


def contract(**changes):
    base = {
        "name": "demo",
        "data_path": "/data.csv",
        "target": "y",
        "features": {"a": Feature("smooth"), "b": Feature("smooth"), "c": Feature("categorical", categories=("u", "v")), "d": Feature("exclude")},
        "models": (Model("main"), Model("pairs", "explicit", (("a", "b"),))),
    }
    return Contract(**(base | changes))


def test_round_trip(tmp_path):
    made = contract().validate()
    write_yaml_atomic(tmp_path / "c.yaml", to_dict(made))
    assert load(tmp_path / "c.yaml") == made


def test_relative_path_is_resolved(tmp_path):
    data = to_dict(contract(data_path="in.csv"))
    assert from_dict(data, tmp_path).data_path == str(tmp_path / "in.csv")


@pytest.mark.parametrize(
    "changes",
    [
        {"name": " "},
        {"target": ""},
        {"target": "a"},
        {"validation": Validation(1)},
        {"validation": Validation(outer_repeats=0)},
        {"features": {"a": Feature("exclude")}},
        {"models": (Model("x"), Model("x"))},
        {"models": (Model("-bad"),)},
        {"models": (Model("p", "explicit"),)},
        {"models": (Model("p", "explicit", (("a", "a"),)),)},
        {"models": (Model("p", "explicit", (("a", "c"),)),)},
        {"search": Search(n_knots=(1,))},
        {"search": Search(degree=(0,))},
        {"search": Search(C=(0.0,))},
        {"search": Search(C=())},
        {"features": {"a": Feature("smooth", "most_frequent")}},
        {"features": {"c": Feature("categorical", "median")}},
    ],
)
def test_rules(changes):
    with pytest.raises(ConfigurationError):
        contract(**changes).validate()


def test_grid_and_plan():
    standard = contract(validation=PRESETS["standard"][0], search=PRESETS["standard"][1])
    assert plan_rows(standard) == [("main", 24, 1920), ("pairs", 48, 3840)]
    grid = candidates(Search(), True)
    assert [c["ordinal"] for c in grid] == list(range(48)) and grid[1]["interaction_scale"] == 1.0
    with pytest.raises(ConfigurationError):
        preset("huge")


def test_pairs_of_all_eligible():
    assert contract().pairs(Model("m", "all_eligible")) == [("a", "b")]
