"""Every registered query outside the optional subpackage: against DuckDB where it has SQL, else that it runs and has rows."""

import importlib

import pytest
from conftest import SMALL
from oracle import duck, ours

CASES = [(g, n) for g in ("vectors", "pairs", "scores", "events", "outputs") for n in importlib.import_module(f"contrail.queries.{g}").QUERIES]


@pytest.mark.parametrize("group,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, group, name):
    module = importlib.import_module(f"contrail.queries.{group}")
    names, rows = ours(module.QUERIES[name](spark, SMALL))
    if name in module.ORACLE:
        assert (names, rows) == duck(module.ORACLE[name], SMALL)
    else:
        assert rows


def test_oracles_belong_to_queries():
    for g in ("vectors", "pairs", "scores", "events", "outputs"):
        module = importlib.import_module(f"contrail.queries.{g}")
        assert set(module.ORACLE) <= set(module.QUERIES)
