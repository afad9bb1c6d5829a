"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from titlekit.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    said = compare(spark, con, folder, QUERIES[name], ORACLES.get(name))
    assert said.startswith(("ok", "rows only")), said


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["product_name", "core_terms", "brands"]
    assert found.count() == 200
