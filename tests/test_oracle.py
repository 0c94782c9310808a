"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import connect, differences

# The corpus operators have tests of their own.
NAMES = sorted(set(entry.queries()) - set(entry.CORPUS))
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in NAMES}


@pytest.fixture(scope="module")
def tables(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, tables, name):
    df = entry.queries()[name](spark, sf_dir)
    if name in ORACLE:
        assert differences(df, tables, ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_only_non_sql_queries_lack_sql():
    assert set(NAMES) - set(ORACLE) == {"pack_batches_greedy", "fit_linear_reward_head"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
