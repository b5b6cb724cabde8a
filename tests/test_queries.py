"""Every query with SQL gives DuckDB's rows; the others run."""

import pytest

import __spark_entry__ as entry
from tallygrove.plans.catalogue import ORACLE_SQL, QUERIES

from .oracle import differences, duck

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert differences(df, ORACLE_SQL[name], con) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_rows_in_native_plans(spark):
    for name in ("fit_rank", "search_filter", "lexicon_signals", "line_blocks", "dedupe_first"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_scan_reads_only_what_is_used(spark):
    plan = QUERIES["required_subset"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in plan
