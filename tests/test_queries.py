"""Every registered query runs; those with SQL equal DuckDB's rows; the plans hold no Python where none is meant."""

from __future__ import annotations

import pytest
from compare import differences, duck

from lexspark import catalog

#: Queries whose greedy step is sequential within a group, or that need a function that SQL lacks.
GROUPED = {"retire_near_senses", "greedy_song_use", "identity_forms", "mwe_substrings", "cognate_scores", "fuzzy_alignment", "calibrated_senses"}
ORACLES = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def checked(spark, sf, name):
    """The query's result; its final plan has Python only where it is meant to."""
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ("Python" in plan or "Pandas" in plan or "Arrow" in plan) == (name in GROUPED), name
    return df


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, con, name):
    assert differences(checked(spark, sf, name), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert checked(spark, sf, name).count() > 0


def test_greedy_song_use_reads_all_lines(spark, sf, tmp_path):
    for name in ("lineitem", "part", "supplier"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        (rows.where("l_orderkey >= 400") if name == "lineitem" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["greedy_song_use"](spark, str(tmp_path)).count() > 0


def test_sql_only_for_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
