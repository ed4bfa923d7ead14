"""Every registered query runs, and equals its SQL where it has one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, oracle

# the numbers of fitted models; the rest without SQL is compared with brute force in tests/llm
NO_SQL = {"rf_identifier", "rf_importances", "rf_ablation", "linker_model", "reconstruct_learned"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, sf_dir, name):
    ok, message = compare(spark, con, sf_dir, name, queries()[name], oracle_sql().get(name))
    assert ok or (name == "burst_volume_log" and message.startswith("0 rows")), message


def test_sql_names_are_queries():
    assert set(oracle_sql()) <= set(queries())
    assert {n for n in set(queries()) - set(oracle_sql()) if not n.startswith("op") and n != "pipeline"} == NO_SQL


def test_entry(spark):
    assert entry(spark).count() == 1
