"""Finite streams publish all of their input, as the batch aggregate does."""

import pytest

from alertloom.plans import stream_queries
from alertloom.streaming import runs


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The events of ``sf_dir`` as a folder of part files."""
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{folder}/events.parquet")
    return folder


def same_rows(a, b):
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("kind", ["file", "folder"])
def test_tails_are_published(spark, sf_dir, parts, kind):
    where = sf_dir if kind == "file" else parts
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bins = stream_queries.stream_bursts(spark, where)
    same_rows(bins, runs.burst_counts(events, ["event_type"], 3600, ts_col="ts"))
    assert bins.agg({"event_count": "sum"}).first()[0] == events.count()
    sessions = stream_queries.stream_rule_correlation(spark, where)
    same_rows(sessions, runs.rule_sessions(events, "user_id", ts_col="ts"))
    assert sessions.agg({"n_events": "sum"}).first()[0] == events.count()


def test_an_empty_table_has_no_rows(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert stream_queries.stream_bursts(spark, str(tmp_path)).count() == 0
    assert stream_queries.stream_rule_correlation(spark, str(tmp_path)).count() == 0
