"""Online correlation and bursts equal their batch forms, over several files, late rows and repeated batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators.bursts import aggregate_bursts
from alertloom.operators.correlate import reconstruct_by_rule
from alertloom.streaming import online, runs

T0 = dt.datetime(2024, 1, 1)
COLUMNS = ("event_id string, timestamp timestamp_ntz, src_ip string, dst_ip string, service string, "
           "predicted_attack_type string, predicted_kill_chain_stage string, is_campaign_link boolean, campaign_id string, g string")


def events(seed, n, hosts, minutes):
    rnd = random.Random(seed)
    host = lambda: f"h{rnd.randrange(hosts)}" if rnd.random() < 0.7 else "hot"
    return sorted(((f"e{i:04d}", T0 + dt.timedelta(seconds=rnd.randrange(minutes * 60)), host(), host(), f"s{rnd.randrange(3)}", "x", "recon",
                    rnd.random() < 0.5, f"c{rnd.randrange(3)}", rnd.choice(["big", "big", "big", "small", None])) for i in range(n)), key=lambda r: r[1])


def clusters(df):
    return {r.event_id: r.cluster_id for r in df.collect()}


def in_batches(spark, rows, parts, shuffled=0):
    """Consecutive parts; rows move by at most ``shuffled`` places."""
    rnd = random.Random(parts)
    order = sorted(range(len(rows)), key=lambda i: i + rnd.uniform(0, shuffled))
    size = -(-len(rows) // parts)
    return [spark.createDataFrame([rows[i] for i in order[k:k + size]], COLUMNS) for k in range(0, len(rows), size)]


@pytest.mark.parametrize("parts,shuffled", [(1, 0), (3, 0), (5, 6)])
def test_rule_over_batches(spark, parts, shuffled):
    rows = events(parts, 160, 25, 300)
    sink = online.RuleCorrelator(spark, late_seconds=3600)
    for i, batch in enumerate(in_batches(spark, rows, parts, shuffled)):
        sink.add(batch, i)
    sink.close()
    assert sink.late_rows() == 0
    assert clusters(sink.clusters()) == clusters(reconstruct_by_rule(spark.createDataFrame(rows, COLUMNS)))


def test_a_repeated_batch_changes_nothing_and_late_rows_are_counted(spark):
    rows = events(7, 90, 10, 200)
    sink = online.RuleCorrelator(spark, late_seconds=60)
    first, second, third = in_batches(spark, rows, 3)
    sink.add(first, 0)
    sink.add(second, 1)
    sink.add(second, 1)  # as after a failure
    sink.add(third, 2)
    sink.add(spark.createDataFrame([("late", T0, "hot", "hot", "s", "x", "recon", True, "c", "g")], COLUMNS), 3)
    sink.close()
    assert sink.late_rows() == 1
    assert clusters(sink.clusters()) == clusters(reconstruct_by_rule(spark.createDataFrame(rows, COLUMNS)))


def test_open_state_stays_within_the_window(spark):
    rows = [(f"e{i:02d}", T0 + dt.timedelta(minutes=20 * i), f"a{i}", f"b{i}", "s", "x", "recon", True, "c", "g") for i in range(30)]
    sink = online.RuleCorrelator(spark, late_seconds=0)
    for i, batch in enumerate(in_batches(spark, rows, 3)):
        sink.add(batch, i)
    schema = sink.tables.read("open", 2, spark.createDataFrame([], sink.schema).withColumn("cluster_id", F.lit("")).schema)
    assert 0 < schema.count() <= 4  # one hour of events every twenty minutes


@pytest.mark.parametrize("parts", [1, 4, 11])
def test_bursts_over_batches(spark, parts):
    rows = events(parts, 240, 12, 30)
    df = spark.createDataFrame(rows, COLUMNS)
    options = dict(threshold=40, bin_seconds=300)
    sink = online.BurstCollector(spark, df.schema, ["g"], **options)
    for i, batch in enumerate(in_batches(spark, rows, parts, 30)):
        sink.add(batch, i)
        if i == 1:
            sink.add(batch, i)
    want = aggregate_bursts(df, ["g"], **options)
    assert sorted(map(str, sink.rows().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert len(sink.tables.batches("kept")) <= 2


def test_streams_of_files(spark, sf_dir, tmp_path):
    """A file a trigger, with a new query that goes on where the last one stopped."""
    from alertloom.plans.alerts import alert_view

    folder = str(tmp_path / "stream")
    stream = lambda: alert_view(spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema)
                                .option("maxFilesPerTrigger", 1).parquet(f"{folder}/events"))
    sink = online.RuleCorrelator(spark, f"{folder}/state")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = rows.select(F.expr("percentile(unix_micros(cast(ts as timestamp)), 0.5)")).first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for part in (at <= half, at > half):
        rows.where(part).write.mode("append").parquet(f"{folder}/events")
        online.run_batches(stream(), sink, folder)
    sink.close()
    assert len(sink.tables.batches("clusters")) >= 3
    assert clusters(sink.clusters()) == clusters(reconstruct_by_rule(alert_view(rows)))


def test_parts_of_a_table_are_the_table(spark, sf_dir, tmp_path):
    stream = runs.stream_in_parts(spark, sf_dir, "events", "ts", str(tmp_path))
    assert stream.isStreaming
    assert spark.read.parquet(f"{tmp_path}/events").exceptAll(spark.read.parquet(f"{sf_dir}/events.parquet")).count() == 0
