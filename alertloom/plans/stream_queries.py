"""Streaming queries, run over all input there is and compared with their batch meaning.
A bin or session is published once the watermark passes its end; at the end of the input the open ones follow."""

from pyspark.sql import functions as F

from ..streaming import online, runs
from .alerts import ALERTS_SQL, alert_view
from .burst_queries import BURSTS_SCORED_SQL, SCORED_COLUMNS
from .correlation_queries import RULE_EDGES, matching_sql
from .registry import query


@query("SELECT event_type, date_trunc('hour', ts) AS timestamp, count(*) AS event_count FROM events GROUP BY ALL")
def stream_bursts(spark, sf_dir):
    events = runs.stream_table(spark, sf_dir, "events")
    counts = runs.burst_counts(events, ["event_type"], 3600, ts_col="ts")
    return runs.run_to_end(counts, still_open=lambda state: runs.open_bursts(state, ["event_type"]))


@query("""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE AS opens FROM events),
n AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM o),
s AS (SELECT user_id, i, min(ts) AS start, max(ts) AS "end", count(*) AS n_events FROM n GROUP BY ALL)
SELECT user_id, start, "end", n_events FROM s""")
def stream_rule_correlation(spark, sf_dir):
    events = runs.stream_table(spark, sf_dir, "events")
    sessions = runs.rule_sessions(events, "user_id", ts_col="ts")
    return runs.run_to_end(sessions, still_open=lambda state: runs.open_sessions(state, "user_id"))


@query(f"WITH RECURSIVE {ALERTS_SQL}, {matching_sql(RULE_EDGES)} SELECT * FROM found")
def stream_rule_pairs(spark, sf_dir):
    """The two-address rule online, over four parts of the table: the clusters that ``reconstruct_rule`` finds."""
    folder = online.new_folder(spark)
    sink = online.RuleCorrelator(spark, f"{folder}/state")
    online.run_batches(alert_view(runs.stream_in_parts(spark, sf_dir, "events", "ts", folder)), sink, folder)
    sink.close()
    return sink.clusters()


@query(BURSTS_SCORED_SQL)
def stream_bursts_scored(spark, sf_dir):
    """Bursts above the threshold online, over four parts of the table: the rows of ``burst_aggregate_scored``."""
    folder = online.new_folder(spark)
    rows = alert_view(runs.stream_in_parts(spark, sf_dir, "events", "ts", folder)).select(*SCORED_COLUMNS)
    sink = online.BurstCollector(spark, rows.schema, ["attack_type"], bin_seconds=3600, folder=f"{folder}/state")
    online.run_batches(rows, sink, folder)
    return sink.rows().withColumn("predicted_attack_type_agreement", F.round("predicted_attack_type_agreement", 9))
