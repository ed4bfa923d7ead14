"""Queries that go through files: what is written from the tables is read back by the feeds."""

import uuid

from pyspark.sql import functions as F

from ..operators import checks
from .. import schema as S
from ..session import _file_system, delete_on_exit, shared_dir
from ..sources import flows, tables
from . import session_feed
from .alerts import ALERTS_SQL, alerts
from .burst_queries import burst_sql
from .normalize_queries import LINES_SQL, PARSED_SQL, session_lines
from .registry import query

FLOW_COLUMNS = ["flow_id", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "label"]


def _folder(spark, name):
    folder = f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    return folder


def _flow_files(spark, sf_dir):
    """The alerts as flow files with three headers: a known one, the same backwards, one with another column. Every
    fiftieth event has a comma too many in its label."""
    folder = _folder(spark, "flows")
    n = F.substring("event_id", 4, 20).cast("long")
    comma = F.when(n % 50 == 0, F.concat("attack_type", F.lit(",x"))).otherwise(F.col("attack_type"))
    rows = alerts(spark, sf_dir).select(
        n.alias("n"), F.col("event_id").alias("flow_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "src_ip",
        (n % 1000).cast("string").alias("src_port"), "dst_ip", F.col("dst_port").cast("int").alias("dst_port"), F.col("service").alias("protocol"),
        comma.alias("label"), F.col("vantage").alias("extra"))
    for i, columns in enumerate([FLOW_COLUMNS, FLOW_COLUMNS[::-1], ["extra", *FLOW_COLUMNS]]):
        rows.where(F.col("n") % 3 == i).select(*columns).write.option("header", True).option("quote", "\u0000").csv(f"{folder}/{i}")
    return folder


@query(f"""WITH {ALERTS_SQL}, a AS (SELECT *, CAST(substr(event_id, 4) AS BIGINT) AS n FROM alerts)
SELECT event_id AS flow_id, timestamp, src_ip, CAST(n % 1000 AS INTEGER) AS src_port, dst_ip, CAST(dst_port AS INTEGER) AS dst_port, service AS protocol,
  attack_type AS label, CASE WHEN n % 3 = 2 THEN vantage END AS extra FROM a WHERE n % 50 <> 0""")
def flow_headers(spark, sf_dir):
    """Flow files with different headers as one table."""
    return flows.read_flows(spark, _flow_files(spark, sf_dir)).select(*FLOW_COLUMNS, "extra")


@query(f"""WITH {ALERTS_SQL}, a AS (SELECT *, CAST(substr(event_id, 4) AS BIGINT) AS n FROM alerts)
SELECT CASE WHEN n % 50 = 0 THEN 'wrong number of fields' ELSE 'good' END AS reason, count(*) AS n FROM a GROUP BY 1""")
def flow_dropped_records(spark, sf_dir):
    """Records of those files by the reason that drops them."""
    records = flows.read_flow_records(spark, _flow_files(spark, sf_dir))
    return records.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


SCANNED = ["src_ip", "dst_ip", "service", "vantage", "source_dataset", "predicted_attack_type", "kill_chain_stage", "event_id"]


@query(f"""WITH {ALERTS_SQL}, l AS (UNPIVOT (SELECT attack_type AS y, {', '.join(SCANNED)} FROM alerts) ON {', '.join(SCANNED)} INTO NAME "column" VALUE v),
c AS (SELECT "column", v, y, count(*)::DOUBLE AS n FROM l GROUP BY ALL), v AS (SELECT "column", v, sum(n) AS n, max(n) AS top, sum(n * log2(n)) AS i FROM c GROUP BY ALL),
t AS (SELECT sum(n) AS n, max(n) AS top, sum(n * log2(n)) AS i FROM (SELECT count(*)::DOUBLE AS n FROM alerts GROUP BY attack_type)),
s AS (SELECT "column", count(*) AS n_values, sum(v.n) / count(*) AS rows_per_value, any_value(t.top / t.n) AS base_accuracy, sum(v.top) / sum(v.n) AS one_rule_accuracy,
  any_value(log2(t.n) - t.i / t.n) AS entropy, greatest(sum(v.n * log2(v.n) - v.i) / sum(v.n), 0) AS conditional_entropy FROM v, t GROUP BY "column")
SELECT "column", n_values, round(rows_per_value, 6) AS rows_per_value, round(base_accuracy, 6) AS base_accuracy, round(one_rule_accuracy, 6) AS one_rule_accuracy,
  round(entropy, 6) AS entropy, round(conditional_entropy, 6) AS conditional_entropy, row_number() OVER (ORDER BY round(conditional_entropy, 9), one_rule_accuracy DESC, "column")::INTEGER AS rank FROM s""")
def leak_scan(spark, sf_dir):
    """What each column of the alerts gives away of the attack type; the stage and the ids give all."""
    found = checks.leak_scan(alerts(spark, sf_dir), "attack_type", SCANNED)
    shown = ["rows_per_value", "base_accuracy", "one_rule_accuracy", "entropy", "conditional_entropy"]
    return found.withColumns({c: F.round(c, 6) for c in shown})


@query(f"""WITH {ALERTS_SQL} SELECT source_dataset, count(*) AS n, count(DISTINCT event_id) AS n_ids, min(timestamp) AS first, max(timestamp) AS last
FROM alerts GROUP BY 1""")
def events_written_twice(spark, sf_dir):
    """The events after two writes of all and a third of one source: every event once."""
    path, events = _folder(spark, "events"), alerts(spark, sf_dir)
    tables.write_events(events, path, 2000)
    tables.write_events(events, path, 2000)
    tables.write_events(events.where("source_dataset = 'events_w1'"), path, 500)
    return tables.read_events(spark, path).groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def _captures(spark, sf_dir):
    """The session lines of the events as capture files, one per scenario, directory and phase."""
    folder = _folder(spark, "captures")
    lines = session_lines(spark, sf_dir).repartition("scenario", "vantage", "phase")
    lines.write.partitionBy("scenario", "vantage", "phase").text(f"{folder}/parts")
    fs, parts = _file_system(spark, f"{folder}/parts/*/*/*/part-*")
    directory = {v: k for k, v in S.VANTAGE_DIRS.items()}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for file in fs.globStatus(parts):
        scenario, vantage, phase = [x.split("=")[1] for x in file.getPath().getParent().toString().split("/")[-3:]]
        target = path(f"{folder}/root/{scenario}/data_and_labeling/{directory[vantage]}/phase-{phase}.list")
        fs.mkdirs(target.getParent())
        fs.rename(file.getPath(), target)
    return f"{folder}/root"


LABELLED_SQL = f"""{LINES_SQL}, parsed AS ({PARSED_SQL}),
inner_hosts AS (SELECT DISTINCT scenario, unnest([src_ip, dst_ip]) AS host FROM parsed WHERE phase = 4),
internal AS (SELECT * FROM inner_hosts WHERE starts_with(host, '172.16.')),
labelled AS (SELECT *, CASE WHEN is_campaign_link THEN scenario ELSE 'NONE' END AS campaign_id FROM (SELECT *, phase IN (4, 5) OR
  (scenario, src_ip) IN (SELECT (scenario, host) FROM internal) OR (scenario, dst_ip) IN (SELECT (scenario, host) FROM internal) AS is_campaign_link FROM parsed)), """


@query(burst_sql("labelled", ["scenario", "vantage", "phase"], 200, "date_trunc('second', timestamp)", "src_ip", "dst_ip", "timestamp", "event_id",
                 link=True, modes=["service"], extra_first=["tier", "source_dataset", "kill_chain_stage", "attack_type"], with_clause=LABELLED_SQL,
                 bin_id="b.scenario || '_' || b.vantage || '_p' || b.phase || '_agg_' || "
                        "(row_number() OVER (PARTITION BY b.scenario, b.vantage, b.phase ORDER BY b.bin) - 1)"))
def session_feed_events(spark, sf_dir):
    """Capture files to unified events: scan, parse, label by hosts, collapse."""
    return session_feed.session_events(spark, _captures(spark, sf_dir)).drop("src_port", "dst_port")


@query("""WITH c AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'LLS_DDOS_1.0' ELSE 'LLS_DDOS_2.0.2' END AS scenario,
  CASE WHEN user_id % 2 = 0 THEN 'tcpdump_inside' ELSE 'tcpdump_dmz' END AS vantage, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1 AS phase FROM events),
d AS (SELECT scenario, v AS vantage FROM (SELECT DISTINCT scenario FROM c), (SELECT unnest(['tcpdump_inside', 'tcpdump_dmz']) AS v))
SELECT scenario, vantage, CAST(NULL AS INTEGER) AS phase, 'directory missing' AS problem FROM d WHERE (scenario, vantage) NOT IN (SELECT (scenario, vantage) FROM c)
UNION ALL SELECT scenario, vantage, NULL, 'fewer than 2 phases' FROM c GROUP BY 1, 2 HAVING count(*) < 2
UNION ALL SELECT scenario, vantage, phase, unnest(['dump is empty', 'truth is missing']) FROM c""")
def capture_inventory(spark, sf_dir):
    """Problems of those captures, from the file system: half the directories, all dumps and all truth files are missing."""
    return session_feed.capture_problems(spark, _captures(spark, sf_dir))
