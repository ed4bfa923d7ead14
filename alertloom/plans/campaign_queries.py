"""Queries that label campaigns, split and sample."""

from pyspark.sql import functions as F

from ..operators import campaigns as C, sampling as P
from .alerts import ALERTS_SQL, alerts, table
from .registry import query

HOSTS_SQL = """hosts AS (SELECT DISTINCT source_dataset, host, starts_with(host, 'h1') AS is_internal FROM (
  SELECT source_dataset, src_ip AS host FROM alerts WHERE attack_type = 'signup' UNION ALL
  SELECT source_dataset, dst_ip FROM alerts WHERE attack_type = 'signup'))"""


@query(f"""WITH {ALERTS_SQL}, {HOSTS_SQL}
SELECT event_id, source_dataset, m AS is_campaign_link, CASE WHEN m THEN source_dataset ELSE 'NONE' END AS campaign_id FROM (
  SELECT event_id, source_dataset, attack_type IN ('signup', 'purchase') OR (attack_type IN ('view', 'click') AND (
    (source_dataset, src_ip) IN (SELECT source_dataset, host FROM hosts WHERE is_internal) OR
    (source_dataset, dst_ip) IN (SELECT source_dataset, host FROM hosts WHERE is_internal))) AS m FROM alerts)""")
def campaign_host_membership(spark, sf_dir):
    kind = F.col("attack_type")
    labelled = C.label_by_hosts(alerts(spark, sf_dir), "source_dataset", early=kind.isin("view", "click"),
                                always=kind.isin("signup", "purchase"), install=kind == "signup", internal_prefix="h1")
    return labelled.select("event_id", "source_dataset", "is_campaign_link", "campaign_id")


@query(f"WITH {ALERTS_SQL}, {HOSTS_SQL} SELECT * FROM hosts")
def campaign_hosts(spark, sf_dir):
    return C.host_roles(alerts(spark, sf_dir), "source_dataset", F.col("attack_type") == "signup", "h1")


def _filed(spark, sf_dir):
    return alerts(spark, sf_dir).withColumn("source_file", F.concat_ws("/", "src_ip", "dst_ip")).withColumn(
        "day", F.col("day").cast("string"))


SPANS_SQL = """spans AS (SELECT CAST(day AS VARCHAR) AS day, src_ip || '/' || dst_ip AS source_file, min(timestamp) AS start,
  max(timestamp) AS "end" FROM alerts GROUP BY ALL)"""


@query(f"WITH {ALERTS_SQL}, {SPANS_SQL} SELECT * FROM spans")
def block_spans(spark, sf_dir):
    return C.block_spans(_filed(spark, sf_dir))


@query(f"""WITH {ALERTS_SQL}, {SPANS_SQL},
seen AS (SELECT *, max("end") OVER (PARTITION BY day ORDER BY start, source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM spans),
named AS (SELECT day, source_file, 'events_' || day || '_c' || sum(CASE WHEN start - seen > INTERVAL 10 MINUTE THEN 1 ELSE 0 END)
  OVER (PARTITION BY day ORDER BY start, source_file ROWS UNBOUNDED PRECEDING) AS campaign_id FROM seen)
SELECT event_id, a_day AS day, campaign_id FROM (SELECT event_id, CAST(day AS VARCHAR) AS a_day, src_ip || '/' || dst_ip AS f FROM alerts)
JOIN named ON a_day = day AND f = source_file""")
def time_gap_campaigns(spark, sf_dir):
    return C.label_by_time_gaps(_filed(spark, sf_dir), gap_minutes=10, prefix="events_").select(
        "event_id", "day", "campaign_id")


@query(f"""WITH {ALERTS_SQL}
SELECT *, n_linked = 0 OR n_distractor = 0 AS degenerate FROM (
  SELECT day, count(*) FILTER (WHERE is_campaign_link) AS n_linked, count(*) FILTER (WHERE NOT is_campaign_link) AS n_distractor
  FROM alerts GROUP BY day)""")
def balance_table(spark, sf_dir):
    return C.balance(alerts(spark, sf_dir), "day")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def label_frequency(spark, sf_dir):
    return C.frequency(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(f"""WITH {ALERTS_SQL}
SELECT event_id, attack_type, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT event_id, attack_type, row_number() OVER (PARTITION BY attack_type ORDER BY timestamp, event_id) AS r,
    count(*) OVER (PARTITION BY attack_type) AS n FROM alerts)""")
def chronological_split(spark, sf_dir):
    return P.chronological_split(alerts(spark, sf_dir), ["attack_type"]).select("event_id", "attack_type", "split")


@query("""
SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 500""")
def exact_sample_per_group(spark, sf_dir):
    return P.exact_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"],
                          lambda n: F.least(n, F.lit(500)), "o_orderkey")


QUOTA_SQL = """quota AS (SELECT day, n_available, coalesce(n_attack, 0) AS n_attack,
  least(50, greatest(10, coalesce(n_attack, 0) * 5), n_available) AS quota
  FROM (SELECT day, count(*) AS n_available FROM alerts WHERE campaign_id = 'NONE' GROUP BY day)
  LEFT JOIN (SELECT day, count(*) AS n_attack FROM alerts WHERE campaign_id <> 'NONE' GROUP BY day) USING (day))"""


def _benign_quota(events):
    counts = lambda df: df.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    loose = F.col("campaign_id") == "NONE"
    return P.benign_quota(counts(events.where(~loose)), counts(events.where(loose)), floor=10, cap=50)


@query(f"WITH {ALERTS_SQL}, {QUOTA_SQL} SELECT * FROM quota")
def sampling_budget(spark, sf_dir):
    return _benign_quota(alerts(spark, sf_dir))


@query(f"""WITH {ALERTS_SQL}, {QUOTA_SQL}
SELECT event_id, day FROM (SELECT event_id, day, quota, row_number() OVER (PARTITION BY day ORDER BY md5('42|' || event_id), event_id) AS r
  FROM alerts JOIN quota USING (day) WHERE campaign_id = 'NONE') WHERE r <= quota""")
def budgeted_sample(spark, sf_dir):
    events = alerts(spark, sf_dir)
    loose = events.where("campaign_id = 'NONE'").select("event_id", "day")
    return P.exact_sample(loose, ["day"], _benign_quota(events))


@query("""
SELECT o_orderpriority, n AS n_available, CAST(sum(n) OVER () AS BIGINT) AS n_total,
  CAST(least(greatest(1000, floor(10000 * (n::DOUBLE / sum(n) OVER ()))), n) AS BIGINT) AS quota
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def proportional_budget(spark, sf_dir):
    n = C.frequency(table(spark, sf_dir, "orders"), "o_orderpriority")
    return P.proportional_quota(n, target=10_000)


@query(f"""WITH {ALERTS_SQL}
SELECT campaign_id, CASE WHEN r <= greatest(1, round_even(n * 0.3::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT campaign_id, row_number() OVER (ORDER BY md5('42|' || campaign_id), campaign_id) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT campaign_id FROM alerts WHERE campaign_id <> 'NONE'))""")
def campaign_split(spark, sf_dir):
    return P.campaign_split(alerts(spark, sf_dir))


@query(f"""WITH {ALERTS_SQL}
SELECT event_id, campaign_id FROM alerts WHERE campaign_id IN (SELECT campaign_id FROM (
  SELECT campaign_id, row_number() OVER (ORDER BY md5('42|' || campaign_id), campaign_id) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT campaign_id FROM alerts WHERE campaign_id <> 'NONE')) WHERE r > greatest(1, round_even(n * 0.3::DOUBLE, 0)))""")
def training_rows(spark, sf_dir):
    events = alerts(spark, sf_dir)
    return P.rows_of_split(events, P.campaign_split(events), "train").select("event_id", "campaign_id")
