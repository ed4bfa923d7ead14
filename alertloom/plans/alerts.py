"""The unified alert view over the events table, and table access."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lookup import map_values
from ..session import tune

TYPE_STAGE = {"view": "recon", "click": "exploit", "signup": "install", "purchase": "action"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_view(table(spark, sf_dir, "events"))


def alert_view(events: DataFrame) -> DataFrame:
    """The events table, read or streamed, as unified events."""
    ev = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    predicted = F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("event_type"))
    label = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return ev.select(
        label("ev_", F.col("event_id")).alias("event_id"),
        F.col("ts").alias("timestamp"),
        label("u", F.col("user_id")).alias("src_ip"),
        label("h", F.col("k")).alias("dst_ip"),
        F.lit(None).cast("double").alias("src_port"),
        F.col("k").cast("double").alias("dst_port"),
        label("svc", F.col("k") % 5).alias("service"),
        F.lit("network").alias("tier"),
        F.when(F.col("user_id") % 2 == 0, "inside").otherwise("dmz").alias("vantage"),
        label("events_w", F.floor((F.dayofmonth("ts") - 1) / 7)).alias("source_dataset"),
        F.when(F.col("event_type") == "error", "NONE").otherwise(label("c", F.col("user_id") % 20)).alias("campaign_id"),
        map_values(F.col("event_type"), TYPE_STAGE, "unknown").alias("kill_chain_stage"),
        F.col("event_type").alias("attack_type"),
        (F.col("event_type") != "error").alias("is_campaign_link"),
        predicted.alias("predicted_attack_type"),
        map_values(predicted, TYPE_STAGE, "unknown").alias("predicted_kill_chain_stage"),
        F.to_date("ts").alias("day"),
    )


ALERTS_SQL = """
alerts AS (
  SELECT 'ev_' || event_id AS event_id, ts AS timestamp, 'u' || user_id AS src_ip, 'h' || k AS dst_ip,
    CAST(NULL AS DOUBLE) AS src_port, CAST(k AS DOUBLE) AS dst_port, 'svc' || (k % 5) AS service,
    'network' AS tier, CASE WHEN user_id % 2 = 0 THEN 'inside' ELSE 'dmz' END AS vantage,
    'events_w' || ((day(ts) - 1) // 7) AS source_dataset,
    CASE WHEN event_type = 'error' THEN 'NONE' ELSE 'c' || (user_id % 20) END AS campaign_id,
    CASE event_type WHEN 'view' THEN 'recon' WHEN 'click' THEN 'exploit' WHEN 'signup' THEN 'install'
      WHEN 'purchase' THEN 'action' ELSE 'unknown' END AS kill_chain_stage,
    event_type AS attack_type, event_type <> 'error' AS is_campaign_link,
    p AS predicted_attack_type,
    CASE p WHEN 'view' THEN 'recon' WHEN 'click' THEN 'exploit' WHEN 'signup' THEN 'install'
      WHEN 'purchase' THEN 'action' ELSE 'unknown' END AS predicted_kill_chain_stage,
    CAST(ts AS DATE) AS day
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
          CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS p FROM events)
)"""
