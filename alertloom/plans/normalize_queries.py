"""Queries that parse, clean and unify records."""

from pyspark.sql import functions as F

from ..functions import lookup, numeric, temporal, text
from ..sources.sessions import parse_lines, rejected_lines, tag_phase
from .. import schema as S
from .alerts import ALERTS_SQL, alerts, table
from .registry import query

ORDINAL = """CASE {c} WHEN 'recon' THEN 0 WHEN 'exploit' THEN 1 WHEN 'install' THEN 2 WHEN 'action' THEN 3 ELSE -1 END"""


@query(f"""
WITH {ALERTS_SQL}
SELECT event_id, timestamp, src_ip, dst_ip, src_port, dst_port, service, tier, vantage, source_dataset, campaign_id,
  kill_chain_stage, attack_type, is_campaign_link, attack_type AS ideal_attack_type,
  {ORDINAL.format(c='kill_chain_stage')} AS stage_ordinal,
  'MULTI(n=' || CAST(dst_port AS BIGINT) || ')' AS marker, starts_with(dst_ip, 'h1') AS internal,
  replace(lower('LLS_DDOS_' || vantage), 'lls_ddos_', 'lldos') AS short_source
FROM alerts""")
def unified_events(spark, sf_dir):
    a = alerts(spark, sf_dir)
    return a.select(
        *S.UNIFIED_COLUMNS, F.col("attack_type").alias("ideal_attack_type"),
        lookup.stage_ordinal(F.col("kill_chain_stage")).alias("stage_ordinal"),
        text.multi_marker(F.col("dst_port").cast("long")).alias("marker"),
        F.col("dst_ip").startswith("h1").alias("internal"),
        text.scenario_source(F.concat(F.lit("LLS_DDOS_"), F.col("vantage")), "").alias("short_source"))


def session_lines(spark, sf_dir):
    """Events written as session lines, with every eleventh one spoilt."""
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    even = F.col("user_id") % 2 == 0
    line = F.concat_ws(
        " ", F.col("event_id").cast("string"), F.date_format("ts", "MM/dd/yyyy"), F.date_format("ts", "HH:mm:ss"),
        F.lit("00:00:01"), F.concat(F.lit("svc"), (F.col("k") % 5).cast("string")), F.lit("-"),
        F.when(F.col("k") % 3 == 0, "-").otherwise(F.col("k").cast("string")),
        F.concat(F.lit("172.016."), pad(F.col("user_id") % 256), F.lit("."), pad(F.col("k"))),
        F.concat(F.lit("202.077."), pad(F.col("k")), F.lit("."), pad(F.col("user_id") % 256)), F.lit("0"), F.lit("x"))
    return ev.select(
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("# "), line)).otherwise(F.concat(F.lit("  "), line)).alias("value"),
        F.when(even, "LLS_DDOS_1.0").otherwise("LLS_DDOS_2.0.2").alias("scenario"),
        F.when(even, "inside").otherwise("dmz").alias("vantage"), (F.col("k") % 5 + 1).alias("phase"))


LINES_SQL = """
lines AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CASE WHEN user_id % 2 = 0 THEN 'LLS_DDOS_1.0' ELSE 'LLS_DDOS_2.0.2' END AS scenario,
  CASE WHEN user_id % 2 = 0 THEN 'inside' ELSE 'dmz' END AS vantage FROM events)"""


PARSED_SQL = """SELECT scenario || '_' || vantage || '_p' || (k % 5 + 1) || '_' || event_id AS event_id,
  date_trunc('second', ts) AS timestamp, '172.16.' || (user_id % 256) || '.' || k AS src_ip,
  '202.77.' || k || '.' || (user_id % 256) AS dst_ip, CAST(NULL AS DOUBLE) AS src_port,
  CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS dst_port, 'svc' || (k % 5) AS service,
  'network' AS tier, vantage, CASE WHEN user_id % 2 = 0 THEN 'darpa2000_lldos1.0' ELSE 'darpa2000_lldos2.0.2' END AS source_dataset,
  scenario, k % 5 + 1 AS phase,
  CASE k % 5 WHEN 2 THEN 'exploit' WHEN 3 THEN 'install' WHEN 4 THEN 'action' ELSE 'recon' END AS kill_chain_stage,
  CASE k % 5 WHEN 2 THEN 'exploit' WHEN 3 THEN 'backdoor_install' WHEN 4 THEN 'ddos' ELSE 'recon' END AS attack_type
FROM lines WHERE event_id % 11 <> 0"""


@query(f"WITH {LINES_SQL} {PARSED_SQL}")
def parse_session_lines(spark, sf_dir):
    return tag_phase(parse_lines(session_lines(spark, sf_dir)))


@query(f"""
WITH {LINES_SQL}
SELECT scenario, vantage, k % 5 + 1 AS phase, count(*) FILTER (WHERE event_id % 11 = 0) AS n_rejected, count(*) AS n_lines
FROM lines GROUP BY ALL""")
def rejected_session_lines(spark, sf_dir):
    return rejected_lines(session_lines(spark, sf_dir))


@query("""
SELECT event_id, CAST(CASE WHEN event_id % 5 IN (0, 1, 2) THEN 0 ELSE CAST(value AS FLOAT) END AS DOUBLE) AS cleaned,
  CASE WHEN event_id % 5 IN (0, 1, 2) THEN 0.0 WHEN value = 0 THEN 0.0 ELSE round(event_id / value, 6) END AS ratio,
  CAST(user_id AS INTEGER) AS small_user, CASE WHEN event_id % 5 = 1 THEN NULL WHEN event_id % 5 = 2 THEN NULL
    WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS optional
FROM events""")
def numeric_clean(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    m = F.col("event_id") % 5
    raw = F.when(m == 0, "inf").when(m == 1, "").when(m == 2, "abc").otherwise(F.col("value").cast("string"))
    x = numeric.clean_number(raw)
    value = F.when(m <= 2, F.lit(0.0)).otherwise(F.col("value"))
    port = F.when(m == 0, "0").when(m == 1, "").when(m == 2, "-").otherwise(F.col("value").cast("string"))
    return ev.select(
        "event_id", x.cast("double").alias("cleaned"),
        F.round(numeric.guarded_ratio(F.col("event_id"), value), 6).alias("ratio"),
        numeric.shrink_integer(F.col("user_id")).alias("small_user"), text.optional_number(port).alias("optional"))


LABEL_NAMES = ["FTP-Patator", "DoS_Hulk", "DoS Hulk", "DDoS_LOIT", "Web_XSS", "Benign", "benign", "Botnet_ARES", "Other"]


@query("""
WITH l AS (SELECT (['FTP-Patator','DoS_Hulk','DoS Hulk','DDoS_LOIT','Web_XSS','Benign','benign','Botnet_ARES','Other'])[user_id % 9 + 1] AS label FROM events)
SELECT label, CASE label WHEN 'FTP-Patator' THEN 'recon' WHEN 'Web_XSS' THEN 'exploit' WHEN 'DoS_Hulk' THEN 'action' WHEN 'DoS Hulk' THEN 'action'
    WHEN 'DDoS_LOIT' THEN 'action' WHEN 'Botnet_ARES' THEN 'action' ELSE 'unknown' END AS stage,
  CASE label WHEN 'FTP-Patator' THEN 'recon' WHEN 'Web_XSS' THEN 'exploit' WHEN 'DoS Hulk' THEN 'action'
    WHEN 'Botnet_ARES' THEN 'action' ELSE 'unknown' END AS published_stage,
  label NOT IN ('benign', 'Other') AS mapped, count(*) AS n
FROM l GROUP BY ALL""")
def label_stages(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in LABEL_NAMES])
    label = F.get(names, (F.col("user_id") % len(LABEL_NAMES)).cast("int"))
    rows = table(spark, sf_dir, "events").select(label.alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        "label", lookup.label_stage(F.col("label")).alias("stage"),
        lookup.label_stage(F.col("label"), compat=True).alias("published_stage"),
        lookup.is_mapped_label(F.col("label")).alias("mapped"), "n")


@query("""
SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT) AS n_marks FROM pages""")
def marker_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.count_marker(F.col("html"), "<p>").alias("n_marks"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS parsed FROM events")
def mixed_timestamps(spark, sf_dir):
    m = F.col("event_id") % 3
    raw = (F.when(m == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(m == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm")))
    return table(spark, sf_dir, "events").select("event_id", temporal.parse_mixed(raw).alias("parsed"))
