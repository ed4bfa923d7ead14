"""Queries that collapse high-volume groups."""

from pyspark.sql import functions as F

from ..operators.bursts import aggregate_bursts, volume_log
from .alerts import ALERTS_SQL, alerts, table
from .registry import query


def burst_sql(source, groups, threshold, bin_expr, src, dst, ts, event_id, link=False, prediction=False, modes=(),
              extra_first=(), bin_id=None, with_clause=""):
    """The burst rules in plain SQL: windows and correlated counts, no shared code with the operator."""
    g = ", ".join(groups)
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in groups + ["bin"])

    def mode(col):
        return (f"m_{col} AS (SELECT {g}, bin, v, n FROM (SELECT {g}, bin, v, n, row_number() OVER (PARTITION BY {g}, bin "
                f"ORDER BY n DESC, v) AS r FROM (SELECT {g}, bin, {col} AS v, count(*) AS n FROM big WHERE {col} IS NOT NULL "
                f"GROUP BY ALL)) WHERE r = 1)")

    cols = [src, dst, *modes] + (["predicted_attack_type"] if prediction else [])
    ctes = [
        f"sized AS (SELECT *, count(*) OVER (PARTITION BY {g}) AS group_rows FROM {source})",
        f"big AS (SELECT *, {bin_expr} AS bin FROM sized WHERE group_rows > {threshold})",
        f"""bins AS (SELECT {g}, bin, count(*) AS n, count(DISTINCT {src}) AS n_src, count(DISTINCT {dst}) AS n_dst,
          arg_min({event_id}, ({ts}, {event_id})) AS first_id{''.join(f", arg_min({c}, ({ts}, {event_id})) AS first_{c}" for c in extra_first)}
          {", bool_or(is_campaign_link) AS link, arg_min(campaign_id, (" + ts + ", " + event_id + ")) FILTER (WHERE is_campaign_link) AS camp" if link else ""}
          FROM big GROUP BY ALL)""",
    ] + [mode(c) for c in cols]
    joins = " ".join(f"LEFT JOIN m_{c} ON {same('b', 'm_' + c)}" for c in cols)
    new_id = bin_id or "b.first_id"
    group_out = [c for c in groups if c not in (src, dst, "campaign_id", "is_campaign_link")]
    out = [f"b.{c} AS {c}" for c in group_out] + [
        f"{new_id} AS event_id", "b.bin AS timestamp",
        f"CASE WHEN n_src <= n_dst THEN CAST(m_{src}.v AS VARCHAR) ELSE 'MULTI(n=' || n_src || ')' END AS src_ip",
        f"CASE WHEN n_src <= n_dst THEN 'MULTI(n=' || n_dst || ')' ELSE CAST(m_{dst}.v AS VARCHAR) END AS dst_ip",
        "b.n AS event_count"]
    calm = group_out + [f"{event_id} AS event_id", f"{ts} AS timestamp", f"CAST({src} AS VARCHAR)", f"CAST({dst} AS VARCHAR)", "1"]
    if link:
        out += ["b.link AS is_campaign_link", "coalesce(b.camp, 'NONE') AS campaign_id"]
        calm += ["is_campaign_link", "campaign_id"]
    if prediction:
        out += ["m_predicted_attack_type.v AS predicted_attack_type",
                "round(m_predicted_attack_type.n / b.n, 9) AS predicted_attack_type_agreement"]
        calm += ["predicted_attack_type", "1.0"]
    for c in modes:
        out.append(f"m_{c}.v AS {c}")
        calm.append(c)
    for c in extra_first:
        out.append(f"b.first_{c} AS {c}")
        calm.append(c)
    return (f"WITH {with_clause}{', '.join(ctes)} SELECT {', '.join(out)} FROM bins b {joins} "
            f"UNION ALL SELECT {', '.join(calm)} FROM sized WHERE group_rows <= {threshold}")


def _shipments(spark, sf_dir):
    line_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", line_id.alias("event_id"), F.col("l_shipdate").alias("timestamp"),
        F.col("l_suppkey").cast("string").alias("src_ip"), F.col("l_partkey").cast("string").alias("dst_ip"))


SHIPMENTS_SQL = """shipments AS (SELECT l_returnflag, l_linestatus,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS event_id, l_shipdate AS timestamp,
  CAST(l_suppkey AS VARCHAR) AS src_ip, CAST(l_partkey AS VARCHAR) AS dst_ip FROM lineitem), """


@query(burst_sql("shipments", ["l_returnflag", "l_linestatus"], 200, "date_trunc('day', timestamp)", "src_ip", "dst_ip",
                 "timestamp", "event_id", with_clause=SHIPMENTS_SQL))
def burst_aggregate(spark, sf_dir):
    return aggregate_bursts(_shipments(spark, sf_dir), ["l_returnflag", "l_linestatus"], bin_seconds=86_400)


SCORED_COLUMNS = ["attack_type", "event_id", "timestamp", "src_ip", "dst_ip", "is_campaign_link", "campaign_id",
                  "predicted_attack_type", "service", "dst_port"]
BURSTS_SCORED_SQL = burst_sql(
    "alerts", ["attack_type"], 200, "date_trunc('hour', timestamp)", "src_ip", "dst_ip", "timestamp", "event_id",
    link=True, prediction=True, extra_first=["service", "dst_port"], with_clause=ALERTS_SQL + ", ")


@query(BURSTS_SCORED_SQL)
def burst_aggregate_scored(spark, sf_dir):
    rows = alerts(spark, sf_dir).select(*SCORED_COLUMNS)
    out = aggregate_bursts(rows, ["attack_type"], bin_seconds=3600)
    return out.withColumn("predicted_attack_type_agreement", F.round("predicted_attack_type_agreement", 9))


@query(burst_sql("alerts", ["source_dataset", "vantage", "attack_type"], 200, "date_trunc('hour', timestamp)", "src_ip",
                 "dst_ip", "timestamp", "event_id", link=True, modes=["service"], with_clause=ALERTS_SQL + ", ",
                 bin_id="b.source_dataset || '_' || b.vantage || '_p' || b.attack_type || '_agg_' || "
                        "(row_number() OVER (PARTITION BY b.source_dataset, b.vantage, b.attack_type ORDER BY b.bin) - 1)"))
def burst_aggregate_sessions(spark, sf_dir):
    rows = alerts(spark, sf_dir).select("source_dataset", "vantage", "attack_type", "event_id", "timestamp", "src_ip",
                                        "dst_ip", "is_campaign_link", "campaign_id", "service", "src_port", "dst_port")
    name = lambda i: F.concat_ws("_", "source_dataset", "vantage", F.concat(F.lit("p"), F.col("attack_type")), F.lit("agg"),
                                 i.cast("string"))
    return aggregate_bursts(rows, ["source_dataset", "vantage", "attack_type"], bin_seconds=3600,
                            null_cols=["src_port", "dst_port"], mode_cols=["service"], bin_id=name
                            ).drop("src_port", "dst_port")


@query("""SELECT l_suppkey, count(*) AS raw_rows, CAST(1 AS BIGINT) AS bin_seconds FROM lineitem
GROUP BY l_suppkey HAVING count(*) > 200""")
def burst_volume_log(spark, sf_dir):
    return volume_log(table(spark, sf_dir, "lineitem"), ["l_suppkey"])
