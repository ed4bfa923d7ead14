"""Queries over anchor/candidate pairs."""

from pyspark.sql import functions as F

from ..functions.pairs import FEATURES, rule_decision
from ..operators import pairing as P
from ..operators.sampling import campaign_split
from .alerts import ALERTS_SQL, alerts
from .registry import query

FIELDS = ["event_id", "timestamp", "src_ip", "dst_ip", "service", "predicted_attack_type", "predicted_kill_chain_stage"]


def asof_sql(condition):
    """Latest earlier event of the group that satisfies the condition, field by field."""
    w = "(PARTITION BY source_dataset ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last = ", ".join(f"last_value(CASE WHEN {condition} THEN {f} END IGNORE NULLS) OVER {w} AS a_{f}" for f in FIELDS)
    return f"latest AS (SELECT * FROM (SELECT *, {last} FROM alerts) WHERE a_event_id IS NOT NULL)"


def ordinal(c):
    return f"(CASE {c} WHEN 'recon' THEN 0 WHEN 'exploit' THEN 1 WHEN 'install' THEN 2 WHEN 'action' THEN 3 ELSE -1 END)"


def features_sql(a="a_", c=""):
    gap = f"((epoch_us({c}timestamp) - epoch_us({a}timestamp)) / 1e6::DOUBLE)"
    shared = " OR ".join(f"{a}{x} = {c}{y}" for x in ("src_ip", "dst_ip") for y in ("src_ip", "dst_ip"))
    return f"""CAST(least(greatest({gap}, 0::DOUBLE), 3600::DOUBLE) / 3600::DOUBLE AS FLOAT) AS time_delta_norm,
      CAST({a}src_ip = {c}src_ip AS FLOAT) AS shared_src_ip, CAST({a}dst_ip = {c}dst_ip AS FLOAT) AS shared_dst_ip,
      CAST(({shared}) AS FLOAT) AS shared_any_ip, CAST({a}service = {c}service AS FLOAT) AS same_service,
      CAST({a}predicted_attack_type = {c}predicted_attack_type AS FLOAT) AS same_predicted_type,
      CAST({ordinal(c + 'predicted_kill_chain_stage')} - {ordinal(a + 'predicted_kill_chain_stage')} AS FLOAT) AS stage_progression"""


ASOF_SQL = asof_sql("is_campaign_link")
FEATURES_SQL = f"feats AS (SELECT source_dataset, a_event_id AS anchor_id, event_id AS candidate_id, is_campaign_link, {features_sql()} FROM latest)"
SPANS_SQL = """spans AS (SELECT campaign_id AS pool_id, count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
  arg_min(day, (timestamp, event_id)) AS first_day, arg_min(event_id, (timestamp, event_id)) AS first_id
  FROM alerts WHERE campaign_id <> 'NONE' GROUP BY 1 HAVING count(*) >= 2)"""


@query(f"""WITH {ALERTS_SQL}, {SPANS_SQL}
SELECT pool_id AS campaign_id, event_id, timestamp FROM alerts JOIN spans ON day = first_day
  AND timestamp BETWEEN first_ts AND last_ts + INTERVAL 30 MINUTE WHERE campaign_id = 'NONE'""")
def distractor_range_join(spark, sf_dir):
    return P.distractors_in_range(alerts(spark, sf_dir)).select("campaign_id", "event_id", "timestamp")


@query(f"WITH {ALERTS_SQL}, {ASOF_SQL} SELECT source_dataset, a_event_id AS anchor_id, event_id AS candidate_id FROM latest")
def asof_anchor_pairs(spark, sf_dir):
    return P.asof_pairs(alerts(spark, sf_dir)).select(
        "source_dataset", F.col("a.event_id").alias("anchor_id"), F.col("c.event_id").alias("candidate_id"))


@query(f"""WITH {ALERTS_SQL}, {ASOF_SQL}, {FEATURES_SQL}
SELECT anchor_id, candidate_id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)} FROM feats""")
def pair_features(spark, sf_dir):
    pairs = P.with_features(P.asof_pairs(alerts(spark, sf_dir)))
    return pairs.select(F.col("a.event_id").alias("anchor_id"), F.col("c.event_id").alias("candidate_id"),
                        *[F.col(f).cast("double").alias(f) for f in FEATURES])


@query(f"""WITH {ALERTS_SQL}, {ASOF_SQL}, {FEATURES_SQL},
d AS (SELECT source_dataset, is_campaign_link AS t, shared_any_ip = 1 AND time_delta_norm <= 0.5 AS a FROM feats),
s AS (SELECT source_dataset, count(*) AS n_steps, count(*) FILTER (WHERE a AND t) AS tp, count(*) FILTER (WHERE a AND NOT t) AS fp,
  count(*) FILTER (WHERE NOT a AND t) AS fn, count(*) FILTER (WHERE NOT a AND NOT t) AS tn FROM d GROUP BY 1),
r AS (SELECT *, round(tp - fp - 2.5 * fn + 0.1 * tn, 6)::DOUBLE AS total_reward, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q FROM s)
SELECT source_dataset, n_steps, tp, fp, fn, tn, total_reward, round(p, 9) AS precision, round(q, 9) AS recall,
  round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 9) AS f1 FROM r""")
def pair_rewards(spark, sf_dir):
    pairs = P.asof_pairs(alerts(spark, sf_dir))
    decided = pairs.select("source_dataset", F.col("is_campaign_link").alias("true_link"),
                           rule_decision()(F.col("a"), F.col("c")).alias("action"))
    tally = P.decision_tally(decided, ["source_dataset"])
    return tally.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")}
                             | {"total_reward": F.round("total_reward", 6)})


POOL_SQL = f"""{SPANS_SQL},
true_rows AS (SELECT * FROM (SELECT a.*, pool_id, true AS is_true, row_number() OVER (PARTITION BY pool_id
    ORDER BY event_id <> first_id, md5('42|' || event_id), event_id) AS r FROM alerts a JOIN spans ON campaign_id = pool_id) WHERE r <= 36),
loose AS (SELECT * FROM (SELECT a.*, pool_id, false AS is_true, row_number() OVER (PARTITION BY pool_id
    ORDER BY md5('42|' || event_id), event_id) AS r, 60 - least(n, 36) AS room FROM alerts a JOIN spans ON day = first_day
    AND timestamp BETWEEN first_ts AND last_ts + INTERVAL 30 MINUTE WHERE campaign_id = 'NONE') WHERE r <= room),
pool AS (SELECT * FROM true_rows UNION ALL SELECT * EXCLUDE (room) FROM loose)"""
POOL_WINDOW = "(PARTITION BY pool_id ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
POOL_LAST = ", ".join(f"last_value(CASE WHEN is_true THEN {f} END IGNORE NULLS) OVER {POOL_WINDOW} AS a_{f}" for f in FIELDS)


@query(f"""WITH {ALERTS_SQL}, {POOL_SQL}, anchored AS (SELECT *, {POOL_LAST} FROM pool),
f AS (SELECT pool_id, a_event_id, event_id, is_true, {features_sql()} FROM anchored WHERE a_event_id IS NOT NULL)
SELECT pool_id AS campaign_id, a_event_id AS anchor_id, event_id AS candidate_id,
  {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)}, is_true AS true_link,
  CASE WHEN is_true THEN 1.0 ELSE -1.0 END::DOUBLE AS reward_link, CASE WHEN is_true THEN -2.5 ELSE 0.1 END::DOUBLE AS reward_no_link FROM f""")
def pair_training_set(spark, sf_dir):
    pairs = P.training_pairs(alerts(spark, sf_dir))
    return pairs.withColumns({f: F.col(f).cast("double") for f in FEATURES})


@query(f"WITH {ALERTS_SQL}, {POOL_SQL} SELECT pool_id, event_id, campaign_id, is_true FROM pool")
def episode_pools(spark, sf_dir):
    return P.episode_pool(alerts(spark, sf_dir)).select("pool_id", "event_id", "campaign_id", "is_true")


HELD_OUT_SQL = f"""WITH {ALERTS_SQL}, {SPANS_SQL},
val AS (SELECT campaign_id FROM (SELECT campaign_id, row_number() OVER (ORDER BY md5('42|' || campaign_id), campaign_id) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT campaign_id FROM alerts WHERE campaign_id <> 'NONE')) WHERE r <= greatest(1, round_even(n * 0.3::DOUBLE, 0))),
pool AS (SELECT pool_id, timestamp, event_id, true AS is_true, first_ts, first_id FROM alerts JOIN spans ON campaign_id = pool_id
  UNION ALL SELECT pool_id, timestamp, event_id, false, first_ts, first_id FROM alerts JOIN spans ON day = first_day
    AND timestamp BETWEEN first_ts AND last_ts + INTERVAL 30 MINUTE WHERE campaign_id = 'NONE'),
h AS (SELECT pool_id AS campaign_id, count(*) AS n_steps, count(*) FILTER (WHERE is_true) AS n_true FROM pool
WHERE pool_id IN (SELECT campaign_id FROM val) AND (timestamp > first_ts OR timestamp = first_ts AND event_id > first_id) GROUP BY 1)"""


@query(f"{HELD_OUT_SQL} SELECT * FROM h")
def held_out_pairs(spark, sf_dir):
    """What a link decision is validated on: every step of the held-out campaigns, none sampled."""
    events = alerts(spark, sf_dir)
    held_out = campaign_split(events).where("split = 'val'")
    return P.whole_pairs(events, held_out).groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if("true_link").alias("n_true"))
