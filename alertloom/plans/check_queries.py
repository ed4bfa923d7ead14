"""Leakage and data-quality queries."""

from pyspark.sql import functions as F

from ..functions.pairs import FEATURES
from ..operators import checks as Q, pairing as P
from .alerts import ALERTS_SQL, alerts, table
from .pair_queries import ASOF_SQL, FEATURES_SQL, asof_sql
from .registry import query


def _order_sides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")
    return orders.where(early), orders.where(~early)


@query("""SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'""")
def leakage_overlap(spark, sf_dir):
    return Q.campaign_overlap(*_order_sides(spark, sf_dir), key="o_custkey")


@query(f"""WITH {ALERTS_SQL}
SELECT DISTINCT source_dataset FROM alerts WHERE source_dataset IN ('events_w4', 'events_w9', 'darpa2000_lldos1.0')""")
def test_only_violation(spark, sf_dir):
    return Q.test_only_violation(alerts(spark, sf_dir), ["events_w4", "events_w9", "darpa2000_lldos1.0"])


@query(f"WITH {ALERTS_SQL} SELECT DISTINCT source_dataset FROM alerts")
def sources_present(spark, sf_dir):
    return Q.sources_present(alerts(spark, sf_dir))


@query("""SELECT l_orderkey || '-' || l_linenumber AS event_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"))
    return Q.duplicate_ids(ids)


@query("""
WITH c AS (SELECT quality, source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT quality, source AS top_value, n AS n_top, CAST(n_rows AS BIGINT) AS n_rows, n_values, round(n / n_rows, 9) AS top_share FROM (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, source) AS r, sum(n) OVER (PARTITION BY quality) AS n_rows,
    count(*) OVER (PARTITION BY quality) AS n_values FROM c) WHERE r = 1""")
def identity_column_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return Q.identity_audit(rows, "quality", "source").withColumn("top_share", F.round("top_share", 9))


@query(f"""WITH {ALERTS_SQL}, {asof_sql('true')}, {FEATURES_SQL},
l AS (UNPIVOT (SELECT {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)} FROM feats) ON {', '.join(FEATURES)} INTO NAME feature VALUE v)
SELECT feature, count(DISTINCT v) AS n_values, count(DISTINCT v) <= 1 AS is_constant FROM l GROUP BY feature""")
def constant_feature_audit(spark, sf_dir):
    pairs = P.with_features(P.consecutive_pairs(alerts(spark, sf_dir), "source_dataset"))
    return Q.constant_features(pairs, FEATURES)


@query("""
SELECT day, coalesce(a.n, 0) AS n_list, coalesce(b.n, 0) AS n_xml FROM (SELECT o_orderdate AS day, count(*) AS n FROM orders GROUP BY 1) a
FULL JOIN (SELECT l_shipdate AS day, count(*) AS n FROM lineitem GROUP BY 1) b USING (day) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def reconcile_counts(spark, sf_dir):
    n = lambda name, day, out: table(spark, sf_dir, name).groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias(out))
    return Q.reconcile(n("orders", "o_orderdate", "n_list"), n("lineitem", "l_shipdate", "n_xml"), "day")


INVENTORY_SQL = """inventory AS (SELECT p_brand AS scenario, p_type AS vantage, p_size % 5 AS phase,
  sum(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END) AS dump_bytes,
  max(CASE WHEN p_size % 7 < 3 THEN NULL WHEN p_size % 7 < 5 THEN 0 ELSE p_size END) AS truth_xml_bytes
  FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 DAY) GROUP BY ALL)"""


@query(f"""WITH {INVENTORY_SQL}, phases AS (SELECT scenario, vantage, count(DISTINCT phase) AS n FROM inventory GROUP BY ALL)
SELECT scenario, vantage, CAST(NULL AS INTEGER) AS phase, 'fewer than 2 phases' AS problem FROM phases WHERE n < 2
UNION ALL SELECT DISTINCT p_brand, p_type, CAST(NULL AS INTEGER), 'directory missing' FROM part WHERE (p_brand, p_type) NOT IN (SELECT (scenario, vantage) FROM inventory)
UNION ALL SELECT scenario, vantage, phase, 'dump is empty' FROM inventory WHERE coalesce(dump_bytes, 0) = 0
UNION ALL SELECT scenario, vantage, phase, 'truth is missing' FROM inventory WHERE truth_xml_bytes IS NULL
UNION ALL SELECT scenario, vantage, phase, 'truth is empty' FROM inventory WHERE truth_xml_bytes = 0""")
def inventory_problems(spark, sf_dir):
    """Every brand and type should show, those shipped on the last two days do."""
    part = table(spark, sf_dir, "part")
    items = table(spark, sf_dir, "lineitem")
    from_day = items.agg((F.max("l_shipdate") - F.expr("INTERVAL '1' DAY")).alias("d")).scalar()
    lately = items.where(F.col("l_shipdate") >= from_day).select(F.col("l_partkey").alias("p_partkey"))
    m = F.col("p_size") % 7
    inventory = part.join(lately, "p_partkey", "left_semi").groupBy(
        F.col("p_brand").alias("scenario"), F.col("p_type").alias("vantage"), (F.col("p_size") % 5).alias("phase")).agg(
        F.sum(F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size"))).alias("dump_bytes"),
        F.max(F.when(m < 3, None).when(m < 5, 0).otherwise(F.col("p_size"))).alias("truth_xml_bytes"))
    return Q.inventory_problems(inventory, part.select(F.col("p_brand").alias("scenario"), F.col("p_type").alias("vantage")).distinct())


@query(f"""WITH {ALERTS_SQL} SELECT attack_type AS label, count(*) AS n FROM alerts GROUP BY 1""")
def unmapped_labels(spark, sf_dir):
    return Q.unmapped_labels(alerts(spark, sf_dir).withColumnRenamed("attack_type", "label"))
