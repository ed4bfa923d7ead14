"""Classification reports, audits, weights and training-history reports."""

from pyspark.sql import functions as F

from ..operators import history as H, metrics as M
from .alerts import ALERTS_SQL, alerts, table
from .registry import query

CELLS_SQL = "cells AS (SELECT attack_type AS true_label, predicted_attack_type AS predicted_label, count(*) AS n FROM alerts GROUP BY ALL)"
REPORT_SQL = """labels_all AS (SELECT true_label AS label FROM cells UNION SELECT predicted_label FROM cells),
counts AS (SELECT label, coalesce((SELECT sum(n) FROM cells WHERE true_label = label), 0)::BIGINT AS support,
  coalesce((SELECT sum(n) FROM cells WHERE predicted_label = label), 0)::BIGINT AS n_predicted,
  coalesce((SELECT sum(n) FROM cells WHERE true_label = label AND predicted_label = label), 0)::BIGINT AS n_hit FROM labels_all),
rates AS (SELECT *, CASE WHEN n_predicted = 0 THEN 0 ELSE n_hit / n_predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE n_hit / support END AS recall FROM counts),
report AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rates)"""
WITH_REPORT = f"WITH {ALERTS_SQL}, {CELLS_SQL}, {REPORT_SQL}"


def _cells(spark, sf_dir):
    return M.confusion(alerts(spark, sf_dir), "attack_type", "predicted_attack_type")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"WITH {ALERTS_SQL}, {CELLS_SQL} SELECT * FROM cells")
def confusion_matrix(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"""WITH {ALERTS_SQL}, {CELLS_SQL}, l AS (SELECT true_label AS x FROM cells UNION SELECT predicted_label FROM cells)
SELECT t.x AS true_label, p.x AS predicted_label, coalesce(n, 0) AS n FROM l t CROSS JOIN l p LEFT JOIN cells ON true_label = t.x AND predicted_label = p.x""")
def dense_confusion_matrix(spark, sf_dir):
    return M.dense_confusion(_cells(spark, sf_dir))


@query(f"""WITH {ALERTS_SQL} SELECT DISTINCT attack_type AS label FROM alerts UNION SELECT predicted_attack_type FROM alerts""")
def label_universe(spark, sf_dir):
    a = alerts(spark, sf_dir)
    return a.select(F.col("attack_type").alias("label")).union(a.select("predicted_attack_type")).distinct()


@query(f"""{WITH_REPORT} SELECT label, support, n_predicted, n_hit, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM report""")
def classification_report(spark, sf_dir):
    return _rounded(M.class_report(_cells(spark, sf_dir)), "precision", "recall", "f1")


SUMMARY_SQL = """CAST(sum(support) AS BIGINT) AS n, round(sum(n_hit) / sum(support), 9) AS accuracy,
  round(avg(precision), 9) AS macro_precision, round(sum(precision * support) / sum(support), 9) AS weighted_precision,
  round(avg(recall), 9) AS macro_recall, round(sum(recall * support) / sum(support), 9) AS weighted_recall,
  round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1"""
SUMMARY_COLUMNS = ["accuracy"] + [f"{a}_{m}" for m in ("precision", "recall", "f1") for a in ("macro", "weighted")]


@query(f"{WITH_REPORT} SELECT {SUMMARY_SQL} FROM report")
def report_summary(spark, sf_dir):
    return _rounded(M.report_summary(M.class_report(_cells(spark, sf_dir))), *SUMMARY_COLUMNS)


@query(f"""WITH {ALERTS_SQL}, {CELLS_SQL} SELECT true_label, predicted_label, n, CAST(sum(n) OVER (PARTITION BY true_label) AS BIGINT) AS support,
  round(n / nullif(sum(n) OVER (PARTITION BY true_label), 0), 9) AS share FROM cells""")
def row_normalized_recall(spark, sf_dir):
    return _rounded(M.row_normalized(_cells(spark, sf_dir)), "share")


@query(f"{WITH_REPORT} SELECT label, round(recall, 9) AS recall, support FROM report WHERE recall >= 0.99 AND support >= 100")
def recall_audit(spark, sf_dir):
    return _rounded(M.recall_audit(_cells(spark, sf_dir)), "recall")


@query(f"""{WITH_REPORT} SELECT label, round(f1, 9) AS f1, support, CASE WHEN support < 1900 THEN 'low power' ELSE 'investigate' END AS verdict
FROM report WHERE f1 >= 0.9""")
def near_perfect_audit(spark, sf_dir):
    return _rounded(M.near_perfect(M.class_report(_cells(spark, sf_dir)), min_f1=0.9, low_power=1900), "f1")


@query(f"""{WITH_REPORT} SELECT w.label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support,
  CASE WHEN support IS NULL THEN 'not present' WHEN support < 15 THEN 'too few rows' ELSE 'ok' END AS note
FROM (SELECT unnest(['view', 'click', 'scan', 'error']) AS label) w LEFT JOIN report USING (label)""")
def headline_report(spark, sf_dir):
    short = M.headline(M.class_report(_cells(spark, sf_dir)), ["view", "click", "scan", "error"])
    return _rounded(short, "precision", "recall", "f1")


@query("""SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS train_n,
  count(*) FILTER (WHERE l_linestatus <> 'F') AS test_n FROM lineitem GROUP BY 1""")
def class_support(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    return M.class_support(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus <> 'F'"), "l_returnflag")


@query("""SELECT o_orderpriority, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def balanced_class_weights(spark, sf_dir):
    return _rounded(M.class_weights(table(spark, sf_dir, "orders"), "o_orderpriority"), "weight")


def _summary_of(predicted):
    cells = CELLS_SQL.replace("predicted_attack_type AS", f"{predicted} AS")
    return f"(WITH {cells}, {REPORT_SQL} SELECT {SUMMARY_SQL} FROM report)"


PLAIN_GUESS = "(CASE WHEN src_port IS NULL THEN 'view' END)"


@query(f"""WITH {ALERTS_SQL}, w AS (UNPIVOT (SELECT accuracy, macro_f1, weighted_f1 FROM {_summary_of('predicted_attack_type')}) ON accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE with_columns),
o AS (UNPIVOT (SELECT accuracy, macro_f1, weighted_f1 FROM {_summary_of(PLAIN_GUESS)}) ON accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE without_columns)
SELECT metric, with_columns, without_columns, round(with_columns - without_columns, 8) AS delta, with_columns - without_columns > 0.02 AS material
FROM w JOIN o USING (metric)""")
def ablation_delta(spark, sf_dir):
    full = _rounded(M.report_summary(M.class_report(_cells(spark, sf_dir))), *SUMMARY_COLUMNS)
    guess = alerts(spark, sf_dir).withColumn("guess", F.when(F.col("src_port").isNull(), "view"))
    plain = _rounded(M.report_summary(M.class_report(M.confusion(guess, "attack_type", "guess"))), *SUMMARY_COLUMNS)
    return M.ablation(full, plain).withColumn("delta", F.round("delta", 8))


HISTORY_SQL = "history AS (SELECT CAST(ts AS DATE) AS episode, avg(value) AS score, max(value) AS reward FROM events GROUP BY 1)"


def _history(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("episode")).agg(
        F.avg("value").alias("score"), F.max("value").alias("reward"))


@query(f"""WITH {HISTORY_SQL}, loss AS (SELECT episode, CASE WHEN day(episode) % 4 <> 0 THEN score END AS loss FROM history)
SELECT episode, round(loss, 6) AS loss, round(CASE WHEN count(loss) OVER w >= 10 THEN avg(loss) OVER w END, 6) AS rolling_mean
FROM loss WINDOW w AS (ORDER BY episode ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def history_rolling_mean(spark, sf_dir):
    loss = _history(spark, sf_dir).select("episode", F.when(F.dayofmonth("episode") % 4 != 0, F.col("score")).alias("loss"))
    out = H.rolling_mean(loss, "loss", "episode")
    return out.withColumns({c: F.round(c, 6) for c in ("loss", "rolling_mean")})


@query(f"""WITH {HISTORY_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY episode) AS r, count(*) OVER () // 3 AS k, count(*) OVER () AS n FROM history),
s AS (SELECT avg(score) FILTER (WHERE r <= k) AS a, avg(score) FILTER (WHERE r > n - k) AS b, stddev_samp(score) FILTER (WHERE r > n - k) AS d,
  avg(reward) FILTER (WHERE r <= k) AS e, avg(reward) FILTER (WHERE r > n - k) AS f FROM p)
SELECT round(a, 6) AS first_mean, round(b, 6) AS last_mean, round(d, 6) AS last_std, round(e, 6) AS first_reward, round(f, 6) AS last_reward,
  b > a AS improved, d < 0.15 AS stable FROM s""")
def history_thirds(spark, sf_dir):
    out = H.thirds(_history(spark, sf_dir), "score", "reward", "episode")
    return out.withColumns({c: F.round(c, 6) for c in ("first_mean", "last_mean", "last_std", "first_reward", "last_reward")})
