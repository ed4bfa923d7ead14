"""Clustering and classification metrics, all from counts. No pair of events is ever formed."""

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import schema as S
from ..functions.numeric import guarded_ratio, harmonic_mean, pair_count
from .ranking import join_on


def attach_clusters(events: DataFrame, assignment: DataFrame, id_col="event_id", how="inner") -> DataFrame:
    return events.join(assignment.select(id_col, "cluster_id"), id_col, how)


def missing_assignments(events: DataFrame, assignment: DataFrame, id_col="event_id") -> DataFrame:
    return events.join(assignment, id_col, "left_anti").select(id_col)


def contingency(clustered: DataFrame, truth="campaign_id") -> DataFrame:
    """Events per (campaign, cluster). Everything below reads this table only."""
    return clustered.groupBy(truth, "cluster_id").agg(F.count(F.lit(1)).alias("n"))


def pair_totals(cells: DataFrame, truth="campaign_id") -> DataFrame:
    """One row: events, pairs sharing both, cluster only, campaign only. Events without a
    campaign form no true pair."""
    real = F.col(truth) != S.NO_CAMPAIGN
    by_cluster = cells.groupBy("cluster_id").agg(
        F.sum("n").alias("size"),
        F.sum(F.when(real, pair_count(F.col("n"))).otherwise(F.lit(0))).alias("both"))
    predicted = by_cluster.agg(
        F.sum("size").alias("n_events"), F.count(F.lit(1)).alias("n_clusters"),
        F.coalesce(F.sum(pair_count(F.col("size"))), F.lit(0)).cast("decimal(38,0)").alias("n_predicted_pairs"),
        F.coalesce(F.sum("both"), F.lit(0)).cast("decimal(38,0)").alias("tp_pairs"))
    true = cells.where(real).groupBy(truth).agg(F.sum("n").alias("size")).agg(
        F.coalesce(F.sum(pair_count(F.col("size"))), F.lit(0)).cast("decimal(38,0)").alias("n_true_pairs"))
    return predicted.withColumn("n_true_pairs", true.scalar()).withColumns({
        "fp_pairs": F.col("n_predicted_pairs") - F.col("tp_pairs"),
        "fn_pairs": F.col("n_true_pairs") - F.col("tp_pairs")})


def pairwise_scores(totals: DataFrame) -> DataFrame:
    """Precision, recall and F1 over co-clustered pairs."""
    out = totals.withColumns({
        "precision": guarded_ratio(F.col("tp_pairs"), F.col("n_predicted_pairs")),
        "recall": guarded_ratio(F.col("tp_pairs"), F.col("n_true_pairs"))})
    return out.withColumn("f1", harmonic_mean(F.col("precision"), F.col("recall")))


def adjusted_rand(totals: DataFrame) -> DataFrame:
    """Adjusted Rand index where every event without a campaign is its own true cluster.
    Products of pair counts exceed a bigint, so they are formed in double."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp_pairs", "fp_pairs", "fn_pairs"))
    tn = pair_count(F.col("n_events")).cast("double") - tp - fp - fn
    spread = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    value = F.when((fp == 0) & (fn == 0), F.lit(1.0)).otherwise(
        F.lit(2.0) * (tp * tn - fn * fp) / F.nullif(spread, F.lit(0.0)))
    return totals.withColumn("adjusted_rand_index", value)


def cluster_count(clustered: DataFrame) -> DataFrame:
    return clustered.agg(F.count_distinct("cluster_id").alias("n_clusters"))


def completeness(clustered: DataFrame, truth="campaign_id", stage="kill_chain_stage") -> DataFrame:
    """Share of a campaign's stages that its best cluster holds; campaigns with unknown stages
    only are skipped. The smallest cluster id wins a tie."""
    known = F.when(F.col(stage) != S.UNKNOWN_STAGE, F.col(stage))
    cells = clustered.where(F.col(truth) != S.NO_CAMPAIGN).groupBy(truth, "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(known).alias("stages"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "cluster_id", "stages"))
    per = cells.groupBy(truth).agg(
        F.sum("n").alias("n_true_events"), F.count(F.lit(1)).alias("n_predicted_clusters_touched"),
        best.alias("_best"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("stages")))).alias("true_stages"))
    captured = F.array_sort(F.col("_best.stages"))
    return per.where(F.size("true_stages") > 0).select(
        truth, F.col("_best.cluster_id").alias("best_cluster"), "true_stages", captured.alias("captured_stages"),
        (F.size(captured) / F.size("true_stages")).alias("completeness"), "n_true_events",
        "n_predicted_clusters_touched", (F.col("n_predicted_clusters_touched") > 1).alias("fragmentation"))


def cluster_profile(cells: DataFrame, truth="campaign_id") -> DataFrame:
    """Size, share of all events, dominant campaign and purity of every cluster."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(truth).alias("campaign")))
    per = cells.groupBy("cluster_id").agg(F.sum("n").alias("n_events"), best.alias("_b"))
    total = cells.agg(F.sum("n").alias("_all")).scalar()
    return per.select(
        "cluster_id", "n_events", (F.col("n_events") / total).alias("event_share"),
        F.col("_b.campaign").alias("dominant_campaign"), (-F.col("_b.neg")).alias("n_dominant"),
        (-F.col("_b.neg") / F.col("n_events")).alias("purity"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Long confusion matrix (true_label, predicted_label, n)."""
    return df.groupBy(F.col(truth).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(
        F.count(F.lit(1)).alias("n"))


def dense_confusion(cells: DataFrame) -> DataFrame:
    """Every (true, predicted) cell over the union of labels. Labels are few: for output only."""
    labels = cells.select(F.col("true_label").alias("label")).union(cells.select("predicted_label")).distinct()
    every = labels.agg(F.collect_list(F.struct("label")).alias("_all")).scalar()
    grid = labels.select(F.col("label").alias("true_label"), every.alias("_all")).select(
        "true_label", F.explode("_all.label").alias("predicted_label"))
    return join_on(grid, cells, ["true_label", "predicted_label"], "left").fillna(0, ["n"])


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label of the union of true and predicted labels."""
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("n_predicted"),
                 F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0).alias("n_hit")),
        F.struct(F.col("predicted_label").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("n_predicted"), F.lit(0).cast("long").alias("n_hit")))
    per = cells.select(F.inline(sides)).groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("support", "n_predicted", "n_hit")])
    out = per.withColumns({
        "precision": guarded_ratio(F.col("n_hit"), F.col("n_predicted")),
        "recall": guarded_ratio(F.col("n_hit"), F.col("support"))})
    return out.withColumn("f1", harmonic_mean(F.col("precision"), F.col("recall")))


def report_summary(report: DataFrame) -> DataFrame:
    """One row: accuracy, macro averages over all labels, averages weighted by support."""
    total = F.sum("support")
    aggs = [F.sum("support").alias("n"), guarded_ratio(F.sum("n_hit"), total).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs.append(F.avg(m).alias(f"macro_{m}"))
        aggs.append(guarded_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}"))
    return report.agg(*aggs)


def row_normalized(cells: DataFrame) -> DataFrame:
    """Cell share of its true label; null for a label without true rows."""
    rows = cells.groupBy("true_label").agg(F.sum("n").alias("support"))
    return join_on(cells, rows, ["true_label"]).withColumn("share", F.try_divide(F.col("n"), F.col("support")))


def recall_audit(cells: DataFrame, min_recall=S.AUDIT_RECALL, min_support=S.AUDIT_SUPPORT) -> DataFrame:
    """Labels recalled almost perfectly on real support: candidates for a leak."""
    hit = row_normalized(cells).where("true_label = predicted_label")
    return hit.where((F.col("share") >= min_recall) & (F.col("support") >= min_support)).select(
        F.col("true_label").alias("label"), F.col("share").alias("recall"), "support")


def near_perfect(report: DataFrame, min_f1=S.NEAR_PERFECT_F1, low_power=S.LOW_POWER_SUPPORT) -> DataFrame:
    verdict = F.when(F.col("support") < low_power, "low power").otherwise("investigate")
    return report.where(F.col("f1") >= min_f1).select("label", "f1", "support", verdict.alias("verdict"))


def class_support(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Train and test rows per label, 0 where a side has none."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = train.select(label, one.alias("train_n"), none.alias("test_n")).unionByName(test.select(label, none.alias("train_n"), one.alias("test_n")))
    return sides.groupBy(label).agg(F.sum("train_n").alias("train_n"), F.sum("test_n").alias("test_n"))


def headline(report: DataFrame, classes=S.HEADLINE_CLASSES, low_power=S.LOW_POWER_SUPPORT) -> DataFrame:
    """The short class list against the report; absent classes are kept and say so."""
    spark = report.sparkSession
    wanted = spark.createDataFrame([(c,) for c in classes], "label string")
    found = wanted.join(report, "label", "left")
    note = F.when(F.col("support").isNull(), "not present").when(F.col("support") < low_power, "too few rows")
    return found.select("label", "precision", "recall", "f1", "support", note.otherwise("ok").alias("note"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per label: n / (number of labels * rows of the label)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    per_label = counts.agg((F.sum("n") / F.count(F.lit(1))).alias("_mean")).scalar()
    return counts.select(label, "n", (per_label / F.col("n")).alias("weight"))


def ablation(full: DataFrame, reduced: DataFrame, min_delta=S.ABLATION_DELTA) -> DataFrame:
    """Summary with and without the suspect columns, side by side."""
    metrics = ["accuracy", "macro_f1", "weighted_f1"]
    long = lambda df, name: df.unpivot([], metrics, "metric", name)
    both = long(full.select(*metrics), "with_columns").join(long(reduced.select(*metrics), "without_columns"), "metric")
    delta = F.col("with_columns") - F.col("without_columns")
    return both.withColumn("delta", delta).withColumn("material", F.col("delta") > min_delta)


def crosstab(clustered: DataFrame, truth="campaign_id") -> DataFrame:
    return contingency(clustered, truth)
