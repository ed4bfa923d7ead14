"""Repeatable samples and splits."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.numeric import benign_budget, share_budget
from ..functions.text import seeded_hash
from .ranking import join_on, mark_first, range_bucket


def chronological_split(df: DataFrame, group_cols=("source_file",), ts_col="timestamp", id_col="event_id",
                        train_fraction=S.TRAIN_FRACTION, bucket: Column = None) -> DataFrame:
    """First ``floor(n * fraction)`` rows of each group in time order are "train".
    ``bucket`` coarsens the order; ranges of equal shares by default."""
    fraction = F.lit(float(train_fraction))
    bucket = range_bucket(df, group_cols, [ts_col, id_col]) if bucket is None else bucket
    marked = mark_first(df, group_cols, bucket, [ts_col, id_col],
                        lambda n: F.floor(n * fraction), "_train")
    return marked.withColumn("split", F.when(F.col("_train"), "train").otherwise("test")).drop("_train")


def exact_sample(df: DataFrame, group_cols, quota, id_col="event_id", seed=S.SEED, prefix=3) -> DataFrame:
    """Exactly ``quota`` rows per group (all rows of smaller groups), without replacement.

    Rows are ranked by a seeded digest of their id; ``prefix`` hex digits bucket them.
    """
    digest = seeded_hash(seed, F.col(id_col).cast("string"))
    rows = df.withColumn("_h", digest)
    marked = mark_first(rows, group_cols, F.substring("_h", 1, prefix), ["_h", id_col], quota, "_keep")
    return marked.where("_keep").drop("_h", "_keep")


def benign_quota(attack_counts: DataFrame, available: DataFrame, group_cols=("day",),
                 multiplier=S.BENIGN_MULTIPLIER, floor=S.BENIGN_FLOOR, cap=S.BENIGN_CAP) -> DataFrame:
    """Distractor budget per group: a multiple of the attack rows, floored, capped, at most what exists."""
    both = join_on(available.withColumnRenamed("n", "n_available"),
                   attack_counts.withColumnRenamed("n", "n_attack"), list(group_cols), "left")
    n_attack = F.coalesce("n_attack", F.lit(0)).cast("long")
    return both.withColumn("n_attack", n_attack).withColumn(
        "quota", benign_budget(F.col("n_attack"), F.col("n_available"), multiplier, floor, cap))


def proportional_quota(available: DataFrame, target=S.BENIGN_TOTAL_TARGET, floor=S.BENIGN_FLOOR) -> DataFrame:
    """Budget per group as its share of a total target."""
    total = available.agg(F.sum("n").alias("n_total")).scalar()
    return available.withColumnRenamed("n", "n_available").withColumn("n_total", total).withColumn(
        "quota", share_budget(F.col("n_available"), F.col("n_total"), target, floor))


def campaign_split(events: DataFrame, campaign_col="campaign_id", seed=S.SEED,
                   fraction=S.VALIDATION_FRACTION, manifest: DataFrame = None) -> DataFrame:
    """Assign whole campaigns to "train" or "val". A given manifest is used as it is."""
    if manifest is not None:
        return manifest.select(campaign_col, "split")
    campaigns = events.where(F.col(campaign_col) != S.NO_CAMPAIGN).select(campaign_col).distinct()
    rows = campaigns.withColumns({"_all": F.lit(1), "_h": seeded_hash(seed, F.col(campaign_col))})
    n_val = lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction))))
    marked = mark_first(rows, ["_all"], F.substring("_h", 1, 3), ["_h", campaign_col], n_val, "_val")
    return marked.select(campaign_col, F.when(F.col("_val"), "val").otherwise("train").alias("split"))


def rows_of_split(events: DataFrame, split: DataFrame, name: str, key="campaign_id") -> DataFrame:
    return events.join(split.where(F.col("split") == name).select(key), key, "left_semi")
