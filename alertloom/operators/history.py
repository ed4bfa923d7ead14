"""Training-history reports: one row per episode or checkpoint, a few thousand rows at most."""

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import schema as S


def rolling_mean(history: DataFrame, value: str, order: str, rows=50, min_values=10, out="rolling_mean") -> DataFrame:
    """Mean of the last ``rows`` rows, null until ``min_values`` of them are present."""
    w = W.orderBy(order).rowsBetween(1 - rows, W.currentRow)
    mean = F.when(F.count(value).over(w) >= min_values, F.avg(value).over(w))
    return history.withColumn(out, mean)


def drop_missing(history: DataFrame, value: str) -> DataFrame:
    return history.where(F.col(value).isNotNull())


def thirds(history: DataFrame, value: str, reward: str, order: str, stable_std=S.STABLE_STD) -> DataFrame:
    """First against last third of a history, and whether the value improved and settled.
    All values are null when there are fewer than three rows."""
    w = W.orderBy(order)
    size = history.agg(F.count(F.lit(1)).alias("_n")).scalar()
    placed = history.select(value, reward, F.row_number().over(w).alias("_rn"), size.alias("_n"))
    third = F.floor(F.col("_n") / 3)
    first = F.col("_rn") <= third
    last = F.col("_rn") > F.col("_n") - third
    out = placed.agg(
        F.avg(F.when(first, F.col(value))).alias("first_mean"),
        F.avg(F.when(last, F.col(value))).alias("last_mean"),
        F.stddev_samp(F.when(last, F.col(value))).alias("last_std"),
        F.avg(F.when(first, F.col(reward))).alias("first_reward"),
        F.avg(F.when(last, F.col(reward))).alias("last_reward"))
    return out.withColumns({
        "improved": F.col("last_mean") > F.col("first_mean"),
        "stable": F.col("last_std") < stable_std})
