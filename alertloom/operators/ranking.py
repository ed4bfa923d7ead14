"""Ordered work inside groups that may be arbitrarily large.

A plain window over a group sorts the whole group in one task. The helpers here
split a group along its sort order into buckets, fold every bucket to one row
(with map-side combine), carry the fold across the buckets, and only sort inside
a bucket. ``bucket`` must be a coarsening of ``order`` inside every group: if row x sorts
before row y then bucket(x) <= bucket(y). ``range_bucket`` makes one of equal shares, wherever
the rows crowd.

Group and bucket travel as one struct. It is never null and equal when its fields are, so the
window and the join of the carry ask for the same partitioning: the rows are shuffled once.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

SAMPLED = 32  # sampled rows per bucket
BEFORE = (W.unboundedPreceding, -1)
THROUGH = (W.unboundedPreceding, W.currentRow)


def same_keys(left: DataFrame, right: DataFrame, keys) -> Column:
    """Null-safe equality on all keys, so that a null group stays a group."""
    return reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[k]) for k in keys])


def join_on(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Null-safe equi-join that keeps one copy of the keys."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def _combine(fold: str, carry: Column, inner: Column) -> Column:
    if fold == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(inner, F.lit(0))
    if fold == "max":
        return F.greatest(carry, inner)
    # "last": max over structs that sort by position, so the later one wins
    return F.when(inner.isNull() | (carry > inner), carry).otherwise(inner)


def range_bucket(df: DataFrame, group, order, buckets: int = None) -> Column:
    """Bucket number of a row by (group, order): ranges with about equally many rows.

    The bounds come from the ``SAMPLED`` rows per bucket with the lowest digests, read in one pass over these
    columns only; a few thousand rows reach the driver, whatever the size. Only groups larger than a bucket are
    split, and rows that crowd in one moment are split by the later columns of ``order``. Rows that agree in
    all of them stay together. ``buckets`` is the number of shuffle partitions by default.
    """
    spark = df.sparkSession
    buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = [*group, *order]
    ranked = df.select(F.struct(*columns).alias("_k"), F.xxhash64(*columns).alias("_d")).orderBy("_d").limit(SAMPLED * buckets)
    drawn = [r[0] for r in ranked.select("_k").orderBy("_k").collect()]
    bounds = [drawn[i] for i in range(SAMPLED, len(drawn), SAMPLED)]
    if not bounds:
        return F.lit(0)
    kinds = [df.select(c).schema[0].dataType for c in columns]
    literal = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(f"c{i}") for i, (v, kind) in enumerate(zip(b, kinds))]) for b in bounds])
    key = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    # binary search: as many of the bounds as do not lie above the row
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(literal, at + step - 1) <= key), at + step).otherwise(at))


def write_ranges(df: DataFrame, group, order, out: str) -> DataFrame:
    """``df`` written to the shared folder, with the bucket of every row by (group, order) as column ``out``.

    The buckets are Spark's own range partitions, as many as the size asks for. They cost a shuffle, but no search for
    the bounds in every pass, which pays for tables that are written anyway and read more than once. Rows that agree
    in all columns of group and order stay together.
    """
    return cut_lineage(df.repartitionByRange(*group, *order).withColumn(out, F.spark_partition_id()))


def running(df: DataFrame, group, bucket: Column, order, value: Column, out: str,
            fold: str = "sum", inclusive: bool = True) -> DataFrame:
    """Running fold of ``value`` per group, in two levels.

    ``fold`` is "sum", "max" (atomic values) or "last" (``value`` is a struct whose
    leading fields are the sort order; null values are skipped).
    """
    group = list(group)
    agg = F.sum if fold == "sum" else F.max
    rows = df.withColumns({"__b": _placed(group, bucket), "__v": value})
    totals = rows.groupBy("__b").agg(agg("__v").alias("__t"))
    across = W.partitionBy(F.struct(*[F.col("__b")[c] for c in group])).orderBy("__b._bucket").rowsBetween(*BEFORE)
    carry = totals.select(F.col("__b").alias("__cb"), agg("__t").over(across).alias("__c"))
    inside = W.partitionBy("__b").orderBy(*order).rowsBetween(*(THROUGH if inclusive else BEFORE))
    rows = rows.withColumn("__i", agg("__v").over(inside))
    joined = rows.join(carry, F.col("__b") == F.col("__cb"))
    return joined.withColumn(out, _combine(fold, F.col("__c"), F.col("__i"))).drop("__b", "__cb", "__v", "__i", "__c")


def _placed(group, bucket: Column) -> Column:
    return F.struct(*[F.col(c) for c in group], bucket.alias("_bucket"))


def number_rows(df: DataFrame, group, bucket: Column, order, out: str = "rn") -> DataFrame:
    """1-based row number per group, as a bigint."""
    return running(df, group, bucket, order, F.lit(1).cast("long"), out, "sum", True)


def mark_first(df: DataFrame, group, bucket: Column, order, quota, out: str = "is_first") -> DataFrame:
    """Mark the first ``quota`` rows of every group in ``order``.

    ``quota`` is a function from the group size column to the number of rows, or a
    DataFrame ``(*group, quota)``. A histogram of the buckets decides whole buckets at once;
    only rows of the one bucket per group that the quota cuts are sorted.
    """
    group = list(group)
    rows = df.withColumn("__b", _placed(group, bucket))
    hist = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).select("*", *[F.col("__b")[c].alias(c) for c in group])
    per_group = W.partitionBy(*group)
    hist = hist.withColumns({
        "__before": F.coalesce(F.sum("__n").over(per_group.orderBy("__b").rowsBetween(*BEFORE)), F.lit(0)),
        "__size": F.sum("__n").over(per_group),
    })
    if isinstance(quota, DataFrame):
        wanted = quota.select(*group, F.col("quota").cast("long").alias("__q"))
        hist = join_on(hist, wanted, group)
    else:
        hist = hist.withColumn("__q", quota(F.col("__size")).cast("long"))
    fate = hist.select(
        F.col("__b").alias("__cb"), (F.col("__q") - F.col("__before")).alias("__left"),
        F.when(F.col("__before") + F.col("__n") <= F.col("__q"), "in")
        .when(F.col("__before") >= F.col("__q"), "out").otherwise("cut").alias("__fate"))
    joined = rows.join(fate, F.col("__b") == F.col("__cb"))
    whole = joined.where("__fate <> 'cut'").withColumn(out, F.col("__fate") == "in")
    w = W.partitionBy("__b").orderBy(*order)
    cut = joined.where("__fate = 'cut'").withColumn(out, F.row_number().over(w) <= F.col("__left"))
    return whole.unionByName(cut).drop("__b", "__cb", "__left", "__fate")
