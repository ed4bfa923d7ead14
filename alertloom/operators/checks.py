"""Leakage and data-quality checks. The tables are lazy; ``assert_*`` look at a few rows only."""

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import schema as S
from ..functions.lookup import is_mapped_label


class LeakageError(AssertionError):
    pass


def campaign_overlap(train: DataFrame, test: DataFrame, key="campaign_id") -> DataFrame:
    return train.select(key).intersect(test.select(key))


def assert_no_campaign_leakage(train: DataFrame, test: DataFrame, key="campaign_id", context="") -> dict:
    shared = campaign_overlap(train, test, key)
    sample = [r[0] for r in shared.orderBy(key).limit(10).collect()]
    if sample:
        raise LeakageError(f"campaigns on both sides of the split {context}: {shared.count()}, first {sample}")
    count = lambda df: df.agg(F.count_distinct(key)).first()[0]
    return {"train_campaigns": count(train), "test_campaigns": count(test), "overlap": 0}


def sources_present(df: DataFrame, col="source_dataset") -> DataFrame:
    return df.select(col).distinct()


def test_only_violation(df: DataFrame, sources=S.TEST_ONLY_SOURCES, col="source_dataset") -> DataFrame:
    return sources_present(df, col).where(F.col(col).isin(list(sources)))


def assert_no_test_only_rows(df: DataFrame, sources=S.TEST_ONLY_SOURCES, col="source_dataset", context="") -> dict:
    found = [r[0] for r in test_only_violation(df, sources, col).orderBy(col).collect()]
    if found:
        raise LeakageError(f"test-only sources in training rows {context}: {found}")
    return {"test_only_sources": sorted(sources), "violation": None}


def duplicate_ids(df: DataFrame, id_col="event_id") -> DataFrame:
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique_ids(df: DataFrame, id_col="event_id") -> None:
    sample = duplicate_ids(df, id_col).limit(10).collect()
    if sample:
        raise ValueError(f"repeated {id_col}: {[r[0] for r in sample]}")


def unmapped_labels(df: DataFrame, label="label") -> DataFrame:
    """Labels that would silently fall to the unknown stage."""
    return df.where(~is_mapped_label(F.col(label))).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def null_group_rows(df: DataFrame, group_cols) -> DataFrame:
    """How many rows have a null in a grouping column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in group_cols])


def identity_audit(df: DataFrame, class_col: str, value_col: str) -> DataFrame:
    """Dominant value of a column per class and its share: a share near 1 that differs
    between classes means the column gives the class away."""
    counts = df.groupBy(class_col, value_col).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(value_col).alias("v")))
    per_class = counts.groupBy(class_col).agg(
        best.alias("_b"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values"))
    return per_class.select(
        class_col, F.col("_b.v").alias("top_value"), (-F.col("_b.neg")).alias("n_top"), "n_rows", "n_values",
        (-F.col("_b.neg") / F.col("n_rows")).alias("top_share"))


def constant_features(pairs: DataFrame, features) -> DataFrame:
    """One row per feature with its number of distinct values. A first pass keeps distinct
    (feature, value) rows, so that no task sees more than the values of a feature."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    values = pairs.select(F.explode(entries).alias("e")).select("e.feature", "e.v").distinct()
    return values.groupBy("feature").agg(F.count("v").alias("n_values")).withColumn(
        "is_constant", F.col("n_values") <= 1)


def reconcile(left: DataFrame, right: DataFrame, key, left_n="n_list", right_n="n_xml", keys: DataFrame = None) -> DataFrame:
    """Keys whose counts differ; a side that lacks a key counts 0 there, and a null key is a key.

    ``keys`` lists the keys that must have a count; without it they are those of either side.
    """
    key = [key] if isinstance(key, str) else list(key)
    none = F.lit(0).cast("long")
    sides = left.select(*key, left_n, none.alias(right_n)).unionByName(right.select(*key, none.alias(left_n), right_n))
    both = sides.groupBy(*key).agg(F.sum(left_n).alias(left_n), F.sum(right_n).alias(right_n))
    if keys is not None:
        both = both.join(keys, key, "left_semi")
    return both.where(F.col(left_n) != F.col(right_n))


def inventory_problems(inventory: DataFrame, expected: DataFrame) -> DataFrame:
    """Problems of a capture inventory: (scenario, vantage, phase, dump_bytes, list_bytes, truth_xml_bytes).

    ``expected`` lists the (scenario, vantage) pairs that should exist.
    """
    where = ["scenario", "vantage"]
    phases = inventory.groupBy(*where).agg(F.count_distinct("phase").alias("n_phases"))
    absent = expected.join(phases, where, "left_anti").select(
        *where, F.lit(None).cast("int").alias("phase"), F.lit("directory missing").alias("problem"))
    thin = phases.where("n_phases < 2").select(
        *where, F.lit(None).cast("int").alias("phase"), F.lit("fewer than 2 phases").alias("problem"))
    rules = F.array_compact(F.array(
        F.when(F.coalesce("dump_bytes", F.lit(0)) == 0, F.lit("dump is empty")),
        F.when(F.col("truth_xml_bytes").isNull(), F.lit("truth is missing")),
        F.when(F.col("truth_xml_bytes") == 0, F.lit("truth is empty"))))
    per_phase = inventory.select(*where, "phase", F.explode(rules).alias("problem"))
    return absent.unionByName(thin).unionByName(per_phase)


def leak_scan(df: DataFrame, class_col: str, columns) -> DataFrame:
    """How much every column gives away of the class, all columns at once, the most telling first by ``rank``.

    One table of (column, value, class) counts, combined before its only large shuffle, serves all measures:
    ``one_rule_accuracy`` is the share of rows that the majority class of their value gets right,
    ``conditional_entropy`` the bits left of the class once the value is known, next to ``base_accuracy`` and
    ``entropy`` without the column. ``rows_per_value`` tells identifiers, where every value is new, from codes.
    A null value is a value, a null class a class.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    cells = df.select(F.col(class_col).alias("_y"), F.explode(entries).alias("_e")).groupBy("_e.column", "_e.value", "_y").agg(
        F.count(F.lit(1)).alias("n"))
    spread = lambda n: F.col(n) * F.log2(n)
    values = cells.groupBy("column", "value").agg(F.sum("n").alias("n"), F.max("n").alias("_top"), F.sum(spread("n")).alias("_inner"))
    scores = values.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_rows"), F.sum("_top").alias("_top"),
        F.sum(spread("n") - F.col("_inner")).alias("_bits"))
    classes = df.groupBy(F.col(class_col).alias("_y")).agg(F.count(F.lit(1)).alias("n"))
    whole = classes.agg(F.struct(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum(spread("n")).alias("inner"))).scalar()
    known = scores.withColumn("_w", whole)
    total = F.col("_w.n")
    out = known.select(
        "column", "n_values", (F.col("n_rows") / F.col("n_values")).alias("rows_per_value"),
        (F.col("_w.top") / total).alias("base_accuracy"), (F.col("_top") / F.col("n_rows")).alias("one_rule_accuracy"),
        (F.log2(total) - F.col("_w.inner") / total).alias("entropy"), F.greatest(F.col("_bits") / F.col("n_rows"), F.lit(0.0)).alias("conditional_entropy"))
    order = W.orderBy(F.round("conditional_entropy", 9), F.desc("one_rule_accuracy"), "column")
    return out.withColumn("rank", F.row_number().over(order))  # a row per column of the table
