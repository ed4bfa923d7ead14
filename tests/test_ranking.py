"""Ordered work in ranges: equal buckets wherever rows crowd, one shuffle of full rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertloom.operators import ranking


@pytest.fixture(scope="module")
def crowded(spark):
    """50,000 rows of one key in one minute, two of them null, beside small groups and a null group."""
    rnd = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [("hot", start + timedelta(microseconds=rnd.randrange(60_000_000)), f"e{i:05d}", rnd.randrange(9)) for i in range(50_000)]
    rows += [(rnd.choice(["a", "b", None]), start + timedelta(hours=rnd.randrange(500)), f"s{i}", i % 7) for i in range(400)]
    rows += [("hot", None, f"n{i}", 1) for i in range(2)]
    return spark.createDataFrame(rows, "g string, ts timestamp_ntz, id string, v int")


def folded(rows):
    total, out = {}, {}
    low = datetime(1, 1, 1)
    for r in sorted(rows, key=lambda r: (r.ts or low, r.id)):
        total[r.g] = total.get(r.g, 0) + r.v
        out[r.id] = total[r.g]
    return out


def test_a_busy_minute_is_spread_and_folded_right(crowded):
    bucket = ranking.range_bucket(crowded, ["g"], ["ts", "id"], 16)
    shares = [r["count"] for r in crowded.groupBy(bucket.alias("b")).count().collect()]
    assert len(shares) == 16 and max(shares) < 3 * sum(shares) / 16
    sums = ranking.running(crowded, ["g"], bucket, ["ts", "id"], F.col("v").cast("long"), "s", "sum", True)
    assert {r.id: r.s for r in sums.collect()} == folded(crowded.collect())


def test_buckets_follow_the_order(crowded):
    bucket = ranking.range_bucket(crowded, ["g"], ["ts", "id"], 16)
    rows = crowded.where("g = 'hot'").select("ts", "id", bucket.alias("b")).collect()
    low = datetime(1, 1, 1)
    seen = [r.b for r in sorted(rows, key=lambda r: (r.ts or low, r.id))]
    assert seen == sorted(seen)


def test_rows_are_shuffled_once(spark, crowded):
    """No exchange but that of the window carries the columns of the rows, broadcasts forbidden."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucket = ranking.range_bucket(crowded, ["g"], ["ts", "id"], 16)
        out = ranking.running(crowded, ["g"], bucket, ["ts", "id"], F.col("v").cast("long"), "s", "sum", True)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # the rows, the bucket totals, the carry over the buckets, the carry to the join
    assert plan.count("Exchange hashpartitioning") == 4
    below = plan.split("SortMergeJoin")[1]
    assert below.index("Window") < below.index("Exchange")  # the join takes the rows as the window leaves them


@pytest.mark.parametrize("rows", [[], [("a", None, "x", 1)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, id string, v int")
    bucket = ranking.range_bucket(df, ["g"], ["ts", "id"])
    assert [r.n for r in ranking.number_rows(df, ["g"], bucket, ["ts", "id"], "n").collect()] == [1] * len(rows)
