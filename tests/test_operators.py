"""Ordered work, bursts, samples and pairs against plain Python, with one group far larger than the rest."""

import collections
import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import bursts, campaigns, checks, pairing, ranking, sampling
from alertloom.plans import check_queries

T0 = dt.datetime(2024, 1, 1)


def skewed(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [("big" if rnd.random() < 0.5 else rnd.choice(["a", "b", None]), T0 + dt.timedelta(minutes=rnd.randrange(600)), f"e{i:03d}", i)
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, ts timestamp_ntz, id string, v long")


def by_group(rows):
    groups = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[r[0]].append(r)
    return groups


def test_number_rows_and_running_folds(spark):
    rows, df = skewed(spark)
    hour = F.date_trunc("hour", F.col("ts"))
    numbered = {r.id: r.rn for r in ranking.number_rows(df, ["g"], hour, ["ts", "id"]).collect()}
    top = {r.id: r.m for r in ranking.running(df, ["g"], hour, ["ts", "id"], F.col("v"), "m", "max", False).collect()}
    last = ranking.running(df, ["g"], hour, ["ts", "id"], F.when(F.col("v") % 7 == 0, F.struct("ts", "id")), "p", "last", False)
    last = {r.id: r.p and r.p.id for r in last.collect()}
    for group in by_group(rows).values():
        for i, r in enumerate(group):
            assert numbered[r[2]] == i + 1
            assert top[r[2]] == max((x[3] for x in group[:i]), default=None)
            assert last[r[2]] == next((x[2] for x in reversed(group[:i]) if x[3] % 7 == 0), None)


@pytest.mark.parametrize("quota", [0, 1, 37, 1000])
def test_mark_first(spark, quota):
    rows, df = skewed(spark)
    marked = ranking.mark_first(df, ["g"], F.date_trunc("hour", F.col("ts")), ["ts", "id"], lambda n: F.least(n, F.lit(quota)))
    got = {r.id for r in marked.where("is_first").collect()}
    assert marked.count() == len(rows)
    assert got == {r[2] for g in by_group(rows).values() for r in g[:quota]}


def test_split_is_disjoint_complete_and_in_order(spark):
    rows, df = skewed(spark)
    out = {r.id: r.split for r in sampling.chronological_split(df, ["g"], "ts", "id").collect()}
    assert set(out) == {r[2] for r in rows}
    for group in by_group(rows).values():
        cut = int(len(group) * 0.7)
        assert [out[r[2]] for r in group] == ["train"] * cut + ["test"] * (len(group) - cut)


def test_sample_is_the_lowest_digests(spark):
    rows, df = skewed(spark)
    got = {r.id for r in sampling.exact_sample(df, ["g"], lambda n: F.least(n, F.lit(20)), "id").collect()}
    digest = lambda r: hashlib.md5(f"42|{r[2]}".encode()).hexdigest()
    assert got == {r[2] for g in by_group(rows).values() for r in sorted(g, key=digest)[:20]}


def test_given_manifest_is_used(spark):
    manifest = spark.createDataFrame([("c1", "val"), ("c2", "train")], "campaign_id string, split string")
    assert sampling.campaign_split(None, manifest=manifest).collect() == manifest.collect()


def flood_rows(seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(300):
        link = rnd.random() < 0.3
        rows.append((f"e{i:03d}", T0 + dt.timedelta(milliseconds=rnd.randrange(5000)), f"s{rnd.randrange(40)}",
                     f"d{rnd.randrange(3)}", "flood", link, f"c{rnd.randrange(2)}" if link else "NONE", rnd.choice("xyz")))
    rows += [(f"q{i}", T0 + dt.timedelta(seconds=i), "s", "d", "calm", False, "NONE", "x") for i in range(200)]
    return rows


FLOOD = ("event_id string, timestamp timestamp_ntz, src_ip string, dst_ip string, kind string, is_campaign_link boolean, "
         "campaign_id string, predicted_attack_type string")


def test_bursts_by_hand(spark):
    rows = flood_rows()
    out = bursts.aggregate_bursts(spark.createDataFrame(rows, FLOOD), ["kind"]).collect()
    assert sum(r.event_count for r in out) == len(rows)
    calm = [r for r in out if r.kind == "calm"]
    assert len(calm) == 200 and all(r.event_count == 1 and r.predicted_attack_type_agreement == 1.0 for r in calm)
    bins = collections.defaultdict(list)
    for r in rows:
        if r[4] == "flood":
            bins[r[1].replace(microsecond=0)].append(r)
    top = lambda values: min(collections.Counter(values).items(), key=lambda kv: (-kv[1], kv[0]))
    got = {r.timestamp: r for r in out if r.kind == "flood"}
    assert set(got) == set(bins)
    for at, members in bins.items():
        members.sort(key=lambda r: (r[1], r[0]))
        row, linked = got[at], [m for m in members if m[5]]
        vote = top(m[7] for m in members)
        assert row.src_ip == f"MULTI(n={len({m[2] for m in members})})" and row.dst_ip == top(m[3] for m in members)[0]
        assert row.event_id == members[0][0] and row.is_campaign_link == bool(linked)
        assert row.campaign_id == (linked[0][6] if linked else "NONE")
        assert row.predicted_attack_type == vote[0]
        assert row.predicted_attack_type_agreement == pytest.approx(vote[1] / len(members))


def test_gaps_of_sixty_and_sixty_one_minutes(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("d", "f1", at(0)), ("d", "f1", at(30)), ("d", "f2", at(90)), ("d", "f3", at(10)), ("d", "f4", at(151)), ("e", "f1", at(0))]
    out = campaigns.label_by_time_gaps(spark.createDataFrame(rows, "day string, source_file string, timestamp timestamp_ntz"), prefix="x_")
    assert {(r.day, r.source_file): r.campaign_id for r in out.collect()} == {
        ("d", "f1"): "x_d_c0", ("d", "f2"): "x_d_c0", ("d", "f3"): "x_d_c0", ("d", "f4"): "x_d_c1", ("e", "f1"): "x_e_c0"}


def test_pools_are_whole_and_bounded(spark):
    """Sampled distractors equal the lowest digests of the full range, edge hours included."""
    rnd = random.Random(9)
    rows = []
    for i in range(900):
        at = T0 + dt.timedelta(seconds=rnd.randrange(86_400))
        inside = 5 * 3600 + 1200 <= (at - T0).total_seconds() <= 9 * 3600 + 100
        rows.append((f"e{i:03d}", at, "c1" if inside and rnd.random() < 0.4 else "NONE", at.date()))
    df = spark.createDataFrame(rows, "event_id string, timestamp timestamp_ntz, campaign_id string, day date")
    df = df.withColumns({c: F.lit("x") for c in ("src_ip", "dst_ip", "service", "predicted_attack_type", "predicted_kill_chain_stage")})
    camp = sorted((r for r in rows if r[2] == "c1"), key=lambda r: (r[1], r[0]))
    reach = [r for r in rows if r[2] == "NONE" and camp[0][1] <= r[1] <= camp[-1][1] + dt.timedelta(minutes=30)]
    digest = lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest()
    n_true = min(len(camp), 36)
    want = {camp[0][0]} | {r[0] for r in sorted(camp[1:], key=digest)[:n_true - 1]}
    want |= {r[0] for r in sorted(reach, key=digest)[:60 - n_true]}
    pool = pairing.episode_pool(df).collect()
    assert {r.event_id for r in pool} == want and len(pool) == len(want) <= 60
    assert pairing.distractors_in_range(df).count() == len(reach)
    pairs = pairing.pool_pairs(pairing.episode_pool(df)).collect()
    assert len(pairs) == len([r for r in pool if (r.timestamp, r.event_id) > (camp[0][1], camp[0][0])])


def campaign_rows(spark):
    """Crowded moments, events without a time, an id or a campaign, rows that come twice, a campaign of one event."""
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *(f"e{i}" for i in range(300))]), rnd.choice([None] + [T0 + dt.timedelta(minutes=rnd.randrange(3000))] * 9),
             rnd.choice(["a", "b", "NONE", None])) for _ in range(300)]
    rows += [(f"x{i}", T0 + dt.timedelta(minutes=9 + i // 40), "big") for i in range(400)] + [("only", T0, "one")]
    rows = [(i, at, c, at and at.date()) for i, at, c in rows + rows[:50]]
    df = spark.createDataFrame(rows, "event_id string, timestamp timestamp_ntz, campaign_id string, day date")
    return rows, df.withColumns({c: F.lit("x") for c in ("src_ip", "dst_ip", "service", "predicted_attack_type", "predicted_kill_chain_stage")})


def nulls_first(*values):
    return [(v is not None, v if v is not None else 0) for v in values]


def test_spans_are_found_by_hashing(spark, monkeypatch):
    """No sort sees all events of a campaign; the first event is that of the order, without a time first."""
    rows, df = campaign_rows(spark)
    written, cut = [], pairing.campaign_spans.__globals__.get("cut_lineage")
    monkeypatch.setattr(pairing, "cut_lineage", lambda x: written.append(x._jdf.queryExecution().executedPlan().toString()) or cut(x), raising=False)
    found = {r.campaign_id: (r.n_events, r.first_id, r.day, r.start, r.end) for r in pairing.campaign_spans(df).collect()}
    want = {}
    for c in ("a", "b", "big"):
        own = sorted((r for r in rows if r[2] == c), key=lambda r: nulls_first(r[1], r[0], r[3]))
        want[c] = (len(own), own[0][0], own[0][3], own[0][1], max(r[1] for r in own if r[1]))
    assert found == want
    assert written and "HashAggregate" in written[0] and "Sort" not in written[0]


def test_low_digests_are_counted_not_sorted(spark):
    rows, df = campaign_rows(spark)
    hashed = df.where("campaign_id <> 'NONE' AND event_id IS NOT NULL").withColumn("_h", F.md5(F.concat(F.lit("42|"), "event_id")))
    for k in (1, 35, 1000):
        low = pairing._low_digests(hashed, k)
        kept = collections.Counter((r.campaign_id, r._h) for r in low.collect())
        for c in ("a", "b", "big", "one"):
            every = sorted(hashlib.md5(f"42|{r[0]}".encode()).hexdigest() for r in rows if r[2] == c and r[0] is not None)
            mine = sorted(kept_h for (camp, kept_h), n in kept.items() if camp == c for _ in range(n))
            assert mine == every[:len(mine)] and min(k, len(every)) <= len(mine) <= k + 12
        assert "Sort" not in low._jdf.queryExecution().executedPlan().toString()


def test_whole_pairs_take_the_latest_member(spark):
    """Members and distractors in ranges that Spark draws, against the plain order."""
    rows, df = campaign_rows(spark)
    rows = [r for r in rows if r[0] is not None]
    found = pairing.whole_pairs(df.where("event_id IS NOT NULL"), spark.createDataFrame([("big",)], "campaign_id string"))
    camp = [r for r in rows if r[2] == "big"]
    start, end = min(r[1] for r in camp), max(r[1] for r in camp) + dt.timedelta(minutes=30)
    pool = [(*r[:2], True) for r in camp] + [(*r[:2], False) for r in rows if r[2] == "NONE" and r[1] and r[3] == start.date() and start <= r[1] <= end]
    anchor, want = None, []
    for i, at, member in sorted(pool, key=lambda r: (r[1], r[0])):
        if anchor is not None:
            want.append((anchor, i, member))
        anchor = i if member else anchor
    assert sorted((r.anchor_id, r.candidate_id, r.true_link) for r in found.collect()) == sorted(want) and len(want) > 399


def test_reconcile_counts_absent_keys_as_zero(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, n_list long")
    right = spark.createDataFrame([("a", 1), ("b", 5), ("d", 6), (None, 7)], "k string, n_xml long")
    found = checks.reconcile(left, right, "k")
    assert {tuple(r) for r in found.collect()} == {("b", 2, 5), ("c", 3, 0), ("d", 0, 6), (None, 4, 7)}
    asked = checks.reconcile(left, right, "k", keys=left.sparkSession.createDataFrame([("a",), ("d",), ("e",)], "k string"))
    assert {tuple(r) for r in asked.collect()} == {("d", 0, 6)}


def test_reconcile_counts_query_has_days_of_one_side(spark, sf_dir):
    days = lambda t, c: {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").groupBy(c).count().collect()}
    orders, items = days("orders", "o_orderdate"), days("lineitem", "l_shipdate")
    want = {(d, orders.get(d, 0), items.get(d, 0)) for d in {*orders, *items} if orders.get(d, 0) != items.get(d, 0)}
    assert {tuple(r) for r in check_queries.reconcile_counts(spark, sf_dir).collect()} == want
    assert any(a == 0 for _, a, _ in want)

def test_bursts_sort_few_rows(spark):
    """Counting hashes: no sort stands between the rows and their cells, and wide rows are carried for a bin's first only."""
    rows = spark.createDataFrame(flood_rows(), FLOOD)
    rules = bursts.BurstRules(rows.schema, ["kind"])
    plan = rules._votes(rows)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan
    whole = rules._whole(rows)
    assert whole.count() == whole.select("kind", "_bin").distinct().count() and whole.agg(F.sum("n")).first()[0] == rows.count()


def test_bursts_first_row_among_equal_times(spark):
    """Ids that agree in their leading bytes, are empty or null, and rows without time or votes."""
    at = T0
    ids = ["abcdefghij2", "abcdefghij10", "abcdefghij1", "abcdefghij"]
    rows = [(i, at, None, None, "f", i == ids[0], f"c{i}", None) for i in ids] + [(i, None, "a", None, "f", None, "x", None) for i in ("", None, "z")]
    out = bursts.aggregate_bursts(spark.createDataFrame(rows, FLOOD), ["kind"], threshold=2).collect()
    got = {r.timestamp: r for r in out}
    assert set(got) == {at, None}
    assert got[at].event_id == "abcdefghij" and got[at].campaign_id == "cabcdefghij2" and got[at].is_campaign_link and got[at].event_count == 4
    assert got[at].src_ip is None and got[at].dst_ip == "MULTI(n=0)" and got[at].predicted_attack_type is None
    assert got[None].event_id is None and got[None].event_count == 3 and got[None].campaign_id == "NONE" and not got[None].is_campaign_link
