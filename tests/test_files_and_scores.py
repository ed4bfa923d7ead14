"""Flow files of several headers, repeatable sinks, range tiles, leak scan, compiled forests, final evaluation."""

import datetime as dt
import glob
import json
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alertloom.functions.temporal import TILE_SECONDS, cover, tiles_of
from alertloom.functions.trees import forest_decision, forest_probability
from alertloom.operators import checks, history, linker, metrics, pairing, sampling
from alertloom.plans import evaluation
from alertloom.plans.alerts import alerts
from alertloom.sources import flows, tables

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "portscan.csv").write_text("flow_id,timestamp,src_ip,rate,label\nf1,2017-07-07 10:00:00,x,1.5,A\nf2,2017-07-07 10:00:01,y\n")
    (tmp_path / "b.csv").write_text("\ufefflabel, rate ,src_ip,timestamp,flow_id\nB,2.5,z,07/07/2017 11:00:00,f3\n,,,,\nB,2.5,z,07/07/2017 11:00:00,f4,more\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("flow_id,timestamp,src_ip,rate,rate,label\nf5,2017-07-07 12:00:00,w,3,4,C\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head_only.csv").write_text("flow_id,timestamp,label\n")
    return str(tmp_path)


def test_files_are_read_by_their_headers(spark, files):
    rows = {r.flow_id: r for r in flows.read_flows(spark, files).collect()}
    assert set(rows) == {"f1", "f3", "f5"}
    assert (rows["f1"].src_ip, rows["f1"].label, rows["f1"].day, rows["f1"].rate_4) == ("x", "A", "fri", None)
    assert (rows["f3"].src_ip, rows["f3"].rate, rows["f3"].label, rows["f3"].timestamp) == ("z", "2.5", "B", dt.datetime(2017, 7, 7, 11))
    assert (rows["f5"].rate, rows["f5"].rate_4) == ("3", "4")


def test_dropped_records_have_reasons(spark, files):
    found = {tuple(r) for r in flows.dropped_records(flows.read_flow_records(spark, files)).collect()}
    assert found == {("portscan.csv", "wrong number of fields", 1), ("b.csv", "blank record", 1), ("b.csv", "wrong number of fields", 1)}
    known = flows.read_flow_records(spark, files, None)
    assert {r.reason for r in known.where("source_file = 'c.csv'").collect()} == {"unlisted file"}


def test_no_files(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    assert flows.read_flows(spark, str(tmp_path)).count() == 0


def test_events_are_written_repeatably_and_evenly(spark, tmp_path):
    rows = [(f"e{i}", "big" if i % 10 else f"s{i % 3}", i) for i in range(20_000)]
    events = spark.createDataFrame(rows, "event_id string, source_dataset string, v int")
    path = str(tmp_path / "events")
    for _ in range(2):
        tables.write_events(events, path, 2000)
        assert sorted(map(tuple, tables.read_events(spark, path).select("event_id", "source_dataset", "v").collect())) == sorted(rows)
    sizes = [os.path.getsize(f) for f in glob.glob(f"{path}/source_dataset=big/*.parquet")]
    assert len(sizes) >= 9 and sorted(sizes)[1] > 0.5 * max(sizes)
    tables.write_events(events.where("source_dataset = 's0'").limit(5), path, 2000)
    left = Counter(r[0] for r in tables.read_events(spark, path).select("source_dataset").collect())
    assert left["s0"] == 5 and left["big"] == 18_000


def test_tiles_cover_a_range_once(spark):
    rnd = random.Random(3)
    spans = [(i, T0 + dt.timedelta(microseconds=(a := rnd.randrange(4 * 10**11))), T0 + dt.timedelta(microseconds=a + rnd.choice([0, 1, 10**6, 10**8, 10**10, 3 * 10**11]) + rnd.randrange(10**7)))
             for i in range(60)]
    at = sorted({t for _, a, b in spans for t in (a, b, a - dt.timedelta(microseconds=1), b + dt.timedelta(microseconds=1))} | {T0 + dt.timedelta(seconds=rnd.randrange(500_000)) for _ in range(400)})
    reach = spark.createDataFrame(spans, "i int, start timestamp_ntz, end timestamp_ntz").select("i", "start", "end", F.explode(cover(F.col("start"), F.col("end"))).alias("t"))
    reach = reach.select("i", "start", "end", F.struct("t.level", "t.number").alias("tile"), "t.whole")
    moments = spark.createDataFrame([(t,) for t in at], "at timestamp_ntz").withColumn("tile", F.explode(tiles_of(F.col("at"))))
    hit = Counter(tuple(r) for r in reach.join(moments, "tile").where("whole OR at BETWEEN start AND end").select("i", "at").collect())
    assert hit == Counter((i, t) for i, a, b in spans for t in at if a <= t <= b)
    assert max(r.n for r in reach.groupBy("i").agg(F.count("tile").alias("n")).collect()) <= 2 + 6 * len(TILE_SECONDS)


def test_leak_scan(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("aab"), rnd.randrange(4), f"id{i}") for i in range(500)]
    rows = [(y, {"a": "A", "b": "B"}[y], n, i, None if n else y) for y, n, i in rows]
    found = checks.leak_scan(spark.createDataFrame(rows, "y string, same string, noise int, id string, half string"), "y", ["noise", "same", "id", "half"]).collect()
    by = {r.column: r for r in found}
    assert [r.column for r in sorted(found, key=lambda r: r.rank)][:2] == ["id", "same"] and by["noise"].rank == 4
    assert by["same"].rows_per_value > 100 and by["id"].rows_per_value == 1

    def bits(counts):
        n = sum(counts)
        return -sum(c / n * math.log2(c / n) for c in counts)

    groups = {}
    for y, _, noise, _, _ in rows:
        groups.setdefault(noise, Counter())[y] += 1
    want = sum(sum(c.values()) / 500 * bits(c.values()) for c in groups.values())
    assert abs(by["noise"].conditional_entropy - want) < 1e-9
    assert abs(by["noise"].entropy - bits(Counter(r[0] for r in rows).values())) < 1e-9
    assert by["noise"].one_rule_accuracy == sum(max(c.values()) for c in groups.values()) / 500


def test_compiled_forest_votes_like_the_model(spark, sf_dir):
    events = alerts(spark, sf_dir)
    found, held_out = linker.train_and_validate(events, sampling.campaign_split(events), train=lambda p, c: linker.train_forest_linker(p, c, trees=7, depth=4))
    votes = linker.forest_votes(found, held_out).first()
    assert votes.n_pairs == held_out.count() > 0 and votes.n_differ == 0 and votes.n_far == 0


def test_history_is_made_written_and_read(spark, sf_dir, tmp_path):
    events = alerts(spark, sf_dir)
    split = sampling.campaign_split(events)
    tables.write_csv(split, str(tmp_path / "split.csv"))
    tables.write_table(split, str(tmp_path / "split"))
    again = tables.read_split(spark, str(tmp_path / "split.csv"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, tables.read_split(spark, str(tmp_path / "split")).collect()))
    made = linker.training_history(events, again, (1, 3, 9))
    tables.write_table(made, str(tmp_path / "history"))
    per = spark.read.parquet(str(tmp_path / "history")).groupBy("checkpoint").agg(F.avg("f1").alias("f1"), F.sum("total_reward").alias("reward"))
    whole = history.drop_missing(per.unionByName(spark.createDataFrame([(99, None, 0.0)], per.schema)), "f1")
    r = history.thirds(whole, "f1", "reward", "checkpoint").first()
    by = {x.checkpoint: x for x in whole.collect()}
    assert set(by) == {1, 3, 9} and (r.first_mean, r.last_reward) == (by[1].f1, by[9].reward)


def test_history_judges_all_checkpoints_in_one_pass(spark, sf_dir, monkeypatch):
    """One tally of the held-out pairs, with the outcomes of every checkpoint's own model."""
    events = alerts(spark, sf_dir)
    split = sampling.campaign_split(events)
    tally, passes = linker.evaluate_linker, []
    monkeypatch.setattr(linker, "evaluate_linker", lambda *a, **k: passes.append(a) or tally(*a, **k))
    made = linker.training_history(events, split, (9, 1, 1))
    columns = ["campaign_id", "n_steps", "tp", "fp", "fn", "tn"]
    found = sorted(map(tuple, made.select("checkpoint", *columns).collect()))
    assert len(passes) == 1
    _, held_out = linker.train_and_validate(events, split)
    pairs = pairing.training_pairs(events).join(split.where("split = 'train'"), "campaign_id", "left_semi")
    want = []
    for n in (9, 1, 1):
        alone = tally(linker.train_linker(pairs, max_iter=n), held_out, ["campaign_id"])
        want += [(n, *r) for r in alone.select(*columns).collect()]
    assert found == sorted(want) and len({r[3] for r in found}) > 1


def test_score_decision_prefers_no_link_in_a_tie(spark):
    from alertloom.functions.pairs import score_decision

    decide = score_decision(lambda a, c: a["v"], lambda a, c: c["v"])
    df = spark.createDataFrame([(1, 1), (2, 1), (1, 2)], "x int, y int").select(F.struct(F.col("x").alias("v")).alias("a"), F.struct(F.col("y").alias("v")).alias("c"))
    assert [r.d for r in df.select(decide(F.col("a"), F.col("c")).alias("d")).collect()] == [False, True, False]


def test_tree_expressions(spark):
    trees = [("time_delta_norm", 0.5, 0.25, ("same_service", 0.5, 0.5, 1.0)), 0.75]
    df = spark.createDataFrame([(0.5, 1.0), (0.6, 0.0), (0.6, 1.0)], "time_delta_norm double, same_service double")
    p = forest_probability(trees, {c: F.col(c) for c in df.columns})
    assert [r.p for r in df.select(p.alias("p")).collect()] == [0.5, 0.625, 0.875]
    assert callable(forest_decision(trees))


def test_final_evaluation(spark, sf_dir, tmp_path):
    events = alerts(spark, sf_dir)
    deciders = {"one": lambda e: e.select("event_id", F.lit("k").alias("cluster_id")),
                "some": lambda e: e.where("is_campaign_link").select("event_id", F.col("campaign_id").alias("cluster_id"))}
    scores, complete = evaluation.final_evaluation(events, deciders, str(tmp_path), ideal=True)
    rows = {r.method: r for r in scores.collect()}
    lost = events.where("NOT is_campaign_link").count()
    assert rows["some"].n_unassigned == lost and rows["one"].n_unassigned == 0 and rows["some"].f1 == 1.0
    assert abs(rows["one - some"].f1 - (rows["one"].f1 - 1.0)) < 1e-12 and rows["one - some"].n_clusters is None
    written = tables.read_events(spark, f"{tmp_path}/events")
    assert written.count() == events.count() and written.where("some_predicted_cluster IS NULL").count() == lost
    assert written.where("predicted_attack_type <> attack_type").count() == 0
    documents = [json.loads(line) for f in glob.glob(f"{tmp_path}/metrics/scores/*.json") for line in open(f)]
    assert {d["method"]: d["pairwise"]["f1"] for d in documents} == {m: rows[m].f1 for m in deciders}
    assert complete.select("method").distinct().count() == 2


def test_repeated_ids_stop_an_evaluation(spark, sf_dir, tmp_path):
    events = alerts(spark, sf_dir)
    with pytest.raises(ValueError):
        evaluation.final_evaluation(events.union(events.limit(1)), {}, str(tmp_path))


def test_null_labels_stay_labels(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a"), (None, None)], "t string, p string")
    support = {r.t: (r.train_n, r.test_n) for r in metrics.class_support(df, df.limit(0), "t").collect()}
    assert support == {"a": (1, 0), None: (2, 0)}
    cells = metrics.confusion(df, "t", "p")
    assert {(r.true_label, r.predicted_label): r.share for r in metrics.row_normalized(cells).collect()} == {("a", "a"): 1.0, (None, "a"): 0.5, (None, None): 0.5}
    assert metrics.dense_confusion(cells).count() == 4


def test_many_files_need_few_tasks(spark, tmp_path, monkeypatch):
    """A task writes several files once there are more than ``WRITERS``; no file is larger than asked for."""
    monkeypatch.setattr(tables, "WRITERS", 3)
    path = str(tmp_path / "events")
    events = spark.range(1000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("source_dataset"))
    for _ in range(2):
        tables.write_events(events, path, 20)
    back = tables.read_events(spark, path)
    assert sorted(map(tuple, back.select(*events.columns).collect())) == sorted(map(tuple, events.collect()))
    files = back.groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) >= 50 and max(r["count"] for r in files) <= 20
    assert len({r.f.split("/")[-1].split("-")[1] for r in files}) <= 3


def test_evaluation_joins_clusters_once(spark, tmp_path, monkeypatch):
    """The sink gets a written table, since it counts, samples and writes; unassigned events stay and are told from null clusters."""
    given = []
    monkeypatch.setattr(tables, "write_events", lambda df, path: given.append((hasattr(df, "_cut_path"), df.count())))
    events = spark.createDataFrame([("e1", "c1", "recon"), ("e2", "c1", "recon"), ("e3", "c2", "recon")], "event_id string, campaign_id string, kill_chain_stage string")
    found = spark.createDataFrame([("e1", "k"), ("e2", None)], "event_id string, cluster_id string")
    tables.write_reconstruction(events, {"one": found}, str(tmp_path))
    assert given == [(True, 3)]
    attached = {r.event_id: (r.cluster_id, r._assigned) for r in evaluation.attach_once(events, found).collect()}
    assert attached == {"e1": ("k", True), "e2": (None, True), "e3": (None, None)}
