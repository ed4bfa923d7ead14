"""Raw files to unified events: session captures, flow files, sinks."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom import schema as S
from alertloom.functions import lookup, text
from alertloom.operators import checks, identifier as I
from alertloom.plans import flow_feed, session_feed
from alertloom.sources import flows, sessions, tables


def line(seq, clock, src, dst, service="telnet", sport="1024", dport="23"):
    return f"   {seq} 03/07/2000 {clock} 00:00:01 {service} {sport} {dport} {src} {dst} 0 x"


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    """Two scenarios; the first has both vantages, a dead-end probe, a flood, a junk line, a count mismatch."""
    root = tmp_path_factory.mktemp("captures")

    def put(scenario, vantage, phase, lines, n_xml=None, dump=b"x"):
        folder = root / scenario / scenario / "data_and_labeling" / vantage
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"phase-{phase}.list").write_bytes(("\n".join(lines) + "\n").encode() + b"\xff\xfe junk\n")
        (folder / f"{vantage}-phase-{phase}-dump").write_bytes(dump)
        if n_xml is not None:
            (folder / f"mid-level-phase-{phase}.xml").write_text("<Alerts>" + "<Alert a='1'/> " * n_xml + "</Alerts>")

    one, attacker, victim, dead = "LLS_DDOS_1.0", "202.077.162.213", "172.016.115.020", "172.016.113.099"
    put(one, "tcpdump_inside", 1, [line(1, "09:51:36", attacker, victim, "eco/i", "-", "-"), line(2, "09:51:37", attacker, dead),
                                   "not a session line"], 2)
    put(one, "tcpdump_inside", 4, [line(1, "10:50:00", attacker, victim)], 3, dump=b"")
    flood = [line(i, f"11:26:{i % 3:02d}", f"1.2.{i // 200}.{i % 200}", "131.084.001.031", "udp") for i in range(300)]
    put(one, "tcpdump_inside", 5, flood)
    put("LLS_DDOS_2.0.2", "tcpdump_dmz", 1, [line(1, "15:00:00", attacker, victim)], 1)
    return str(root)


def test_session_feed(spark, captures):
    events = session_feed.session_events(spark, captures)
    assert events.columns == S.UNIFIED_COLUMNS + ["scenario", "phase", "event_count"]
    rows = {r.event_id: r for r in events.collect()}
    hit, miss = rows["LLS_DDOS_1.0_inside_p1_1"], rows["LLS_DDOS_1.0_inside_p1_2"]
    assert (hit.src_ip, hit.dst_ip, hit.src_port, hit.service) == ("202.77.162.213", "172.16.115.20", None, "eco/i")
    assert hit.campaign_id == "LLS_DDOS_1.0" and hit.is_campaign_link and hit.kill_chain_stage == "recon"
    assert miss.campaign_id == "NONE" and not miss.is_campaign_link and miss.src_port == 1024.0
    assert hit.source_dataset == "darpa2000_lldos1.0"
    bins = [r for r in rows.values() if "_agg_" in r.event_id]
    assert sorted(r.event_id[-1] for r in bins) == ["0", "1", "2"] and sum(r.event_count for r in bins) == 300
    assert all(r.src_ip == "MULTI(n=100)" and r.dst_ip == "131.84.1.31" and r.src_port is None for r in bins)
    assert rows["LLS_DDOS_2.0.2_dmz_p1_1"].campaign_id == "NONE"


def test_counts_and_rejects(spark, captures):
    bad = [(r.scenario, r.phase, r.n_list, r.n_xml) for r in session_feed.count_mismatches(spark, captures).collect()]
    assert bad == [("LLS_DDOS_1.0", 4, 1, 3)]
    rejected = sessions.rejected_lines(sessions.read_session_lines(spark, captures)).where("phase = 1 AND vantage = 'inside'").first()
    assert (rejected.n_rejected, rejected.n_lines) == (2, 4)


def test_files_without_records_count_as_zero(spark, tmp_path):
    folder = tmp_path / "LLS_DDOS_1.0" / "data_and_labeling" / "tcpdump_inside"
    folder.mkdir(parents=True)
    (folder / "phase-1.list").write_text("no session here\n")
    (folder / "mid-level-phase-1.xml").write_text("<Alerts><Alert a='1'/> <Alert a='2'/> </Alerts>")
    bad = [(r.scenario, r.phase, r.n_list, r.n_xml) for r in session_feed.count_mismatches(spark, str(tmp_path)).collect()]
    assert bad == [("LLS_DDOS_1.0", 1, 0, 2)]


def test_an_impossible_date_is_null(spark):
    from pyspark.sql import functions as F

    from alertloom.functions.temporal import parse_session_clock

    df = spark.createDataFrame([("99/99/2000", "10:00:00"), ("03/07/2000", "10:00:00")], "d string, t string")
    assert [r[0] is None for r in df.select(parse_session_clock(F.col("d"), F.col("t"))).collect()] == [True, False]


def test_inventory(spark, captures):
    found = {(r.scenario, r.vantage, r.phase, r.problem) for r in session_feed.capture_problems(spark, captures).collect()}
    assert ("LLS_DDOS_1.0", "tcpdump_dmz", None, "directory missing") in found
    assert ("LLS_DDOS_1.0", "tcpdump_inside", 4, "dump is empty") in found
    assert ("LLS_DDOS_1.0", "tcpdump_inside", 5, "truth is missing") in found
    assert ("LLS_DDOS_2.0.2", "tcpdump_dmz", None, "fewer than 2 phases") in found


def test_balance_flags_a_scenario_without_distractors(spark, captures):
    rows = {r.scenario: r.degenerate for r in session_feed.sanity(session_feed.session_events(spark, captures)).collect()}
    assert rows == {"LLS_DDOS_1.0": False, "LLS_DDOS_2.0.2": True}


@pytest.fixture(scope="module")
def flow_files(tmp_path_factory):
    """Three attack files with gaps of exactly 60 and of 61 minutes, one benign file, repeated rows, inf and blanks."""
    root = tmp_path_factory.mktemp("flows")
    rnd = random.Random(3)
    head = "flow_id,timestamp,src_ip,src_port,dst_ip,dst_port,protocol,duration,rate,label\n"

    def put(name, label, minutes, mean, n=40, fmt="2017-07-06 {:02d}:{:02d}:00"):
        out = [head]
        for i in range(n):
            m = minutes[0] + (minutes[1] - minutes[0]) * i // (n - 1)
            rate = "inf" if i == 1 else "" if i == 2 else f"{rnd.gauss(mean, 1):.3f}"
            out.append(f"f{i},{fmt.format(9 + m // 60, m % 60)},172.16.0.1,{i},192.168.10.50,80,{'TCP' if i % 2 else 'UDP'},{rnd.gauss(mean, 1):.3f},{rate},{label}\n")
        out.append(out[-1])  # an identical row
        (root / name).write_text("".join(out))

    put("web_brute_force.csv", "Web_Brute_Force", (0, 30), 5.0)
    put("web_xss.csv", "Web_XSS", (90, 100), 10.0, fmt="06/07/2017 {:02d}:{:02d}:00")
    put("web_sql_injection.csv", "Web_SQL_Injection", (161, 170), 15.0)
    put("thursday_benign.csv", "Benign", (0, 170), 0.0, n=60)
    return str(root)


def test_flow_feed(spark, flow_files):
    raw = flows.read_flows(spark, flow_files)
    assert raw.count() == 3 * 41 + 61
    train, test, features = flow_feed.identifier_sets(raw)
    assert features == ["protocol", "duration", "rate"]
    model = I.train_identifier(train, test, features, categorical=["protocol"], trees=10, depth=5, min_leaf=1)
    report = {r.label: r for r in I.evaluate(model, test).collect()}
    assert report["Web_SQL_Injection"].f1 > 0.8
    events = flow_feed.flow_events(raw, model).persist()
    assert events.columns == S.UNIFIED_COLUMNS + S.FLOW_EXTRAS.fieldNames()
    assert events.count() == raw.count() and events.select("event_id").distinct().count() == raw.count()
    by_file = {r[0]: r[1] for r in events.groupBy("source_file").agg(F.max("campaign_id")).collect()}
    assert by_file == {"web_brute_force.csv": "cicids2017_thu_c0", "web_xss.csv": "cicids2017_thu_c0",
                       "web_sql_injection.csv": "cicids2017_thu_c1", "thursday_benign.csv": "NONE"}
    split = flow_feed.checked_split(events)
    assert sorted(r.split for r in split.collect()) == ["train", "val"]
    assert [r.feature for r in I.top_features(model, 2).collect()] != []
    events.unpersist()


def test_no_row_is_cut_unless_asked(spark, flow_files):
    raw = flows.read_flows(spark, flow_files)
    train, test, _ = flow_feed.identifier_sets(raw, target=10, floor=1)
    # 61 background rows: 42 are early, of which at most the budget is fitted on; the other 19 are all tested
    assert train.where("label = 'Benign'").count() == 10 and test.where("label = 'Benign'").count() == 19
    model = I.train_identifier(train, test, ["protocol", "duration", "rate"], categorical=["protocol"], trees=2, depth=2)
    assert flow_feed.flow_events(raw, model).where("campaign_id = 'NONE'").count() == 61
    few = flow_feed.flow_events(raw, model, benign_budget={"multiplier": 0, "floor": 5, "cap": 7})
    assert few.where("campaign_id = 'NONE'").count() == 5


def test_files_of_no_known_day_are_counted(spark, flow_files, tmp_path):
    import shutil

    shutil.copy(f"{flow_files}/web_xss.csv", tmp_path / "web_xss.csv")
    shutil.copy(f"{flow_files}/web_xss.csv", tmp_path / "strange.csv")
    assert [tuple(r) for r in flows.unlisted_rows(spark, str(tmp_path)).collect()] == [("strange.csv", 41)]
    assert flows.read_flows(spark, str(tmp_path), "all").where("day IS NULL").count() == 41


def test_model_round_trip(spark, flow_files, tmp_path):
    raw = flows.read_flows(spark, flow_files)
    train, test, features = flow_feed.identifier_sets(raw)
    model = I.train_identifier(train, test, features, categorical=["protocol"], trees=3, depth=3)
    tables.save_model(model, str(tmp_path / "m"))
    again = tables.load_model(str(tmp_path / "m"))
    score = lambda m: sorted(map(tuple, I.score_events(m, test, ["event_id"]).collect()))
    assert score(model) == score(again)


def test_burst_and_collapse_keep_all_rows(spark, flow_files):
    raw = flows.read_flows(spark, flow_files)
    train, test, features = flow_feed.identifier_sets(raw)
    model = I.train_identifier(train, test, features, categorical=["protocol"], trees=3, depth=3)
    events = flow_feed.flow_events(raw, model, threshold=20)
    assert events.agg(F.sum("event_count")).first()[0] == raw.count()
    assert events.where("predicted_attack_type_agreement <= 0 OR predicted_attack_type_agreement > 1").count() == 0


def test_second_flows_with_byte_order_mark(spark, tmp_path):
    rnd = random.Random(1)
    for name in ("train", "test"):
        rows = ["id,proto,service,state,sttl,dttl,rate,attack_cat,label"]
        for i in range(60):
            bad = i % 2
            rows.append(f"{i},tcp,-,FIN,{254 if bad else 31},{rnd.randrange(9)},{rnd.random():.3f},{'Fuzzers' if bad else 'Normal'},{bad}")
        (tmp_path / f"{name}.csv").write_text("﻿" + "\n".join(rows) + "\n", encoding="utf-8")
    train, test = (flows.read_second_flows(spark, str(tmp_path / f"{n}.csv")) for n in ("train", "test"))
    assert train.columns[0] == "id"
    rows = {r.metric: r for r in flow_feed.second_flow_study(train, test, trees=5, depth=4).collect()}
    assert rows["accuracy"].with_columns == 1.0 and rows["accuracy"].material
    audit = {r.attack_cat: r.top_value for r in checks.identity_audit(train, "attack_cat", "sttl").collect()}
    assert audit == {"Fuzzers": 254.0, "Normal": 31.0}


def test_events_csv_and_sinks(spark, tmp_path, captures):
    events = session_feed.session_events(spark, captures)
    tables.write_csv(events.withColumn("vantage", F.lit("N/A")), str(tmp_path / "csv"))
    back = tables.read_events_csv(spark, str(tmp_path / "csv"), S.SESSION_EXTRAS)
    assert back.where("vantage = 'N/A'").count() == events.count() and back.where("timestamp IS NULL").count() == 0
    assignment = events.select("event_id", F.lit("k").alias("cluster_id"))
    tables.write_reconstruction(events, {"rule": assignment}, str(tmp_path / "out"))
    assert tables.read_events(spark, str(tmp_path / "out")).where("rule_predicted_cluster = 'k'").count() == events.count()


def test_confusion_csv(spark, tmp_path):
    (tmp_path / "cm.csv").write_text(",a,b\na,5,1\nb,0,4\n")
    cells = {(r.true_label, r.predicted_label): r.n for r in tables.read_confusion_csv(spark, str(tmp_path / "cm.csv")).collect()}
    assert cells == {("a", "a"): 5, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 4}


def test_labels_and_addresses(spark):
    rows = spark.createDataFrame([("DoS Hulk",), ("DoS_Hulk",), ("DDoS_LOIT",), ("benign",)], "l string")
    got = [tuple(r) for r in rows.select(lookup.label_stage(F.col("l")), lookup.label_stage(F.col("l"), True)).collect()]
    assert got == [("action", "action"), ("action", "unknown"), ("action", "unknown"), ("unknown", "unknown")]
    ips = spark.createDataFrame([("202.077.162.213",), ("010.000.001.100",), ("1.x.2.3",)], "ip string")
    assert [r[0] for r in ips.select(text.clean_ip(F.col("ip"))).collect()] == ["202.77.162.213", "10.0.1.100", None]


def test_leakage_errors(spark):
    a = spark.createDataFrame([("c1",), ("c2",)], "campaign_id string")
    b = spark.createDataFrame([("c2",), ("c3",)], "campaign_id string")
    with pytest.raises(checks.LeakageError, match="c2"):
        checks.assert_no_campaign_leakage(a, b)
    assert checks.assert_no_campaign_leakage(a, b.where("campaign_id = 'c3'"))["overlap"] == 0
    sources = spark.createDataFrame([("darpa2000_lldos1.0",)], "source_dataset string")
    with pytest.raises(checks.LeakageError):
        checks.assert_no_test_only_rows(sources)
    with pytest.raises(ValueError, match="x"):
        checks.assert_unique_ids(spark.createDataFrame([("x",), ("x",)], "event_id string"))
