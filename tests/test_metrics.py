"""Published numbers as formula checks, and algebraic properties."""

import pytest
from pyspark.sql import functions as F

from alertloom.functions.pairs import break_even, link_reward
from alertloom.operators import history as H, metrics as M


def totals(spark, n, tp, fp, fn):
    return spark.createDataFrame([(n, tp, fp, fn, tp + fp, tp + fn)],
                                 "n_events long, tp_pairs long, fp_pairs long, fn_pairs long, n_predicted_pairs long, n_true_pairs long")


@pytest.mark.parametrize("tp,fp,fn,ari", [
    (2425, 5213, 9246, 0.08061386396373661), (8711, 26063, 2960, 0.036935283282148845), (1866, 5351, 9805, 0.02239826770816053)])
def test_adjusted_rand_golden(spark, tp, fp, fn, ari):
    assert M.adjusted_rand(totals(spark, 316, tp, fp, fn)).first().adjusted_rand_index == pytest.approx(ari, rel=1e-12)


def test_pairwise_golden(spark):
    row = M.pairwise_scores(totals(spark, 316, 2425, 5213, 9246)).first()
    assert (row.precision, row.recall, row.f1) == pytest.approx((0.3174914899188269, 0.2077799674406649, 0.2511782070537055))


def clustered(spark, rows):
    return spark.createDataFrame(rows, "event_id string, campaign_id string, cluster_id string, kill_chain_stage string")


def test_true_pairs_golden(spark):
    rows = [(f"a{i}", "A", "x", "recon") for i in range(150)] + [(f"b{i}", "B", "x", "recon") for i in range(32)]
    assert M.pair_totals(M.contingency(clustered(spark, rows))).first().n_true_pairs == 11671


def test_identical_partitions_score_one(spark):
    rows = [(f"e{i}", f"c{i % 4}", f"k{i % 4}", "recon") for i in range(40)]
    row = M.adjusted_rand(M.pairwise_scores(M.pair_totals(M.contingency(clustered(spark, rows))))).first()
    assert row.adjusted_rand_index == 1.0 and row.f1 == 1.0


def test_pair_counts_beyond_a_bigint(spark):
    cells = spark.createDataFrame([("A", "x", 10**11), ("B", "x", 10**11)], "campaign_id string, cluster_id string, n long")
    row = M.adjusted_rand(M.pairwise_scores(M.pair_totals(cells))).first()
    assert int(row.n_true_pairs) == 10**11 * (10**11 - 1) and abs(row.adjusted_rand_index) < 1e-6


def test_no_pairs_at_all(spark):
    row = M.pairwise_scores(M.pair_totals(M.contingency(clustered(spark, [("e1", "NONE", "x", "unknown")])))).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_against_pairs_by_hand(spark):
    import itertools
    import random

    rnd = random.Random(5)
    rows = [(f"e{i}", rnd.choice(["A", "B", "NONE"]), f"k{rnd.randrange(5)}", "recon") for i in range(60)]
    true = {p for p in itertools.combinations(rows, 2) if p[0][1] == p[1][1] != "NONE"}
    pred = {p for p in itertools.combinations(rows, 2) if p[0][2] == p[1][2]}
    row = M.pair_totals(M.contingency(clustered(spark, rows))).first()
    assert (row.tp_pairs, row.fp_pairs, row.fn_pairs) == (len(true & pred), len(pred - true), len(true - pred))


def test_completeness(spark):
    rows = [("1", "A", "x", "recon"), ("2", "A", "x", "exploit"), ("3", "A", "y", "action"), ("4", "A", "y", "unknown"),
            ("5", "B", "x", "unknown"), ("6", "NONE", "x", "install")]
    out = M.completeness(clustered(spark, rows)).collect()
    assert len(out) == 1
    row = out[0]
    assert row.best_cluster == "x" and row.true_stages == ["action", "exploit", "recon"]
    assert row.captured_stages == ["exploit", "recon"] and row.completeness == pytest.approx(2 / 3)
    assert row.n_predicted_clusters_touched == 2 and row.fragmentation


def test_report_zero_division_and_label_union(spark):
    cells = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("c", "a", 2)], "true_label string, predicted_label string, n long")
    rows = {r.label: r for r in M.class_report(cells).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["b"].recall == 0.0 and rows["c"].precision == 0.0
    summary = M.report_summary(M.class_report(cells)).first()
    assert summary.accuracy == 0.5 and summary.macro_recall == pytest.approx(0.75 / 3)


def test_near_perfect_and_recall_audit(spark):
    cells = spark.createDataFrame([("a", "a", 200), ("b", "b", 5)], "true_label string, predicted_label string, n long")
    verdicts = {r.label: r.verdict for r in M.near_perfect(M.class_report(cells)).collect()}
    assert verdicts == {"a": "investigate", "b": "low power"}
    assert [r.label for r in M.recall_audit(cells).collect()] == ["a"]


def test_profile_golden_shape(spark):
    rows = [(f"e{i}", "A" if i < 34 else "NONE", "k0", "recon") for i in range(38)] + [(f"f{i}", "B", "k1", "recon") for i in range(262)]
    out = {r.cluster_id: r for r in M.cluster_profile(M.contingency(clustered(spark, rows))).collect()}
    assert out["k0"].purity == pytest.approx(34 / 38) and out["k1"].event_share == pytest.approx(262 / 300)


def test_thirds(spark):
    hist = spark.createDataFrame([(i, float(i), 1.0) for i in range(10)], "ep int, f1 double, reward double")
    row = H.thirds(hist, "f1", "reward", "ep").first()
    assert (row.first_mean, row.last_mean, row.last_std) == (1.0, 8.0, 1.0) and row.improved and not row.stable
    assert H.thirds(hist.limit(2), "f1", "reward", "ep").first().last_mean is None
    flat = spark.createDataFrame([(i, 0.5, 1.0) for i in range(6)], "ep int, f1 double, reward double")
    assert H.thirds(flat, "f1", "reward", "ep").first().stable is True


def test_rewards_and_break_even(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, t boolean")
    got = [r[0] for r in rows.select(link_reward(F.col("a"), F.col("t"))).collect()]
    assert got == [1.0, -1.0, -2.5, 0.1]
    assert break_even() == pytest.approx(1.1 / 4.6)
