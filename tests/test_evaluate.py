import pytest

from fathom.operators import evaluate as ev


def questions(spark, rows):
    return spark.createDataFrame(rows, "qid string, expected_files array<string>")


def score(spark, expected, retrieved, ks=(2, 3, 10)):
    files = spark.createDataFrame([("q", p, i + 1) for i, p in enumerate(retrieved)], "qid string, path string, rank int")
    rows = ev.per_question(questions(spark, [("q", expected)]), ev.retrieved_files(files), ks).collect()
    return {r["k"]: r for r in rows}


def test_metric_vectors(spark):
    s = score(spark, ["a", "b"], ["a", "x", "b"])
    assert s[3]["recall"] == 1 and s[2]["recall"] == 0.5 and s[2]["precision"] == 0.5 and s[3]["rr"] == 1
    s = score(spark, ["a"], ["a", "x", "y", "z"], (4,))
    assert s[4]["precision"] == 0.25 and s[4]["ndcg"] == 1
    assert score(spark, ["a"], ["x", "a"])[2]["rr"] == 0.5
    s = score(spark, ["a"], [], (10,))[10]
    assert (s["recall"], s["precision"], s["rr"], s["ndcg"]) == (0, 0, 0, 0)
    s = score(spark, [], ["x"], (10,))[10]
    assert (s["recall"], s["ndcg"]) == (1, 1)
    assert score(spark, ["a", "a"], ["a"], (1,))[1]["recall"] == 1


def test_k_counts_distinct_files(spark):
    s = score(spark, ["b"], ["a", "a", "a", "b"], (2,))
    assert s[2]["recall"] == 1 and s[2]["rr"] == 0.5


def test_ceiling_floor_and_monotone(spark):
    q = questions(spark, [(f"q{i}", [f"f{i}", f"f{i + 1}"]) for i in range(8)])
    best = ev.aggregate(ev.per_question(q, ev.retrieved_files(ev.oracle_hits(q)))).collect()
    assert all(r["recall"] == 1 and r["mrr"] == 1 and r["ndcg"] == 1 and r["misses"] == "" for r in best)
    noisy = {r["k"]: r for r in ev.aggregate(ev.per_question(q, ev.retrieved_files(ev.noisy_hits(q)))).collect()}
    assert noisy[10]["recall"] == 1 and noisy[5]["recall"] == 0.5 and abs(noisy[10]["precision"] - 0.2) < 1e-12
    pool = spark.createDataFrame([(f"f{i}",) for i in range(200)], "path string")
    floor = sorted(ev.aggregate(ev.per_question(q, ev.retrieved_files(ev.random_hits(q, pool, 50)))).collect(), key=lambda r: r["k"])
    assert floor[0]["recall"] < 0.3 and all(a["recall"] <= b["recall"] for a, b in zip(floor, floor[1:]))
    with pytest.raises(ValueError, match="7"):
        ev.require_ks(ev.per_question(q, ev.retrieved_files(ev.oracle_hits(q))), (5, 7))


def gt(spark, rows):
    return spark.createDataFrame(rows, "id string, answerable boolean, expected_files array<string>, verified boolean")


def test_ground_truth_problems(spark):
    assert ev.ground_truth_problems(gt(spark, [("a", True, ["f"], None), ("b", False, [], None)])).count() == 0
    bad = [("a", True, [], None), ("a", True, None, None)]
    assert sorted((r["id"] or "", r["problem"]) for r in ev.ground_truth_problems(gt(spark, bad)).collect()) == [
        ("", "no unanswerable questions"), ("a", "answerable but has no expected files"), ("a", "answerable but has no expected files"), ("a", "duplicate id")]
    assert ev.ground_truth_problems(gt(spark, [("u", False, ["f"], None)])).count() == 2
    assert ev.verified_only(gt(spark, [("a", True, [], None), ("b", True, [], True), ("c", False, [], None)])).count() == 2


def test_spread_subset(spark):
    q = gt(spark, [(f"q{i:02}", True, [], None) for i in range(10)])
    assert [r["id"] for r in ev.spread_subset(q, 4).orderBy("id").collect()] == ["q00", "q02", "q05", "q07"]
    assert ev.spread_subset(q, 99).count() == 10


def signals(spark, scores):
    df = spark.createDataFrame([("q", i + 1, s) for i, s in enumerate(scores)], "qid string, rank int, score double")
    return ev.refusal_signals(df).first()


def test_signals(spark):
    s = signals(spark, [1.0, 0.2, 0.15, 0.1, 0.05])
    assert abs(s["gap_ratio"] - 0.8) < 1e-12 and s["above_half"] == 1 and s["candidate_count"] == 5 and abs(s["concentration"] - 1 / 1.5) < 1e-12
    assert signals(spark, [0.5, 0.49, 0.48, 0.47, 0.46])["above_half"] == 5
    assert signals(spark, [3.0])["gap_ratio"] == 1 and signals(spark, [0.0, 0.0])["decay"] == 0
    assert abs(signals(spark, [10.0, 2.0, 1.5, 1.0, 0.5])["gap_ratio"] - 0.8) < 1e-12


def test_policy(spark):
    df = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.49)], "qid string, rank int, score double")
    s = ev.refusal_signals(df)
    assert ev.should_refuse(s).first()["refuse"] is False
    row = ev.should_refuse(s, min_candidates=5, min_top_score=0.6, min_concentration=0.1, min_gap_ratio=0.5, min_decay=9).first()
    assert row["refuse"] and len(row["reasons"]) == 4 and row["reasons"][0].startswith("candidates: 2")
    assert not ev.should_refuse(s, min_top_score=0.5).first()["refuse"]


def test_sweep_separates_and_is_monotone(spark):
    rows = [(f"a{i}", True, 0.9 + i / 100, *[1.0] * 5) for i in range(5)] + [(f"u{i}", False, 0.1 + i / 100, *[1.0] * 5) for i in range(5)]
    obs = spark.createDataFrame(rows, "qid string, answerable boolean, " + ", ".join(f"{s} double" for s in ev.SIGNALS))
    sweep = sorted((r for r in ev.sweep(obs).collect() if r["signal"] == "top_score"), key=lambda r: r["step"])
    assert len(sweep) == 21 and sweep[0]["true_refusal"] == 0 and all(a["true_refusal"] <= b["true_refusal"] for a, b in zip(sweep, sweep[1:]))
    best = {r["signal"]: r for r in ev.best_thresholds(obs).collect()}
    assert best["top_score"]["youden"] == 1 and best["decay"]["youden"] == 0 and best["decay"]["step"] == 0 and set(best) == set(ev.SIGNALS)


def test_baseline(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "metric string, value double")
    before = {"recall@5": 0.5, "recall@10": 0.6, "mrr": 0.5, "questions": 62.0}
    rows = {r["metric"]: r["verdict"] for r in ev.compare_baseline(frame(before), frame({"recall@5": 0.47, "recall@10": 0.63, "mrr": 0.51, "recall@50": 1.0, "questions": 62.0})).collect()}
    assert rows == {"recall@5": "regression", "recall@10": "improvement", "mrr": "same"}
    assert {r["verdict"] for r in ev.compare_baseline(frame(before), frame(before | {"questions": 9.0})).collect()} == {"incomparable"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "qid string")
    assert {(r["qid"], r["change"]) for r in ev.compare_misses(ids("a", "b"), ids("b", "c")).collect()} == {("a", "fixed"), ("c", "new")}
