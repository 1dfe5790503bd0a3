import datetime as dt

import pytest

from fathom.operators import incremental as inc

T = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)
OBS = "rec_id long, repo string, path string, content_hash string, recorded_at timestamp, processed_at timestamp, content string"


def obs(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], OBS)


def pending(spark, rows):
    return {(r["repo"], r["path"], r["content_hash"], r["change"]) for r in inc.pending_files(obs(spark, rows)).collect()}


def test_new_changed_same_late_and_case(spark):
    rows = [
        (1, "r", "a", "AA", T(1), T(2)), (2, "r", "./a", "aa", T(5), None),  # same content in another case
        (3, "r", "/b", "b1", T(1), T(2)), (4, "r", "b", "b2", T(3), None),  # changed
        (5, "r", "c\\d", "c1", T(1), None),  # never committed
        (6, "r", "e", "e2", T(9), T(10)), (7, "r", "e", "e1", T(1), T(3)),  # an old version came late
        (8, "r", "f", "f1", T(1), T(9)), (9, "r", "f", "f2", T(2), T(3)),  # committed last: f1, current: f2
        (10, "r", "g", None, T(9), None), (11, "r", "g", "g1", T(1), T(2)),  # unreadable rows do not count
        (12, "s", "a", "zz", T(1), None), (13, None, "a", "x", T(1), None), (14, "r", None, "x", T(1), None),
        (15, "r", "h", "h1", T(1), T(1)), (16, "r", "h", "h2", T(1), None),  # equal times: the greater rec_id
    ]
    assert pending(spark, rows) == {("r", "b", "b2", "changed"), ("r", "c/d", "c1", "new"), ("r", "f", "f2", "changed"), ("s", "a", "zz", "new"), ("r", "h", "h2", "changed")}
    assert pending(spark, rows + rows) == pending(spark, rows) and pending(spark, []) == set()


def test_paths(spark):
    from pyspark.sql import functions as F

    cases = {"/a": "a", "./a": "a", "././a/./b": "a/b", "a//b": "a/b", "\\a\\b": "a/b", ".github/x": ".github/x", "../a": "../a", "a/..b": "a/..b"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", inc.canonical_path(F.col("p")).alias("c")).collect()
    assert {r["p"]: r["c"] for r in rows} == cases


def test_hot_key(spark):
    rows = [(i, "r", "hot", f"h{i}", T(i), T(i) if i < 500 else None) for i in range(600)] + [(1000 + i, "r", f"p{i}", "x", T(1), None) for i in range(50)]
    got = pending(spark, rows)
    assert ("r", "hot", "h599", "changed") in got and len(got) == 51


def test_state_survives_failures(spark, tmp_path):
    cur = lambda *rows: spark.createDataFrame(rows, "repo string, path string, content_hash string")
    keys = lambda df: sorted((r["path"], r["change"]) for r in df.collect())
    store = inc.StateStore(spark, f"file://{tmp_path}/state")
    first = cur(("r", "a", "1"), ("r", "b", "1"))
    assert keys(store.plan(first)) == [("a", "new"), ("b", "new")]
    first.write.parquet(f"{tmp_path}/state/v-dead")  # a run that died before its commit
    assert keys(inc.StateStore(spark, store.root).plan(first)) == [("a", "new"), ("b", "new")]
    store.commit(store.plan(first))
    assert keys(store.plan(first)) == [] and keys(store.plan(cur(("r", "a", "2"), ("r", "b", "1"), ("r", "c", "1")))) == [("a", "changed"), ("c", "new")]
    store.commit(cur(("r", "a", "2")))
    store.commit(cur(("r", "a", "2")))  # again: nothing changes
    assert sorted((r["path"], r["content_hash"]) for r in store.read().collect()) == [("a", "2"), ("b", "1")]
    assert store.version()["version"] == 3


def test_concurrent_commit(spark, tmp_path, monkeypatch):
    store = inc.StateStore(spark, f"file://{tmp_path}/state")
    df = spark.createDataFrame([("r", "a", "1")], "repo string, path string, content_hash string")
    store.commit(df)
    seen = iter([store.version(), store.version(), {"version": 9, "dir": "x"}, {"version": 9, "dir": "x"}])
    monkeypatch.setattr(store, "version", lambda: next(seen))
    with pytest.raises(inc.ConcurrentCommit):
        store.commit(df)


def test_actions(spark):
    cur = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "1")], "repo string, path string, content_hash string")
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "z", "1")], "repo string, path string, content_hash string")
    assert {r["path"]: r["action"] for r in inc.actions(cur, old).collect()} == {"a": "skip", "b": "update", "c": "add", "z": "stale"}


def test_two_writers_and_a_killed_run(spark, tmp_path):
    cur = lambda *rows: spark.createDataFrame(rows, "repo string, path string, content_hash string")
    a, b = (inc.StateStore(spark, f"file://{tmp_path}/state") for _ in range(2))
    a.commit(cur(("r", "a", "1")))
    number = b._pointer.latest()[0]
    a.commit(cur(("r", "b", "1")))
    with pytest.raises(inc.ConcurrentCommit):
        b._pointer.swap({"parts": []}, number)  # both began from the same version
    assert sorted(r["path"] for r in b.read().collect()) == ["a", "b"]

    write = a._write

    def killed(rows):
        write(rows)
        raise KeyboardInterrupt

    a._write = killed
    with pytest.raises(KeyboardInterrupt):
        a.commit(cur(("r", "a", "2"), ("r", "c", "1")))
    assert sorted((r["path"], r["change"]) for r in b.plan(cur(("r", "a", "2"), ("r", "c", "1"))).collect()) == [("a", "changed"), ("c", "new")]
    b.commit(cur(("r", "a", "2"), ("r", "c", "1")))
    assert b.plan(cur(("r", "a", "2"), ("r", "c", "1"))).isEmpty()
    assert len(b.vacuum(0)) >= 1 and b.read().count() == 3


def test_a_commit_costs_what_it_changes(spark, tmp_path):
    store = inc.StateStore(spark, f"file://{tmp_path}/state")
    rows = lambda lo, hi, h: spark.createDataFrame([("r", f"p{i}", h) for i in range(lo, hi)], "repo string, path string, content_hash string")
    store.commit(rows(0, 100, "1"))
    for i in range(6):
        store.commit(rows(i, i + 2, f"n{i}"))
    parts = store.version()["parts"]
    assert parts[0]["rows"] == 100 and len(parts) <= 4  # the large part was not written again
    got = {r["path"]: r["content_hash"] for r in store.read().collect()}
    assert len(got) == 100 and got["p0"] == "n0" and got["p5"] == "n5" and got["p6"] == "n5" and got["p7"] == "1"


def test_pending_against_a_kept_store(spark, tmp_path):
    store = inc.StateStore(spark, f"file://{tmp_path}/state")
    first = obs(spark, [(1, "r", "a", "AA", T(1), T(2)), (2, "r", "b", "b1", T(1), None)])
    assert [r["path"] for r in inc.pending_files(first, store).collect()] == ["b"]
    store.commit(spark.createDataFrame([("r", "b", "b1")], "repo string, path string, content_hash string"))
    later = obs(spark, [(3, "r", "a", "aa", T(3), None), (4, "r", "b", "b2", T(4), None)])
    assert [(r["path"], r["change"]) for r in inc.pending_files(later, store).collect()] == [("b", "changed")]


def test_hashes_of_records(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("a", "b")], "x string, y string")
    got = [r["h"] for r in inc.hashed(df, ["x", "y"], "h").collect()]
    assert len(set(got)) == 4 and got[0] == got[4]
