import random

import pytest

from fathom.llm import near_dup
from fathom.llm.components import connected_components
from fathom.llm.near_dup import near_duplicate_groups, near_duplicate_pairs


def brute(rows, gamma=0.7, width=3):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None:
            w = near_dup.TOKEN.findall(t.lower())
            s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            if s:
                sets[i] = s
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= gamma * len(sets[a] | sets[b]) - 1e-9}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "e") for i, t in rows], "id string, content string, key string, n int, elems string")


def pairs(spark, rows, **kw):
    return {(r["id_a"], r["id_b"]) for r in near_duplicate_pairs(frame(spark, rows), **kw).collect()}


def corpus(seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([4, 8, 15, 40, 90, 300]))]
        rows.append((f"d{i}", " ".join(w)))
        for j in range(r.randint(0, 3)):
            v = list(w)
            for _ in range(max(1, len(v) // r.choice([10, 20, 30, 60]))):
                k = r.randrange(len(v))
                v[k : k + 1] = r.choice([[], ["new"], [v[k], "ins"], [f"x{r.randint(0, 99)}"]])
            if r.random() < 0.2:
                v = v[len(v) // 2 :] + v[: len(v) // 2]
            rows.append((f"d{i}-{j}", " ".join(v)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_on_random_edits(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert len(want) > 20 and pairs(spark, rows) == want


def test_small_caps_use_the_exact_fallback(spark):
    """Boilerplate shared by all makes hot signatures; nothing may be lost whatever the cap."""
    r = random.Random(5)
    head = " ".join(f"head{i}" for i in range(30))
    rows = [(f"d{i}", head + " " + " ".join(f"w{r.randint(0, 40)}" for _ in range(r.choice([2, 5, 12, 40])))) for i in range(60)]
    want = brute(rows)
    assert len(want) > 100
    for cap in (1, 3):
        assert pairs(spark, rows, cap=cap) == want


def test_hot_signatures_leave_their_group():
    import numpy as np
    import pyarrow as pa

    from fathom.llm.hashing import mix

    shared = mix(np.arange(1, 200, dtype=np.uint64))
    sets = [np.unique(np.r_[shared, mix(np.arange(1000 * i, 1000 * i + 20, dtype=np.uint64))]) for i in range(1, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "elems"])
    out = pa.Table.from_batches(near_dup._emit_signatures(0.7, 4)(iter([batch, batch.slice(0, 0)])))
    every = out.to_pylist()
    rows = [r for r in every if r["margin"] is None]
    margins = [(r["key"], r["band"], r["margin"]) for r in every if r["margin"] is not None]
    assert sorted(margins) == sorted((i, *m) for i, s in enumerate(sets) for m in near_dup.signatures(s, 0.7)[1])
    per = {}
    for r in rows:
        per.setdefault(r["sig"], []).append(r["key"])
    assert max(len(v) for k, v in per.items() if k is not None) == 5 and len(per[None]) > 100
    assert len(rows) == sum(len(near_dup.signatures(s, 0.7)[0]) for s in sets)


def test_defined_cases(spark):
    t = "alpha beta gamma delta epsilon zeta"
    rows = [("a", t), ("b", t.upper()), ("c", "ALPHA, beta; gamma--delta epsilon/zeta!"), ("a", t), (None, t), ("n", None), ("e", ""), ("s", "two words"), ("u", "日本語 だけ"), ("o", "one two three")]
    assert pairs(spark, rows) == {("a", "b"), ("a", "c"), ("b", "c")} == brute(rows)
    assert pairs(spark, []) == set() and pairs(spark, [("a", t)]) == set()
    long = " ".join(f"w{i}" for i in range(30_000))
    assert pairs(spark, [("x", long), ("y", long + " tail")]) == {("x", "y")}


def test_third_of_rows_one_text(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:03}", t) for i in range(40)] + corpus(7, 10)
    assert pairs(spark, rows) == brute(rows)
    groups = {r["id"]: r for r in near_duplicate_groups(frame(spark, rows)).collect()}
    assert all(groups[f"c{i:03}"]["class_id"] == "c000" and groups[f"c{i:03}"]["links"] == 0 for i in range(40))


def test_groups(spark):
    rows = corpus(3)
    want = brute(rows)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["group_id"] for r in near_duplicate_groups(frame(spark, rows)).collect()}
    assert got == {x: find(x) for x in parent}
    assert near_duplicate_groups(frame(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("z1", "z2")], "u string, v string")
    out = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert len(out) == 73 and {v for k, v in out.items() if k[0] == "n"} == {"n000"} and out["z2"] == "z1"
    assert connected_components(edges.limit(0)).count() == 0


def test_classes_are_expanded_in_blocks(spark):
    """A text under many ids, beside a near one under several: every pair comes out once, whatever the block."""
    text = " ".join(f"t{i}" for i in range(40))
    near = text.replace("t20", "other")
    rows = [(f"a{i:02d}", text) for i in range(23)] + [(f"b{i}", near) for i in range(7)] + [("z", "quite another text here")]
    df = spark.createDataFrame(rows, "id string, content string")
    ids = sorted(i for i, _ in rows[:-1])
    want = {(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :]}
    for block in (4, 1000):
        got = [(r["id_a"], r["id_b"]) for r in near_dup.near_duplicate_pairs(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
