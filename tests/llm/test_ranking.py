import random

from fathom.llm.ranking import leximin_first, leximin_ranking

NAN, INF = float("nan"), float("inf")
SCHEMA = "qid string, source string, chunk_id string, score double, q string, item string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)  # extra columns with clashing names


def brute(rows):
    out = {}
    for qid in {r[0] for r in rows if r[0] is not None}:
        best = {}
        for q, s, c, v in rows:
            if q == qid and s is not None and c is not None and v is not None and v == v and abs(v) != INF:
                best.setdefault(s, {})
                best[s][c] = max(v, best[s].get(c, v))
        if not best:
            continue
        vec = {}
        for m in best.values():
            vals = list(m.values())
            for c, v in m.items():
                vec.setdefault(c, []).append((sum(x < v for x in vals) + sum(x == v for x in vals) / 2) / len(vals))
        key = {c: sorted([0.0] * (len(best) - len(v)) + v) for c, v in vec.items()}
        out[qid] = sorted(key, key=lambda c: ([-round(x, 12) for x in key[c]], c))
    return out


def check(spark, rows):
    want = brute(rows)
    df = frame(spark, rows)
    assert {r["q"]: r["item"] for r in leximin_first(df).collect()} == {q: v[0] for q, v in want.items()}
    got = {}
    for r in leximin_ranking(df).collect():
        got.setdefault(r["q"], {})[r["position"]] = r["item"]
    assert {q: [v[i + 1] for i in range(len(v))] for q, v in got.items()} == want


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = []
    for q in range(6):
        for s, scale in (("a", 1e-3), ("b", 100), ("c", -50)):
            if r.random() < 0.8:
                rows += [(f"q{q}", s, f"c{r.randint(0, 12)}", float(r.choice([r.gauss(0, 1) * scale, scale]))) for _ in range(15)]
    check(spark, rows)


def test_edge_cases(spark):
    rows = [("q", "a", "x", 1.0), ("q", "a", "x", 5.0), ("q", "a", "y", 3.0), ("q", "b", "y", -9999.0), ("q", "b", "x", None), ("q", "b", "z", NAN), ("q", "c", "w", INF),
            (None, "a", "x", 1.0), ("q", None, "x", 1.0), ("q", "a", None, 9.0), ("none", "a", "x", None), ("tie", "a", "m", 1.0), ("tie", "a", "k", 1.0)]
    check(spark, rows + rows)
    assert leximin_first(frame(spark, [])).count() == 0 and leximin_ranking(frame(spark, [])).count() == 0


def test_no_range_prevails(spark):
    rows = [("q", "a", "steady", 0.8), ("q", "a", "spike", 0.05), ("q", "a", "low", 0.1), ("q", "b", "steady", 10.0), ("q", "b", "spike", 1e9), ("q", "b", "low", 1.0)]
    assert leximin_first(frame(spark, rows)).first()["item"] == "steady"


def test_hot_query(spark):
    rows = [("hot", s, f"c{i:04}", float((i * 7919) % 1000)) for s in ("a", "b") for i in range(500)] + [("q", "a", "z", 1.0)]
    check(spark, rows)
