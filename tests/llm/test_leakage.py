import random

import numpy as np

from fathom.llm.leakage import MATCH, align, leaks, words

DOC = "doc_id long, text string, item_id string, score string"
ITEM = "id string, question string, passage string, doc_id string"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], DOC)
    q = spark.createDataFrame([(*r, "z") for r in items], ITEM)
    return leaks(d, q, **kw).collect()


def brute(docs, items, run_words=12):
    grams = {}
    for i, *fields in items:
        for f in fields:
            if i is None or f is None:
                continue
            w = words(f)
            for k in range(len(w) - run_words + 1):
                grams.setdefault(tuple(w[k : k + run_words]), set()).add(i)
    out = set()
    for d, t in docs:
        if d is None or t is None:
            continue
        w = words(t)
        for k in range(len(w) - run_words + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run_words]), ())}
    return out


def test_words():
    assert words("Ｆｏｏ-bar_baz’s ﬁn ²x नमस्ते") == ["foo", "bar", "baz", "s", "fin", "2x", "नमस", "त"]
    assert words("a.b C3") == ["a", "b", "c3"] and words("") == []


def test_alignment_against_plain_dynamic_programme():
    r = random.Random(3)
    for _ in range(20):
        a = [r.randint(0, 5) for _ in range(r.randint(1, 14))]
        bs = [[r.randint(-1, 5) for _ in range(r.randint(1, 20))] for _ in range(4)]
        score, longest = align(np.array(a), [np.array(b) for b in bs])
        for b, s, n in zip(bs, score, longest):
            h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            run_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            best = top = 0
            for i, x in enumerate(a, 1):
                for j, y in enumerate(b, 1):
                    same = x == y
                    h[i][j] = max(0, h[i - 1][j - 1] + (2 if same else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                    run_[i][j] = run_[i - 1][j - 1] + 1 if same else 0
                    best, top = max(best, h[i][j]), max(top, run_[i][j])
            assert (s, n) == (best, top)


def test_exact_runs_whatever_the_blocks(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of"] * 8
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(f"q{i}", say(r.randint(5, 25)), say(r.randint(20, 60))) for i in range(20)] + [("null", None, None), (None, say(20), say(20)), ("same", *[say(14)] * 2)]
    docs = []
    for d in range(120):
        parts = [say(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items[:20])[r.choice([1, 2])])
            n = r.randint(8, 16)
            k = r.randint(0, max(0, len(w) - n))
            parts += [" ".join(w[k : k + n]).upper().replace(" ", ", "), say(r.randint(0, 9))]
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (None, docs[0][1]), (501, ""), (502, "— !"), (503, " ".join([say(3000), items[3][2], say(3000)]))]
    want = brute(docs, items)
    assert len(want) > 20
    for block in (2_000_000, 300):
        got = {(x["doc_id"], x["item_id"]) for x in run(spark, docs, items, block=block) if x["run_words"] >= 12}
        assert got == want
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_edited_copy_scores_high(spark):
    base = [f"unique{i}" for i in range(60)]
    edited = [x if i % 9 else "changed" for i, x in enumerate(base)]
    rows = run(spark, [(1, " ".join(edited)), (2, " ".join(base)), (3, "nothing here")], [("q", "short", " ".join(base))])
    got = {r["doc_id"]: (r["run_words"], round(r["coverage"], 2)) for r in rows}
    assert got[1][0] == 8 and got[1][1] > 0.8 and got[2] == (60, 1.0) and 3 not in got
    assert MATCH == 2


def test_popular_edited_copies_are_found(spark):
    base = [f"unique{i}" for i in range(60)]
    edited = " ".join(x if i % 9 else "changed" for i, x in enumerate(base))
    rows = run(spark, [(0, " ".join(base)), *[(i, edited) for i in range(1, 13)]], [("q", "short", " ".join(base))])
    got = {r["doc_id"]: r["coverage"] for r in rows}
    assert set(got) == set(range(13)) and min(got.values()) > 0.8


def test_recall_by_edit_rate_and_chance_hits(spark):
    """Copies with words replaced at random: at 30 % at least nine in ten are found; unrelated texts of the same words are not."""
    r = random.Random(11)
    vocab = [f"word{i}" for i in range(900)]
    items = [(f"q{i}", None, " ".join(r.choice(vocab) for _ in range(r.randint(30, 70)))) for i in range(120)]
    docs, n = [], 0
    for rate, least in ((0.1, 1.0), (0.2, 0.97), (0.3, 0.9)):
        for i, _, text in items:
            copy = " ".join(x if r.random() > rate else r.choice(vocab) for x in text.split())
            docs.append((n, " ".join(r.choice(vocab) for _ in range(40)) + " " + copy + " " + " ".join(r.choice(vocab) for _ in range(40))))
            n += 1
    got = {(x["doc_id"], x["item_id"]) for x in run(spark, docs, items)}
    for k, least in enumerate((1.0, 0.97, 0.9)):
        found = sum((k * 120 + i, f"q{i}") in got for i in range(120))
        assert found >= least * 120
    assert len(got) <= 360


def test_passage_over_the_margin_and_short_fields(spark):
    base = " ".join(f"u{i}" for i in range(40))
    moved = " ".join([*base.split()[:12], *(f"x{i}" for i in range(9)), *base.split()[12:]])
    rows = run(spark, [(1, moved), (2, "a b c"), (3, "p q r s t u v w x")], [("q", "a b c", base), ("s", "p q r s t u v w", None)])
    got = {(r["doc_id"], r["item_id"]): (r["run_words"], r["score"]) for r in rows}
    assert got[1, "q"][0] == 28 and got[1, "q"][1] == 80 - 9 and got[3, "s"] == (8, 16) and (2, "q") not in got
