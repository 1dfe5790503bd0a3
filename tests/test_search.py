import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom.operators import search
from fathom.operators.ranks import cumulative_counts


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vid string, embedding array<float>")


def queries(spark, rows):
    return spark.createDataFrame(rows, "qid string, embedding array<float>")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_matches_brute_force(spark, metric):
    r = random.Random(3)
    vs = [(f"v{i:03}", [r.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [("null", None), ("tie1", [1.0] * 8), ("tie0", [1.0] * 8)]
    qs = [(f"q{i}", [r.gauss(0, 1) for _ in range(8)]) for i in range(5)] + [("t", [1.0] * 8), ("empty", [])]
    got = {}
    for row in search.knn(queries(spark, qs), vectors(spark, vs), 7, metric, block=2).collect():
        got.setdefault(row["qid"], []).append((row["rank"], row["vid"], row["score"]))
    import numpy as np

    for q, v in qs:
        if not v:
            assert q not in got
            continue
        v = np.float32(v).astype(float)

        def score(w):
            w = np.float32(w).astype(float)
            return 1 / (1 + np.sqrt(((v - w) ** 2).sum())) if metric == "l2" else v @ w / (np.linalg.norm(v) * np.linalg.norm(w))

        want = sorted(((-score(w), i) for i, w in vs if w), key=lambda x: (round(x[0], 12), x[1]))[:7]
        assert [x[1] for x in sorted(got[q])] == [i for _, i in want]
        assert all(abs(a[2] + b[0]) < 1e-9 for a, b in zip(sorted(got[q]), want))


def test_knn_dimension_mismatch_and_empty(spark):
    with pytest.raises(Exception, match="dimensions"):
        search.knn(queries(spark, [("q", [1.0, 2.0])]), vectors(spark, [("v", [1.0])]), 1).collect()
    assert search.knn(queries(spark, [("q", [1.0])]).limit(0), vectors(spark, [("v", [1.0])]), 1).count() == 0
    assert search.knn(queries(spark, [("q", [1.0])]), vectors(spark, []), 1).count() == 0


def test_filter_before_and_after_ranking(spark):
    vs = spark.createDataFrame([(f"v{i}", [float(i)], "a" if i < 40 else "b") for i in range(50)], "vid string, embedding array<float>, path string")
    q = queries(spark, [("q", [0.0])])
    assert search.knn(q, vs.where("path = 'b'"), 5).count() == 5
    assert search.knn_overfetch(q, vs, 5, F.col("path") == "b").count() == 0


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    with pytest.raises(Exception, match="dimension"):
        spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<float>, b array<float>").select(search.cosine(F.col("a"), F.col("b"))).collect()


DOCS = [("1", "a/get.go", "get", "get sub domain get"), ("2", "b.go", None, "sub get"), ("3", "c.go", "x", "get sub then get sub"), ("4", "d.go", None, "other words here"), ("5", "e.go", None, None)]


def docs(spark):
    return spark.createDataFrame(DOCS, "id string, path string, symbol_name string, content string")


def plain_bm25(query_terms, single=True):
    import re

    tok = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    cols = {d[0]: [tok(x) for x in d[1:]] for d in DOCS}
    n, avg = len(cols), sum(sum(map(len, c)) for c in cols.values()) / len(cols)
    out = Counter()
    for t in query_terms:
        words = [w for w in t.lower().split("_") if w]
        tf = {d: sum(1 for c in cs for i in range(len(c)) if c[i : i + len(words)] == words) for d, cs in cols.items()}
        df = sum(1 for v in tf.values() if v)
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for d, f in tf.items():
            if f:
                out[d] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(map(len, cols[d])) / avg))
    return out


def test_bm25_with_phrases_and_repeats(spark):
    qs = spark.createDataFrame([("q1", "domain then domain"), ("q2", "get_sub other"), ("q3", "?!"), ("q4", "absent_term")], "qid string, query string")
    got = {}
    for r in search.bm25(qs, docs(spark), 10).collect():
        got.setdefault(r["qid"], {})[r["doc"]] = r["score"] / (1 - r["score"])
    for q, terms in {"q1": ["domain", "then", "domain"], "q2": ["get_sub", "other"]}.items():
        want = plain_bm25(terms)
        assert set(got[q]) == set(want)
        assert all(abs(got[q][d] - want[d]) < 1e-6 for d in want)
    assert "q3" not in got and "q4" not in got


def test_bm25_filter_keeps_statistics(spark):
    qs = spark.createDataFrame([("q", "domain words")], "qid string, query string")
    whole = {r["doc"]: r["score"] for r in search.bm25(qs, docs(spark), 10).collect()}
    part = {r["doc"]: r["score"] for r in search.bm25(qs, docs(spark), 10, keep=spark.createDataFrame([("4",)], "doc string")).collect()}
    assert part == {"4": whole["4"]} and search.bm25(qs, docs(spark).limit(0), 3).count() == 0


def test_keyword_overlap(spark):
    qs = spark.createDataFrame([("q", "domain thing get domain")], "qid string, query string")
    got = {r["doc"]: r["score"] for r in search.keyword_overlap(qs, docs(spark), 10).collect()}
    assert got == {"1": 0.75, "2": 0.25, "3": 0.25}
    assert search.keyword_overlap(qs.limit(0), docs(spark), 10).count() == 0


def plain_overlap(qs, texts):
    """{qid: [(doc, score)]}: the first k of each (qid, query, k) over {doc: text}, worked out query by query."""
    import re

    out = {}
    for q, text, k in qs:
        terms = [t for t in re.split("[^a-z0-9_]+", text.lower()) if len(t) > 2]
        hit = {d: sum(t in h for t in terms) for d, h in texts.items()}
        best = sorted((-n, d) for d, n in hit.items() if n)[:k]
        if best:
            out[q] = [(d, -n / len(terms)) for n, d in best]
    return out


@pytest.mark.parametrize("block, asked", [(100_000, 200_000), (7, 60)])
def test_keyword_overlap_passes_on_only_the_best_of_each_task(spark, monkeypatch, block, asked):
    r = random.Random(11)
    words = [f"w{i:02}x" for i in range(40)] + ["common", "frequent"]
    text = lambda n: " ".join(["common"] + r.choices(words, k=n))
    ds = [(f"d{r.randrange(10**9):09}", text(r.randrange(1, 12))) for _ in range(1500)]
    qs = [(f"q{i:03}", text(r.randrange(1, 9)), r.choice([0, 1, 3, 8])) for i in range(60)] + [("none", "a of !", 3), ("all", "common", 2000), ("null", None, 2)]
    passed = []
    plain = search.top_k_each
    monkeypatch.setattr(search, "top_k_each", lambda rows, *a: passed.append(rows) or plain(rows, *a))
    monkeypatch.setattr(search, "BLOCK_PHRASES", asked)
    out = search.keyword_overlap(
        spark.createDataFrame(qs, "qid string, query string, k int"), spark.createDataFrame(ds, "id string, content string").repartition(4), "k", columns=("content",), block=block)
    got = {}
    for row in out.orderBy("qid", "rank").collect():
        got.setdefault(row["qid"], []).append((row["doc"], row["score"]))
    want = plain_overlap([(q, t or "", k) for q, t, k in qs], dict(ds))
    assert {q: [d for d, _ in x] for q, x in got.items()} == {q: [d for d, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))
    # every query meets all 1,500 documents, for "common" is in each; at most k rows of it leave each of at most 8 tasks
    assert passed[0].where("qid <> 'all'").count() <= 8 * sum(k for _, _, k in qs[:60]) < 60 * 1500 / 10


def test_keyword_overlap_counts_rows_of_one_id_once(spark):
    qs = spark.createDataFrame([("q", "domain thing get domain")], "qid string, query string")
    got = search.keyword_overlap(qs, docs(spark).unionByName(docs(spark)), 10).collect()
    assert {r["doc"]: r["score"] for r in got} == {"1": 0.75, "2": 0.25, "3": 0.25} and len(got) == 3


def test_keyword_overlap_hands_on_early_when_much_is_kept(spark, monkeypatch):
    """What a task may keep comes out in several lots where it is less than k of each query, and nothing twice."""
    monkeypatch.setattr(search, "TASK_HITS", 400)
    qs = spark.createDataFrame([(f"q{i:02}", f"common t{i:02}x") for i in range(40)], "qid string, query string")
    ds = spark.createDataFrame([(f"d{i:03}", f"common t{i % 40:02}x") for i in range(200)], "id string, content string").coalesce(1)
    out = search.keyword_overlap(qs, ds, 2_000_000_000, columns=("content",))
    assert out.agg(F.count(F.lit(1)), F.countDistinct("qid", "doc"), F.sum((F.col("score") == 1).cast("int"))).first() == (8000, 8000, 200)
    few = search.keyword_overlap(qs, ds, 20, columns=("content",)).where("qid = 'q03'").orderBy("rank").collect()
    assert [r["doc"] for r in few] == [f"d{i:03}" for i in (3, 43, 83, 123, 163, *[i for i in range(16) if i != 3])]


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid string, doc string, rank int")


def ranking(spark, *docs_):
    return hits(spark, [("q", d, i + 1) for i, d in enumerate(docs_)])


def order(df):
    return [r["doc"] for r in df.orderBy("rank").collect()]


def test_rrf_laws(spark):
    assert order(search.hybrid(ranking(spark, "a", "b", "c"), ranking(spark, "c", "d", "e"), 9))[0] == "c"
    assert order(search.hybrid(ranking(spark, "a", "b"), ranking(spark, "a", "b"), 9)) == ["a", "b"]
    assert order(search.hybrid(ranking(spark, "a"), ranking(spark, "z"), 9, keyword_weight=10, vector_weight=0.1)) == ["z", "a"]
    assert order(search.hybrid(ranking(spark, "a"), ranking(spark, "z"), 9)) == ["a", "z"]
    assert search.hybrid(ranking(spark).limit(0) if False else hits(spark, []), hits(spark, []), 5).count() == 0
    deep = search.hybrid(ranking(spark, *[f"v{i}" for i in range(50)]), ranking(spark, "v49"), 5)
    assert "v49" in order(deep)


def test_rerank_order_and_scores(spark):
    base = spark.createDataFrame([("q", d, 1 - i / 10, i + 1) for i, d in enumerate("abcd")] + [("single", "x", 0.5, 1)], "qid string, doc string, score double, rank int")
    scores = spark.createDataFrame([("q", "c", 9.0), ("q", "a", 2.0), ("q", "b", 0.0), ("single", "x", 3.0)], "qid string, doc string, value double")
    rows = search.rerank(base, scores).orderBy("qid", "rank").collect()
    assert [(r["doc"], r["score"]) for r in rows] == [("c", 0.9), ("a", 0.2), ("b", 0.0), ("d", 0.7), ("x", 0.5)]
    keyed = search.rerank_batches(base.withColumn("query", F.lit("t")), "m", 3).orderBy("qid", "batch").collect()
    assert [(r["qid"], r["batch"], r["n"]) for r in keyed] == [("q", 0, 3), ("q", 1, 1), ("single", 0, 1)] and len({r["key"] for r in keyed}) == 3


def test_cumulative_counts_in_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i}", i, 1 + i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, w long")
    got = {(r["g"], r["v"]): (r["before"], r["total"]) for r in cumulative_counts(df, ["g"], ["v"], "w", 7).collect()}
    for g, v, _ in rows[:50]:
        mine = [(b, c) for a, b, c in rows if a == g]
        assert got[(g, v)] == (sum(c for b, c in mine if b < v), sum(c for _, c in mine))


def test_hybrid_search_covers_both_tables(spark, tmp_path):
    import duckdb

    from fathom.plans import catalog
    from fathom.plans.views import bm25_sql

    r = random.Random(5)
    say = lambda: " ".join(f"word{r.randint(0, 90)}" for _ in range(12))
    docs = [(i, say()) for i in (*range(40, 112), 150, 200)] + [(250, None)]
    vecs = [(i, [r.gauss(0, 1) for _ in range(4)], i % 5) for i in (*range(80), 100, 300)]  # 50 and 100 in both, 150 and 200 as text, 0 and 300 as vector only
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(x["qid"], x["doc"]): (x["rank"], round(x["score"], 9)) for x in catalog.hybrid_search(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"""WITH HQ AS (SELECT doc_id AS qid, text AS query FROM documents WHERE doc_id % 50 = 0), {bm25_sql('documents', 'doc_id', ('text',), 'HQ', 'qid', 'query')}, R AS (
      SELECT q.vec_id AS qid, v.vec_id AS doc, 0 AS src, 1.0::DOUBLE AS weight, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS rank
      FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 QUALIFY rank <= 50
      UNION ALL SELECT qid, doc, 1, 0.3::DOUBLE, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, doc) AS rank FROM BM QUALIFY rank <= 50
    ) SELECT qid, doc::VARCHAR, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc::VARCHAR) AS rank
    FROM (SELECT qid, doc, round(sum(weight / (60 + rank)), 12) AS score, min(src * 1000000 + rank) AS seen FROM R GROUP BY ALL) QUALIFY rank <= 8""").fetchall()
    assert got == {(q, d): (n, round(s, 9)) for q, d, s, n in want}
    assert {q for q, _ in got} == {0, 50, 100, 150, 200, 300} and ("300" in {d for _, d in got}) and ("150" in {d for _, d in got})


def test_bm25_in_blocks_and_batches(spark, monkeypatch):
    """Blocks of queries, small cells, a filter, ties at the edge, and k by query give what one plain pass gives."""
    import math
    import random

    from fathom.functions.text import plain_tokens
    from fathom.operators import search

    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["the"] * 20
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 30))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t if i % 17 else None, i % 3 == 0) for i, t in enumerate(texts)], "id long, body string, ok boolean").repartition(3)
    asked = [(f"q{i}", " ".join(r.choice(vocab) for _ in range(r.randint(0, 5))) + (" w1_w2" if i % 4 == 0 else ""), i % 6) for i in range(30)]
    queries = spark.createDataFrame(asked, "qid string, query string, k int")
    tokens = {i: plain_tokens(t) if i % 17 else [] for i, t in enumerate(texts)}
    mean = sum(map(len, tokens.values())) / len(tokens)

    def tf(words, found):
        return sum(found[i : i + len(words)] == words for i in range(len(found)))

    want = {}
    for qid, text, k in asked:
        scores = dict.fromkeys(tokens, 0.0)
        for term in [t for t in text.split() if len(t) > 1]:
            words = term.split("_")
            have = {i: n for i, f in tokens.items() if (n := tf(words, f))}
            idf = max(math.log((len(tokens) - len(have) + 0.5) / (len(have) + 0.5)), 1e-6)
            for i, n in have.items():
                scores[i] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean))
        ranked = sorted(((-round(s, 9), i) for i, s in scores.items() if s > 0 and i % 3 == 0))
        want |= {(qid, i): n for n, (_, i) in enumerate(ranked[:k], 1)}
    best = search.PhraseBlock.best
    monkeypatch.setattr(search, "BLOCK_PHRASES", 20)
    monkeypatch.setattr(search.PhraseBlock, "best", lambda *a, **kw: best(*a, **kw, cells=100))
    keep = docs.where("ok").selectExpr("id as doc")
    got = {(x["qid"], x["doc"]): x["rank"] for x in search.bm25(queries, docs, "k", columns=("body",), keep=keep).collect()}
    assert got == want
