import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from fathom.api import Engine
from fathom.operators.store import Store, retrieval_filter
from fathom.schema import CHUNK_SCHEMA, EmbeddingMismatchError
from fathom.sources import clients, files
from fathom.streaming.indexer import index_batch, index_stream, windowed_counts


def chunk(i, path="src/a.ts", repo="r", vector=(1.0, 0.0), content=None, model="m", dim=2):
    return (i, repo, path, "typescript", i, "function", 1, 2, content or f"text {i}", "e", ["x"], "sha", model, dim, list(vector))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), StructType([*CHUNK_SCHEMA.fields, StructField("embedding", ArrayType(FloatType()))]))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/index", "m", 2)


def test_upsert_delete_stats(spark, store):
    assert store.info() is None and store.stats() == {"chunks": 0, "files": 0, "files_by_repo": 0, "vectors": 0}
    store.upsert(frame(spark, chunk("a"), chunk("b", "src/b.ts"), chunk("c", "src/b.ts", "s")))
    store.upsert(frame(spark, chunk("a", content="newer", vector=(0.0, 1.0))))
    assert store.stats() == {"chunks": 3, "files": 2, "files_by_repo": 3, "vectors": 3} and store.info() == {"model": "m", "dim": 2}
    assert [r["content"] for r in store.get_by_ids(["c", "zz", "a"])] == ["text c", "newer"]
    assert store.delete_by_file(spark.createDataFrame([("r", "src/b.ts")], "repo string, path string")) == 1
    assert store.stats()["chunks"] == 2 and store.stats()["vectors"] == 2
    assert store.has_path_prefix("src/") and not store.has_path_prefix("s_c") and not store.has_path_prefix("SRC")


def test_many_changes_are_merged(spark, store):
    for i in range(10):
        store.upsert(frame(spark, chunk("a", content=f"v{i}"), chunk(f"b{i}")))
    assert len(store._parts()) <= 8 and store.stats()["chunks"] == 11 == store.stats()["vectors"]
    assert store.get_by_ids(["a"])[0]["content"] == "v9"
    store.compact()
    assert len(store._parts()) == 1 and store.stats()["chunks"] == 11


def test_mismatches(spark, store):
    store.upsert(frame(spark, chunk("a")))
    with pytest.raises(EmbeddingMismatchError):
        Store(spark, store.root, "other", 2)
    with pytest.raises(ValueError, match="prefix"):
        Store(spark, store.root, "m", 2, "d: ")
    with pytest.raises(EmbeddingMismatchError):
        store.upsert(frame(spark, chunk("b", model="x")))
    with pytest.raises(EmbeddingMismatchError):
        store.upsert(frame(spark, chunk("b", vector=(1.0,))))
    assert Store(spark, store.root, "m", 2).stats()["chunks"] == 1


def test_searches_and_filters(spark, store):
    store.upsert(frame(spark, *[chunk(f"c{i}", f"src/{i % 2}.ts", vector=(1.0, i / 10)) for i in range(10)]))
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<float>")
    near = store.vector_search(q, 3).orderBy("rank").collect()
    assert [r["doc"] for r in near] == ["c0", "c1", "c2"] and near[0]["score"] == 1
    assert [r["doc"] for r in store.vector_search(q, 3, keep=retrieval_filter(path_prefix="src/1")).orderBy("rank").collect()] == ["c1", "c3", "c5"]
    assert store.vector_search(q, 1, keep=retrieval_filter(path_prefix="src/1"), overfetch=1).count() == 0
    words = store.keyword_search(spark.createDataFrame([("q", "c3 text")], "qid string, query string"), 2).orderBy("rank").collect()
    assert words[0]["doc"] == "c3" and 0 < words[0]["score"] < 1


def test_index_twice_and_change(spark, tmp_path):
    tree = tmp_path / "tree"
    for p, t in {"src/a.py": "def f():\n    return 1\n", "src/b.ts": "export function g() {\n  return 2;\n}\n", "node_modules/x.ts": "function z() {}\n", "big.py": "x" * 400_001, "logo.png": "x"}.items():
        (tree / p).parent.mkdir(parents=True, exist_ok=True)
        (tree / p).write_text(t)
    assert files.walk(str(tree)) == ["big.py", "logo.png", "src/a.py", "src/b.ts"]
    e = Engine(spark, f"file://{tmp_path}/index", clients.HashingEmbedder(16))
    assert e.index(f"file://{tree}", "r") == {"add": 2}
    assert e.index(f"file://{tree}", "r") == {"skip": 2}
    (tree / "src/a.py").write_text("def f():\n    return 3\n")
    os.remove(tree / "src/b.ts")
    assert e.index(f"file://{tree}", "r") == {"update": 1}
    assert sorted(r["content"] for r in e.store.chunks().collect()) == ["def f():\n    return 3", "export function g() {\n  return 2;\n}"]
    assert e.index(f"file://{tree}", "r", prune=True) == {"skip": 1, "stale": 1}
    assert e.index(f"file://{tree}", "r", force=True) == {"update": 1}
    assert e.store.stats()["chunks"] == 1
    q = spark.createDataFrame([("q", "return f")], "qid string, query string")
    hits = e.search(q, 5).collect()
    assert hits[0]["symbol_name"] == "f" and e.search(q, 5, path_prefix="lib/").count() == 0
    assert "lib/" in e.explain_empty("lib/") and "matches" in e.explain_empty()
    assert files.stale_files(files.read_tree(spark, f"file://{tree}", "r"), time.time() - 3600) == 1
    assert files.stale_files(files.read_tree(spark, f"file://{tree}", "r"), time.time() + 3600) == 0
    variants = spark.createDataFrame([("q", 1, "f")], "qid string, n int, query string")
    assert e.retrieve_rewritten(q, variants, 3).first()["qid"] == "q"
    assert e.status()["index"]["dim"] == 16

    class Model:
        def generate(self, prompt):
            if "broken" in prompt:
                raise OSError("down")
            return '{"answer": "it returns 3", "claims": [{"text": "`return 3`", "citations": [1]}], "confidence": 1}'

    both = spark.createDataFrame([("q", "return f"), ("b", "broken f")], "qid string, query string")
    assert {r["qid"]: (r["kind"], r["text"]) for r in e.ask(both, Model()).collect()} == {"q": ("answer", "it returns 3"), "b": ("refusal", "down")}
    gt = spark.createDataFrame([("q", "return f", True, ["src/a.py"], True), ("u", "nothing", False, [], None)], "id string, question string, answerable boolean, expected_files array<string>, verified boolean")
    assert e.evaluate(gt).where("k = 5").first()["recall"] == 1 and e.calibrate(gt).count() == 6


def test_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index", "hashing", 64)
    src = str(tmp_path / "in")
    now = dt.datetime(2026, 1, 1)
    rows = [("r", "a.py", "def f():\n    pass\n", "h1", now), ("r", "a.py", "def g():\n    pass\n", "h2", now + dt.timedelta(minutes=5)), ("r", "b.py", "def h():\n    pass\n", "h3", now)]
    df = spark.createDataFrame(rows, "repo string, path string, text string, content_hash string, recorded_at timestamp")
    df.write.parquet(src)
    for _ in range(2):
        index_stream(spark.readStream.schema(df.schema).parquet(src), store, clients.HashingEmbedder(), str(tmp_path / "cp")).awaitTermination()
        assert sorted(r["symbol_name"] for r in store.chunks().collect()) == ["g", "h"]
    assert index_batch(store, df.where("content_hash = 'h2'").drop("recorded_at"), clients.HashingEmbedder()) == {"skip": 1}
    events = spark.createDataFrame([(now, "a", 1.0), (now + dt.timedelta(minutes=59), "a", 2.0), (now + dt.timedelta(minutes=61), "a", 4.0)], "ts timestamp, event_type string, value double")
    assert sorted(r["total"] for r in windowed_counts(events).collect()) == [3.0, 4.0]


def test_embedders(spark):
    calls = []

    def transport(url, body, headers):
        calls.append((url, len(body["input"]), body["input"][0]))
        return {"embeddings": [[1.0] * 768 for _ in body["input"]]}

    e = clients.create_embedder("nomic-embed-text", transport=transport)
    assert len(e.embed(["t"] * 32)) == 32 and [c[1] for c in calls] == [16, 16] and calls[0][0].endswith("/api/embed")
    assert clients.create_embedder("ollama:qwen3-embedding:4b").model == "qwen3-embedding:4b" and clients.create_embedder("qwen3-embedding:4b").dim == 2560
    with pytest.raises(ValueError, match="provider"):
        clients.create_embedder("acme:model")
    with pytest.raises(ValueError, match="key"):
        clients.create_embedder("openai:text-embedding-3-small")
    wrong = clients.HttpEmbedder("ollama", "m", 3, "u", transport=transport)
    with pytest.raises(EmbeddingMismatchError):
        wrong.check()
    tries = []

    def flaky(url, body, headers):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("no")
        return {"data": [{"embedding": [0.0, 1.0]}]}

    assert clients.HttpEmbedder("openai", "m", 2, "u", "k", transport=flaky, wait=0).embed(["a"]) == [[0.0, 1.0]] and len(tries) == 3
    with pytest.raises(RuntimeError, match="cannot be used"):
        clients.HttpEmbedder("ollama", "m", 2, "u", transport=lambda *a: (_ for _ in ()).throw(OSError("x")), wait=0).check()
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [len(r["v"]) for r in clients.embed_column(df, clients.HashingEmbedder(8), "t", "d: ", "v").collect()] == [8, 8]


def test_reranker_rewriter_telemetry():
    replies = iter(['{"scores":[{"id":0,"score":5}]}', "garbage"])

    def transport(url, body, headers):
        return {"response": next(replies)}

    r = clients.ModelReranker(clients.HttpModel("m", transport=transport))
    snippet = {"path": "p", "start_line": 1, "end_line": 2, "content": "c" * 999}
    assert r.score("k", "q", [snippet]) == [(0, 5.0)] == r.score("k", "q", [snippet]) and r.score("k2", "q", [snippet]) == [] and r.score("k3", "q", [snippet]) == []
    t = r.telemetry
    assert (t.calls, t.parsed, t.cached, t.unparsed, t.failed, t.sample) == (3, 1, 1, 1, 1, "garbage")
    w = clients.ModelRewriter(clients.HttpModel("m", transport=lambda *a: {"response": '["a", "b", "c"]'}))
    assert w.rewrite("q") == ["a", "b"] and w.cache == {"q": ["a", "b"]}
    assert clients.ModelRewriter(clients.HttpModel("m", transport=lambda *a: 1 / 0)).rewrite("q") == []
    clients.HttpModel("m").check(["m:latest"])
    with pytest.raises(RuntimeError):
        clients.HttpModel("m").check(["mm"])


def test_ground_truth_and_json(spark, tmp_path):
    p = str(tmp_path / "x" / "gt.json")
    assert files.load_json(p, {}) == {}
    files.save_json(p, {"meta": {"a": "b"}, "questions": [{"id": "q", "answerable": True, "expectedFiles": ["f"]}, {"id": "u", "answerable": False, "expectedFiles": [], "refusalReason": "r"}]})
    meta, q = files.load_ground_truth(spark, p)
    assert meta == {"a": "b"} and q.where("answerable").first()["expected_files"] == ["f"] and q.where(F.col("refusal_reason") == "r").count() == 1
    files.save_json(p, {"questions": [{"id": "q", "answerable": True}]})
    with pytest.raises(ValueError, match="no expected files.*|no unanswerable"):
        files.load_ground_truth(spark, p)
    (tmp_path / ".git").mkdir()
    (tmp_path / "d" / "e").mkdir(parents=True)
    assert files.repository_root(str(tmp_path / "d" / "e")) == str(tmp_path.resolve())
    assert files.index_path("/nowhere/repo", "/cache", {}) == ("/cache/nowhere-repo", False) and files.index_path("/x", "/c", {"FATHOM_INDEX": "/i"}) == ("/i", True)


def test_two_writers(spark, store):
    from fathom.sources.pointer import ConcurrentCommit

    store.upsert(frame(spark, chunk("a")))
    other = Store(spark, store.root, "m", 2)
    publish = other._publish

    def late(*args):
        store.upsert(frame(spark, chunk("b")))
        publish(*args)

    other._publish = late
    with pytest.raises(ConcurrentCommit):
        other.upsert(frame(spark, chunk("c")))
    assert sorted(r["id"] for r in store.chunks().collect()) == ["a", "b"]
    other._publish = publish
    other.upsert(frame(spark, chunk("c")))
    assert store.stats()["chunks"] == 3 == store.stats()["vectors"]
