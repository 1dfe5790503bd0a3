import io
import json
import threading
import time

import pytest

from fathom import api
from fathom.operators import models, summary
from fathom.operators.code_chunks import chunk_files
from fathom.server import Server, clamp
from fathom.sources import clients


def Model(down=False):
    class Answering:  # local, so that it travels to the tasks by value
        """Answers by the kind of prompt."""

        model = "m"

        def generate(self, prompt):
            if down or ("short search queries" in prompt and "broken" in prompt):
                raise OSError("down")
            if "short search queries" in prompt:
                return '{"queries": ["token check", "session"]}' if "login" in prompt else "garbage"
            if "Score from 0 to 10" in prompt:
                n = prompt.count("### ")
                return json.dumps({"scores": [{"id": i, "score": i} for i in range(n)]})
            return '{"answer": "it checks `check(token)`", "claims": [{"text": "`check(token)`", "citations": [1]}], "confidence": 0.9}'

    return Answering()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "auth.py").write_text("def login(token):\n    # token check of the session\n    return check(token)\n")
    (root / "cart.py").write_text("def price(cart):\n    return sum(cart)\n")
    (root / "note.md").write_text("no code")
    return root


def test_rewriting_is_kept_between_runs(spark, tmp_path):
    q = spark.createDataFrame([("a", "where is login"), ("b", "where is login"), ("c", "other"), ("d", "broken")], "qid string, query string")
    root = f"file://{tmp_path}/cache"
    found, outcomes = models.rewrite_queries(q, Model(), 2, models.ReplyCache(spark, "array<string>", root), at_once=4)
    assert sorted(map(tuple, found.collect())) == sorted((i, n, t) for i in "ab" for n, t in ((1, "token check"), (2, "session")))
    got = models.telemetry(outcomes)
    assert (got["parsed"], got["unparsed"], got["failed"], got["cached"], got["calls"]) == (1, 1, 1, 0, 3) and got["sample"] in ("garbage", "down")
    again, outcomes = models.rewrite_queries(q, Model(down=True), 2, models.ReplyCache(spark, "array<string>", root))
    assert again.count() == 4 and models.telemetry(outcomes)["cached"] == 1 and models.telemetry(outcomes)["failed"] == 2


def test_cache_merges_and_keeps_the_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "MERGE_AT", 3)
    cache = models.ReplyCache(spark, "array<string>", f"file://{tmp_path}/c")
    for i in range(5):
        cache.add(spark.createDataFrame([("same", [str(i)]), (f"k{i}", ["x"])], "key string, value array<string>"))
    rows = {r["key"]: r["value"] for r in cache.read().collect()}
    assert rows["same"] == ["0"] and len(rows) == 6 and len(cache._pointer.read()["parts"]) <= 3


def test_reranking(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", "p", 1, 2, None, None, f"text {i}") for i in range(13)], "id string, path string, start_line int, end_line int, symbol_name string, symbol_kind string, content string")
    base = spark.createDataFrame([("q", "what", f"c{i}", i + 1) for i in range(13)], "qid string, query string, doc string, rank int")
    scores, outcomes = models.rerank_scores(base, chunks, Model())
    got = {r["doc"]: r["value"] for r in scores.collect()}
    assert got == {f"c{i}": float(i % 10) for i in range(13)} and models.telemetry(outcomes)["parsed"] == 2
    scores, outcomes = models.rerank_scores(base, chunks, Model(down=True))
    assert scores.count() == 0 and models.telemetry(outcomes)["failed"] == 2


def test_engine_with_a_model(spark, tmp_path, tree):
    e = api.Engine(spark, f"file://{tmp_path}/index", clients.HashingEmbedder(32), Model(), f"file://{tmp_path}/cache", at_once=2)
    e.index(f"file://{tree}", "r")
    q = spark.createDataFrame([("q", "how does login work"), ("x", "broken price")], "qid string, query string")
    plain = e.find(q, 2, rewrite=False).count()
    assert e.find(q, 2).where("qid = 'q'").count() == 2 and plain == 4 and "rewrite" in e.outcomes
    ranked = e.find(q, 1, rerank=True).collect()
    assert len(ranked) == 2 and models.telemetry(e.outcomes["rerank"])["calls"] == 2
    assert e.search(q, 2, rerank=True).count() == 4
    assert {r["kind"] for r in e.ask(q.where("qid = 'q'")).collect()} == {"answer"}
    gt = spark.createDataFrame([("q", "how does login work", True, ["auth.py"], True), ("r", "price", True, ["cart.py"], None), ("u", "no", False, [], None)], "id string, question string, answerable boolean, expected_files array<string>, verified boolean")
    assert e.evaluate(gt, only_verified=True).select("qid").distinct().count() == 1 and e.evaluate(gt, limit=1, rerank=True).select("qid").distinct().count() == 1
    with pytest.raises(ValueError, match="verified"):
        e.evaluate(gt.where("verified is null"), only_verified=True)
    scores = e.evaluate(gt)
    place = api.save_run(str(tmp_path / "runs"), "hybrid", scores, False)
    saved = json.load(open(place))
    assert saved["retriever"] == "hybrid" and saved["timestamp"].endswith("Z") and len(saved["perQuestion"]) == 8
    with pytest.raises(RuntimeError, match="delete"):
        api.Engine(spark, f"file://{tmp_path}/index", clients.HashingEmbedder(8))
    with pytest.raises(ValueError, match="model"):
        api.Engine(spark, f"file://{tmp_path}/other", clients.HashingEmbedder(8)).find(q, rerank=True)


def test_tools(spark, tmp_path, tree):
    e = api.Engine(spark, f"file://{tmp_path}/index", clients.HashingEmbedder(32), Model())
    s = Server(e, str(tree), "r")
    call = lambda name, **kw: s.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": kw}})["result"]
    text = lambda r: r["content"][0]["text"]
    assert "index_repo" in text(call("search_code", query="login")) and "no index yet" in text(call("index_status"))
    assert "2 files written" in text(call("index_repo")) and "2 unchanged" in text(call("index_repo"))
    assert "auth.py:1-3" in text(call("search_code", query="login", k=99)) and "cart.py" not in text(call("search_code", query="login", path_prefix=f"{tree}/auth"))
    assert "under" in text(call("search_code", query="login", path_prefix="absent/")) and "chunks: 2" in text(call("index_status"))
    assert "confidence 0.90" in text(call("ask_codebase", question="how does login work"))
    assert call("nothing")["isError"] and call("search_code")["isError"]
    out = io.StringIO()
    lines = ['{"jsonrpc":"2.0","id":1,"method":"initialize","params":{}}', '{"jsonrpc":"2.0","method":"notifications/initialized"}', '{"jsonrpc":"2.0","id":2,"method":"tools/list"}', "oops", '{"jsonrpc":"2.0","id":3,"method":"x"}', ""]
    s.run(io.StringIO("\n".join(lines)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == 4 and {t["name"] for t in got[1]["result"]["tools"]} == {"search_code", "ask_codebase", "index_repo", "index_status"} and got[2]["error"]["code"] == -32700
    assert [clamp(x, 8, 30) for x in (None, 0, 99, 3.7, float("nan"), True, "x")] == [8, 1, 30, 3, 8, 8, 8]


def test_summary_and_dry_run(spark, tree):
    got = api.dry_run(spark, f"file://{tree}", "r")
    assert got["files"] == 2 and got["chunks"] == 2 and got["languages"] == {"python": 2} and got["sizes"] == {"<500": 2} and len(got["largest"]) == 2
    empty = chunk_files(spark.createDataFrame([], "repo string, path string, text string"), "", "m", 1)
    assert summary.summarise(empty, 0)["chunks"] == 0


def test_calls_in_parallel_and_errors_that_do_not_pass():
    at = []
    lock = threading.Lock()

    def slow(x):
        with lock:
            at.append(1)
            now = len(at)
        time.sleep(0.05)
        with lock:
            at.pop()
        return x, now

    got = clients.in_parallel(slow, list(range(12)), 3)
    assert [x for x, _ in got] == list(range(12)) and 1 < max(n for _, n in got) <= 3
    tries = []

    def refused():
        tries.append(1)
        raise clients.urllib.error.HTTPError("u", 401, "no", {}, None)

    with pytest.raises(clients.urllib.error.HTTPError):
        clients.with_retry(refused, (0, 0))
    assert len(tries) == 1
    with pytest.raises(RuntimeError, match="not installed"):
        clients.require_installed("a", "u", lambda _: {"models": [{"name": "b:latest"}]})
    with pytest.raises(RuntimeError, match="no model service"):
        clients.require_installed("a", "u", lambda _: 1 / 0)
    clients.require_installed("b", "u", lambda _: {"models": [{"name": "b:latest"}]})
