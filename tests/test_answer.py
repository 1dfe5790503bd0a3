import json

import pytest
from pyspark.sql import functions as F

from fathom.operators import answer as an

SRC = "qid string, ref int, chunk_id string, path string, start_line int, end_line int, symbol_name string, symbol_kind string, language string, content string"
ANS = "qid string, answer string, claims array<struct<text:string,citations:array<int>>>"


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("q", 1, "c1", "a.ts", 1, 3, "f", "function", "typescript", "const a  =\n 'x';"), ("q", 2, "c2", "b.ts", 4, 5, None, None, "typescript", "return b + 1;")]
    return spark.createDataFrame(rows, SRC)


def check(spark, sources, claims, text="fine"):
    df = spark.createDataFrame([("q", text, claims)], ANS)
    v = an.validate(df, sources).first()
    return v, sorted((r["kind"], r["claim"]) for r in an.validation_errors(df, sources).collect())


def test_valid_answer(spark, sources):
    v, errors = check(spark, sources, [("see `const a = 'x';`", [1]), ("and ```ts\nreturn b + 1;\n``` `name`", [1, 2])])
    assert errors == [] and v["ok"] and v["cited_fraction"] == 1 and v["quotes_checked"] == 2


def test_each_fault(spark, sources):
    assert check(spark, sources, [("x", [9])])[1] == [("uncited-claim", 0), ("unknown-citation", 0)]
    assert check(spark, sources, [("x", [])])[1] == [("uncited-claim", 0)]
    assert check(spark, sources, [("`return c;`", [2])])[1] == [("quote-not-found", 0)]
    assert check(spark, sources, [("`return b + 1;`", [1])])[1] == [("quote-not-found", 0)]
    assert check(spark, sources, [("`return b + 1;`", [])])[1] == [("quote-not-found", 0), ("uncited-claim", 0)]
    assert check(spark, sources, [], " ")[1] == [("empty-answer", None), ("no-claims", None)]
    v, _ = check(spark, sources, [("x", [1]), ("y", [])])
    assert v["cited_fraction"] == 0.5 and not v["ok"]


def test_citations_and_prompts(spark, sources):
    df = spark.createDataFrame([("q", "t", [("x", [2, 9])])], ANS)
    assert [(r["ref"], r["chunk_id"], r["start_line"]) for r in an.resolve_citations(df, sources).collect()] == [(2, "c2", 4)]
    q = spark.createDataFrame([("q", "why?")], "qid string, query string")
    p = an.answer_prompts(q, sources, chars=7).first()["prompt"]
    assert "[1] a.ts:1-3\nsymbol: f (function)\n```typescript\nconst a\n```\n\n[2] b.ts" in p and "symbol: (none) (?)" in p and "Question: why?" in p
    assert "symbol" not in an.groundedness_prompts(q, sources).first()["prompt"].split("Sources:")[1].split("JSON")[0]
    assert an.repair_text([str(i) for i in range(9)]).count("- ") == 6


@pytest.mark.parametrize("reply, want", [
    ('{"scores":[{"id":0,"score":7},{"id":1,"score":2}]}', [(0, 7), (1, 2)]),
    ('[{"index":1,"relevance":3},{"index":0,"relevance":9}]', [(1, 3), (0, 9)]),
    ("[7, 2]", [(0, 7), (1, 2)]), ('{"0": 7, "1": "2"}', [(0, 7), (1, 2)]), ('```json\n{"scores":[7,2]}\n```', [(0, 7), (1, 2)]),
    ('Here: {"scores":[{"snippet":0,"rating":7}]} ok', [(0, 7)]), ('{"scores":{"0":5}}', [(0, 5)]), ('[{"value":4},{"value":5}]', [(0, 4), (1, 5)]),
    ('{"scores":[{"id":5,"score":1},{"id":0,"score":"x"}]}', []), ("garbage", []), (None, []), ("[1, 2, 3]", [(0, 1), (1, 2)]), ('[{"id":0,"score":1},{"id":0,"score":4}]', [(0, 4)]),
])
def test_score_shapes(reply, want):
    assert an.parse_scores(reply, 2) == want


def test_variant_shapes():
    assert an.parse_variants('{"queries": ["a b", " ", 3, "c"]}') == ["a b", "c"]
    assert an.parse_variants('x ["a","b","c"] y', 2) == ["a", "b"]
    assert an.parse_variants('```\n{"n": 1, "v": ["z"]}\n```') == ["z"] and an.parse_variants("no") == [] and an.parse_variants(None) == []


def test_answer_shapes():
    full = an.parse_answer('x {"answer": " a ", "claims": [{"text": "t", "refs": ["1", 2, null, true, 2.5]}, {"text": " "}, 3], "confidence": 7} y')
    assert full == {"answer": "a", "claims": [{"text": "t", "citations": [1, 2]}], "confidence": 1.0}
    assert an.parse_answer('{"answer": "a", "confidence": "high"}')["confidence"] == 0.0 and an.parse_answer('{"answer": "a"}')["confidence"] == 0.0
    assert an.parse_answer("3") == {"answer": "", "claims": [], "confidence": 0.0} and an.parse_answer("none") is None and an.parse_answer(None) is None


def test_groundedness_shapes():
    assert an.parse_groundedness('{"answerable": true, "missing": "m"}') == {"answerable": True, "missing": "m"}
    assert an.parse_groundedness('{"can_answer": "Yes"}')["answerable"] and not an.parse_groundedness('{"contains_answer": "no"}')["answerable"]
    assert an.parse_groundedness("[]") is None and an.parse_groundedness('{"answerable": 3}') is None


def test_state_machine(spark, sources):
    src = None
    for q in ("good", "retry", "never", "zero", "error", "garbage"):
        one = sources.withColumn("qid", F.lit(q))
        src = one if src is None else src.unionByName(one)
    qs = spark.createDataFrame([(q, "why?") for q in ("good", "retry", "never", "zero", "error", "garbage", "none")], "qid string, query string")
    calls = []

    def generate(prompts, attempt):
        seen = sorted(r["qid"] for r in prompts.select("qid").collect())
        calls.append((attempt, seen))
        good = json.dumps({"answer": "yes", "claims": [{"text": "`return b + 1;`", "citations": [2]}], "confidence": 0.9})
        bad = good.replace("[2]", "[9]")
        reply = F.when(F.col("qid") == "good", good).when(F.col("qid") == "retry", good if attempt > 1 else bad).when(F.col("qid") == "never", bad).when(F.col("qid") == "zero", '{"answer": "cannot", "claims": [{"text": "`zz z`", "citations": [9]}], "confidence": 0}').when(F.col("qid") == "garbage", "no json")
        return prompts.select("qid", reply.alias("reply"), F.when(F.col("qid") == "error", "model down").alias("error"))

    out = {r["qid"]: (r["kind"], r["text"], r["attempts"], r["ok"]) for r in an.ask(qs, src, generate).collect()}
    failed = "citations could not be verified after 2 attempts"
    assert out == {
        "good": ("answer", "yes", 1, True), "retry": ("answer", "yes", 2, True), "never": ("refusal", failed, 2, False), "zero": ("refusal", "cannot", 1, True),
        "error": ("refusal", "model down", 1, False), "garbage": ("refusal", failed, 2, False), "none": ("refusal", "nothing was retrieved for this question", 0, False)}
    assert calls == [(1, ["error", "garbage", "good", "never", "retry", "zero"]), (2, ["garbage", "never", "retry"])]
