"""Evidence checking of generated answers, prompts, lenient parsing of replies, and the answering state machine."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import extract_quotes, normalise
from fathom.session import materialize

ANSWER_SCHEMA = "struct<answer:string,claims:array<struct<text:string,citations:array<int>>>,confidence:double>"


def sources_of(hits: DataFrame, most: int = 8) -> DataFrame:
    """``hits`` with ``ref`` 1, 2, ... for the first ``most`` of each query."""
    return hits.where(F.col("rank") <= most).withColumn("ref", F.col("rank").cast("int"))


def _claims(answers: DataFrame) -> DataFrame:
    return answers.select("qid", F.posexplode("claims").alias("claim", "c")).select("qid", "claim", F.col("c.text").alias("text"), F.col("c.citations").alias("citations"))


def _judged(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, answer, judged) with an array of (claim, text, refs, known, quotes) for each answer: the references with
    whether they are known, whether one is, and the quotes with whether a cited source holds them literally.

    The sources of a query are few (they are numbered in its prompt), so they are one array a query and everything
    else is done within the row, after a single join.
    """
    own = sources.groupBy("qid").agg(F.collect_list(F.struct("ref", normalise(F.col("content")).alias("body"))).alias("own"))
    rows = answers.join(own, "qid", "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<ref:int,body:string>>")))

    def judge(c, at):
        cited = F.filter("own", lambda s: F.array_contains(c["citations"], s["ref"]) & s["body"].isNotNull())
        refs = F.transform(c["citations"], lambda r: F.struct(r.alias("ref"), F.exists("own", lambda s: (s["ref"] == r) & s["body"].isNotNull()).alias("known")))
        quotes = F.transform(extract_quotes(c["text"]), lambda q: F.struct(q.alias("quote"), F.exists(cited, lambda s: F.contains(s["body"], q)).alias("found")))
        return F.struct(at.alias("claim"), c["text"].alias("text"), refs.alias("refs"), (F.size(cited) > 0).alias("known"), quotes.alias("quotes"))

    return rows.select("qid", "answer", F.transform(F.coalesce("claims", F.array().cast(_CLAIMS)), judge).alias("judged"))


_CLAIMS = "array<struct<text:string,citations:array<int>>>"


def _faults() -> Column:
    """The faults (kind, claim, detail) of a judged answer, in order."""

    def fault(kind: str, claim: Column, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), claim.cast("int").alias("claim"), detail.alias("detail"))

    def of_claim(j):
        label = F.concat(F.lit("claim "), (j["claim"] + 1).cast("string"))
        unknown = F.transform(F.filter(j["refs"], lambda r: ~r["known"]), lambda r: fault("unknown-citation", j["claim"], F.concat(label, F.lit(" cites unknown source "), r["ref"].cast("string"))))
        uncited = F.when(~j["known"], F.array(fault("uncited-claim", j["claim"], F.concat(label, F.lit(" has no valid citation: "), F.substring(j["text"], 1, 80)))))
        missing = F.transform(F.filter(j["quotes"], lambda q: ~q["found"]), lambda q: fault("quote-not-found", j["claim"], F.concat(label, F.lit(" quotes what its sources lack: "), F.substring(q["quote"], 1, 60))))
        return F.concat(unknown, F.coalesce(uncited, F.array().cast(_FAULTS)), missing)

    none = F.lit(None).cast("int")
    empty = F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", F.array(fault("empty-answer", none, F.lit("the answer is empty"))))
    bare = F.when(F.size("judged") == 0, F.array(fault("no-claims", none, F.lit("the answer has no claims"))))
    nothing = F.array().cast(_FAULTS)
    return F.concat(F.coalesce(empty, nothing), F.coalesce(bare, nothing), F.flatten(F.transform("judged", of_claim)))


_FAULTS = "array<struct<kind:string,claim:int,detail:string>>"


def validation_errors(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, kind, claim, detail) of answers (qid, answer, claims) against sources (qid, ref, content).

    Kinds: empty-answer, no-claims, unknown-citation (each bad reference), uncited-claim (no known reference),
    quote-not-found (quoted code that stands literally in no cited source). Claims count from 0; null for the answer.
    """
    return _judged(answers, sources).select("qid", F.inline(_faults()))


def validate(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, ok, errors, cited_fraction, quotes_checked) of every answer; no claims give a fraction of 0."""
    judged = _judged(answers, sources)
    errors = F.size(_faults()).cast("long")
    cited = F.size(F.filter("judged", lambda j: j["known"])).cast("long")
    quotes = F.aggregate("judged", F.lit(0), lambda n, j: n + F.size(j["quotes"])).cast("long")
    return judged.select(
        "qid", (errors == 0).alias("ok"), errors.alias("errors"),
        F.when(F.size("judged") == 0, 0.0).otherwise(cited / F.size("judged")).alias("cited_fraction"), quotes.alias("quotes_checked"),
    )


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, claim, ref, chunk_id, path, start_line, end_line, symbol_name) of every known reference."""
    cited = _claims(answers).select("qid", "claim", F.explode("citations").alias("ref"))
    return cited.join(sources.select("qid", "ref", "chunk_id", "path", "start_line", "end_line", "symbol_name"), ["qid", "ref"])


def _snippet(path: Column, start: Column, end: Column, ref: Column, language: Column, content: Column, name: Column | None, kind: Column | None, chars: int) -> Column:
    head = F.concat(F.lit("["), ref.cast("string"), F.lit("] "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    lines = [head]
    if name is not None:
        lines.append(F.concat(F.lit("symbol: "), F.coalesce(name, F.lit("(none)")), F.lit(" ("), F.coalesce(kind, F.lit("?")), F.lit(")")))
    return F.concat_ws("\n", *lines, F.concat(F.lit("```"), language), F.substring(content, 1, chars), F.lit("```"))


def _prompt(queries: DataFrame, sources: DataFrame, block: Column, head: str, tail: str, question: str) -> DataFrame:
    blocks = sources.select("qid", "ref", block.alias("block")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ref", "block"))).alias("b"))
    text = F.concat(F.lit(head + "\n\nQuestion: "), F.col(question), F.lit("\n\nSources:\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit("\n\n" + tail))
    return queries.join(blocks, "qid").select("qid", text.alias("prompt"))


ANSWER_HEAD = "Answer the question about a codebase from the numbered sources alone."
ANSWER_TAIL = (
    "Split the answer into claims and give each the numbers of the sources it rests on. Quote code in backticks only "
    "as it stands in a cited source. If the sources hold no answer, set confidence to 0 and name what is missing.\n"
    'Reply with one JSON object: {"answer": text, "claims": [{"text": text, "citations": [numbers]}], "confidence": 0 to 1}'
)
GROUNDED_HEAD = "Judge whether the numbered snippets hold the answer to the question. Do not answer it."
GROUNDED_TAIL = 'A related topic is not an answer. Reply with one JSON object: {"answerable": true or false, "missing": text}'


def answer_prompts(queries: DataFrame, sources: DataFrame, question: str = "query", chars: int = 1200) -> DataFrame:
    """(qid, prompt) for answering, with the sources in order and at most ``chars`` characters of each."""
    c = F.col
    block = _snippet(c("path"), c("start_line"), c("end_line"), c("ref"), c("language"), c("content"), c("symbol_name"), c("symbol_kind"), chars)
    return _prompt(queries, sources, block, ANSWER_HEAD, ANSWER_TAIL, question)


def groundedness_prompts(queries: DataFrame, sources: DataFrame, question: str = "query", chars: int = 600) -> DataFrame:
    """(qid, prompt) asking whether the first eight sources hold an answer."""
    c = F.col
    block = _snippet(c("path"), c("start_line"), c("end_line"), c("ref"), F.lit(""), c("content"), None, None, chars)
    return _prompt(queries, sources.where("ref <= 8"), block, GROUNDED_HEAD, GROUNDED_TAIL, question)


def repair_text(details: list[str]) -> str:
    """What is added to the prompt after a failed check: up to six faults and what to do."""
    return "\n".join([
        "The last answer failed its check:", *[f"- {d}" for d in details[:6]],
        "Write it again. Cite only numbers of the sources given, quote only what a cited source holds, and say so if they hold no answer.",
    ])


def rewrite_prompt(query: str, variants: int = 2) -> str:
    return (
        f"Turn the question about a codebase into {variants} short search queries in the words the code itself would use: names, framework "
        f'terms, protocols. Leave out product language.\n\nQuestion: {query}\n\nReply with one JSON object: {{"queries": [texts]}}'
    )


RERANK_HEAD = "Score from 0 to 10 how directly each snippet answers the question; 0 is unrelated, 10 holds the answer.\n\nQuestion: "
RERANK_TAIL = 'Reply with one JSON object: {"scores": [{"id": number, "score": number}]}'


def rerank_prompt(query: str, snippets: list[dict], chars: int = 400) -> str:
    parts = [
        f"### {i}\npath: {s['path']}:{s['start_line']}-{s['end_line']}\nsymbol: {s.get('symbol_name') or '(none)'} ({s.get('symbol_kind') or '?'})\n```\n{s['content'][:chars]}\n```"
        for i, s in enumerate(snippets)
    ]
    return RERANK_HEAD + "\n\n".join([query, *parts, RERANK_TAIL])


# Lenient parsing of replies


def _candidates(reply: str) -> Iterator[str]:
    """The texts that may be the JSON of a reply: all of it, a fenced block, the widest braces, the widest brackets."""
    yield reply.strip()
    if m := re.search(r"```(?:json)?\s*([\s\S]*?)```", reply):
        yield m.group(1).strip()
    for a, b in ("{}", "[]"):
        i, j = reply.find(a), reply.rfind(b)
        if 0 <= i < j:
            yield reply[i : j + 1]


def loads_lenient(reply: str | None):
    """The first candidate that is JSON, or None."""
    for text in _candidates(reply or ""):
        try:
            return json.loads(text)
        except ValueError:
            continue
    return None


def _number(v) -> float | None:
    try:
        x = float(v) if isinstance(v, (int, float, str)) and not isinstance(v, bool) and str(v).strip() else None
    except ValueError:
        return None
    return x if x is not None and x == x and abs(x) != float("inf") else None


# The names under which models give an index, a score, citations and whether an answer is there.
INDEX_NAMES = ("id", "index", "snippet")
SCORE_NAMES = ("score", "relevance", "rating", "value")
CITATION_NAMES = ("citations", "sources", "refs")
ANSWERABLE_NAMES = ("answerable", "contains_answer", "can_answer")


def parse_scores(reply: str | None, n: int) -> list[tuple[int, float]]:
    """(index, score) pairs of a reranking reply in any of its shapes; indexes outside [0, n) are dropped, the last of an index wins."""

    def entries(rows: list) -> list[tuple]:
        out = []
        for at, row in enumerate(rows):
            if isinstance(row, dict):
                index = next((row[k] for k in INDEX_NAMES if k in row), at)
                value = next((row[k] for k in SCORE_NAMES if k in row), None)
                out.append((index, value))
            else:
                out.append((at, row))
        return clean(out)

    def clean(rows: list[tuple]) -> list[tuple[int, float]]:
        kept = {}
        for index, value in rows:
            i, v = _number(index), _number(value)
            if i is not None and v is not None and i == int(i) and 0 <= i < n:
                kept[int(i)] = v
        return list(kept.items())

    data = loads_lenient(reply)
    if isinstance(data, list):
        return entries(data)
    if isinstance(data, dict):
        for value in data.values():
            if isinstance(value, list) and (found := entries(value)):
                return found
        inner = next((v for v in data.values() if isinstance(v, dict)), None)
        return clean(list(data.items())) or (clean(list(inner.items())) if inner else [])
    return []


def parse_variants(reply: str | None, limit: int = 2) -> list[str]:
    """Search queries of a rewriting reply: a list, or the first list-valued property, of non-empty texts."""
    for text in _candidates(reply or ""):
        try:
            data = json.loads(text)
        except ValueError:
            continue
        rows = data if isinstance(data, list) else next((v for v in data.values() if isinstance(v, list)), []) if isinstance(data, dict) else []
        found = [r.strip() for r in rows if isinstance(r, str) and r.strip()]
        if found:
            return found[:limit]
    return []


def parse_answer(reply: str | None) -> dict | None:
    """The answer of a reply, or None if it holds no JSON.

    Claims of no text are dropped, citations read from ``citations``, ``sources`` or ``refs`` and kept if whole
    numbers (texts of numbers count, null and truth values do not), the confidence clamped to [0, 1], 0 if it is
    no number. A bare scalar is an empty answer.
    """
    data = loads_lenient(reply)
    if data is None:
        return None
    if not isinstance(data, dict):
        return {"answer": "", "claims": [], "confidence": 0.0}
    claims = []
    for c in data.get("claims") if isinstance(data.get("claims"), list) else []:
        if not isinstance(c, dict) or not isinstance(c.get("text"), str) or not c["text"].strip():
            continue
        refs = next((c[k] for k in CITATION_NAMES if isinstance(c.get(k), list)), [])
        numbers = [x for x in map(_number, refs) if x is not None and x == int(x)]
        claims.append({"text": c["text"].strip(), "citations": [int(x) for x in numbers]})
    answer = data.get("answer")
    return {"answer": answer.strip() if isinstance(answer, str) else "", "claims": claims, "confidence": min(1.0, max(0.0, _number(data.get("confidence")) or 0.0))}


def parse_groundedness(reply: str | None) -> dict | None:
    """Whether a reply says that the answer is there, and what it says is missing; None if it says neither."""
    data = loads_lenient(reply)
    if not isinstance(data, dict):
        return None
    value = next((data[k] for k in ANSWERABLE_NAMES if k in data), None)
    if isinstance(value, str):
        value = value.strip().lower().startswith("t") or value.strip().lower() == "yes"
    if not isinstance(value, bool):
        return None
    missing = data.get("missing")
    return {"answerable": value, "missing": missing if isinstance(missing, str) else ""}


_PADDED = r"(?U)^\s|\s\z"


def parsed_answers(replies: DataFrame) -> DataFrame:
    """Replies (qid, reply) with ``parsed`` (null where unusable): replies in the form asked for are parsed in the JVM,
    only the others in Python."""

    @F.pandas_udf(ANSWER_SCHEMA)
    def lenient(reply: pd.Series) -> pd.DataFrame:
        rows = [parse_answer(r) or {"answer": None, "claims": None, "confidence": None} for r in reply]
        return pd.DataFrame(rows, columns=["answer", "claims", "confidence"])

    strict = F.from_json("reply", "answer string, claims array<struct<text:string,citations:array<int>>>, confidence double", {"mode": "PERMISSIVE"})
    out = replies.withColumn("_s", strict)
    # whatever is missing, empty, null or out of range is left to the lenient reader
    sound = (
        F.col("reply").rlike(r'^\s*\{[\s\S]*\}\s*$') & ~F.col("_s.answer").rlike(_PADDED) & F.col("_s.confidence").between(0, 1)
        & (F.size("_s.claims") > 0) & F.forall("_s.claims", lambda c: (c["text"] != "") & ~c["text"].rlike(_PADDED) & (F.size(c["citations"]) >= 0) & F.forall(c["citations"], lambda n: n.isNotNull()))
    )
    out = out.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    out = out.withColumn("_l", lenient(F.when(~F.col("_ok"), F.col("reply"))))
    parsed = F.when(F.col("_ok"), F.struct(F.col("_s.answer").alias("answer"), F.col("_s.claims").alias("claims"), F.col("_s.confidence").alias("confidence")))
    parsed = F.coalesce(parsed, F.when(F.col("_l.confidence").isNotNull(), F.col("_l")))
    return out.withColumn("parsed", parsed).drop("_s", "_l", "_ok")


def ask(queries: DataFrame, sources: DataFrame, generate: Callable[[DataFrame, int], DataFrame], retries: int = 1) -> DataFrame:
    """(qid, kind, text, attempts, ok, confidence): the outcome of every query (qid, query).

    ``generate(prompts, attempt)`` gives (qid, reply, error) for prompts (qid, prompt), once for all open queries.
    No source: refusal without a call. A failed call: refusal at once. No JSON or a failed check: another attempt
    with the faults added, then refusal. Confidence 0: refusal with the model's text, before any check. Only the
    failures of an attempt reach the next one.
    """
    with_sources = sources.select("qid").distinct()
    out = queries.join(with_sources, "qid", "left_anti").select(
        "qid", F.lit("refusal").alias("kind"), F.lit("nothing was retrieved for this question").alias("text"), F.lit(0).alias("attempts"),
        F.lit(False).alias("ok"), F.lit(0.0).alias("confidence"))
    prompts = answer_prompts(queries, sources)
    for attempt in range(1, retries + 2):
        replies = materialize(parsed_answers(generate(prompts, attempt)), f"replies{attempt}")  # a call is never made twice
        state = replies.select("qid", "error", F.col("parsed.answer").alias("answer"), F.col("parsed.claims").alias("claims"), F.col("parsed.confidence").alias("confidence"))
        usable = state.where("error is null and confidence is not null and confidence > 0")
        checked = state.join(validate(usable, sources).select("qid", F.col("ok").alias("valid")), "qid", "left")
        last = attempt == retries + 1
        final = F.lit(last) | F.col("error").isNotNull() | (F.col("confidence") == 0) | F.coalesce("valid", F.lit(False))
        good = F.coalesce("valid", F.lit(False)) & F.col("error").isNull()
        text = (
            F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("confidence") == 0, F.when(F.col("answer") != "", F.col("answer")).otherwise("the sources do not answer the question"))
            .when(good, F.col("answer")).otherwise(f"citations could not be verified after {attempt} attempts"))
        done = checked.withColumn("final", F.coalesce(final, F.lit(last)))
        out = out.unionByName(done.where("final").select(
            "qid", F.when(good, "answer").otherwise("refusal").alias("kind"), text.alias("text"), F.lit(attempt).alias("attempts"),
            F.coalesce(good | (F.col("error").isNull() & (F.col("confidence") == 0)), F.lit(False)).alias("ok"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")))
        if not last:
            failed = done.where(~F.col("final")).select("qid")
            faults = validation_errors(usable.join(failed, "qid", "left_semi"), sources)
            lines = faults.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list("detail")), 1, 6).alias("d"))
            note = F.concat(F.lit("\n\n" + repair_text([]) + "\n"), F.array_join(F.transform(F.coalesce("d", F.array(F.lit("the reply held no JSON"))), lambda x: F.concat(F.lit("- "), x)), "\n"))
            prompts = prompts.join(failed, "qid", "left_semi").join(lines, "qid", "left").select("qid", F.concat("prompt", note).alias("prompt"))
    return out
