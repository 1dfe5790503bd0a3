"""Rewriting of queries and reranking of hits by a model, for whole batches of queries, with replies kept between runs.

The model is called in the tasks, once for each distinct question that no earlier run has a usable reply to. What came
of every call is a row, so counts are sums over the data and none is lost with a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import search
from fathom.operators.answer import RERANK_HEAD, RERANK_TAIL, parse_scores, parse_variants, rewrite_prompt
from fathom.session import folder, materialize
from fathom.sources.clients import generate_column
from fathom.sources.pointer import ConcurrentCommit, Pointer

#: So many parts of a cache are read together before an addition merges them.
MERGE_AT = 16


class ReplyCache:
    """Rows (key, value) under one folder, kept between runs; ``value`` is of the Spark type given.

    Additions of several writers all stay: one that finds a newer version publishes again on top of it. Of two values
    of a key the one added first stays. Without a folder the rows live as long as the driver.
    """

    def __init__(self, spark: SparkSession, kind: str, root: str | None = None):
        self.spark, self.kind, self.root = spark, kind, (root or folder(spark, "cache")).rstrip("/")
        self._pointer = Pointer(spark, f"{self.root}/versions")

    def read(self) -> DataFrame:
        return self._rows((self._pointer.read() or {"parts": []})["parts"])

    def _rows(self, parts: list[str]) -> DataFrame:
        schema = f"key string, value {self.kind}"
        rows = None
        for n, part in enumerate(parts):
            own = self.spark.read.schema(schema).parquet(f"{self.root}/{part}").withColumn("_n", F.lit(n))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        return rows.groupBy("key").agg(F.min_by("value", "_n").alias("value"))

    def add(self, rows: DataFrame) -> None:
        part = f"p-{uuid.uuid4().hex}"
        rows.select("key", "value").write.parquet(f"{self.root}/{part}")
        while True:
            number, content = self._pointer.latest()
            parts = [*(content or {"parts": []})["parts"], part]
            if len(parts) > MERGE_AT:
                merged = f"p-{uuid.uuid4().hex}"
                self._rows(parts).write.parquet(f"{self.root}/{merged}")
                parts = [merged]
            try:
                return self._pointer.swap({"parts": parts}, number)
            except ConcurrentCommit:
                continue


def _answered(prompts: DataFrame, client, cache: ReplyCache, parse, at_once: int) -> tuple[DataFrame, DataFrame]:
    """(values, outcomes): (key, value) of prompts (key, prompt, n), and what came of each: ``cached``, ``parsed``, ``unparsed`` or ``failed``.

    ``parse(reply, n)`` gives the value as a list, empty if the reply is unusable. Only usable values are kept.
    """
    asked = materialize(prompts.dropDuplicates(["key"]), "asked")
    known = materialize(cache.read().join(asked.select("key"), "key", "left_semi"), "known")
    fresh = asked.join(known.select("key"), "key", "left_anti")
    replies = generate_column(fresh, client, "key", at_once).join(fresh.select("key", "n"), "key")

    kind = pa.list_(pa.struct([("index", pa.int32()), ("score", pa.float64())])) if "struct" in cache.kind else pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [parse(r, n) if r is not None else [] for r, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([v or None for v in values], kind)], ["key", "reply", "error", "value"])

    # written before anything reads it, so a call is never made twice
    done = materialize(replies.select("key", "reply", "n", "error").mapInArrow(run, f"key string, reply string, error string, value {cache.kind}"), "replies")
    if not (usable := done.where("value is not null").select("key", "value")).isEmpty():
        cache.add(usable)
    outcome = F.when(F.col("value").isNotNull(), "parsed").when(F.col("error").isNotNull(), "failed").otherwise("unparsed")
    outcomes = done.select("key", outcome.alias("outcome"), F.substring(F.coalesce("error", "reply"), 1, 400).alias("sample"))
    return known.unionByName(usable), outcomes.unionByName(known.select("key", F.lit("cached").alias("outcome"), F.lit(None).cast("string").alias("sample")))


def telemetry(outcomes: DataFrame) -> dict:
    """Counts of the outcomes and a sample of an unusable reply or error."""
    rows = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("sample")).collect()  # four rows at most
    out = dict.fromkeys(("cached", "parsed", "unparsed", "failed"), 0) | {r["outcome"]: r["n"] for r in rows}
    return out | {"calls": out["parsed"] + out["unparsed"] + out["failed"], "sample": next((r["sample"] for r in rows if r["outcome"] in ("unparsed", "failed")), None)}


def rewrite_queries(queries: DataFrame, client, variants: int = 2, cache: ReplyCache | None = None, at_once: int = 1) -> tuple[DataFrame, DataFrame]:
    """(variants, outcomes): the search variants (qid, n from 1, query) of queries (qid, query); a failed or unusable reply gives none."""
    cache = cache or ReplyCache(queries.sparkSession, "array<string>")
    head, tail = rewrite_prompt("\0", variants).split("\0")
    key = F.sha2(F.concat_ws("\0", F.lit(client.model), F.lit(str(variants)), F.col("query")), 256)
    keyed = queries.select("qid", "query", key.alias("key"))
    prompts = keyed.select("key", F.concat(F.lit(head), "query", F.lit(tail)).alias("prompt"), F.lit(variants).alias("n"))
    values, outcomes = _answered(prompts, client, cache, parse_variants, at_once)
    found = keyed.join(values, "key").select("qid", F.posexplode("value").alias("p", "query"))
    return found.select("qid", (F.col("p") + 1).alias("n"), "query"), outcomes


def rerank_scores(base: DataFrame, chunks: DataFrame, client, size: int = 10, chars: int = 400, cache: ReplyCache | None = None, at_once: int = 1) -> tuple[DataFrame, DataFrame]:
    """(scores, outcomes): a model's (qid, doc, value from 0 to 10) of ranked hits ``base`` (qid, query, doc, rank).

    Hits are scored ``size`` at a time; a batch without a usable reply has no scores, so its hits keep their old order.
    """
    cache = cache or ReplyCache(base.sparkSession, "array<struct<index:int,score:double>>")
    own = chunks.select(F.col("id").alias("doc"), "path", "start_line", "end_line", "symbol_name", "symbol_kind", F.substring("content", 1, chars).alias("content"))
    keys = search.rerank_batches(base, client.model, size)
    ranked = base.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int")).withColumn("index", ((F.col("rank") - 1) % size).cast("int"))
    # a hit without its chunk still counts in the batch, so that indexes stay true
    shown = ranked.join(own, "doc", "left").withColumn("symbol", F.concat(F.coalesce("symbol_name", F.lit("(none)")), F.lit(" ("), F.coalesce("symbol_kind", F.lit("?")), F.lit(")")))
    part = F.concat(F.lit("### "), "index", F.lit("\npath: "), F.coalesce("path", F.lit("?")), F.lit(":"), F.coalesce("start_line", F.lit(0)), F.lit("-"), F.coalesce("end_line", F.lit(0)),
                    F.lit("\nsymbol: "), "symbol", F.lit("\n```\n"), F.coalesce("content", F.lit("")), F.lit("\n```"))
    text = shown.groupBy("qid", "query", "batch").agg(F.array_sort(F.collect_list(F.struct("index", part.alias("part")))).alias("parts"))
    text = text.select("qid", "batch", F.concat(F.lit(RERANK_HEAD), "query", F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"), F.lit("\n\n" + RERANK_TAIL)).alias("prompt"))
    keys = materialize(keys.join(text, ["qid", "batch"]), "batches")
    values, outcomes = _answered(keys.select("key", "prompt", "n"), client, cache, parse_scores, at_once)
    scores = keys.select("qid", "batch", "key").join(values, "key").select("qid", "batch", F.inline("value"))
    return scores.join(ranked.select("qid", "batch", "index", "doc"), ["qid", "batch", "index"]).select("qid", "doc", F.col("score").alias("value")), outcomes
