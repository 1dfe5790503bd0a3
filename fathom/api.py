"""The engine as one object, and its command line: index, search, ask, eval, calibrate, status, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import matches
from fathom.operators import answer, evaluate, models, search, summary
from fathom.operators.code_chunks import chunk_files
from fathom.operators.store import Store
from fathom.schema import EmbeddingMismatchError
from fathom.session import get_spark, materialize
from fathom.sources.clients import HttpModel, create_embedder, embed_column, generate_column
from fathom.sources.files import index_path, load_ground_truth, load_json, read_tree, repository_root, save_json, stale_files
from fathom.streaming.indexer import index_batch

KEYWORD_WEIGHT, ORIGINAL_WEIGHT, CANDIDATES, TOP_K = 0.3, 1.5, 50, 8


class Engine:
    """An index and what is asked of it. ``client`` is the model that rewrites, reranks and answers; ``cache`` a folder
    where its replies are kept between runs."""

    def __init__(self, spark: SparkSession, root: str, embedder, client=None, cache: str | None = None, at_once: int = 1):
        self.spark, self.embedder, self.client, self.cache, self.at_once = spark, embedder, client, cache and cache.rstrip("/"), at_once
        try:
            self.store = Store(spark, root, embedder.model, embedder.dim, embedder.document_prefix)
        except EmbeddingMismatchError as e:
            raise RuntimeError(f"{e}; to use {embedder.model}, delete {root} and index again") from e
        self.outcomes: dict[str, DataFrame] = {}

    def index(self, tree: str, repo: str, force: bool = False, prune: bool = False, git_sha: str = "") -> dict:
        """Index a source tree; gives the number of files per action."""
        files = materialize(read_tree(self.spark, tree, repo).drop("modified"), "tree")
        return index_batch(self.store, files, self.embedder, git_sha, force, prune)

    def retrieve(self, queries: DataFrame, k: int = TOP_K, how: str = "hybrid", **fields: str) -> DataFrame:
        """(qid, doc, score, rank) of queries (qid, query) by ``vector``, ``keyword`` or ``hybrid`` search under a filter."""
        keep = matches(**fields) if any(fields.values()) else None
        depth = max(CANDIDATES, k) if how == "hybrid" else k
        words = self.store.keyword_search(queries, depth, keep) if how != "vector" else None
        if how == "keyword":
            return words.select("qid", "doc", "score", "rank")
        vectors = embed_column(queries, self.embedder, "query", self.embedder.query_prefix).select("qid", "embedding")
        near = self.store.vector_search(vectors, depth, keep=keep)
        return near if how == "vector" else search.hybrid(near.select("qid", "doc", "rank"), words.select("qid", "doc", "rank"), k, KEYWORD_WEIGHT)

    def retrieve_rewritten(self, queries: DataFrame, variants: DataFrame, k: int = TOP_K, original_weight: float = ORIGINAL_WEIGHT, how: str = "hybrid", **fields: str) -> DataFrame:
        """Search of each query and of its variants (qid, n from 1, query) in one batch, fused once more."""
        own = queries.select("qid", F.lit(0).alias("n"), "query").unionByName(variants.select("qid", "n", "query"))
        tagged = own.select(F.concat_ws("\u0001", "qid", F.col("n").cast("string")).alias("qid"), "query")
        found = self.retrieve(tagged, max(CANDIDATES, k), how, **fields)
        parts = F.split("qid", "\u0001")
        rows = found.select(parts[0].alias("qid"), parts[1].cast("int").alias("src"), "doc", "rank")
        return search.rrf(rows.withColumn("weight", F.when(F.col("src") == 0, original_weight).otherwise(1.0)), k)

    def _cache(self, name: str, kind: str) -> models.ReplyCache:
        return models.ReplyCache(self.spark, kind, f"{self.cache}/{name}" if self.cache else None)

    def find(self, queries: DataFrame, k: int = TOP_K, how: str = "hybrid", rewrite: bool | None = None, rerank: bool = False,
             variants: int = 2, original_weight: float = ORIGINAL_WEIGHT, **fields: str) -> DataFrame:
        """(qid, doc, score, rank): retrieval, with rewriting (the default where there is a model) and reranking.

        A failed rewriting leaves the query itself, a failed scoring the order before it. What came of the calls is in
        ``outcomes``, see ``fathom.operators.models.telemetry``.
        """
        rewrite = self.client is not None if rewrite is None else rewrite
        if (rewrite or rerank) and self.client is None:
            raise ValueError("rewriting and reranking need a model")
        depth = max(CANDIDATES, k) if rerank else k
        if rewrite:
            found, self.outcomes["rewrite"] = models.rewrite_queries(queries, self.client, variants, self._cache("rewrites", "array<string>"), self.at_once)
            hits = self.retrieve_rewritten(queries, found, depth, original_weight, how, **fields)
        else:
            hits = self.retrieve(queries, depth, how, **fields)
        if not rerank:
            return hits
        base = materialize(hits.join(queries.select("qid", "query"), "qid"), "candidates")
        scores, self.outcomes["rerank"] = models.rerank_scores(base, self.store.chunks(), self.client, cache=self._cache("scores", "array<struct<index:int,score:double>>"), at_once=self.at_once)
        return search.rerank(base.select("qid", "doc", "score", "rank"), scores, k)

    def search(self, queries: DataFrame, k: int = TOP_K, how: str = "hybrid", **options) -> DataFrame:
        """Hits with their chunks, best first; options as for ``find``."""
        options = {"rewrite": False} | options
        hits = self.find(queries, min(k, 30), how, **options)
        return hits.join(self.store.chunks().withColumnRenamed("id", "doc"), "doc").orderBy("qid", "rank")

    def explain_empty(self, path_prefix: str = "") -> str:
        """Why a search found nothing: an empty index, a prefix under which nothing is stored, or the query itself."""
        if self.store.info() is None:
            return "the index is empty; index a repository first"
        if path_prefix and not self.store.has_path_prefix(path_prefix):
            return f"nothing is indexed under {path_prefix!r}; paths are relative to the repository"
        return "nothing matches the query"

    def sources(self, queries: DataFrame, top_k: int = TOP_K, **options) -> DataFrame:
        """The numbered sources of each query, written once."""
        hits = self.find(queries, min(top_k, 20), **options)
        joined = hits.join(self.store.chunks().withColumnRenamed("id", "doc"), "doc").withColumnRenamed("doc", "chunk_id")
        return materialize(answer.sources_of(joined, min(top_k, 20)), "sources")

    def ask(self, queries: DataFrame, client=None, top_k: int = TOP_K, retries: int = 1, sources: DataFrame | None = None, **options) -> DataFrame:
        """The outcome of each query; see ``fathom.operators.answer.ask``. Options as for ``find``."""
        client = client or self.client
        sources = sources or self.sources(queries, top_k, **options)
        return answer.ask(queries, sources, lambda prompts, _: generate_column(prompts, client, at_once=self.at_once), retries)

    def evaluate(self, questions: DataFrame, how: str = "hybrid", ks: tuple[int, ...] = evaluate.KS, only_verified: bool = False, limit: int | None = None, **options) -> DataFrame:
        """Scores per question and k of the answerable questions, or of the verified ones only; ``limit`` takes a spread subset."""
        asked = questions.where("answerable and verified" if only_verified else "answerable")
        if limit:
            asked = evaluate.spread_subset(asked, limit)
        if asked.isEmpty():
            raise ValueError("no verified answerable question; verify some or evaluate all" if only_verified else "no answerable question")
        q = asked.select(F.col("id").alias("qid"), F.col("question").alias("query"), "expected_files")
        hits = self.find(q.select("qid", "query"), max(CANDIDATES, *ks), how, **({"rewrite": False} | options))
        paths = hits.join(self.store.chunks().select(F.col("id").alias("doc"), "path"), "doc")
        return evaluate.per_question(q, evaluate.retrieved_files(paths), ks)

    def calibrate(self, questions: DataFrame, how: str = "hybrid") -> DataFrame:
        q = questions.where("not answerable or verified").select(F.col("id").alias("qid"), F.col("question").alias("query"), "answerable")
        signals = evaluate.refusal_signals(self.retrieve(q.select("qid", "query"), CANDIDATES, how))
        return evaluate.best_thresholds(materialize(signals.join(q.select("qid", "answerable"), "qid"), "observations"))

    def status(self, tree: str | None = None, repo: str = "", indexed_at: float = 0.0) -> dict:
        out = self.store.stats() | {"index": self.store.info()}
        return out | {"stale": stale_files(read_tree(self.spark, tree, repo), indexed_at)} if tree else out


def dry_run(spark: SparkSession, tree: str, repo: str, git_sha: str = "", include_unparsable: bool = False) -> dict:
    """What an index run would make of a tree, without a model: see ``fathom.operators.summary``."""
    files = materialize(read_tree(spark, tree, repo, include_unparsable=include_unparsable), "tree")
    chunks = materialize(chunk_files(files, git_sha, "none", 0), "chunks")
    return summary.summarise(chunks, chunks.select("path").distinct().count())


def save_run(folder: str, retriever: str, scores: DataFrame, only_verified: bool) -> str:
    """Write an evaluation run, aggregate and questions, as one document named by its time; gives its place."""
    now = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    place = os.path.join(folder, f"{now.replace(':', '-').replace('.', '-')}_{retriever}.json")
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]  # noqa: E731 - a row a question and k
    save_json(place, {"retriever": retriever, "timestamp": now, "onlyVerified": only_verified, "aggregate": rows(evaluate.aggregate(scores), "k"), "perQuestion": rows(scores, "qid", "k")})
    return place


def format_hits(rows: list, lines: int = 2) -> str:
    """Hits with place, kind, name and their first lines."""
    out = []
    for r in rows:
        out += [f"{r['rank']:>3}. {r['score']:.3f}  {r['path']}:{r['start_line']}-{r['end_line']}", f"     {r['symbol_kind'] or '-'}  {r['symbol_name'] or '(unnamed)'}"]
        out += [f"     | {x[:90]}" for x in r["content"].split("\n")[:lines]]
    return "\n".join(out)


def format_scores(rows: list, retriever: str) -> str:
    """The aggregate of a run as a table."""
    out = [f"{retriever}: {rows[0]['questions'] if rows else 0} questions", "   k   recall  precision    nDCG"]
    out += [f"{r['k']:>4} {r['recall']:>7.1%} {r['precision']:>9.1%} {r['ndcg']:>8.1%}" for r in rows]
    if rows:
        out.append(f"MRR {rows[0]['mrr']:.3f}")
        if rows[-1]["misses"]:
            out.append(f"nothing found for: {rows[-1]['misses']}")
    return "\n".join(out)


def format_answer(row, sources: list) -> str:
    """An answer, or the refusal with the sources that came nearest."""
    near = [f"  [{s['ref']}] {s['path']}:{s['start_line']}-{s['end_line']}  {s['symbol_name'] or ''}".rstrip() for s in sources]
    if row["kind"] == "answer":
        return "\n".join([row["text"], "", f"confidence {row['confidence']:.2f}, sources:", *near])
    return "\n".join([f"refused: {row['text']}", *(["nearest sources:", *near[:3]] if near else [])])


def default_index(spark: SparkSession) -> str:
    """Where the index of the working directory's repository lies. Only a local run may put it on this machine."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name the index with --index; it must lie where all executors reach it")
    return "file://" + index_path(repository_root("."), os.path.expanduser("~/.fathom"))[0]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fathom")
    p.add_argument("command", choices=("index", "search", "ask", "eval", "calibrate", "status", "serve"))
    p.add_argument("subject", nargs="?", default="")
    p.add_argument("--index", default="", help="folder of the index; in a local run by default inside the repository")
    p.add_argument("--embedder", default="hashing")
    p.add_argument("--model", default="", help="the model that rewrites, reranks and answers")
    p.add_argument("--cache", default="", help="folder where the model's replies are kept")
    p.add_argument("--repo", default="")
    p.add_argument("--git-sha", default="")
    p.add_argument("--k", type=int, default=TOP_K)
    p.add_argument("--how", choices=("vector", "keyword", "hybrid"), default="hybrid")
    p.add_argument("--path-prefix", default="")
    p.add_argument("--rewrite", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--rerank", action="store_true")
    p.add_argument("--variants", type=int, default=2)
    p.add_argument("--original-weight", type=float, default=ORIGINAL_WEIGHT)
    p.add_argument("--parallel", type=int, default=1, help="model calls at a time in each task")
    p.add_argument("--force", action="store_true")
    p.add_argument("--prune", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--all", action="store_true", help="evaluate unverified questions too")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--runs", default="", help="folder where evaluation runs are written")
    p.add_argument("--baseline", default="")
    p.add_argument("--record", action="store_true")
    a = p.parse_args(argv)
    spark = get_spark()
    repo = a.repo or os.path.basename(os.path.abspath(a.subject.removeprefix("file://") or ".")) or "repo"
    if a.command == "index" and a.dry_run:
        print(json.dumps(dry_run(spark, a.subject, repo, a.git_sha), indent=2))
        return 0
    embedder, client = create_embedder(a.embedder), HttpModel(a.model) if a.model else None
    if client is not None:
        client.check()
    e = Engine(spark, a.index or default_index(spark), embedder, client, a.cache or None, a.parallel)
    find = {"rewrite": a.rewrite, "rerank": a.rerank, "variants": a.variants, "original_weight": a.original_weight}
    one = spark.createDataFrame([("q", a.subject)], "qid string, query string")
    if a.command == "index":
        if hasattr(embedder, "check"):
            embedder.check()
        print(json.dumps(e.index(a.subject, repo, a.force, a.prune, a.git_sha) | e.store.stats()))
    elif a.command == "status":
        print(json.dumps(e.status()))
    elif a.command == "serve":
        from fathom.server import Server

        Server(e, a.subject or ".", repo).run(sys.stdin, sys.stdout)
    elif a.command == "search":
        rows = e.search(one, a.k, a.how, path_prefix=a.path_prefix, **(find | {"rewrite": bool(a.rewrite)})).collect()
        print(format_hits(rows) if rows else e.explain_empty(a.path_prefix))
    elif a.command == "ask":
        if client is None:
            p.error("ask needs --model")
        sources = e.sources(one, a.k, how=a.how, **find)
        row = e.ask(one, sources=sources).first()
        print(format_answer(row, sources.orderBy("ref").collect()))
        return 0 if row["kind"] == "answer" else 2
    else:
        _, questions = load_ground_truth(spark, a.subject)
        if a.command == "calibrate":
            e.calibrate(questions, a.how).show(truncate=False)
            return 0
        name = "+".join([a.how, *(["rewrite"] if a.rewrite else []), *(["rerank"] if a.rerank else [])])
        scores = materialize(e.evaluate(questions, a.how, only_verified=not a.all, limit=a.limit or None, **(find | {"rewrite": bool(a.rewrite)})), "scores")
        print(format_scores(evaluate.aggregate(scores).orderBy("k").collect(), name))
        for step, outcomes in e.outcomes.items():
            print(f"{step}: {json.dumps(models.telemetry(outcomes))}")
        if a.runs:
            print(save_run(a.runs, name, scores, not a.all))
        now = {r["metric"]: r["value"] for r in evaluate.means(scores).collect()}
        if a.record:
            save_json(a.baseline, now)
        elif a.baseline and (before := load_json(a.baseline)):
            frame = lambda m: spark.createDataFrame(list(m.items()), "metric string, value double")
            rows = evaluate.compare_baseline(frame(before), frame(now)).collect()
            print("\n".join(f"{r['metric']}: {r['before']:.3f} -> {r['after']:.3f} {r['verdict']}" for r in rows))
            return int(any(r["verdict"] in ("regression", "incomparable") for r in rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
