"""Incremental indexing as a stream: every micro-batch of file versions is planned, chunked, embedded and committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.operators.code_chunks import chunk_files
from fathom.operators.store import Store
from fathom.sources.clients import embed_column


def index_batch(store: Store, files: DataFrame, embedder, git_sha: str = "", force: bool = False, prune: bool = False) -> dict:
    """Index files (repo, path, text, content_hash): only new and changed ones are chunked and embedded.

    A file seen several times counts with its last row by hash order of (path); callers that stream versions pass the
    newest only. Everything the batch changes becomes visible in one commit.
    """
    plan = store.plan(files.select("repo", "path", "content_hash"), force, prune)
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    work = plan.where("action in ('add', 'update')").select("repo", "path")
    changed = files.join(work, ["repo", "path"], "left_semi")
    if counts.get("add", 0) + counts.get("update", 0) + counts.get("stale", 0):
        chunks = chunk_files(changed, git_sha, embedder.model, embedder.dim)
        chunks = embed_column(chunks, embedder, "embedding_text", embedder.document_prefix)
        drop = plan.where("action in ('update', 'stale')").select("repo", "path")
        store.apply(new=chunks, drop_files=drop, files=changed.select("repo", "path", "content_hash"))
    return counts


def index_stream(stream: DataFrame, store: Store, embedder, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Start indexing a stream of file versions (repo, path, text, content_hash, recorded_at).

    Within a micro-batch the newest version of a file counts. A batch that is delivered again after a failure finds
    its hashes already recorded and changes nothing. Rows later than ``delay`` behind the newest are dropped by the
    watermark only where the caller aggregates; here every version is compared with the store.
    """

    def handle(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("repo", "path").agg(F.max_by(F.struct("text", "content_hash"), "recorded_at").alias("v"))
        index_batch(store, newest.select("repo", "path", "v.text", "v.content_hash"), embedder)

    return stream.withWatermark("recorded_at", delay).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "2 hours", at: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums of events per tumbling window and key, late rows accepted up to ``delay``; works on streams and tables."""
    rows = events.withWatermark(at, delay) if events.isStreaming else events
    return rows.groupBy(F.window(at, window).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), key, "events", "total")
