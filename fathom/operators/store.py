"""The chunk store: chunks, vectors and file hashes under one folder, as a list of parts.

Every change writes one part (new rows, and the ids that it removes from earlier parts) and publishes a version that
lists it, so a reader sees either all of a change or none, and a run that dies leaves the old version. Of two writers
that began from the same version one fails. The cost of a change follows its size, not the store's; when there are
``COMPACT_AT`` parts, the next change merges them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.text import matches
from fathom.operators import search
from fathom.operators.incremental import actions
from fathom.schema import CHUNK_SCHEMA, EmbeddingMismatchError, fields
from fathom.session import folder, materialize, scratch
from fathom.sources.pointer import Pointer

VECTOR_SCHEMA = fields("id string, embedding array<float>")
FILE_SCHEMA = fields("repo string, path string, content_hash string")
GONE_SCHEMA = fields("id string")
#: So many parts are read together before a change merges them.
COMPACT_AT = 8
#: Up to so many ids (16 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


class Store:
    """Chunks with their vectors and the hashes of the files they came from, for one embedding model.

    Without ``root`` the store lives in the shared folder for as long as the driver.
    """

    def __init__(self, spark: SparkSession, root: str | None, model: str, dim: int, prefix: str = ""):
        self.spark, self.root, self.model, self.dim, self.prefix = spark, (root or folder(spark, "store")).rstrip("/"), model, dim, prefix
        self._pointer = Pointer(spark, f"{self.root}/versions")
        meta = self._pointer.read()
        if meta:
            if (meta["model"], meta["dim"]) != (model, dim):
                raise EmbeddingMismatchError((meta["model"], meta["dim"]), (model, dim))
            if meta["prefix"] != prefix:
                raise ValueError("the index was built with another document prefix; delete it and index again")

    def _parts(self) -> list[str]:
        meta = self._pointer.read()
        return meta["parts"] if meta else []

    def _part(self, part: str, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{part}/{name}")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of all parts that no later part removed."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = gone = None
        removed = sum(self._pointer.read()["gone"].values())
        for n, part in enumerate(parts):
            own = self._part(part, name, schema).withColumn("_n", F.lit(n))
            rows = own if rows is None else rows.unionByName(own)
            if n:
                out = self._part(part, "gone", GONE_SCHEMA).withColumn("_gone", F.lit(n))
                gone = out if gone is None else gone.unionByName(out)
        if gone is None:
            return rows.drop("_n")
        last = gone.groupBy("id").agg(F.max("_gone").alias("_gone"))
        if removed <= BROADCAST_IDS:
            last = F.broadcast(last)
        return rows.join(last, "id", "left").where(F.col("_gone").isNull() | (F.col("_n") >= F.col("_gone"))).select(*schema.names)

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK_SCHEMA)

    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTOR_SCHEMA)

    def files(self) -> DataFrame:
        """The hash recorded last for each file."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], FILE_SCHEMA)
        rows = None
        for n, part in enumerate(parts):
            own = self._part(part, "files", FILE_SCHEMA).withColumn("_n", F.lit(n))
            rows = own if rows is None else rows.unionByName(own)
        if len(parts) == 1:
            return rows.drop("_n")
        return rows.groupBy("repo", "path").agg(F.max_by("content_hash", "_n").alias("content_hash"))

    def _publish(self, number: int, parts: list[str], chunks: DataFrame, vectors: DataFrame, files: DataFrame, gone: DataFrame) -> None:
        part = f"p-{uuid.uuid4().hex}"
        # a repository's filter then reads its own folders only; by range, so that a large repository is several files
        chunks.select(*CHUNK_SCHEMA.names).repartitionByRange("repo", "path").write.partitionBy("repo").parquet(f"{self.root}/{part}/chunks")
        vectors.select(*VECTOR_SCHEMA.names).write.parquet(f"{self.root}/{part}/vectors")
        files.select(*FILE_SCHEMA.names).write.parquet(f"{self.root}/{part}/files")
        gone.select("id").distinct().write.parquet(f"{self.root}/{part}/gone")
        old = (self._pointer.read() or {"gone": {}})["gone"]
        counts = {p: old.get(p, 0) for p in parts} | {part: self._part(part, "gone", GONE_SCHEMA).count()}
        self._pointer.swap({"parts": [*parts, part], "gone": counts, "model": self.model, "dim": self.dim, "prefix": self.prefix}, number)

    def compact(self) -> None:
        """Merge all parts into one."""
        number, meta = self._pointer.latest()
        if meta and len(meta["parts"]) > 1:
            self._publish(number, [], self.chunks(), self.vectors(), self.files(), self.spark.createDataFrame([], GONE_SCHEMA))

    def check(self, chunks: DataFrame) -> None:
        """Raise if a chunk was embedded by another model, in another dimension, or has a vector of another length."""
        wrong = chunks.where((F.col("embedding_model") != self.model) | (F.col("embedding_dim") != self.dim)).select("embedding_model", "embedding_dim").first()
        if wrong:
            raise EmbeddingMismatchError((self.model, self.dim), (wrong[0], wrong[1]))
        if "embedding" in chunks.columns and (size := chunks.where(F.size("embedding") != self.dim).select(F.size("embedding")).first()):
            raise EmbeddingMismatchError((self.model, self.dim), (self.model, size[0]))

    def apply(self, new: DataFrame | None = None, drop_files: DataFrame | None = None, files: DataFrame | None = None) -> None:
        """One commit: chunks of ``drop_files`` (repo, path) go, ``new`` chunks with ``embedding`` replace those of
        their ids, the hashes of ``files`` are recorded. A null or an empty frame changes nothing."""
        with scratch():
            if new is not None:
                # written once, so that a model is asked once for each vector
                new = materialize(new.dropDuplicates(["id"]), "new")
                self.check(new)
            if len(self._parts()) >= COMPACT_AT:
                self.compact()
            self._apply(new, drop_files, files)

    def _apply(self, new: DataFrame | None, drop_files: DataFrame | None, files: DataFrame | None) -> None:
        number, meta = self._pointer.latest()
        empty = lambda schema: self.spark.createDataFrame([], schema)
        gone = empty(GONE_SCHEMA)
        if drop_files is not None:
            gone = gone.unionByName(self.chunks().join(drop_files, ["repo", "path"], "left_semi").select("id"))
        if new is not None:
            gone = gone.unionByName(new.select("id"))
        chunks = new.drop("embedding") if new is not None else empty(CHUNK_SCHEMA)
        vectors = new.select("id", "embedding") if new is not None else empty(VECTOR_SCHEMA)
        known = files.select("repo", "path", "content_hash") if files is not None else empty(FILE_SCHEMA)
        self._publish(number, meta["parts"] if meta else [], chunks, vectors, known, gone)

    def upsert(self, chunks: DataFrame) -> None:
        self.apply(new=chunks)

    def delete_by_file(self, files: DataFrame) -> int:
        """Delete the chunks of the files; their hashes stay, as a deleted file is no changed one. Gives the number of chunks."""
        n = self.chunks().join(files, ["repo", "path"], "left_semi").count()
        if n:
            self.apply(drop_files=files.select("repo", "path"))
        return n

    def get_by_ids(self, ids: list[str]) -> list:
        """The chunks of ``ids`` in their order; unknown ids are dropped."""
        wanted = self.spark.createDataFrame([(i, p) for p, i in enumerate(ids)], "id string, position int")
        return self.chunks().join(F.broadcast(wanted) if len(ids) <= BROADCAST_IDS else wanted, "id").orderBy("position").drop("position").collect()

    def get_many(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (any columns with ``id``) joined with the stored chunks; unknown ids are dropped."""
        return wanted.join(self.chunks(), "id")

    def plan(self, current: DataFrame, force: bool = False, prune: bool = False) -> DataFrame:
        """(repo, path, action) of the files (repo, path, content_hash) against the stored hashes, before any chunking.

        ``force`` updates unchanged files too; files gone from the repository (stale) are kept unless ``prune``.
        """
        out = actions(current, self.files())
        if force:
            out = out.withColumn("action", F.when(F.col("action") == "skip", "update").otherwise(F.col("action")))
        return out if prune else out.where("action != 'stale'")

    def stats(self) -> dict:
        """Chunks, distinct paths (equal paths of two repositories count once), files of all repositories, vectors."""
        row = self.chunks().agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("path").alias("files"), F.count_distinct("repo", "path").alias("files_by_repo")).first()
        return row.asDict() | {"vectors": self.vectors().count()}

    def info(self) -> dict | None:
        """Model and dimension of the stored index, None while it has no chunks."""
        meta = self._pointer.read()
        if not meta or self.chunks().isEmpty():
            return None
        return {"model": meta["model"], "dim": meta["dim"]}

    def has_path_prefix(self, prefix: str) -> bool:
        return not self.chunks().where(F.col("path").startswith(prefix)).limit(1).isEmpty()

    def vector_search(self, queries: DataFrame, k: int, metric: str = "l2", keep: Column | None = None, overfetch: int = 0) -> DataFrame:
        """k-NN over the stored vectors (qid, doc, score, rank). A filter acts before ranking; with ``overfetch`` it
        acts after fetching that many times k, and may leave fewer."""
        v = self.vectors().withColumnRenamed("id", "vid")
        if keep is None:
            near = search.knn(queries, v, k, metric)
        elif overfetch:
            near = search.knn_overfetch(queries, v.join(self.chunks().withColumnRenamed("id", "vid"), "vid"), k, keep, metric, overfetch)
        else:
            near = search.knn(queries, v.join(self.chunks().where(keep).select(F.col("id").alias("vid")), "vid", "left_semi"), k, metric)
        return near.withColumnRenamed("vid", "doc")

    def keyword_search(self, queries: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
        """BM25 over path, symbol and content (qid, doc, score, rank); statistics stay those of the whole store."""
        c = self.chunks()
        return search.bm25(queries, c, k, keep=c.where(keep).select(F.col("id").alias("doc")) if keep is not None else None)


def retrieval_filter(**fields: str) -> Column:
    """A predicate for the searches; see ``fathom.functions.text.matches``."""
    return matches(**fields)


