"""Processing only new or changed records.

State is one row per key with the hash of the content that was committed last, kept in parts under one folder. A run
hashes the current records, joins them with the state, processes what is new or changed, and only then publishes the
next version of the state, a small document that lists the parts in force. A run that dies before that leaves the old
version in force, so its records come out again; a run that ends publishes all of them at once, so none comes out twice.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.session import folder
from fathom.sources.pointer import ConcurrentCommit, Pointer


def canonical_path(path: Column) -> Column:
    """Repository-relative path: forward slashes, no empty or ``.`` parts, no leading ``/`` or ``./``."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, r"/(?:\.?/)+", "/")
    return F.regexp_replace(p, r"^(?:\.?/)+", "")


def current_versions(obs: DataFrame, key=("repo", "path"), hash_col="content_hash", order=("recorded_at", "rec_id")) -> DataFrame:
    """The newest observed hash of each key: that of the row greatest in ``order`` (nulls sort first).

    Rows without a hash or with a null in the key are left out. ``max_by`` is combined before the shuffle, so a
    key that holds a third of all rows costs one row a task.
    """
    rows = obs.where(F.col(hash_col).isNotNull() & _all_set(key))
    return rows.groupBy(*key).agg(F.max_by(F.lower(hash_col), F.struct(*order)).alias("content_hash"))


def committed_state(obs: DataFrame, key=("repo", "path"), hash_col="content_hash", at="processed_at", tie="rec_id") -> DataFrame:
    """The hash committed last for each key; a row counts as committed when ``at`` is set, whatever became of its run."""
    rows = obs.where(F.col(hash_col).isNotNull() & F.col(at).isNotNull() & _all_set(key))
    return rows.groupBy(*key).agg(F.max_by(F.lower(hash_col), F.struct(at, tie)).alias("content_hash"))


def _all_set(key) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).isNotNull()
    return out


def select_changed(current: DataFrame, state: DataFrame, key=("repo", "path")) -> DataFrame:
    """Keys of ``current`` that the state lacks or holds with another hash, with ``change`` = new | changed.

    Both sides hold one row a key, so the join is one-to-one and has no hot key.
    """
    old = state.select(*key, F.col("content_hash").alias("_old"))
    joined = current.join(old, list(key), "left")
    return joined.where(F.col("_old").isNull() | (F.col("_old") != F.col("content_hash"))).select(
        *key, "content_hash", F.when(F.col("_old").isNull(), "new").otherwise("changed").alias("change")
    )


def actions(current: DataFrame, state: DataFrame, key=("repo", "path")) -> DataFrame:
    """(key, action) of every key on either side: add, update, skip, or stale where it is only in the state."""
    old = state.select(*key, F.col("content_hash").alias("_old"))
    joined = current.select(*key, "content_hash").join(old, list(key), "full")
    action = F.when(F.col("content_hash").isNull(), "stale").when(F.col("_old").isNull(), "add").when(F.col("_old") == F.col("content_hash"), "skip")
    return joined.select(*key, action.otherwise("update").alias("action"))


def observations(files: DataFrame) -> DataFrame:
    """``indexed_files`` with canonical paths; only the columns that decide what is pending are read."""
    return files.select("repo", canonical_path(F.col("path")).alias("path"), "content_hash", "recorded_at", "rec_id", "processed_at")


def hashed(records: DataFrame, columns: list[str], out: str = "content_hash") -> DataFrame:
    """``records`` with a hash of the values of ``columns``; null, the empty string and another column's value differ."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(c).cast("string") for c in columns)]
    return records.withColumn(out, F.sha2(F.concat(*parts), 256))


def pending_files(files: DataFrame, store: StateStore | None = None) -> DataFrame:
    """Files whose current content is not committed yet: (repo, path, content_hash, change).

    The committed rows are published as the next version of ``store``, by default a new one in the shared folder, and
    the current hashes are compared with what the store then holds.
    """
    obs = observations(files)
    store = store or StateStore(files.sparkSession, folder(files.sparkSession, "state"))
    store.commit(committed_state(obs))
    return store.plan(current_versions(obs))


class StateStore:
    """Versions of the key-to-hash state under one folder; each version lists the parts that make it up.

    * ``plan(records)`` gives the new and changed keys against the version in force.
    * ``commit(processed)`` writes a part of the processed keys and publishes a version with it, all at once.
      ``processed`` overrides the state key by key. Committing a batch again changes nothing.
    * The cost of a commit follows its size: a part is merged with those before it only while they are not much larger,
      so a key is rewritten as often as the logarithm of the number of commits. Later parts win.
    * A part that no version lists (a run that died) is never read; ``vacuum`` removes it.
    * A writer that finds a version newer than the one it began from raises ``ConcurrentCommit`` and publishes nothing,
      as does the slower of two that publish at the same moment.
    """

    SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("repo", "path", "content_hash")])

    def __init__(self, spark: SparkSession, root: str, key=("repo", "path")):
        self.spark, self.root, self.key = spark, root.rstrip("/"), tuple(key)
        self._pointer = Pointer(spark, f"{self.root}/versions")

    def version(self) -> dict | None:
        """The version in force, or None before the first commit."""
        number, content = self._pointer.latest()
        return content and content | {"version": number}

    def _rows(self, parts: list[dict]) -> DataFrame:
        """The rows of some parts; of several for a key, that of the last part."""
        rows = None
        for n, part in enumerate(parts):
            own = self.spark.read.parquet(f"{self.root}/{part['dir']}").select(*self.key, "content_hash", F.lit(n).alias("_n"))
            rows = own if rows is None else rows.unionByName(own)
        if len(parts) == 1:
            return rows.drop("_n")
        return rows.groupBy(*self.key).agg(F.max_by("content_hash", "_n").alias("content_hash"))

    def read(self) -> DataFrame:
        v = self.version()
        if v is None:
            schema = T.StructType([T.StructField(n, T.StringType()) for n in (*self.key, "content_hash")])
            return self.spark.createDataFrame([], schema)
        return self._rows(v["parts"])

    def plan(self, current: DataFrame) -> DataFrame:
        return select_changed(current, self.read(), self.key)

    def _write(self, rows: DataFrame) -> dict:
        part = {"dir": f"v-{uuid.uuid4().hex}"}
        rows.select(*self.key, "content_hash").write.parquet(f"{self.root}/{part['dir']}")
        return part | {"rows": self.spark.read.parquet(f"{self.root}/{part['dir']}").count()}

    def commit(self, processed: DataFrame) -> dict:
        before = self.version()
        parts = before["parts"] if before else []
        new = self._write(processed.select(*self.key, F.lower("content_hash").alias("content_hash")))
        size, keep = new["rows"], len(parts)
        while keep and parts[keep - 1]["rows"] <= 2 * size:
            keep -= 1
            size += parts[keep]["rows"]
        if self.version() == before and keep < len(parts):
            new = self._write(self._rows([*parts[keep:], new]))
        after = {"parts": [*parts[:keep], new]}
        if self.version() != before:
            raise ConcurrentCommit(f"state moved from {before} to {self.version()} during the run")
        self._pointer.swap(after, before["version"] if before else 0)
        return after

    def vacuum(self, older_than: float = 86_400.0) -> list[str]:
        """Remove the parts that no kept version lists, if they are older than so many seconds; gives their names."""
        listed = {p["dir"] for v in self._pointer.versions() for p in v["parts"]}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = []
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if name.startswith("v-") and name not in listed and time.time() - s.getModificationTime() / 1000 >= older_than:
                fs.delete(s.getPath(), True)
                gone.append(name)
        return gone
