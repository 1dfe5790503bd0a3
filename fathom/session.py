"""Session construction and materialisation in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "fathom", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the engine is tuned for; an existing session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset and the master runs in this
    process (tests) a temporary folder is made; a cluster without the setting is an error, since a machine's
    own temporary folder is lost with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="fathom-")
    return _LOCAL


_LOCAL: str | None = None
_WRITTEN: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder's place in the shared folder; it is removed as a materialised frame is."""
    path = f"{shared_dir(spark)}/fathom-{uuid.uuid4().hex}/{tag}"
    _WRITTEN[path] = spark
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and computes an expensive stage once for several
    readers. Folders are removed at the end of the enclosing ``scratch``, else when the driver ends.
    """
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathom_path = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove at the end what is materialised inside, but for the frames handed to the function that it gives.

    ``with scratch() as keep: result = keep(materialize(last, "result"))``
    """
    scope: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._fathom_path)
        return df

    _SCOPES.append(scope)
    try:
        yield keep
    finally:
        _SCOPES.remove(scope)
        for path in scope:
            if path in kept:
                if _SCOPES:
                    _SCOPES[-1].append(path)
            else:
                _remove(path)


def release(df: DataFrame) -> None:
    """Remove the folder of a materialised frame that nothing reads any more."""
    _remove(df._fathom_path)


def _remove(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is None:
        return
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return


@atexit.register
def _clean() -> None:
    for path in list(_WRITTEN):
        _remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
