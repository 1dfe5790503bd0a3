"""What a set of chunks looks like: counts by kind, language and size, and the largest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZES = (500, 1500, 3000, 6000)
OVERSIZED = 3000


def by_kind(chunks: DataFrame) -> DataFrame:
    """(kind, n): chunks of each symbol kind, ``none`` for those without."""
    return chunks.groupBy(F.coalesce("symbol_kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def by_language(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def by_size(chunks: DataFrame) -> DataFrame:
    """(bucket, n): chunks below each of ``SIZES`` characters, and those of the last size or more."""
    n = F.length("content")
    bucket = F.when(n < SIZES[0], f"<{SIZES[0]}")
    for size in SIZES[1:]:
        bucket = bucket.when(n < size, f"<{size}")
    return chunks.groupBy(bucket.otherwise(f"{SIZES[-1]}+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def totals(chunks: DataFrame) -> DataFrame:
    """(chunks, median, oversized, unnamed): one row; the upper median comes from counts per size, not from a sort of all rows."""
    z = chunks.select(F.length("content").alias("n"), F.col("symbol_name").isNull().alias("bare"))
    sizes = z.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("bare"), 1)).alias("u"))
    # sizes of chunks are few, so this window over one partition holds one row a size
    run = sizes.withColumn("upto", F.sum("c").over(Window.orderBy("n"))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    return run.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).cast("long").alias("median"),
        F.coalesce(F.sum(F.when(F.col("n") > OVERSIZED, F.col("c"))), F.lit(0)).alias("oversized"), F.coalesce(F.sum("u"), F.lit(0)).alias("unnamed"))


def largest(chunks: DataFrame, most: int = 5) -> DataFrame:
    """(id, path, n): the ``most`` largest chunks."""
    return chunks.select("id", "path", F.length("content").alias("n")).orderBy(F.col("n").desc(), "id").limit(most)


def summarise(chunks: DataFrame, files: int) -> dict:
    """All of the above as one document, with ``files`` as the number of files that gave the chunks."""
    pairs = lambda df: {r[0]: r[1] for r in df.orderBy(F.col("n").desc(), df.columns[0]).collect()}  # noqa: E731 - a row a kind, language or bucket
    return {
        "files": files, **totals(chunks).first().asDict(), "kinds": pairs(by_kind(chunks)), "languages": pairs(by_language(chunks)), "sizes": pairs(by_size(chunks)),
        "largest": [r.asDict() for r in largest(chunks).collect()],
    }
