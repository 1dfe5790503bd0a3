"""One ranking from several differently-scaled scores, by leximin order over percentiles.

A score becomes its mid-rank percentile among the scores of its own source and query, so neither a source's
scale nor one far-off value matters. An item's percentiles, one a source of the query and 0 for a source that
does not list it, are sorted ascending; items are compared by these arrays, greatest first. The weakest source
is compared first, so a weak score cannot be masked by a strong one.

Defined cases: null, NaN and infinite scores and rows with a null query, source or item are not usable and
count for nothing; an item repeated in a source counts once with its best score; equal scores share one
percentile; items with equal arrays are ordered by item; a query without a usable score yields no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.ranks import cumulative_counts


def usable(hits: DataFrame, query="qid", source="source", item="chunk_id", score="score") -> DataFrame:
    """(q, src, item, score): the best usable score of each item in each source of each query."""
    rows = hits.select(
        F.col(query).alias("q"), F.col(source).alias("src"), F.col(item).alias("item"), F.col(score).cast("double").alias("score")
    ).where("q is not null and src is not null and item is not null and score is not null and not isnan(score) and abs(score) < double('Infinity')")
    return rows.groupBy("q", "src", "item").agg(F.max("score").alias("score"))


def percentiles(best: DataFrame) -> DataFrame:
    """(q, src, score, pct): the mid-rank percentile of each distinct score of a source in a query."""
    counts = best.groupBy("q", "src", "score").agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulative_counts(counts, ["q", "src"], ["score"], "n")
    return ranked.select("q", "src", "score", ((F.col("before") + F.col("n") / 2) / F.col("total")).alias("pct"))


def leximin_vectors(hits: DataFrame, **names) -> DataFrame:
    """(q, item, vec): ascending percentiles of each item, padded with 0 for the sources of the query that lack it."""
    best = usable(hits, **names)
    scored = best.join(percentiles(best), ["q", "src", "score"])
    sources = best.groupBy("q").agg(F.count_distinct("src").alias("n_src"))
    vec = scored.groupBy("q", "item").agg(F.collect_list("pct").alias("v")).join(sources, "q")
    padded = F.concat(F.array_repeat(F.lit(0.0), (F.col("n_src") - F.size("v")).cast("int")), F.array_sort("v"))
    return vec.select("q", "item", padded.alias("vec"))


def leximin_first(hits: DataFrame, **names) -> DataFrame:
    """(q, item): the first item of each query. One aggregate with partial maxima, no window."""
    v = leximin_vectors(hits, **names)
    key = F.struct(F.transform("vec", lambda x: -x).alias("neg"), F.col("item"))
    return v.groupBy("q").agg(F.min(key)["item"].alias("item"))


def leximin_ranking(hits: DataFrame, **names) -> DataFrame:
    """(q, item, position, weakest, mean): the whole ranking of every query, positions from 1."""
    v = leximin_vectors(hits, **names).select(
        "q", "item", F.transform("vec", lambda x: -x).alias("neg"), F.lit(1).cast("long").alias("one"),
        F.element_at("vec", 1).alias("weakest"), (F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / F.size("vec")).alias("mean"),
    )
    ranked = cumulative_counts(v, ["q"], ["neg", "item"], "one")
    return ranked.select("q", "item", (F.col("before") + 1).alias("position"), "weakest", "mean")
