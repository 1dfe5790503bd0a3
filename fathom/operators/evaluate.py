"""Retrieval metrics, ground-truth checks, refusal calibration and baseline comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.ranks import cumulative_counts

KS = (5, 10, 20, 50)
SIGNALS = ("top_score", "concentration", "gap_ratio", "decay", "above_half", "candidate_count")


def retrieved_files(hits: DataFrame) -> DataFrame:
    """(qid, path, pos): distinct paths of hits (qid, path, rank) by first appearance."""
    first = hits.groupBy("qid", "path").agg(F.min("rank").alias("rank"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "path"))).select("qid", "path", "pos")


def per_question(expected: DataFrame, files: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(qid, k, recall, precision, ndcg, rr) of each question (qid, expected_files) over retrieved files (qid, path, pos).

    k counts distinct files. Precision divides by what was returned; no expected file gives recall and nDCG 1;
    the reciprocal rank is uncut. Repeated expected files count again in recall.
    """
    e = expected.select("qid", F.coalesce("expected_files", F.array().cast("array<string>")).alias("expected"))
    want = e.select("qid", F.explode("expected").alias("path")).groupBy("qid", "path").agg(F.count(F.lit(1)).alias("times"))
    marked = files.join(want, ["qid", "path"], "left")
    cuts = [F.when(F.col("pos") <= k, True) for k in ks]
    gain = F.when(F.col("times").isNotNull(), 1 / F.log2(F.col("pos") + 1))
    aggregates = [F.coalesce(1 / F.min(F.when(F.col("times").isNotNull(), F.col("pos"))), F.lit(0.0)).alias("rr")]
    for k, cut in zip(ks, cuts):
        aggregates += [
            F.coalesce(F.sum(F.when(cut, F.col("times"))), F.lit(0)).alias(f"hit{k}"),
            F.count(F.when(cut & F.col("times").isNotNull(), True)).alias(f"rel{k}"),
            F.count(cut).alias(f"ret{k}"),
            F.coalesce(F.sum(F.when(cut, gain)), F.lit(0.0)).alias(f"dcg{k}"),
        ]
    joined = e.join(marked.groupBy("qid").agg(*aggregates), "qid", "left")
    size = F.size("expected")
    rows = []
    for k in ks:
        hit, rel, ret, dcg = (F.coalesce(F.col(f"{n}{k}"), F.lit(0)) for n in ("hit", "rel", "ret", "dcg"))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), size), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        rows.append(F.struct(
            F.lit(k).alias("k"), F.when(size == 0, 1.0).otherwise(hit / size).alias("recall"),
            F.when(ret == 0, 0.0).otherwise(rel / ret).alias("precision"), F.when(size == 0, 1.0).otherwise(dcg / ideal).alias("ndcg"),
        ))
    return joined.select("qid", F.coalesce("rr", F.lit(0.0)).alias("rr"), F.explode(F.array(*rows)).alias("m")).select("qid", "m.*", "rr")


def aggregate(scores: DataFrame) -> DataFrame:
    """(k, questions, recall, precision, ndcg, mrr, misses): means per k; misses are the questions of recall 0, in order."""
    return scores.groupBy("k").agg(
        F.count(F.lit(1)).alias("questions"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("ndcg").alias("ndcg"),
        F.avg("rr").alias("mrr"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("recall") == 0, F.col("qid")))), ",").alias("misses"),
    )


def require_ks(scores: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``scores``, or an error naming the k that were asked for but not scored."""
    have = {r["k"] for r in scores.select("k").distinct().collect()}
    missing = [k for k in ks if k not in have]
    if missing:
        raise ValueError(f"not scored at k = {', '.join(map(str, missing))}")
    return scores


def spread_subset(questions: DataFrame, limit: int, order: str = "id") -> DataFrame:
    """``limit`` questions at even distances of the order: those at floor(i * n / limit)."""
    n = questions.count()
    if limit >= n:
        return questions
    numbered = cumulative_counts(questions.withColumn("_one", F.lit(1)), [], [order], "_one")
    # the only i that can lead to a position is the least with i * n / limit at or beyond it
    i = F.ceil(F.col("before") * limit / F.lit(n))
    return numbered.where(F.floor(i * F.lit(n) / limit) == F.col("before")).select(*questions.columns)


def ground_truth_problems(q: DataFrame) -> DataFrame:
    """(id, problem): repeated ids, answerable questions without files, unanswerable ones with files, a missing class."""
    files = F.size(F.coalesce("expected_files", F.array().cast("array<string>")))
    repeated = q.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    bare = q.where(F.col("answerable") & (files == 0)).select("id", F.lit("answerable but has no expected files").alias("problem"))
    extra = q.where(~F.col("answerable") & (files > 0)).select("id", F.lit("unanswerable but has expected files").alias("problem"))
    counts = q.agg(F.count(F.when(F.col("answerable"), 1)).alias("a"), F.count(F.when(~F.col("answerable"), 1)).alias("u"))
    none = F.lit(None).cast("string").alias("id")
    lacking = counts.where("a = 0").select(none, F.lit("no answerable questions").alias("problem")).unionByName(
        counts.where("u = 0").select(none, F.lit("no unanswerable questions").alias("problem")))
    return repeated.unionByName(bare).unionByName(extra).unionByName(lacking)


def verified_only(q: DataFrame) -> DataFrame:
    return q.where(F.coalesce("verified", F.lit(False)) | ~F.col("answerable"))


def refusal_signals(hits: DataFrame, n: int = 10) -> DataFrame:
    """(qid, six signals) of ranked hits (qid, rank, score): over the top ``n``, the candidate count over all.

    A total, top or mean of zero or less gives 0; a missing second score counts as 0.
    """
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    base = hits.groupBy("qid").agg(
        F.coalesce(top, F.lit(0.0)).alias("top_score"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
        F.coalesce(F.sum(F.when(F.col("rank") <= n, F.col("score"))), F.lit(0.0)).alias("total"), F.count(F.when(F.col("rank") <= n, 1)).alias("m"),
        F.collect_list(F.when(F.col("rank") <= n, F.col("score"))).alias("scores"), F.count(F.lit(1)).alias("candidate_count"),
    )
    mean = F.when(F.col("m") > 0, F.col("total") / F.col("m")).otherwise(0.0)
    return base.select(
        "qid", "top_score",
        F.when(F.col("total") > 0, F.col("top_score") / F.col("total")).otherwise(0.0).alias("concentration"),
        F.when(F.col("top_score") > 0, (F.col("top_score") - F.col("second")) / F.col("top_score")).otherwise(0.0).alias("gap_ratio"),
        F.when(mean > 0, F.col("top_score") / mean).otherwise(0.0).alias("decay"),
        F.size(F.filter("scores", lambda s: s >= F.col("top_score") / 2)).cast("long").alias("above_half"), "candidate_count",
    )


def should_refuse(signals: DataFrame, min_candidates=None, min_top_score=None, min_concentration=None, min_gap_ratio=None, min_decay=None) -> DataFrame:
    """(qid, refuse, reasons): every rule whose signal lies strictly below its minimum, in fixed order; unset rules are off."""
    rules = []
    if min_candidates is not None:
        rules.append(F.when(F.col("candidate_count") < min_candidates, F.format_string("candidates: %d below %s", F.col("candidate_count"), F.lit(str(min_candidates)))))
    for name, least in (("top_score", min_top_score), ("concentration", min_concentration), ("gap_ratio", min_gap_ratio), ("decay", min_decay)):
        if least is not None:
            rules.append(F.when(F.col(name) < least, F.format_string(f"{name}: %.3f below %s", F.col(name), F.lit(str(least)))))
    reasons = F.filter(F.array(*rules) if rules else F.array().cast("array<string>"), lambda r: r.isNotNull())
    return signals.select("qid", (F.size(reasons) > 0).alias("refuse"), reasons.alias("reasons"))


def unpivot_signals(observations: DataFrame) -> DataFrame:
    """(answerable, signal, value) of observations (qid, answerable, signals)."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in SIGNALS])
    return observations.select("answerable", F.explode(pairs).alias("p")).select("answerable", "p.signal", "p.value")


def sweep(observations: DataFrame, steps: int = 20) -> DataFrame:
    """(signal, step, threshold, true_refusal, false_refusal, youden): refusal rates below evenly spaced thresholds."""
    long = unpivot_signals(observations)
    bounds = long.groupBy("signal").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    grid = bounds.select("signal", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"), "lo", "hi")
    grid = grid.select("signal", "step", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / steps).alias("threshold"))
    # six signals times the steps, so this side is tiny whatever the data
    joined = long.join(F.broadcast(grid), "signal")
    rate = lambda which: F.coalesce(F.avg(F.when(which, (F.col("value") < F.col("threshold")).cast("double"))), F.lit(0.0))
    rates = joined.groupBy("signal", "step", "threshold").agg(rate(~F.col("answerable")).alias("true_refusal"), rate(F.col("answerable")).alias("false_refusal"))
    return rates.withColumn("youden", F.col("true_refusal") - F.col("false_refusal"))


def best_thresholds(observations: DataFrame, steps: int = 20) -> DataFrame:
    """(signal, means, separation, threshold, rates, youden): the earliest threshold of the greatest Youden index."""
    means = unpivot_signals(observations).groupBy("signal").agg(
        F.coalesce(F.avg(F.when(F.col("answerable"), F.col("value"))), F.lit(0.0)).alias("mean_answerable"),
        F.coalesce(F.avg(F.when(~F.col("answerable"), F.col("value"))), F.lit(0.0)).alias("mean_unanswerable"),
    )
    key = F.struct(F.round("youden", 12).alias("y"), (-F.col("step")).alias("s"))
    best = sweep(observations, steps).groupBy("signal").agg(
        *[F.max_by(c, key).alias(c) for c in ("step", "threshold", "true_refusal", "false_refusal", "youden")]
    )
    return means.join(best, "signal").withColumn("separation", F.col("mean_answerable") - F.col("mean_unanswerable"))


def compare_baseline(baseline: DataFrame, current: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, before, after, delta, verdict) of two long frames (metric, value); only metrics of both are compared.

    A change of more than the tolerance is a regression or an improvement; ``questions`` differing makes the runs
    incomparable, which every row then says.
    """
    b, c = baseline.withColumnRenamed("value", "before"), current.withColumnRenamed("value", "after")
    joined = b.join(c, "metric").withColumn("delta", F.col("after") - F.col("before"))
    counted = joined.where("metric = 'questions'").agg(F.coalesce(F.max(F.col("delta") != 0), F.lit(False)).alias("differs"))
    verdict = F.when(F.col("differs"), "incomparable").when(F.col("delta") < -tolerance, "regression").when(F.col("delta") > tolerance, "improvement").otherwise("same")
    return joined.where("metric != 'questions'").crossJoin(F.broadcast(counted)).select("metric", "before", "after", "delta", verdict.alias("verdict"))


def compare_misses(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, change): misses (qid) of only one of two runs, ``new`` or ``fixed``."""
    return after.join(before, "qid", "left_anti").select("qid", F.lit("new").alias("change")).unionByName(
        before.join(after, "qid", "left_anti").select("qid", F.lit("fixed").alias("change")))


def means(scores: DataFrame) -> DataFrame:
    """The aggregate of a run as (metric, value): recall@k, mrr and questions."""
    agg = aggregate(scores)
    recall = agg.select(F.concat(F.lit("recall@"), "k").alias("metric"), F.col("recall").alias("value"))
    top = agg.agg(F.max("mrr").alias("mrr"), F.max("questions").alias("n"))
    return recall.unionByName(top.select(F.lit("mrr").alias("metric"), F.col("mrr").alias("value"))).unionByName(
        top.select(F.lit("questions").alias("metric"), F.col("n").cast("double").alias("value")))


def oracle_hits(questions: DataFrame) -> DataFrame:
    """The ceiling: every expected file in its order (qid, path, rank)."""
    return questions.select("qid", F.posexplode("expected_files").alias("p", "path")).select("qid", "path", (F.col("p") + 1).alias("rank"))


def noisy_hits(questions: DataFrame, distractors: int = 4) -> DataFrame:
    """The ceiling with made-up files between: each expected file follows ``distractors`` that match nothing."""
    step = distractors + 1
    return questions.select("qid", F.posexplode("expected_files").alias("p", "path")).select(
        "qid", F.explode(F.transform(F.sequence(F.lit(1), F.lit(step)), lambda i: F.struct(
            F.when(i == step, F.col("path")).otherwise(F.concat(F.lit("absent/"), F.col("p"), F.lit("-"), i)).alias("path"),
            (F.col("p") * step + i).alias("rank")))).alias("h")
    ).select("qid", "h.path", "h.rank")


def random_hits(questions: DataFrame, files: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The floor: ``k`` different files a question, drawn by a hash of seed and question (qid, path, rank).

    The files are numbered and a question draws numbers, so no question meets all files; only where there are fewer
    than eight times ``k`` files it does, and takes the first by hash.
    """
    pool = files.select("path").distinct()
    n = pool.count()
    if n <= 8 * k:
        mixed = questions.select("qid").crossJoin(F.broadcast(pool)).withColumn("h", F.xxhash64(F.lit(seed), "qid", "path"))  # at most 8k files
        ranked = mixed.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("h", "path")))
        return ranked.where(F.col("rank") <= k).select("qid", "path", "rank")
    numbered = cumulative_counts(pool.withColumn("_one", F.lit(1)), [], ["path"], "_one").select("path", F.col("before").alias("number"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(3 * k)), lambda j: F.pmod(F.xxhash64(F.lit(seed), "qid", j), F.lit(n)).cast("long"))
    drawn = questions.select("qid", F.posexplode(F.slice(F.array_distinct(draws), 1, k)).alias("at", "number"))
    return drawn.join(numbered, "number").select("qid", "path", (F.col("at") + 1).alias("rank"))
