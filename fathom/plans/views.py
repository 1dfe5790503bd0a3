"""Derived views that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.session import table

#: SQL of the views below, as the inside of a WITH clause.
C = """C AS (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, git_sha DESC) = 1)"""
H = """H AS (
  SELECT qid, source, chunk_id, score, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT qid, source, chunk_id, max(score) AS score FROM scored_chunks WHERE score IS NOT NULL AND isfinite(score) GROUP BY ALL))"""
S = """S AS (
  SELECT H.qid, H.rank AS ref, C.id AS chunk_id, C.path, C.language, C.symbol_name, C.symbol_kind, C.start_line, C.end_line, C.content, H.rank, H.score
  FROM H JOIN C ON C.id = H.chunk_id WHERE H.source = 'fused' AND H.rank <= 8)"""


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``chunks`` with one row an id, the latest; an id delivered again agrees in all but commit and time."""
    t = table(spark, d, "chunks").where("id is not null")
    if columns and not {"git_sha", "indexed_at"} & set(columns):
        return t.select(*columns).dropDuplicates(["id"])
    latest = t.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("indexed_at").desc(), F.col("git_sha").desc())))
    latest = latest.where("_n = 1").drop("_n")
    return latest.select(*columns) if columns else latest


def hits(spark: SparkSession, d: str) -> DataFrame:
    """(qid, source, chunk_id, score, rank): usable hits, the best score of each, ranked within search and source."""
    t = table(spark, d, "scored_chunks").where("score is not null and not isnan(score) and abs(score) < double('Infinity')")
    best = t.groupBy("qid", "source", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid", "source").orderBy(F.col("score").desc(), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """The first eight fused hits of each search with their chunks."""
    h = hits(spark, d).where("source = 'fused' and rank <= 8")
    c = chunks(spark, d, "id", "path", "language", "symbol_name", "symbol_kind", "start_line", "end_line", "content").withColumnRenamed("id", "chunk_id")
    return h.join(c, "chunk_id").select(
        "qid", F.col("rank").alias("ref"), "chunk_id", "path", "language", "symbol_name", "symbol_kind", "start_line", "end_line", "content", "rank", "score")


def recorded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Made-up answers of the searches, the same as in ``RECORDED``: right, misattributed, unknown and missing evidence."""
    first = F.split("content", "\n")[0]
    lines = sources(spark, d).where("ref <= 2").select("qid", "ref", first.alias("line"))
    by = lines.groupBy("qid").agg(F.max(F.when(F.col("ref") == 1, F.col("line"))).alias("a"), F.max(F.when(F.col("ref") == 2, F.col("line"))).alias("b"))

    def claim(text, *refs):
        return F.struct(text.alias("text"), F.array(*map(F.lit, refs)).cast("array<int>").alias("citations"))

    quote = lambda c: F.concat(F.lit("it holds `"), F.coalesce(c, F.lit("no line")), F.lit("`"))
    even = F.length("qid") % 2 == 0
    return by.select("qid", F.when(even, F.lit("")).otherwise(F.lit("as follows")).alias("answer"), F.array(
        claim(quote(F.col("a")), 1), claim(quote(F.col("b")), 1), claim(F.lit("see elsewhere"), 9, 2), claim(F.lit("no evidence for `name` or `a b`"))).alias("claims"))


RECORDED = """L AS (
  SELECT qid, max(CASE WHEN ref = 1 THEN string_split(content, chr(10))[1] END) AS a, max(CASE WHEN ref = 2 THEN string_split(content, chr(10))[1] END) AS b
  FROM S WHERE ref <= 2 GROUP BY qid
), A AS (
  SELECT qid, 0 AS claim, 'it holds `' || coalesce(a, 'no line') || '`' AS text, [1] AS citations FROM L
  UNION ALL SELECT qid, 1, 'it holds `' || coalesce(b, 'no line') || '`', [1] FROM L
  UNION ALL SELECT qid, 2, 'see elsewhere', [9, 2] FROM L
  UNION ALL SELECT qid, 3, 'no evidence for `name` or `a b`', []::INTEGER[] FROM L
), Q AS (
  SELECT qid, claim, trim(regexp_replace(unnest(regexp_extract_all(text, '`([^`\\n]+)`', 1)), '[ \\t\\n\\f\\r\\x0B\\x{00A0}\\x{FEFF}]+', ' ', 'g')) AS quote FROM A
), QQ AS (SELECT * FROM Q WHERE quote <> '' AND NOT regexp_full_match(quote, '[A-Za-z_$][A-Za-z0-9_$]*')
), B AS (SELECT qid, ref, trim(regexp_replace(translate(content, '‘’“”', '''''""'), '[ \\t\\n\\f\\r\\x0B\\x{00A0}\\x{FEFF}]+', ' ', 'g')) AS body FROM S
), CI AS (SELECT qid, claim, unnest(citations) AS ref FROM A
), KN AS (SELECT CI.*, B.body FROM CI LEFT JOIN B USING (qid, ref)
), QF AS (SELECT QQ.qid, QQ.claim, QQ.quote, coalesce(bool_or(contains(KN.body, QQ.quote)), false) AS found
  FROM QQ LEFT JOIN KN ON KN.qid = QQ.qid AND KN.claim = QQ.claim AND KN.body IS NOT NULL GROUP BY ALL)"""

_FOLD = "translate(lower({x}), '{a}', '{p}')"


def bm25_sql(docs: str, doc: str, columns: tuple[str, ...], queries: str, qid: str, text: str) -> str:
    """CTEs giving ``BM(qid, doc, raw)`` for the documents of view ``docs`` and the queries of view ``queries``."""
    from fathom.functions.text import ACCENTED, PLAIN

    tok = lambda x: f"list_filter(regexp_split_to_array({_FOLD.format(x=x, a=ACCENTED, p=PLAIN)}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    posts = " UNION ALL ".join(
        f"SELECT doc, {i} AS col, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term FROM (SELECT {doc} AS doc, {tok(f'coalesce({c}, ' + chr(39) * 2 + ')')} AS w FROM {docs})"
        for i, c in enumerate(columns))
    dl = " + ".join(f"len({tok(f'coalesce({c}, ' + chr(39) * 2 + ')')})" for c in columns)
    return f"""PH0 AS (
  SELECT qid, list_filter(regexp_split_to_array(lower(t), '_+'), lambda x: x <> '') AS words
  FROM (SELECT {qid} AS qid, unnest(list_filter(regexp_split_to_array({text}, '[^A-Za-z0-9_]+'), lambda t: length(t) > 1)) AS t FROM {queries})
), PH AS (SELECT qid, array_to_string(words, ' ') AS ph, words, count(*) AS weight FROM PH0 WHERE len(words) > 0 GROUP BY ALL
), PW AS (SELECT DISTINCT ph, len(words) AS n, unnest(range(1, len(words) + 1)) AS off, unnest(words) AS term FROM PH
), PO AS ({posts}
), M AS (SELECT ph, n, doc, col, pos - off AS at, count(*) AS m FROM PO JOIN PW USING (term) GROUP BY ALL
), TF AS (SELECT ph, doc, count(*) AS tf FROM M WHERE m = n GROUP BY ALL
), DF AS (SELECT ph, count(*) AS df FROM TF GROUP BY ph
), DL AS (SELECT {doc} AS doc, {dl} AS dl FROM {docs}
), ST AS (SELECT count(*) AS nn, avg(dl) AS avgdl FROM DL
), G AS (
  SELECT ph, doc, greatest(ln((nn - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS gain
  FROM TF JOIN DF USING (ph) JOIN DL USING (doc) CROSS JOIN ST
), BM AS (SELECT qid, doc, round(sum(weight * gain), 9) AS raw FROM PH JOIN G USING (ph) GROUP BY ALL)"""
