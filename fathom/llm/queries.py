"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import leakage, near_dup, packing, ranking, sentences, source_kind, splitting
from fathom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_kind.source_kinds(table(spark, sf_dir, "chunks")).select("repo", "path").distinct()


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_kind.source_kinds(table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.leximin_first(table(spark, sf_dir, "scored_chunks")).select(F.col("q").alias("qid"), F.col("item").alias("chunk_id"))


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.leximin_ranking(table(spark, sf_dir, "scored_chunks")).select(
        F.col("q").alias("qid"), F.col("item").alias("chunk_id"), F.col("position").cast("long").alias("position"),
        F.round("weakest", 9).alias("weakest"), F.round("mean", 9).alias("mean"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(table(spark, sf_dir, "chunks")).select("id_a", "id_b").distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts between units, none within one."""
    return splitting.split_chunks(table(spark, sf_dir, "chunks")).where("piece > 0").select("id", F.col("start_line").alias("cut_line")).distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized chunks, each within the size limit."""
    return splitting.split_chunks(table(spark, sf_dir, "chunks"), cut_units=True)


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "questions"))
    return found.where("run_words >= 12").select("doc_id", F.col("item_id").alias("question_id")).distinct()


def p7_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "questions"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "start_char")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_kinds, p2_found, p2_ranking, p4_found, p4_groups, p5_found, p5_pieces, p6_windows, p7_found, p7_alignments, p8_found, p8_sentences)
    return {f.__name__: f for f in found}


_LEXIMIN = """
WITH best AS (
  SELECT qid AS q, source AS src, chunk_id AS item, max(score) AS score FROM scored_chunks
  WHERE qid IS NOT NULL AND source IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND isfinite(score)
  GROUP BY ALL
), pct AS (
  SELECT q, src, item,
    (rank() OVER (PARTITION BY q, src ORDER BY score) - 1
     + count(*) OVER (PARTITION BY q, src, score) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY q, src) AS p
  FROM best
), n AS (SELECT q, count(DISTINCT src) AS n_src FROM best GROUP BY q
), vec AS (
  SELECT q, item, list_concat(list_transform(range(any_value(n_src) - count(*)), lambda x: 0.0::DOUBLE), list_sort(list(p))) AS v
  FROM pct JOIN n USING (q) GROUP BY q, item
), ranked AS (SELECT q, item, v, row_number() OVER (PARTITION BY q ORDER BY v DESC, item) AS position FROM vec)
"""

_PAIRS = """
WITH t AS (
  SELECT DISTINCT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL
), g AS (
  SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), n AS (SELECT id, count(*) AS n FROM g GROUP BY id
), shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM shared JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.7::DOUBLE * (x.n + y.n - c) - 1e-9
"""

# SQL has no NFKC; the tables hold no letters or digits that it changes, and tests cover those.
_LEAKS = """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), q AS (
  SELECT id, regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+') AS w FROM questions WHERE id IS NOT NULL
  UNION ALL SELECT id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') FROM questions WHERE id IS NOT NULL
), qg AS (SELECT DISTINCT id, w[i : i + 11] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM q WHERE len(w) >= 12)
), dg AS (SELECT doc_id, w[i : i + 11] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, id AS question_id FROM dg JOIN qg USING (g)
"""

_GROUPS = _PAIRS.replace("SELECT id_a, id_b FROM shared", ", pairs AS (SELECT id_a, id_b FROM shared").replace("WITH t AS", "WITH RECURSIVE t AS").rstrip() + """
), sets AS (SELECT id, md5(string_agg(s, chr(10) ORDER BY s)) AS key FROM g GROUP BY id
), classes AS (SELECT key, min(id) AS class_id, count(*) AS copies FROM sets GROUP BY key
), cl AS (SELECT id, class_id, copies FROM sets JOIN classes USING (key)
), both_ways AS (SELECT id_a AS x, id_b AS y FROM pairs UNION ALL SELECT id_b, id_a FROM pairs
), deg AS (SELECT a.class_id, count(DISTINCT b.class_id) AS links FROM both_ways JOIN cl a ON a.id = x JOIN cl b ON b.id = y WHERE a.class_id <> b.class_id GROUP BY a.class_id
), reach(id, r) AS (SELECT x, x FROM both_ways UNION SELECT reach.id, y FROM reach JOIN both_ways ON x = r
), grp AS (SELECT id, min(r) AS low FROM reach GROUP BY id)
SELECT cl.id, cl.class_id, grp.low AS group_id, coalesce(links, 0) AS links FROM cl JOIN grp USING (id) LEFT JOIN deg ON deg.class_id = cl.class_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it exists; the other queries need parsers, tokenizers or Unicode forms that SQL lacks."""
    return {
        "p2_found": _LEXIMIN + "SELECT q AS qid, item AS chunk_id FROM ranked WHERE position = 1",
        "p2_ranking": _LEXIMIN + "SELECT q AS qid, item AS chunk_id, position, round(v[1], 9) AS weakest, round(list_sum(v) / len(v), 9) AS mean FROM ranked",
        "p4_found": _PAIRS,
        "p4_groups": _GROUPS,
        "p7_found": _LEAKS,
    }
