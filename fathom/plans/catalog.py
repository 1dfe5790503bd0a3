"""The registered queries of the core and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.operators import answer, chunking, evaluate, incremental, models, search, summary
from fathom.operators.store import Store
from fathom.plans import views
from fathom.plans.views import C, H, RECORDED, S, bm25_sql
from fathom.session import materialize, table
from fathom.streaming.indexer import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can say the same."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Processing only new or changed records

_OBS = r"""WITH obs AS (
  SELECT repo, regexp_replace(regexp_replace(replace(path, '\', '/'), '/(\.?/)+', '/', 'g'), '^(\.?/)+', '') AS path,
    lower(content_hash) AS content_hash, recorded_at, rec_id, processed_at
  FROM indexed_files WHERE content_hash IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL
), cur AS (
  SELECT repo, path, content_hash FROM obs QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY recorded_at DESC NULLS LAST, rec_id DESC) = 1
), old AS (
  SELECT repo, path, content_hash AS old_hash FROM obs WHERE processed_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY processed_at DESC, rec_id DESC) = 1
)
"""
_PENDING = "FROM cur LEFT JOIN old USING (repo, path) WHERE old_hash IS NULL OR old_hash <> content_hash"


@query(_OBS + f"SELECT repo, path {_PENDING}")
def p3_found(spark, d):
    return incremental.pending_files(table(spark, d, "indexed_files")).select("repo", "path")


@query(_OBS + f"SELECT repo, path, content_hash, CASE WHEN old_hash IS NULL THEN 'new' ELSE 'changed' END AS change {_PENDING}")
def p3_pending(spark, d):
    return incremental.pending_files(table(spark, d, "indexed_files"))


# Store

def _store(spark, d, *deliveries: DataFrame) -> Store:
    """A store of the given deliveries of chunks, each a change of its own; a vector stands for a chunk's embedding."""
    store = Store(spark, None, "stand-in", 2)
    for rows in deliveries or (views.chunks(spark, d),):
        vector = F.array(F.length("content").cast("float"), F.col("start_line").cast("float"))
        store.upsert(rows.withColumn("embedding_model", F.lit("stand-in")).withColumn("embedding_dim", F.lit(2)).withColumn("embedding", vector))
    return store


@query(_OBS + """SELECT coalesce(cur.repo, old.repo) AS repo, coalesce(cur.path, old.path) AS path,
  CASE WHEN cur.path IS NULL THEN 'stale' WHEN old_hash IS NULL THEN 'add' WHEN old_hash = content_hash THEN 'skip' ELSE 'update' END AS action
FROM cur FULL JOIN old ON cur.repo = old.repo AND cur.path = old.path""")
def index_incremental(spark, d):
    """The plan of a run against a store that holds the committed hashes."""
    obs = incremental.observations(table(spark, d, "indexed_files"))
    store = Store(spark, None, "stand-in", 2)
    store.apply(files=incremental.committed_state(obs))
    return store.plan(incremental.current_versions(obs), prune=True)


@query(f"WITH {C} SELECT id, repo, path, git_sha, start_line FROM C")
def store_upsert(spark, d):
    """A store after all deliveries, the oldest of each id first and each later one as a change of its own."""
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy("indexed_at", "git_sha")
    rows = materialize(table(spark, d, "chunks").where("id is not null").withColumn("nth", F.row_number().over(order)), "deliveries")
    times = rows.agg(F.coalesce(F.max("nth"), F.lit(0))).first()[0]
    store = _store(spark, d, *[rows.where(F.col("nth") == n).drop("nth") for n in range(1, times + 1)])
    return store.chunks().select("id", "repo", "path", "git_sha", "start_line")


@query(f"""WITH {C}, gone AS ({_OBS} SELECT repo, path {_PENDING})
SELECT C.id, C.repo, C.path FROM C LEFT JOIN gone ON gone.repo = C.repo AND gone.path = C.path WHERE gone.path IS NULL""")
def store_delete_by_file(spark, d):
    """What is left of the store after deleting the chunks of every file that is pending."""
    store = _store(spark, d)
    store.delete_by_file(incremental.pending_files(table(spark, d, "indexed_files")).select("repo", "path"))
    return store.chunks().select("id", "repo", "path")


@query(f"WITH {C} SELECT count(*) AS chunks, count(DISTINCT path) AS files, count(DISTINCT (repo, path)) AS files_by_repo, count(*) AS vectors FROM C")
def store_stats(spark, d):
    stats = _store(spark, d).stats()
    return spark.createDataFrame([tuple(stats[n] for n in ("chunks", "files", "files_by_repo", "vectors"))], "chunks long, files long, files_by_repo long, vectors long")


@query(f"""WITH {C}, {H} SELECT H.qid, H.rank::BIGINT AS position, C.id, C.repo, C.path FROM H JOIN C ON C.id = H.chunk_id WHERE H.source = 'reranked'""")
def get_by_ids(spark, d):
    """Chunks of the reranked ids of each search, in the order asked for; ids that are not stored are dropped."""
    ids = views.hits(spark, d).where("source = 'reranked'").select("qid", F.col("rank").cast("long").alias("position"), F.col("chunk_id").alias("id"))
    return _store(spark, d).get_many(ids).select("qid", "position", "id", "repo", "path")


@query("SELECT p AS prefix, coalesce(bool_or(starts_with(path, p)), false) AS present FROM (VALUES ('src/lib/'), ('src/li%'), ('pkg'), ('absent/')) v(p) LEFT JOIN chunks ON true GROUP BY p")
def has_path_prefix(spark, d):
    store = _store(spark, d)
    return spark.createDataFrame([(p, store.has_path_prefix(p)) for p in ("src/lib/", "src/li%", "pkg", "absent/")], "prefix string, present boolean")


@query(f"WITH {C} SELECT id, repo, path FROM C WHERE repo = 'harbor-platform' AND language = 'go' AND symbol_kind = 'function' AND starts_with(path, 'apps/')")
def filter_chunks(spark, d):
    keep = tx.matches(repo="harbor-platform", language="go", symbol_kind="function", path_prefix="apps/")
    return table(spark, d, "chunks").where(keep & F.col("id").isNotNull()).select("id", "repo", "path").dropDuplicates(["id"])


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def event_windows(spark, d):
    """Events per hour and type, by the function that a stream runs with."""
    out = windowed_counts(table(spark, d, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events", F.round("total", 6).alias("total"))


# Paths and text

@query(r"""SELECT DISTINCT repo, path, NOT list_has_any(string_split(path, '/'), ['node_modules','.git','.next','dist','build','out','coverage','.turbo','.vercel','__snapshots__','.pnpm-store'])
  AND NOT regexp_matches(path, '\.min\.(js|css)$|-lock\.(json|yaml)$|\.lock$|\.d\.ts$') AND NOT regexp_matches(path, '(?i)\.(png|jpe?g|gif|webp|svg|ico|wav|mp3|mp4|woff2?|ttf|eot|pdf|zip|gz)$')
  AND regexp_matches(path, '\.(tsx|jsx|ts|mts|cts|js|mjs|cjs|py|go)$') AS keep FROM indexed_files""")
def walk_should_index(spark, d):
    return table(spark, d, "indexed_files").select("repo", "path", tx.should_index(F.col("path")).alias("keep")).distinct()


@query(r"""SELECT DISTINCT path, CASE WHEN regexp_matches(path, '\.(tsx|jsx)$') THEN 'tsx' WHEN regexp_matches(path, '\.(ts|mts|cts)$') THEN 'typescript'
  WHEN regexp_matches(path, '\.(js|mjs|cjs)$') THEN 'javascript' WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.go') THEN 'go' END AS language FROM chunks""")
def language_for_path(spark, d):
    return table(spark, d, "chunks").select("path", tx.language_for_path(F.col("path")).alias("language")).distinct()


@query(r"""WITH p AS (SELECT DISTINCT path, replace(trim(path), '\', '/') AS p FROM indexed_files)
SELECT path, regexp_replace(regexp_replace(CASE WHEN p = '/src' THEN '' WHEN starts_with(p, '/src/') THEN substr(p, 6) ELSE p END, '^(\./)+', ''), '^/+', '') AS prefix FROM p""")
def normalize_path_prefix(spark, d):
    return table(spark, d, "indexed_files").select("path").distinct().select("path", tx.normalize_path_prefix(F.col("path"), "/src").alias("prefix"))


@query("""SELECT qid, source, chunk_id, CASE WHEN score IS NULL THEN 1 WHEN NOT isfinite(score) THEN 8 ELSE greatest(1, least(30, trunc(score)::BIGINT)) END::BIGINT AS k FROM scored_chunks""")
def clamp_k(spark, d):
    t = table(spark, d, "scored_chunks")
    return t.select("qid", "source", "chunk_id", tx.clamp_k(F.col("score"), 8, 30).alias("k"))


_TOK = views._FOLD.format(x="text", a=tx.ACCENTED, p=tx.PLAIN)


@query(rf"""SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array({_TOK}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS term FROM documents) GROUP BY ALL""")
def tokenize(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query("""SELECT qid, unnest(range(1, len(w) + 1))::BIGINT AS pos, unnest(w) AS term FROM (
  SELECT qid, list_filter(regexp_split_to_array(query, '[^A-Za-z0-9_]+'), lambda t: length(t) > 1) AS w FROM searches)""")
def query_terms(spark, d):
    t = table(spark, d, "searches").select("qid", F.posexplode(tx.query_terms(F.col("query"))).alias("p", "term"))
    return t.select("qid", (F.col("p") + 1).cast("long").alias("pos"), "term")


_WS = r"[ \t\n\f\r\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


@query(rf"""SELECT doc_id, trim(regexp_replace(translate(text, '‘’“”', '''''""'), '{_WS}', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL""")
def normalise_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.normalise(F.col("text")).alias("text"))


@query(rf"""WITH q AS (
  SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '```[a-z]*\n([\s\S]*?)```', 1), regexp_extract_all(regexp_replace(text, '```[\s\S]*?```', ' ', 'g'), '`([^`\n]+)`', 1))) AS q FROM documents WHERE text IS NOT NULL
), n AS (SELECT doc_id, trim(regexp_replace(translate(q, '‘’“”', '''''""'), '{_WS}', ' ', 'g')) AS quote FROM q)
SELECT doc_id, quote, count(*) AS times FROM n WHERE quote <> '' AND NOT regexp_full_match(quote, '[A-Za-z_$][A-Za-z0-9_$]*') GROUP BY ALL""")
def extract_quotes(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(tx.extract_quotes(F.col("text"))).alias("quote"))
    return t.groupBy("doc_id", "quote").agg(F.count(F.lit(1)).alias("times"))


@query(f"""WITH {C} SELECT id, 'File: ' || path || chr(10) || CASE WHEN coalesce(symbol_name, '') <> '' THEN 'Symbol: ' || symbol_name || ' (' || coalesce(symbol_kind, 'unknown') || ')' || chr(10) ELSE '' END
  || CASE WHEN len(imports) > 0 THEN 'Imports: ' || array_to_string(imports[1:12], ', ') || chr(10) ELSE '' END || '---' || chr(10) || content AS embedding_text FROM C""")
def embedding_text(spark, d):
    c = views.chunks(spark, d, "id", "path", "symbol_name", "symbol_kind", "imports", "content")
    return c.select("id", tx.embedding_text(*map(F.col, ("path", "symbol_name", "symbol_kind", "imports", "content"))).alias("embedding_text"))


@query(f"""WITH {C} SELECT id, substr(sha256(repo || chr(0) || path || chr(0) || start_line || chr(0) || content), 1, 16) AS computed FROM C""")
def chunk_ids(spark, d):
    c = views.chunks(spark, d, "id", "repo", "path", "start_line", "content")
    return c.select("id", tx.chunk_id(*map(F.col, ("repo", "path", "start_line", "content"))).alias("computed"))


# Chunking

def _files(spark, d):
    return table(spark, d, "documents").where("text is not null").select(
        F.col("source").alias("repo"), F.concat_ws("/", "source", F.coalesce("lang", F.lit("none")), F.concat("doc_id", F.lit(".txt"))).alias("path"), "text")


_LINES = "LN AS (SELECT key, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT {key} AS key, string_split({text}, chr(10)) AS l FROM {src})), NL AS (SELECT key, max(i) AS n FROM LN GROUP BY key)"
_TRIM = r"regexp_replace({x}, '^[ \t\n\x0B\f\r\x{{00A0}}\x{{FEFF}}]+|[ \t\n\x0B\f\r\x{{00A0}}\x{{FEFF}}]+$', '', 'g')"
_WINDOW = """{p}W(key, i, s, size, open) AS (
  SELECT key, 0::BIGINT, 1::BIGINT, 0::BIGINT, false FROM {p}NL
  UNION ALL
  SELECT w.key, w.i + 1,
    CASE WHEN length(l.line) > {limit} THEN w.i + 2 WHEN w.open AND w.size + length(l.line) + 1 > {limit} THEN w.i + 1 WHEN NOT w.open THEN w.i + 1 ELSE w.s END,
    CASE WHEN length(l.line) > {limit} THEN 0 WHEN w.open AND w.size + length(l.line) + 1 <= {limit} THEN w.size + length(l.line) + 1 ELSE length(l.line) END,
    length(l.line) <= {limit}
  FROM {p}W w JOIN {p}LN l ON l.key = w.key AND l.i = w.i + 1
)"""


def _window_sql(p: str, limit: int) -> str:
    """CTE ``{p}P(key, a, b, slice, piece)``: window-split pieces of the lines ``{p}LN``, lines from 1."""
    return _WINDOW.format(p=p, limit=limit) + f""", {p}P AS (
  SELECT w.key, w.s AS a, max(w.i) AS b, -1 AS slice, string_agg(l.line, chr(10) ORDER BY l.i) AS piece
  FROM {p}W w JOIN {p}LN l ON l.key = w.key AND l.i = w.i WHERE w.i > 0 AND w.open GROUP BY w.key, w.s
  UNION ALL
  SELECT key, i, i, j::INTEGER, substr(line, j * {limit} + 1, {limit}) FROM (SELECT key, i, line, unnest(range(0, ceil(length(line) / {limit}::DOUBLE)::BIGINT)) AS j FROM {p}LN WHERE length(line) > {limit}))"""


def _prefixed(p: str, key: str, text: str, src: str) -> str:
    return _LINES.format(key=key, text=text, src=src).replace("LN AS", f"{p}LN AS").replace("NL AS", f"{p}NL AS").replace("FROM LN", f"FROM {p}LN")


_FILES = "FI AS (SELECT source AS repo, concat_ws('/', source, coalesce(lang, 'none'), doc_id || '.txt') AS path, doc_id, text FROM documents WHERE text IS NOT NULL)"
_FOLD_SQL = f"""WITH RECURSIVE {_FILES}, {_prefixed('', 'doc_id', 'text', 'FI')}, R(key, i, s, size, closed) AS (
  SELECT key, 0::BIGINT, 1::BIGINT, -1::BIGINT, false FROM NL
  UNION ALL
  SELECT r.key, r.i + 1, CASE WHEN r.closed THEN r.i + 1 ELSE r.s END, CASE WHEN r.closed THEN -1 ELSE r.size END + 1 + length(l.line),
    (CASE WHEN r.closed THEN -1 ELSE r.size END + 1 + length(l.line)) >= 3000 AND ({_TRIM.format(x='l.line')} = '' OR (CASE WHEN r.closed THEN -1 ELSE r.size END + 1 + length(l.line)) >= 3600)
  FROM R r JOIN LN l ON l.key = r.key AND l.i = r.i + 1
), P0 AS (
  SELECT R.key, R.s, max(R.i) AS e, {_TRIM.format(x="string_agg(l.line, chr(10) ORDER BY l.i)")} AS c FROM R JOIN LN l ON l.key = R.key AND l.i = R.i WHERE R.i > 0 GROUP BY R.key, R.s
), P1 AS (SELECT *, key || '/' || s AS k2 FROM P0 WHERE c <> ''
), BIG AS (SELECT * FROM P1 WHERE length(c) > 3600), {_prefixed('B', 'k2', 'c', 'BIG')}, {_window_sql('B', 3000)}, ALLP AS (
  SELECT key, s AS start_line, e AS end_line, c AS content FROM P1 WHERE length(c) <= 3600
  UNION ALL SELECT BIG.key, BIG.s + p.a - 1, BIG.s + p.b - 1, p.piece FROM BIG JOIN BP p ON p.key = BIG.k2
)
"""


@query(_FOLD_SQL + """SELECT repo, path, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, content,
  substr(sha256(repo || chr(0) || path || chr(0) || start_line || chr(0) || content), 1, 16) AS id, 'File: ' || path || chr(10) || '---' || chr(10) || content AS embedding_text
FROM ALLP JOIN FI ON FI.doc_id = ALLP.key""")
def chunk_documents(spark, d):
    return chunking.text_chunks(_files(spark, d))


@query(_FOLD_SQL + """SELECT repo, path, substr(sha256(any_value(text)), 1, 16) AS content_hash, count(*) AS chunks FROM ALLP JOIN FI ON FI.doc_id = ALLP.key WHERE strlen(text) <= 400000 GROUP BY repo, path""")
def index_files(spark, d):
    """What an index run records of each file: its hash and number of chunks; files over the size cap or without chunks are left out."""
    files = _files(spark, d).where(F.octet_length("text") <= 400_000)
    chunks = chunking.text_chunks(files).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("chunks"))
    return files.select("repo", "path", tx.content_hash(F.col("text")).alias("content_hash")).join(chunks, ["repo", "path"])


@query(f"""WITH RECURSIVE {C}, {_prefixed('X', 'id', 'content', 'C')}, {_window_sql('X', 600)}
SELECT key AS id, (row_number() OVER (PARTITION BY key ORDER BY a, slice))::INTEGER AS part, (start_line + a - 1)::INTEGER AS piece_start, (start_line + b - 1)::INTEGER AS piece_end, piece
FROM XP JOIN C ON C.id = XP.key""")
def window_split(spark, d):
    c = views.chunks(spark, d, "id", "content", "start_line")
    return chunking.window_split(c, 600, "content", "start_line").select("id", "part", "piece_start", "piece_end", "piece")


@query(f"""WITH RECURSIVE {C}, O AS (
  SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY start_line, id) AS i, CASE WHEN symbol_kind = 'type' OR symbol_kind IS NULL THEN NULL ELSE symbol_name END AS name, start_line, end_line, content FROM C
), F(repo, path, i, name, s, e, content, g) AS (
  SELECT repo, path, i, name, start_line, end_line, content, 1 FROM O WHERE i = 1
  UNION ALL
  SELECT o.repo, o.path, o.i, o.name,
    CASE WHEN f.name IS NULL AND o.name IS NULL AND length(f.content) < 600 AND length(o.content) < 600 THEN f.s ELSE o.start_line END, o.end_line,
    CASE WHEN f.name IS NULL AND o.name IS NULL AND length(f.content) < 600 AND length(o.content) < 600 THEN f.content || chr(10) || chr(10) || o.content ELSE o.content END,
    CASE WHEN f.name IS NULL AND o.name IS NULL AND length(f.content) < 600 AND length(o.content) < 600 THEN f.g ELSE f.g + 1 END
  FROM F f JOIN O o ON o.repo = f.repo AND o.path = f.path AND o.i = f.i + 1
)
SELECT repo, path, name, s AS start_line, e AS end_line, content FROM F QUALIFY row_number() OVER (PARTITION BY repo, path, g ORDER BY i DESC) = 1""")
def merge_tiny_chunks(spark, d):
    """Small unnamed neighbours of each file joined (types count as unnamed here, the limit is 600 so that it happens)."""
    c = views.chunks(spark, d, "id", "repo", "path", "start_line", "end_line", "symbol_name", "symbol_kind", "content")
    name = F.when(F.col("symbol_kind") != "type", F.col("symbol_name"))
    rows = c.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "end_line", name.alias("name"), "content"))).alias("o"))
    pieces = F.transform("o", lambda x: F.struct(x["name"].alias("name"), x["start_line"].alias("start"), x["end_line"].alias("end"), x["content"].alias("content")))
    out = rows.select("repo", "path", F.explode(chunking.merge_tiny(pieces, 600)).alias("m"))
    return out.select("repo", "path", "m.name", F.col("m.start").alias("start_line"), F.col("m.end").alias("end_line"), "m.content")


@query(f"WITH {C} SELECT coalesce(symbol_kind, 'none') AS kind, count(*) AS n FROM C GROUP BY ALL")
def summary_by_kind(spark, d):
    return summary.by_kind(views.chunks(spark, d, "id", "symbol_kind"))


@query(f"WITH {C} SELECT language, count(*) AS n FROM C GROUP BY ALL")
def summary_by_language(spark, d):
    return summary.by_language(views.chunks(spark, d, "id", "language"))


@query(f"WITH {C} SELECT CASE WHEN length(content) < 500 THEN '<500' WHEN length(content) < 1500 THEN '<1500' WHEN length(content) < 3000 THEN '<3000' WHEN length(content) < 6000 THEN '<6000' ELSE '6000+' END AS bucket, count(*) AS n FROM C GROUP BY ALL")
def summary_size_buckets(spark, d):
    return summary.by_size(views.chunks(spark, d, "id", "content"))


@query(f"""WITH {C}, z AS (SELECT length(content) AS n, symbol_name FROM C)
SELECT count(*) AS chunks, (SELECT n FROM z ORDER BY n LIMIT 1 OFFSET (SELECT count(*) // 2 FROM z))::BIGINT AS median, count(*) FILTER (n > 3000) AS oversized, count(*) FILTER (symbol_name IS NULL) AS unnamed FROM z""")
def summary_scalar(spark, d):
    return summary.totals(views.chunks(spark, d, "id", "content", "symbol_name"))


@query(f"WITH {C} SELECT id, path, length(content)::INTEGER AS n FROM C ORDER BY length(content) DESC, id LIMIT 5")
def summary_largest(spark, d):
    return summary.largest(views.chunks(spark, d, "id", "path", "content"))


# Search

def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("vid"), "embedding", "label", F.concat(F.lit("label_"), "label", F.lit("/f"), F.col("vec_id") % 7, F.lit(".ts")).alias("path"))


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


_D = "list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_KNN = "SELECT q.vec_id AS qid, v.vec_id AS vid, {score} AS s, v.label FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 {cond}"
_TOP = "SELECT qid, vid, round(s, 9) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vid) AS rank FROM ({src})) WHERE rank <= 10"
_L2 = f"1 / (1 + {_D})"
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _scored(df, key="vid"):
    return df.select("qid", key, F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(_TOP.format(src=_KNN.format(score=_L2, cond="")))
def knn_l2(spark, d):
    return _scored(search.knn(_vector_queries(spark, d), _vectors(spark, d), 10))


@query(_TOP.format(src=_KNN.format(score=_COS, cond="")))
def knn_cosine(spark, d):
    return _scored(search.knn(_vector_queries(spark, d), _vectors(spark, d), 10, "cosine"))


@query(_TOP.format(src=_KNN.format(score=_L2, cond="AND v.label = 3")))
def knn_filtered(spark, d):
    """The filter is applied before ranking, so every query gets its full k."""
    return _scored(search.knn(_vector_queries(spark, d), _vectors(spark, d).where(F.col("path").startswith("label_3/")), 10))


@query(_TOP.format(src="SELECT qid, vid, s FROM (" + _KNN.format(score=_L2, cond="") + " QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) <= 40) WHERE label = 3"))
def knn_filtered_overfetch(spark, d):
    return _scored(search.knn_overfetch(_vector_queries(spark, d), _vectors(spark, d), 10, F.col("path").startswith("label_3/")))


@query(f"SELECT q.vec_id AS qid, v.vec_id AS vid, round({_COS}, 9) AS cosine FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.label = v.label")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a"), "label")
    v = e.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("b"), "label")
    return q.join(v, "label").select("qid", "vid", F.round(search.cosine(F.col("a"), F.col("b")), 9).alias("cosine"))


_CODE = ("path", "symbol_name", "content")
_BM_CODE = bm25_sql("C", "id", _CODE, "searches", "qid", "query")
_TOPK = "(SELECT BM.qid, doc, raw, row_number() OVER (PARTITION BY BM.qid ORDER BY raw DESC, doc) AS rank, k FROM BM JOIN searches s ON s.qid = BM.qid)"


def _code(spark, d):
    return views.chunks(spark, d, "id", "repo", *_CODE)


@query(f"WITH {C}, {_BM_CODE} SELECT qid, doc, round(raw / (1 + raw), 7) AS score, rank::INTEGER AS rank FROM {_TOPK} WHERE rank <= k")
def bm25(spark, d):
    """Keyword search of every search over all chunks, with phrases, at the search's own k."""
    out = search.bm25(table(spark, d, "searches"), _code(spark, d), "k")
    return out.select("qid", "doc", F.round("score", 7).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {C}, PS AS (SELECT qid, list_aggregate(list_transform(regexp_extract_all(query, '[a-z]+_[a-z]+[a-z_]*'), lambda x: x), 'string_agg', ' ') AS query FROM searches WHERE regexp_matches(query, '[a-z]+_[a-z]+')), {bm25_sql("C", "id", _CODE, "PS", "qid", "query")}
SELECT qid, doc, round(raw, 7) AS raw FROM BM""")
def bm25_phrase(spark, d):
    """Only the underscored terms of the searches, each a phrase of adjacent tokens: all chunks that hold one."""
    q = table(spark, d, "searches").where(F.col("query").rlike("[a-z]+_[a-z]+"))
    q = q.select("qid", F.array_join(F.regexp_extract_all("query", F.lit("[a-z]+_[a-z]+[a-z_]*"), F.lit(0)), " ").alias("query"))
    out = search.bm25(q, _code(spark, d), 2_000_000_000)
    raw = F.round(F.col("score") / (1 - F.col("score")), 9)  # as it was before squashing
    return out.select("qid", "doc", F.round(raw, 7).alias("raw"))


@query(f"""WITH {C}, T AS (SELECT qid, k, list_filter(regexp_split_to_array(lower(query), '[^A-Za-z0-9_]+'), lambda t: length(t) > 2) AS terms FROM searches
), HY AS (SELECT id AS doc, lower(concat_ws(' ', coalesce(path, ''), coalesce(symbol_name, ''), coalesce(content, ''))) AS hay FROM C
), U AS (SELECT qid, unnest(terms) AS term FROM T), W AS (SELECT qid, term, count(*) AS w FROM U GROUP BY ALL
), M AS (SELECT term, doc FROM (SELECT DISTINCT term FROM U) JOIN HY ON contains(hay, term)
), SC AS (SELECT W.qid, doc, sum(w)::DOUBLE / any_value(len(T.terms)) AS score FROM W JOIN M USING (term) JOIN T ON T.qid = W.qid GROUP BY W.qid, doc)
SELECT qid, doc, round(score, 9) AS score, rank::INTEGER AS rank FROM (SELECT SC.*, T.k, row_number() OVER (PARTITION BY SC.qid ORDER BY score DESC, doc) AS rank FROM SC JOIN T ON T.qid = SC.qid) WHERE rank <= k""")
def keyword_overlap(spark, d):
    # chunks that are delivered again are one document to it, so their texts need no shuffle
    code = table(spark, d, "chunks").where("id is not null").select("id", *_CODE)
    return _scored(search.keyword_overlap(table(spark, d, "searches"), code, "k"), "doc")


_RANKS = "SELECT qid, chunk_id AS doc, rank, CASE source WHEN 'vector' THEN 0 ELSE 1 END AS src, CASE source WHEN 'vector' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM H WHERE source IN ('vector', 'keyword')"
_RRF = """SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen // 1000000, seen % 1000000, doc)::INTEGER AS rank
  FROM (SELECT qid, doc, round(sum(weight / (60 + rank)), 12) AS score, min(src * 1000000 + rank) AS seen FROM ({src}) GROUP BY ALL)"""


@query(f"WITH {H} " + _RRF.format(src=_RANKS))
def rrf_fuse(spark, d):
    h = views.hits(spark, d)
    return search.hybrid(*[h.where(f"source = '{s}'").select("qid", F.col("chunk_id").alias("doc"), "rank") for s in ("vector", "keyword")], 2_000_000_000, keyword_weight=0.3)


@query(f"""WITH HQ AS (SELECT doc_id AS qid, text AS query FROM documents WHERE doc_id % 50 = 0), {bm25_sql('documents', 'doc_id', ('text',), 'HQ', 'qid', 'query')}, VR AS (
  SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY s, doc) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS doc, {_D} AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0)
), KR AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, doc) AS rank FROM BM
), R AS (SELECT qid, doc, rank, 0 AS src, 1.0::DOUBLE AS weight FROM VR WHERE rank <= 50 UNION ALL SELECT qid, doc, rank, 1, 0.3::DOUBLE FROM KR WHERE rank <= 50)
SELECT qid, doc::VARCHAR AS doc, score, rank FROM (""" + _RRF.format(src="SELECT * FROM R").replace(", doc)::INTEGER", ", doc::VARCHAR)::INTEGER") + ") WHERE rank <= 8")
def hybrid_search(spark, d):
    """All documents searched by text and all embeddings by vector, each for every fiftieth of its ids; fused by id with keyword weight 0.3.

    A query or a hit that only one of the tables holds stays with the ranking of that one.
    """
    docs = table(spark, d, "documents")
    q = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    near = search.knn(_vector_queries(spark, d), _vectors(spark, d), 50)
    words = search.bm25(q, docs, 50, doc="doc_id", columns=("text",))
    return search.hybrid(near.select("qid", F.col("vid").alias("doc"), "rank"), words.select("qid", "doc", "rank"), 8, keyword_weight=0.3)


@query(f"WITH {H} " + _RRF.format(src="""SELECT s.question_id AS qid, chunk_id AS doc, rank, row_number() OVER (PARTITION BY s.question_id, chunk_id ORDER BY s.rewritten, s.qid) * 0 + dense_rank() OVER (PARTITION BY s.question_id ORDER BY s.rewritten, s.qid) - 1 AS src,
  CASE WHEN s.rewritten THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS weight FROM H JOIN searches s ON s.qid = H.qid WHERE H.source = 'fused' AND s.question_id IS NOT NULL"""))
def rewrite_fuse(spark, d):
    """The rankings of a question's searches fused: the original weighs 1.5, each rewriting 1."""
    from pyspark.sql import Window

    s = table(spark, d, "searches").where("question_id is not null")
    s = s.select("qid", "question_id", "rewritten", (F.row_number().over(Window.partitionBy("question_id").orderBy("rewritten", "qid")) - 1).alias("src"))
    h = views.hits(spark, d).where("source = 'fused'").join(s, "qid")
    # rankings without hits do not count as seen first, but keep their place
    dense = h.withColumn("src", F.dense_rank().over(Window.partitionBy("question_id").orderBy("src")) - 1)
    return search.rrf(dense.select(F.col("question_id").alias("qid"), F.col("chunk_id").alias("doc"), "rank", "src", F.when(F.col("rewritten"), 1.0).otherwise(1.5).alias("weight")))


@query(f"""WITH {H}, J AS (SELECT b.qid, b.chunk_id AS doc, b.score, b.rank, CASE WHEN count(*) OVER (PARTITION BY b.qid) > 1 THEN r.score END AS value FROM H b LEFT JOIN H r ON r.qid = b.qid AND r.chunk_id = b.chunk_id AND r.source = 'reranked' WHERE b.source = 'fused')
SELECT qid, doc, round(coalesce(value / 10, score), 12) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(value, -1) DESC, rank)::INTEGER AS rank FROM J""")
def rerank(spark, d):
    h = views.hits(spark, d)
    base = h.where("source = 'fused'").select("qid", F.col("chunk_id").alias("doc"), "score", "rank")
    scores = h.where("source = 'reranked'").select("qid", F.col("chunk_id").alias("doc"), F.col("score").alias("value"))
    return search.rerank(base, scores).withColumn("score", F.round("score", 12))


_KEYS = """K AS (SELECT s.qid, (rank - 1) // 10 AS batch, substr(sha256('scorer' || chr(0) || query || chr(0) || string_agg(chunk_id, ',' ORDER BY rank)), 1, 24) AS key, count(*) AS n
  FROM H JOIN searches s ON s.qid = H.qid WHERE source = 'fused' GROUP BY s.qid, query, (rank - 1) // 10)"""


@query(f"WITH {H}, {_KEYS}, cache AS (SELECT DISTINCT K.key FROM K JOIN searches s ON s.qid = K.qid WHERE batch = 0 AND NOT s.rewritten) SELECT K.qid, K.batch::INTEGER AS batch, K.key, K.n::INTEGER AS n, cache.key IS NOT NULL AS cached FROM K LEFT JOIN cache USING (key)")
def rerank_cache_lookup(spark, d):
    """The batches a reranker would score; those of unrewritten searches' first ten are in the cache."""
    s = table(spark, d, "searches").select("qid", "query", "rewritten")
    base = views.hits(spark, d).where("source = 'fused'").join(s, "qid").select("qid", "query", F.col("chunk_id").alias("doc"), "rank")
    keys = materialize(search.rerank_batches(base, "scorer"), "keys")
    cache = keys.where("batch = 0").join(s.where("not rewritten"), "qid", "left_semi").select("key", F.lit(True).alias("cached")).distinct()
    return keys.join(cache, "key", "left").select("qid", "batch", "key", "n", F.coalesce("cached", F.lit(False)).alias("cached"))


def _model():
    """A model that answers by rule: snippets score their place in the batch, a question is varied by adding a word."""

    class Scripted:
        model = "scripted"

        def generate(self, prompt: str) -> str:
            if "search queries" in prompt:
                query = prompt.split("\n\nQuestion: ")[1].split("\n\nReply with")[0]
                return json.dumps({"queries": [f"{query} code", f"{query} symbol"]})
            return json.dumps({"scores": [{"id": i, "score": i} for i in range(prompt.count("\n### ") + prompt.startswith("### "))]})

    return Scripted()


@query("SELECT qid, n, trim(query) || w AS query FROM searches, (VALUES (1::INTEGER, ' code'), (2, ' symbol')) v(n, w)")
def model_rewrites(spark, d):
    """The variants of every search from a scripted model, each distinct question asked once."""
    return models.rewrite_queries(table(spark, d, "searches").select("qid", F.trim("query").alias("query")), _model(), at_once=4)[0]


@query(f"WITH {H} SELECT H.qid, chunk_id AS doc, ((rank - 1) % 10)::DOUBLE AS value FROM H JOIN searches s ON s.qid = H.qid WHERE source = 'fused'")
def model_rerank_scores(spark, d):
    """A scripted model's scores of the fused hits, ten to a call."""
    s = table(spark, d, "searches").select("qid", "query")
    base = views.hits(spark, d).where("source = 'fused'").join(s, "qid").select("qid", "query", F.col("chunk_id").alias("doc"), "rank")
    chunks = views.chunks(spark, d, "id", "path", "start_line", "end_line", "symbol_name", "symbol_kind", "content")
    return models.rerank_scores(base, chunks, _model(), at_once=4)[0]


# Evaluation

_BM_Q = bm25_sql("C", "id", _CODE, "QA", "id", "question")
_EVAL = f"""WITH {C}, QA AS (SELECT id, question, expected_files FROM questions WHERE answerable), {_BM_Q}, HITS AS (
  SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, doc) AS rank FROM BM JOIN C ON C.id = BM.doc WHERE C.repo = 'harbor-platform' QUALIFY rank <= 50
), FL AS (SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY min(rank), path) AS pos FROM HITS GROUP BY qid, path)"""
_METRICS = """, EX AS (SELECT qid, path, count(*) AS times FROM (SELECT id AS qid, unnest(expected_files) AS path FROM {q}) GROUP BY ALL
), KS AS (SELECT unnest([5, 10, 20, 50]) AS k
), MK AS (SELECT FL.qid, FL.pos, times FROM FL LEFT JOIN EX USING (qid, path)
), PQ AS (
  SELECT q.id AS qid, k, len(q.expected_files) AS n, coalesce(sum(times) FILTER (pos <= k), 0) AS hit, count(times) FILTER (pos <= k) AS rel, count(pos) FILTER (pos <= k) AS ret,
    coalesce(sum(CASE WHEN times IS NOT NULL THEN 1 / log2(pos + 1) END) FILTER (pos <= k), 0) AS dcg, coalesce(1.0::DOUBLE / min(pos) FILTER (times IS NOT NULL), 0) AS rr
  FROM {q} q CROSS JOIN KS LEFT JOIN MK ON MK.qid = q.id GROUP BY q.id, k, len(q.expected_files)
), SC AS (SELECT qid, k, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE hit::DOUBLE / n END AS recall, CASE WHEN ret = 0 THEN 0.0::DOUBLE ELSE rel::DOUBLE / ret END AS precision,
  CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE dcg / list_sum(list_transform(range(1, greatest(least(k, n), 1) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg, rr FROM PQ)
"""


def _questions(spark, d):
    return table(spark, d, "questions").where("answerable").select(F.col("id").alias("qid"), "question", "expected_files")


def _question_hits(spark, d):
    """Keyword hits of the answerable questions within their repository; statistics stay those of all chunks."""
    c = _code(spark, d)
    inside = c.where("repo = 'harbor-platform'")
    top = search.bm25(_questions(spark, d), c, 50, text="question", keep=inside.select(F.col("id").alias("doc")))
    return top.join(inside.select(F.col("id").alias("doc"), "path"), "doc").select("qid", "path", "rank", "score")


def _scores(spark, d):
    return evaluate.per_question(_questions(spark, d), evaluate.retrieved_files(_question_hits(spark, d)))


@query(_EVAL + " SELECT qid, path, pos::INTEGER AS pos FROM FL")
def retrieved_files(spark, d):
    return evaluate.retrieved_files(_question_hits(spark, d))


def _metric(name: str, column: str):
    @query(_EVAL + _METRICS.format(q="QA") + f"SELECT qid, k::INTEGER AS k, round({column}, 9) AS value FROM SC")
    def run(spark, d):
        return _scores(spark, d).select("qid", "k", F.round(column, 9).alias("value"))

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


for _name, _column in (("eval_recall", "recall"), ("eval_precision", "precision"), ("eval_ndcg", "ndcg")):
    _metric(_name, _column)


@query(_EVAL + _METRICS.format(q="QA") + "SELECT DISTINCT qid, round(rr, 9) AS rr FROM SC")
def eval_mrr(spark, d):
    return _scores(spark, d).select("qid", F.round("rr", 9).alias("rr")).distinct()


_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in ("recall", "precision", "ndcg", "rr"))
_AGG = "SELECT k::INTEGER AS k, count(*) AS questions, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(ndcg), 9) AS ndcg, round(avg(rr), 9) AS mrr, coalesce(string_agg(CASE WHEN recall = 0 THEN qid END, ',' ORDER BY qid), '') AS misses FROM SC GROUP BY k"


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if c in ("recall", "precision", "ndcg", "mrr", "rr") else c for c in df.columns])


@query(_EVAL + _METRICS.format(q="QA") + f"SELECT qid, k::INTEGER AS k, {_ROUNDED} FROM SC")
def eval_per_question(spark, d):
    return _rounded(_scores(spark, d))


@query(_EVAL + _METRICS.format(q="QA") + _AGG)
def eval_aggregate(spark, d):
    return _rounded(evaluate.aggregate(_scores(spark, d)))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () AS n FROM questions), w AS (SELECT unnest(range(0, 25)) AS i)
SELECT DISTINCT id, question FROM n JOIN w ON p = floor(i * n / 25)""")
def eval_spread_subset(spark, d):
    return evaluate.spread_subset(table(spark, d, "questions"), 25).select("id", "question")


_Q = "WITH QA AS (SELECT id, expected_files FROM questions WHERE answerable), "


@query(_Q + "FL AS (SELECT id AS qid, path, min(i) AS pos FROM (SELECT id, unnest(expected_files) AS path, unnest(range(1, len(expected_files) + 1)) AS i FROM QA) GROUP BY ALL)" + _METRICS.format(q="QA") + _AGG)
def eval_oracle_ceiling(spark, d):
    q = _questions(spark, d)
    return _rounded(evaluate.aggregate(evaluate.per_question(q, evaluate.retrieved_files(evaluate.oracle_hits(q)))))


@query(_Q + """X AS (SELECT id, unnest(expected_files) AS path, unnest(range(1, len(expected_files) + 1)) AS i FROM QA), FL AS (
  SELECT id AS qid, path, min(i * 5) AS pos FROM X GROUP BY ALL UNION ALL SELECT id, 'absent/' || (i - 1) || '-' || j, (i - 1) * 5 + j FROM X, (SELECT unnest([1, 2, 3, 4]) AS j))""" + _METRICS.format(q="QA") + _AGG)
def eval_noisy_oracle(spark, d):
    q = _questions(spark, d)
    return _rounded(evaluate.aggregate(evaluate.per_question(q, evaluate.retrieved_files(evaluate.noisy_hits(q)))))


_FAULTY = """q AS (
  SELECT CASE WHEN id = (SELECT max(id) FROM questions) THEN (SELECT min(id) FROM questions) ELSE id END AS id,
    CASE WHEN category = 'locational' THEN NOT answerable ELSE answerable END AS answerable, expected_files FROM questions)"""


@query(f"""WITH {_FAULTY} SELECT id, 'duplicate id' AS problem FROM q GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'answerable but has no expected files' FROM q WHERE answerable AND len(coalesce(expected_files, [])) = 0
UNION ALL SELECT id, 'unanswerable but has expected files' FROM q WHERE NOT answerable AND len(coalesce(expected_files, [])) > 0
UNION ALL SELECT NULL, 'no answerable questions' FROM (SELECT count(*) FILTER (answerable) AS n FROM q) WHERE n = 0
UNION ALL SELECT NULL, 'no unanswerable questions' FROM (SELECT count(*) FILTER (NOT answerable) AS n FROM q) WHERE n = 0""")
def gt_validate(spark, d):
    """The problems of the questions with faults put in: one id twice, and every answerable mark of one category turned round."""
    q = table(spark, d, "questions")
    ends = q.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    faulty = q.crossJoin(F.broadcast(ends)).withColumn("id", F.when(F.col("id") == F.col("hi"), F.col("lo")).otherwise(F.col("id")))  # one row
    turned = F.when(F.col("category") == "locational", ~F.col("answerable")).otherwise(F.col("answerable"))
    return evaluate.ground_truth_problems(faulty.withColumn("answerable", turned))


@query("SELECT id, category, difficulty FROM questions WHERE coalesce(verified, false) OR NOT answerable")
def gt_verified_only(spark, d):
    return evaluate.verified_only(table(spark, d, "questions")).select("id", "category", "difficulty")


_SIG = """, RH AS (SELECT qid, raw / (1 + raw) AS score, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, doc) AS rank FROM BM QUALIFY rank <= 50
), T1 AS (SELECT qid, coalesce(max(score) FILTER (rank = 1), 0) AS top, coalesce(max(score) FILTER (rank = 2), 0) AS second, coalesce(sum(score) FILTER (rank <= 10), 0) AS total, count(*) FILTER (rank <= 10) AS m, count(*) AS c FROM RH GROUP BY qid
), SG AS (SELECT qid, top AS top_score, CASE WHEN total > 0 THEN top / total ELSE 0 END AS concentration, CASE WHEN top > 0 THEN (top - second) / top ELSE 0 END AS gap_ratio, CASE WHEN m > 0 AND total > 0 THEN top / (total / m) ELSE 0 END AS decay,
  (SELECT count(*) FROM RH WHERE RH.qid = T1.qid AND rank <= 10 AND score >= top / 2) AS above_half, c AS candidate_count FROM T1)
"""
_SIG_ALL = f"WITH {C}, QA AS (SELECT id, question FROM questions), " + bm25_sql("C", "id", _CODE, "QA", "id", "question") + _SIG
_SIG_COLUMNS = "top_score concentration gap_ratio decay".split()


def _signals(spark, d):
    q = table(spark, d, "questions").select(F.col("id").alias("qid"), "question")
    return evaluate.refusal_signals(search.bm25(q, _code(spark, d), 50, text="question"))


def _observations(spark, d):
    q = table(spark, d, "questions").select(F.col("id").alias("qid"), "answerable", "verified")
    return _signals(spark, d).join(q, "qid").where("not answerable or verified").drop("verified")


@query(_SIG_ALL + f"SELECT qid, {', '.join(f'round({c}, 7) AS {c}' for c in _SIG_COLUMNS)}, above_half, candidate_count FROM SG")
def refusal_signals(spark, d):
    s = _signals(spark, d)
    return s.select("qid", *[F.round(c, 7).alias(c) for c in _SIG_COLUMNS], "above_half", "candidate_count")


@query(_SIG_ALL + "SELECT qid, candidate_count < 10 OR top_score < 0.9 OR gap_ratio < 0.001 AS refuse, (CASE WHEN candidate_count < 10 THEN 1 ELSE 0 END + CASE WHEN top_score < 0.9 THEN 1 ELSE 0 END + CASE WHEN gap_ratio < 0.001 THEN 1 ELSE 0 END)::INTEGER AS reasons FROM SG")
def should_refuse(spark, d):
    out = evaluate.should_refuse(_signals(spark, d), min_candidates=10, min_top_score=0.9, min_gap_ratio=0.001)
    return out.select("qid", "refuse", F.size("reasons").alias("reasons"))


_SWEEP = _SIG_ALL.rstrip() + """, LG AS (
  UNPIVOT (SELECT q.answerable, round(top_score, 7) AS top_score, round(concentration, 7) AS concentration, round(gap_ratio, 7) AS gap_ratio, round(decay, 7) AS decay, above_half::DOUBLE AS above_half, candidate_count::DOUBLE AS candidate_count
    FROM SG JOIN questions q ON q.id = SG.qid WHERE NOT q.answerable OR q.verified) ON top_score, concentration, gap_ratio, decay, above_half, candidate_count INTO NAME signal VALUE value
), GR AS (SELECT signal, unnest(range(0, 21)) AS step, min(value) AS lo, max(value) AS hi FROM LG GROUP BY signal
), TH AS (SELECT signal, step, lo + (hi - lo) * step / 20 AS threshold FROM GR
), SW AS (SELECT signal, step, threshold, coalesce(avg((value < threshold)::INTEGER) FILTER (NOT answerable), 0) AS true_refusal, coalesce(avg((value < threshold)::INTEGER) FILTER (answerable), 0) AS false_refusal FROM LG JOIN TH USING (signal) GROUP BY ALL)
"""


def _rounded_observations(spark, d):
    o = _observations(spark, d)
    return o.select(*[F.round(c, 7).alias(c) if c in _SIG_COLUMNS else c for c in o.columns])


@query(_SWEEP + "SELECT signal, step::INTEGER AS step, round(threshold, 6) AS threshold, round(true_refusal, 9) AS true_refusal, round(false_refusal, 9) AS false_refusal, round(true_refusal - false_refusal, 9) AS youden FROM SW")
def calibrate_sweep(spark, d):
    s = evaluate.sweep(materialize(_rounded_observations(spark, d), "observations"))
    return s.select("signal", "step", F.round("threshold", 6).alias("threshold"), *[F.round(c, 9).alias(c) for c in ("true_refusal", "false_refusal", "youden")])


@query(_SWEEP.rstrip() + """, BT AS (SELECT *, round(true_refusal - false_refusal, 12) AS youden FROM SW QUALIFY row_number() OVER (PARTITION BY signal ORDER BY round(true_refusal - false_refusal, 12) DESC, step) = 1
), MN AS (SELECT signal, coalesce(avg(value) FILTER (answerable), 0) AS mean_answerable, coalesce(avg(value) FILTER (NOT answerable), 0) AS mean_unanswerable FROM LG GROUP BY signal)
SELECT signal, step::INTEGER AS step, round(threshold, 6) AS threshold, round(youden, 9) AS youden, round(mean_answerable, 6) AS mean_answerable, round(mean_unanswerable, 6) AS mean_unanswerable, round(mean_answerable - mean_unanswerable, 6) AS separation FROM BT JOIN MN USING (signal)""")
def calibrate_best(spark, d):
    b = evaluate.best_thresholds(materialize(_rounded_observations(spark, d), "observations"))
    return b.select("signal", "step", F.round("threshold", 6).alias("threshold"), F.round("youden", 9).alias("youden"), *[F.round(c, 6).alias(c) for c in ("mean_answerable", "mean_unanswerable", "separation")])


_RUNS = _EVAL + _METRICS.format(q="QA").rstrip() + ", SN AS (SELECT * FROM SC), " + "FL2 AS (SELECT id AS qid, path, min(i) AS pos FROM (SELECT id, unnest(expected_files) AS path, unnest(range(1, len(expected_files) + 1)) AS i FROM QA) GROUP BY ALL)" + _METRICS.format(q="QA").rstrip().replace("FL LEFT", "FL2 LEFT").replace("FL.", "FL2.").replace("EX AS", "EX2 AS").replace("KS AS", "KS2 AS").replace("MK AS", "MK2 AS").replace("PQ AS", "PQ2 AS").replace("SC AS", "SO AS").replace("JOIN EX ", "JOIN EX2 ").replace("JOIN KS ", "JOIN KS2 ").replace("JOIN MK ON MK.", "JOIN MK2 ON MK2.").replace("FROM PQ)", "FROM PQ2)")


@query(_RUNS + """, BA AS (SELECT 'recall@' || k AS metric, avg(recall) AS value FROM SO GROUP BY k UNION ALL SELECT 'mrr', avg(rr) FROM SO WHERE k = 5
), CU AS (SELECT 'recall@' || k AS metric, avg(recall) AS value FROM SN GROUP BY k UNION ALL SELECT 'mrr', avg(rr) FROM SN WHERE k = 5)
SELECT metric, round(BA.value, 9) AS before, round(CU.value, 9) AS after, round(CU.value - BA.value, 9) AS delta, CASE WHEN CU.value - BA.value < -0.02 THEN 'regression' WHEN CU.value - BA.value > 0.02 THEN 'improvement' ELSE 'same' END AS verdict FROM BA JOIN CU USING (metric)""")
def baseline_compare(spark, d):
    """The keyword run against the ceiling as its baseline."""
    q = _questions(spark, d)
    ceiling = evaluate.per_question(q, evaluate.retrieved_files(evaluate.oracle_hits(q)))
    run = materialize(_scores(spark, d), "scores")
    out = evaluate.compare_baseline(evaluate.means(materialize(ceiling, "ceiling")), evaluate.means(run))
    return out.select("metric", *[F.round(c, 9).alias(c) for c in ("before", "after", "delta")], "verdict")


@query(_EVAL + _METRICS.format(q="QA") + "SELECT a.qid, 'fixed' AS change FROM SC a JOIN SC b ON a.qid = b.qid WHERE a.k = 5 AND b.k = 50 AND a.recall = 0 AND b.recall > 0 UNION ALL SELECT a.qid, 'new' FROM SC a JOIN SC b ON a.qid = b.qid WHERE a.k = 5 AND b.k = 50 AND a.recall > 0 AND b.recall = 0")
def baseline_misses(spark, d):
    """Questions missed at 5 files but not at 50."""
    s = materialize(_scores(spark, d), "scores").where("recall = 0")
    return evaluate.compare_misses(s.where("k = 5").select("qid"), s.where("k = 50").select("qid"))


# Answers

_BLOCK = "'[' || ref || '] ' || path || ':' || start_line || '-' || end_line || chr(10) || {symbol}'```' || {language} || chr(10) || substr(content, 1, {chars}) || chr(10) || '```'"


def _prompt_sql(head: str, tail: str, block: str) -> str:
    esc = lambda s: s.replace("'", "''").replace("\n", "' || chr(10) || '")
    nl = "chr(10) || chr(10)"
    return f"""WITH {C}, {H}, {S} SELECT se.qid, '{esc(head)}' || {nl} || 'Question: ' || se.query || {nl} || 'Sources:' || chr(10) || string_agg({block}, {nl} ORDER BY ref) || {nl} || '{esc(tail)}' AS prompt
FROM searches se JOIN S ON S.qid = se.qid GROUP BY se.qid, se.query"""


@query(_prompt_sql(answer.ANSWER_HEAD, answer.ANSWER_TAIL, _BLOCK.format(symbol="'symbol: ' || coalesce(symbol_name, '(none)') || ' (' || coalesce(symbol_kind, '?') || ')' || chr(10) || ", language="language", chars=1200)))
def build_prompt(spark, d):
    return answer.answer_prompts(table(spark, d, "searches").select("qid", "query"), views.sources(spark, d))


@query(_prompt_sql(answer.GROUNDED_HEAD, answer.GROUNDED_TAIL, _BLOCK.format(symbol="", language="''", chars=600)))
def build_groundedness_prompt(spark, d):
    return answer.groundedness_prompts(table(spark, d, "searches").select("qid", "query"), views.sources(spark, d))


_ANSWERS = f"WITH {C}, {H}, {S}, {RECORDED}"
_ERRORS = """, ER AS (
  SELECT qid, 'empty-answer' AS kind, NULL::INTEGER AS claim, 'the answer is empty' AS detail FROM L WHERE length(qid) % 2 = 0
  UNION ALL SELECT qid, 'unknown-citation', claim, 'claim ' || (claim + 1) || ' cites unknown source ' || ref FROM KN WHERE body IS NULL
  UNION ALL SELECT qid, 'uncited-claim', claim, 'claim ' || (claim + 1) || ' has no valid citation: ' || substr(text, 1, 80) FROM A WHERE NOT EXISTS (SELECT 1 FROM KN WHERE KN.qid = A.qid AND KN.claim = A.claim AND body IS NOT NULL)
  UNION ALL SELECT qid, 'quote-not-found', claim, 'claim ' || (claim + 1) || ' quotes what its sources lack: ' || substr(quote, 1, 60) FROM QF WHERE NOT found)
"""


@query(_ANSWERS + _ERRORS + "SELECT * FROM ER")
def validate_errors(spark, d):
    return answer.validation_errors(views.recorded_answers(spark, d), views.sources(spark, d))


@query(_ANSWERS + _ERRORS + """SELECT L.qid, NOT EXISTS (SELECT 1 FROM ER WHERE ER.qid = L.qid) AS ok, (SELECT count(*) FROM ER WHERE ER.qid = L.qid) AS errors,
  (SELECT count(DISTINCT claim) FROM KN WHERE KN.qid = L.qid AND body IS NOT NULL) / 4.0::DOUBLE AS cited_fraction, (SELECT count(*) FROM QQ WHERE QQ.qid = L.qid) AS quotes_checked FROM L""")
def validate_answers(spark, d):
    return answer.validate(views.recorded_answers(spark, d), views.sources(spark, d))


@query(_ANSWERS + " SELECT CI.qid, CI.claim, CI.ref::INTEGER AS ref, chunk_id, path, start_line, end_line, symbol_name FROM CI JOIN S ON S.qid = CI.qid AND S.ref = CI.ref")
def resolve_citations(spark, d):
    return answer.resolve_citations(views.recorded_answers(spark, d), views.sources(spark, d))


@query("SELECT qid, k::DOUBLE / 50 AS confidence, 1 AS claims, query AS answer FROM searches")
def parse_answer(spark, d):
    """Replies made of the searches, fenced and with prose around for some; parsed they give back what went in."""
    body = F.to_json(F.struct(F.col("query").alias("answer"), F.array(F.struct(F.col("query").alias("text"), F.array(F.lit("1"), F.lit("x")).alias("refs"))).alias("claims"), (F.col("k") / 50).alias("confidence")))
    reply = F.when(F.col("rewritten"), F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(F.col("k") > 10, F.concat(F.lit("Here it is. "), body, F.lit(" Done."))).otherwise(body)
    out = answer.parsed_answers(table(spark, d, "searches").select("qid", reply.alias("reply")))
    return out.select("qid", "parsed.confidence", F.size("parsed.claims").alias("claims"), "parsed.answer")


def _scripted(prompts: DataFrame, attempt: int) -> DataFrame:
    """A model that answers by rule: fails, gives no JSON, gives up, or cites source 1 only from the second attempt on."""
    kind = F.conv(F.substring("qid", -1, 1), 10, 10).cast("int") % 5
    cited = '{"answer": "it is so", "claims": [{"text": "so", "citations": [%d]}], "confidence": 0.8}'
    reply = F.when(kind == 1, "no json").when(kind == 2, '{"answer": "unknown", "claims": [], "confidence": 0}').when(kind == 3, cited % (9 if attempt == 1 else 1)).otherwise(cited % 1)
    return prompts.select("qid", F.when(kind != 0, reply).alias("reply"), F.when(kind == 0, "model unavailable").alias("error"))


@query(f"""WITH {C}, {H}, {S}, R AS (SELECT se.qid, right(se.qid, 1)::INTEGER % 5 AS kind, EXISTS (SELECT 1 FROM S WHERE S.qid = se.qid) AS has FROM searches se)
SELECT qid, CASE WHEN has AND kind IN (3, 4) THEN 'answer' ELSE 'refusal' END AS kind,
  CASE WHEN NOT has THEN 'nothing was retrieved for this question' WHEN kind = 0 THEN 'model unavailable' WHEN kind = 1 THEN 'citations could not be verified after 2 attempts' WHEN kind = 2 THEN 'unknown' ELSE 'it is so' END AS text,
  (CASE WHEN NOT has THEN 0 WHEN kind IN (1, 3) THEN 2 ELSE 1 END)::INTEGER AS attempts, has AND kind IN (2, 3, 4) AS ok, CASE WHEN has AND kind IN (3, 4) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM R""")
def ask_outcomes(spark, d):
    return answer.ask(table(spark, d, "searches").select("qid", "query"), materialize(views.sources(spark, d), "sources"), _scripted)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
