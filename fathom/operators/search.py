"""Retrieval for batches of queries: exact nearest neighbours, BM25 with phrases, term overlap, fusion, reranking."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import phrase, plain_tokens, query_terms, tokens
from fathom.session import materialize

K1, B = 1.2, 0.75
RRF_K = 60
#: So many (query, phrase) rows go to the tasks at once; more are more blocks, and each block reads the documents.
BLOCK_PHRASES = 200_000
#: So many hits a task keeps back to see whether better ones come; more are passed on.
TASK_HITS = 4_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision, 0 where one has no length; a difference in dimension raises."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimension"))).otherwise(dot(a, b) / norm)
    return F.when(norm == 0, 0.0).otherwise(checked)


def top_k(hits: DataFrame, k: int, by: list[Column], group: str = "qid") -> DataFrame:
    """The first ``k`` rows of each query with their rank; Spark cuts each partition's share before the shuffle."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by)))
    return ranked.where(F.col("rank") <= k)


def top_k_each(hits: DataFrame, queries: DataFrame, qid: str, k: int | str, by: list[Column]) -> DataFrame:
    """``top_k`` for a number, or for a column of ``queries``: first to the greatest k, which Spark can cut early, then to each query's own."""
    if not isinstance(k, str):
        return top_k(hits, k, by)
    most = queries.agg(F.max(k)).first()[0] or 0
    own = queries.select(F.col(qid).alias("qid"), F.col(k).alias("_k"))
    return top_k(hits, most, by).join(own, "qid").where(F.col("rank") <= F.col("_k")).drop("_k")


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", block: int = 2048) -> DataFrame:
    """(qid, vid, score, rank): the ``k`` nearest of ``vectors`` (vid, embedding) for each of ``queries`` (qid, embedding).

    ``l2`` scores 1/(1+distance), ``cosine`` the cosine. Queries go to the tasks in blocks of at most ``block``
    vectors; a task multiplies a batch of vectors with a block at once and keeps k a query, so only k rows a
    query and batch are shuffled. A null vector matches nothing, an empty query vector finds nothing.
    """
    types = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["vid"]
    out = None
    rows = queries.where(F.col("qid").isNotNull() & (F.size("embedding") > 0)).select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    names: list = []
    held: list = []

    def scan(names: list, held: list) -> DataFrame:
        matrix = np.array(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            length = np.sqrt((matrix**2).sum(axis=1))
            for batch in batches:
                vid = np.array(batch.column(0).to_pylist(), object)
                if not len(vid):
                    continue
                lengths = pc.list_value_length(batch.column(1)).to_numpy()
                if (lengths != matrix.shape[1]).any():
                    raise ValueError(f"query vectors have {matrix.shape[1]} dimensions, stored ones {lengths[lengths != matrix.shape[1]][0]}")
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vid), -1)
                size = np.sqrt((v**2).sum(axis=1))
                product = matrix @ v.T
                if metric == "l2":
                    order = length[:, None] ** 2 + size[None, :] ** 2 - 2 * product
                    slack = 1e-9 * (length**2 + size.max() ** 2)
                else:
                    norm = length[:, None] * size[None, :]
                    order = -np.divide(product, norm, out=np.zeros_like(norm), where=norm > 0)
                    slack = np.zeros(len(matrix))
                n = min(k, len(vid))
                # ties at the edge, and what rounding may have put beyond it, stay
                edge = np.partition(order, n - 1, axis=1)[:, n - 1]
                q, j = np.nonzero(order <= (edge + slack)[:, None])
                if metric == "l2":
                    distance = np.sqrt(((v[j] - matrix[q]) ** 2).sum(axis=1))
                    score = 1 / (1 + distance)
                else:
                    distance, score = order[q, j], -order[q, j]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q]), pa.array(vid[j].tolist()), pa.array(score), pa.array(distance)], ["qid", "vid", "score", "distance"])

        source = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("vid", "embedding")
        return source.mapInArrow(run, f"qid {types[0]}, vid {types[1]}, score double, distance double")

    for row in rows.toLocalIterator():
        names.append(row["qid"])
        held.append(row["embedding"])
        if len(names) == block:
            part = scan(names, held)
            out = part if out is None else out.unionByName(part)
            names, held = [], []
    if names:
        part = scan(names, held)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"qid {types[0]}, vid {types[1]}, score double, rank int")
    return top_k(out, k, [F.col("distance"), F.col("vid")]).select("qid", "vid", "score", "rank")


def knn_overfetch(queries: DataFrame, vectors: DataFrame, k: int, keep: Column, metric: str = "l2", factor: int = 4) -> DataFrame:
    """k-NN that filters after fetching ``factor`` times k, so a narrow filter may leave fewer than k."""
    near = knn(queries, vectors, k * factor, metric).drop("rank")
    kept = near.join(vectors.drop("embedding"), "vid").where(keep)
    return top_k(kept, k, [F.col("score").desc(), F.col("vid")]).select("qid", "vid", "score", "rank")


def postings(docs: DataFrame, doc: str, columns: tuple[str, ...]) -> DataFrame:
    """(doc, dl, col, pos, term) of every token; positions count within a column, ``dl`` over all; every text is tokenised once."""
    parts = F.array(*[tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    rows = docs.select(F.col(doc).alias("doc"), parts.alias("parts"))
    rows = rows.select("doc", F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p)).alias("dl"), F.posexplode("parts").alias("col", "part"))
    return rows.select("doc", "dl", "col", F.posexplode("part").alias("pos", "term"))


def phrases(queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, weight, ph, words): the phrases of each query; a repeated term weighs again, single terms are phrases of one word."""
    terms = queries.select(F.col(qid).alias("qid"), F.explode(query_terms(F.col(text))).alias("t"))
    words = terms.select("qid", phrase(F.col("t")).alias("words")).where(F.size("words") > 0)
    return words.select("qid", F.array_join("words", " ").alias("ph"), "words").groupBy("qid", "ph", "words").agg(F.count(F.lit(1)).alias("weight"))


class PhraseBlock:
    """The phrases of a bounded block of queries, and which queries ask for each with what weight and k."""

    def __init__(self):
        self.words: list[list[str]] = []
        self.number: dict[str, int] = {}
        self.queries: list = []
        self.most: list[int] = []
        self.asked: list[tuple[int, int, int]] = []  # (phrase, query, weight)

    def add(self, qid, k: int, own: list) -> None:
        q = len(self.queries)
        self.queries.append(qid)
        self.most.append(k)
        for p in own:
            n = self.number.setdefault(p["ph"], len(self.words))
            if n == len(self.words):
                self.words.append(p["words"])
            self.asked.append((n, q, p["weight"]))

    def matched(self, docs: DataFrame, doc: str, columns: tuple[str, ...]) -> DataFrame:
        """(doc, dl, ph, tf) of every document: its length, and the numbers and frequencies of the phrases in it."""
        single = {w[0]: n for n, w in enumerate(self.words) if len(w) == 1}
        several: dict[str, list[tuple[int, list[str]]]] = {}
        for n, w in enumerate(self.words):
            if len(w) > 1:
                several.setdefault(w[0], []).append((n, w))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths, phs, tfs = [], [], []
                for parts in zip(*(c.to_pylist() for c in batch.columns[1:])):
                    n = 0
                    seen: Counter = Counter()
                    for part in parts:
                        found = plain_tokens(part) if part else ()
                        n += len(found)
                        seen.update([x for t in found if (x := single.get(t)) is not None])
                        if several:
                            seen.update(x for i, t in enumerate(found) if t in several for x, w in several[t] if found[i : i + len(w)] == w)
                    lengths.append(n)
                    phs.append(list(seen))
                    tfs.append(list(seen.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(lengths, pa.int32()), pa.array(phs, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc", "dl", "ph", "tf"])

        rows = docs.select(F.col(doc).alias("doc"), *columns)
        return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, dl int, ph array<int>, tf array<int>")

    def best(self, matched: DataFrame, df: dict[int, int], n_docs: int, mean: float, kind: str, cells: int = 8_000_000) -> DataFrame:
        """(qid, doc, raw): of each query the documents that are among the best k of those its task has seen, ties included.

        A batch of documents is scored as a product of matrices: phrases that fill much of it by a dense one, the rest
        each by itself.
        """
        # a term as frequent as half the corpus keeps the smallest positive weight
        idf = np.array([max(math.log((n_docs - df.get(p, 0) + 0.5) / (df.get(p, 0) + 0.5)), 1e-6) for p in range(len(self.words))])
        asked = np.array(sorted(self.asked), np.int64).reshape(-1, 3)
        # the queries of a phrase are one stretch of the sorted rows
        first = np.searchsorted(asked[:, 0], np.arange(len(self.words) + 1))
        who, weight = asked[:, 1], asked[:, 2].astype(float)
        queries, most = self.queries, np.array(self.most)
        step = max(64, cells // max(1, len(queries)))

        def scores(n: int, row: np.ndarray, ph: np.ndarray, gain: np.ndarray) -> np.ndarray:
            score = np.zeros((len(queries), n))
            cuts = np.flatnonzero(np.r_[True, ph[1:] != ph[:-1]]) if len(ph) else np.empty(0, int)
            ends = np.r_[cuts[1:], len(ph)]
            held = ph[cuts]
            asks = first[held + 1] - first[held]
            # a dense product costs a twentieth of what single additions cost, for all of the matrix
            dense = asks * (ends - cuts) * 20 > len(queries) * n
            heavy = np.flatnonzero(dense)
            for at in range(0, len(heavy), 512):
                some = heavy[at : at + 512]
                left, right = np.zeros((len(queries), len(some))), np.zeros((len(some), n))
                for i, c in enumerate(some):
                    own = slice(first[held[c]], first[held[c] + 1])
                    left[who[own], i] = weight[own]
                    right[i, row[cuts[c] : ends[c]]] = gain[cuts[c] : ends[c]]
                score += left @ right
            for c in np.flatnonzero(~dense):
                own, here = slice(first[held[c]], first[held[c] + 1]), slice(cuts[c], ends[c])
                score[who[own][:, None], row[here][None, :]] += weight[own][:, None] * gain[here][None, :]
            return np.round(score, 9, out=score)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, np.ndarray] = {}  # of each query, the best scores that the task has seen
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    ph, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(float)
                    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
                    dl = batch.column(1).to_numpy()[row]
                    gain = idf[ph] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
                    order = np.argsort(ph, kind="stable")
                    score = scores(batch.num_rows, row[order], ph[order], gain[order])
                    qs, docs, raws = [], [], []
                    for q in np.flatnonzero((score.max(axis=1) > 0) & (most > 0)):
                        hit = np.flatnonzero(score[q] > 0)
                        own, k = score[q, hit], most[q]
                        if k <= 100_000:
                            seen = np.r_[best.get(q, np.empty(0)), own]
                            if len(seen) > k:
                                seen = np.partition(seen, len(seen) - k)[len(seen) - k :]
                                hit, own = hit[own >= seen.min()], own[own >= seen.min()]
                            best[q] = seen
                        qs += [queries[q]] * len(hit)
                        docs.append(hit)
                        raws.append(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qs, _arrow(kind)), batch.column(0).take(pa.array(np.concatenate([*docs, np.empty(0, int)]))), pa.array(np.concatenate([*raws, np.empty(0)]))], ["qid", "doc", "raw"])

        doc_kind = matched.schema["doc"].dataType.simpleString()
        return matched.select("doc", "dl", "ph", "tf").where(F.size("ph") > 0).mapInArrow(run, f"qid {kind}, doc {doc_kind}, raw double")

    def most_held(self, matched: DataFrame, kind: str, cells: int = 4_000_000) -> DataFrame:
        """(qid, doc, hit): of each query the best k documents of each task by the weight of its phrases among ``held``, their numbers.

        A task reads its documents in the order of their ids, so a later one counts only if it weighs more than the
        worst of k seen before. Phrases that fill much of a batch are summed by a matrix product, the rest singly.
        """
        place = np.full(max(self.number) + 2, -1)
        place[list(self.number)] = np.arange(len(self.words))
        asked = np.array(sorted(self.asked), np.int64).reshape(-1, 3)
        first = np.searchsorted(asked[:, 0], np.arange(len(self.words) + 1))
        which, who, weight = asked[:, 0], asked[:, 1], asked[:, 2].astype(np.float32)
        asks = np.diff(first)
        queries, most = self.queries, np.array(self.most)
        heaviest, limit = int(np.bincount(who, asked[:, 2]).max()), TASK_HITS
        step = max(64, cells // len(queries))

        def scores(n: int, row: np.ndarray, ph: np.ndarray) -> np.ndarray:
            score = np.zeros((len(queries), n), np.float32)
            # a dense product costs a three-hundredth of what single additions cost, for all of the matrix
            dense = asks * np.bincount(ph, minlength=len(asks)) * 300 > len(queries) * n
            heavy = np.flatnonzero(dense)
            for at in range(0, len(heavy), 512):
                some = heavy[at : at + 512]
                number = np.full(len(asks), -1)
                number[some] = np.arange(len(some))
                own, here = number[which] >= 0, number[ph] >= 0
                left, right = np.zeros((len(queries), len(some)), np.float32), np.zeros((len(some), n), np.float32)
                left[who[own], number[which[own]]] = weight[own]
                right[number[ph[here]], row[here]] = 1
                score += left @ right
            row, ph = row[~dense[ph]], ph[~dense[ph]]
            ends = np.cumsum(asks[ph])
            cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, 1_000_000))
            for at, to in zip(cuts, [*cuts[1:], len(ph)]):
                times = asks[ph[at:to]]
                own = np.arange(times.sum()) + np.repeat(first[ph[at:to]] - np.cumsum(times) + times, times)
                np.add.at(score.reshape(-1), who[own] * n + np.repeat(row[at:to], times), weight[own])
            return score

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a document must weigh more; of a query without k none does
            floor = np.where(most > 0, 0, np.inf).astype(np.float32)
            ids: list[pa.Array] = []
            read, size = 0, 64
            kept = [np.empty(0, np.int64)] * 3  # query, hit, document by its number in the task
            new: list[list[np.ndarray]] = []

            def settle() -> list[np.ndarray]:
                q, hit, d = (np.concatenate(x) for x in zip(kept, *new))
                new.clear()
                # stable, so that of equal hits the earlier documents stay
                order = np.argsort(q * (heaviest + 1) + heaviest - hit, kind="stable")
                q, hit, d = q[order], hit[order], d[order]
                rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(queries)))[q]
                last = rank == most[q] - 1
                floor[q[last]] = np.maximum(floor[q[last]], hit[last])
                return [x[rank < most[q]] for x in (q, hit, d)]

            def rows(q: np.ndarray, hit: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
                docs = pa.concat_arrays(ids).take(pa.array(d)) if ids else pa.array([], pa.string())
                return pa.RecordBatch.from_arrays([pa.array([queries[i] for i in q], _arrow(kind)), docs, pa.array(hit)], ["qid", "doc", "hit"])

            for whole in batches:
                ids.append(whole.column(0))
                at = 0
                while at < whole.num_rows:
                    batch = whole.slice(at, size)
                    n = batch.num_rows
                    ph = place[np.minimum(batch.column(1).flatten().to_numpy(), len(place) - 1)]
                    row = np.repeat(np.arange(n), pc.list_value_length(batch.column(1)).to_numpy())[ph >= 0]
                    score = scores(n, row, ph[ph >= 0])
                    cell = np.flatnonzero(score > floor[:, None])
                    new.append([cell // n, score.reshape(-1)[cell].astype(np.int64), cell % n + read])
                    if sum(len(x[0]) for x in new) > max(limit // 40, len(kept[0]) // 2):
                        kept = settle()
                    if len(kept[0]) > limit:  # the floors hold for what follows
                        yield rows(*kept)
                        kept = [x[:0] for x in kept]
                    at, read, size = at + n, read + n, min(size * 2, step)
            yield rows(*settle())

        return matched.select("doc", "held").sortWithinPartitions("doc").mapInArrow(run, f"qid {kind}, doc string, hit bigint")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def _phrase_blocks(queries: DataFrame, ph: DataFrame, qid: str, k: int | str, most: int) -> Iterator[PhraseBlock]:
    """The queries with their phrases, in blocks of at most ``most`` phrases (or one query); they reach the driver block by block."""
    own = ph.groupBy("qid").agg(F.collect_list(F.struct("ph", "words", "weight")).alias("own"))
    if isinstance(k, str):
        own = own.join(queries.groupBy(F.col(qid).alias("qid")).agg(F.max(k).alias("k")), "qid")
    block = PhraseBlock()
    for row in own.toLocalIterator():
        if block.asked and len(block.asked) + len(row["own"]) > most:
            yield block
            block = PhraseBlock()
        block.add(row["qid"], int(row["k"] or 0) if isinstance(k, str) else k, row["own"])
    if block.asked:
        yield block


def bm25(queries: DataFrame, docs: DataFrame, k: int | str, qid: str = "qid", text: str = "query", doc: str = "id",
         columns: tuple[str, ...] = ("path", "symbol_name", "content"), keep: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score, rank): BM25 over all indexed columns, squashed to [0, 1) by r/(1+r).

    N, the mean length and document frequencies are global: a filter (``keep``, a frame of allowed docs) does not
    change them. ``k`` is a number or the name of a column of the queries. Queries go to the tasks in blocks of
    bounded size; the documents are tokenised once a block, and what they hold of its phrases is written, one row a
    document. Scores are summed where the documents are, as a product of sparse matrices, so only k rows a
    query and batch of documents are shuffled.
    """
    kind = queries.select(F.col(qid).alias("q")).schema["q"].dataType.simpleString()
    doc_kind = docs.select(F.col(doc).alias("d")).schema["d"].dataType.simpleString()
    out = None
    for block in _phrase_blocks(queries, phrases(queries, qid, text), qid, k, BLOCK_PHRASES):
        matched = materialize(block.matched(docs, doc, columns), "matched")
        n_docs, mean = matched.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
        # one number a phrase of the block
        df = {r["p"]: r["n"] for r in matched.select(F.explode("ph").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
        part = block.best(matched if keep is None else matched.join(keep, "doc", "left_semi"), df, n_docs, mean, kind)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"qid {kind}, doc {doc_kind}, score double, rank int")
    best = top_k_each(out, queries, qid, k, [F.col("raw").desc(), F.col("doc")])
    return best.select("qid", "doc", (F.col("raw") / (1 + F.col("raw"))).alias("score"), "rank")


def keyword_overlap(queries: DataFrame, docs: DataFrame, k: int | str, qid: str = "qid", text: str = "query", doc: str = "id",
                    columns: tuple[str, ...] = ("path", "symbol_name", "content"), block: int = 100_000) -> DataFrame:
    """(qid, doc, score, rank): the share of a query's terms (words longer than two) that occur anywhere in a document's text.

    The distinct terms go to the tasks in blocks as one automaton, which reads each document once; what a document
    holds is written as one row of term numbers. Queries then go to those rows in blocks, and hits are summed where
    the documents are, so only k rows a query and task are shuffled. Rows of one id are one document.
    """
    import ahocorasick

    kind = queries.select(F.col(qid).alias("q")).schema["q"].dataType.simpleString()
    terms = queries.select(F.col(qid).alias("qid"), F.explode(F.split(F.lower(text), "[^A-Za-z0-9_]+")).alias("term"))
    terms = terms.where((F.length("term") > 2) & F.col("qid").isNotNull())
    total = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("total"))
    # in one partition the ids count from 0
    numbered = materialize(terms.select("term").distinct().repartition(1).withColumn("n", F.monotonically_increasing_id().cast("int")), "terms")
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    source = docs.select(F.col(doc).cast("string").alias("doc"), hay.alias("hay")).where(F.col("doc").isNotNull())
    found = None

    def scan(part: list[tuple[str, int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for t, n in part:
                machine.add_word(t, n)
            machine.make_automaton()
            for batch in batches:
                held = [list({n for _, n in machine.iter(h)}) for h in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int32()))], ["doc", "held"])

        return source.mapInArrow(run, "doc string, held array<int>").where(F.size("held") > 0)

    part: list[tuple[str, int]] = []
    for row in numbered.toLocalIterator():
        part.append((row["term"], row["n"]))
        if len(part) == block:
            found = scan(part) if found is None else found.unionByName(scan(part))
            part = []
    if part:
        found = scan(part) if found is None else found.unionByName(scan(part))
    if found is None:
        return queries.sparkSession.createDataFrame([], f"qid {kind}, doc string, score double, rank int")
    matched = materialize(found.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held")), "held")
    weights = terms.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("weight")).join(numbered, "term")
    weights = weights.select("qid", F.col("n").alias("ph"), F.array("term").alias("words"), "weight")
    out = None
    for some in _phrase_blocks(queries, weights, qid, k, BLOCK_PHRASES):
        best = some.most_held(matched, kind)
        out = best if out is None else out.unionByName(best)
    scored = out.join(total, "qid").select("qid", "doc", (F.col("hit") / F.col("total")).alias("score"))
    return top_k_each(scored, queries, qid, k, [F.col("score").desc(), F.col("doc")]).select("qid", "doc", "score", "rank")


def rrf(rankings: DataFrame, k: int | str | None = None, constant: int = RRF_K) -> DataFrame:
    """(qid, doc, score, rank): weighted reciprocal rank fusion of (qid, doc, src int, weight, rank).

    Ties keep the order of first sight: the smallest (src, rank). Rankings are unioned and grouped once, however
    many there are; sums are rounded to 12 places so that their order cannot matter.
    """
    fused = rankings.groupBy("qid", "doc").agg(
        F.round(F.sum(F.col("weight") / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("src", "rank")).alias("seen")
    )
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "seen.src", "seen.rank", "doc")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("qid", "doc", "score", "rank")


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, keyword_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """Fusion of a vector ranking and a keyword ranking (qid, doc, rank)."""
    a = vector_hits.select("qid", F.col("doc").cast("string").alias("doc"), "rank", F.lit(0).alias("src"), F.lit(vector_weight).alias("weight"))
    b = keyword_hits.select("qid", F.col("doc").cast("string").alias("doc"), "rank", F.lit(1).alias("src"), F.lit(keyword_weight).alias("weight"))
    return rrf(a.unionByName(b), k)


def rerank(base: DataFrame, scores: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, doc, score, rank) of ``base`` (qid, doc, score, rank) reordered by ``scores`` (qid, doc, value on 0-10).

    Unscored candidates come after all scored ones in their old order and keep their base score; a query with a
    single candidate passes through.
    """
    joined = base.join(scores, ["qid", "doc"], "left")
    many = F.count(F.lit(1)).over(Window.partitionBy("qid")) > 1
    value = F.when(many, F.col("value"))
    out = joined.withColumn("value", value).withColumn(
        "new", F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("value", F.lit(-1.0)).desc(), "rank"))
    )
    out = out.select("qid", "doc", F.coalesce(F.col("value") / 10, "score").alias("score"), F.col("new").alias("rank"))
    return out if k is None else out.where(F.col("rank") <= k)


def rerank_batches(base: DataFrame, model: str, size: int = 10) -> DataFrame:
    """(qid, batch, key, n): the batches a reranker would score and their cache keys, from (qid, query, doc, rank)."""
    batch = F.floor((F.col("rank") - 1) / size).cast("int")
    grouped = base.groupBy("qid", "query", batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("members"))
    nul = F.char(F.lit(0))
    ids = F.array_join(F.transform("members", lambda m: m["doc"]), ",")
    return grouped.select("qid", "batch", F.substring(F.sha2(F.concat(F.lit(model), nul, "query", nul, ids), 256), 1, 24).alias("key"), F.size("members").alias("n"))
