"""Evaluation texts leaking into training text.

Method. Words are the maximal runs of letters and digits after NFKC and lower-casing. The seeds of an item's field are
its n-grams: those of ``seed`` words, however frequent in the corpus, and the shorter ones of ``short`` words that are
rare among the items (in at most ``rare`` fields). A document is joined to a field by one seed, or by two rare short
ones. A run of words of twice ``seed`` less two or more holds a seed wherever an edit falls, and every exact run of ``seed`` words
is one, so that joining loses no such run; an edited copy is joined while any ``seed`` successive words or two rare groups of
``short`` words are left of it. Around the seeds the passage of the document is aligned with the field by
Smith-Waterman over words, which scores exact, edited and paraphrased copies alike and gives the longest equal run. The
alignment decides: a pair counts with ``least_run`` equal words in succession, or with ``least_score`` and
``coverage`` of what a whole copy scores.

Scale. Items are few and held out; they are read in blocks of about ``block`` characters, and each block's
tables, whose size that bounds, go to the tasks while every document streams past them once: no shuffle of the
corpus. The documents of a batch are reduced to the item vocabulary and matched together, on integers.

Defined cases: null texts and ids are left out; a field of fewer than ``short`` words joins nothing;
a document counts once per item however often a copy occurs in it; no documents or no items give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORDS = re.compile(r"[a-z0-9]+")
MATCH, MISMATCH, GAP = 2, -1, -1


def words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORDS.findall(text.lower())
    return _WORDS.findall(unicodedata.normalize("NFKC", text).lower())


class SeedTable:
    """Where each of some n-grams stands: sorted keys, and for each the stretch of its (field, place in the field)."""

    def __init__(self, grams: list[np.ndarray], most: int | None = None):
        gram = np.concatenate([*grams, np.empty(0, np.int64)])
        field = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        inner = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        gram, self.fields, self.inner = gram[order], field[order], inner[order]
        self.keys, self.first, self.count = np.unique(gram, return_index=True, return_counts=True)
        if most is not None:
            kept = self.count <= most
            self.keys, self.first, self.count = self.keys[kept], self.first[kept], self.count[kept]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``grams``, field, place in the field) of every stand of the n-gram of a place."""
        if not len(self.keys) or not len(grams):
            return (np.empty(0, np.int64),) * 3
        at = np.searchsorted(self.keys, grams)
        at[at == len(self.keys)] = 0
        place = np.flatnonzero(self.keys[at] == grams)
        at = at[place]
        n = self.count[at]
        at = np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(place, n), self.fields[at], self.inner[at]


class ItemBlock:
    """The fields of a bounded block of items as runs of vocabulary numbers, and their seeds."""

    def __init__(self, fields: list[tuple[str, str, str]], seed: int, short: int, rare: int):
        self.vocab: dict[str, int] = {}
        self.fields: list[tuple[str, str, np.ndarray]] = []
        for item, name, text in fields:
            w = [self.vocab.setdefault(x, len(self.vocab)) for x in words(text)]
            self.fields.append((item, name, np.array(w, np.int64)))
        self.seed, self.short = seed, short
        self.base = np.int64(len(self.vocab) + 1)
        runs = [w for _, _, w in self.fields]
        self.long = SeedTable([self.grams(w, seed) for w in runs])
        self.rare = SeedTable([self.grams(w, short) for w in runs], rare)
        #: A field of so few words that it has one short n-gram is joined by that one.
        self.lengths = np.array([len(w) for w in runs], np.int64)
        self.single = np.array([len(w) <= short for w in runs], bool)

    def grams(self, w: np.ndarray, size: int) -> np.ndarray:
        """A number for each n-gram of ``w``, -1 where a word is outside the vocabulary."""
        n = len(w) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
        for i in range(size):
            part = w[i : n + i]
            bad |= part < 0
            # products wrap: a number is a hash unless the block is small; hits are aligned on the words themselves
            out = out * np.uint64(self.base) + part.astype(np.uint64)
        g = (out >> np.uint64(1)).astype(np.int64)
        g[bad] = -1
        return g

    def joined(self, texts: list[str], band: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(text, field, passages) of every text that the seeds join to a field. A passage reaches from where the field
        would begin to where it would end, a quarter of the field and ``band`` words more on either side."""
        get = self.vocab.get
        runs = [words(t) for t in texts]
        # the texts of a batch are one run, a word outside the vocabulary between two of them
        starts = np.cumsum([0, *(len(r) + 1 for r in runs)])
        w = np.fromiter((get(x, -1) for r in runs for x in (*r, "")), np.int64, starts[-1])
        place, field, inner = self.long.hits(self.grams(w, self.seed))
        sure = np.ones(len(place), bool)
        more, of, within = self.rare.hits(self.grams(w, self.short))
        place, field, inner = np.r_[place, more], np.r_[field, of], np.r_[inner, within]
        sure = np.r_[sure, self.single[of]]
        text = np.searchsorted(starts, place, side="right") - 1
        shift = place - inner
        order = np.lexsort((shift, field, text))
        place, field, text, sure, shift = place[order], field[order], text[order], sure[order], shift[order]
        if not len(place):
            return
        fresh = np.r_[True, (text[1:] != text[:-1]) | (field[1:] != field[:-1])]
        # a short seed counts beside another that does not overlap it, in the same order as in the field but for ``band`` words
        step = np.abs(np.diff(place))
        pair = ~fresh[1:] & (np.diff(shift) <= band) & (step >= self.short) & (step <= self.lengths[field[1:]] + band)
        sure[1:] |= pair
        sure[:-1] |= pair
        cuts = np.flatnonzero(fresh)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)]):
            if (on := sure[a:b]).any():
                t, f = int(text[a]), int(field[a])
                n = len(self.fields[f][2])
                near = np.sort(shift[a:b][on])
                cut = np.flatnonzero(np.r_[True, np.diff(near) > n + 2 * band + n // 2])  # further apart, they are two passages
                lo = np.maximum(near[cut] - band - n // 4, starts[t])
                hi = np.minimum(near[np.r_[cut[1:] - 1, len(near) - 1]] + n + band + n // 4, starts[t + 1] - 1)
                yield t, f, [w[x:y] for x, y in zip(lo, hi)]


def align(target: np.ndarray | list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(score, longest run) of each passage against the target, or against its own one: the best Smith-Waterman local
    alignment with linear gaps, and the longest run of equal words. All pairs advance together, one target word a step."""
    targets = [target] * len(passages) if isinstance(target, np.ndarray) else target
    # the target's words go down the first axis, the pairs along the second
    a = np.full((max(map(len, targets)), len(passages), 1), -3, np.int32)
    b = np.full((len(passages), max(map(len, passages))), -2, np.int32)
    for i, (t, p) in enumerate(zip(targets, passages)):
        a[: len(t), i, 0] = t
        b[i, : len(p)] = p
    b[b == -1] = -2  # a word outside the vocabulary equals nothing
    width = b.shape[1]
    steps = np.arange(1, width + 1, dtype=np.int32) * np.int32(-GAP)
    row = np.zeros((len(passages), width + 1), np.int32)
    run = np.zeros_like(row)
    score, longest = np.zeros(len(passages), np.int32), np.zeros(len(passages), np.int32)
    gain = np.array([MISMATCH, MATCH], np.int32)
    for x in a:
        same = b == x
        fresh = row[:, :-1] + gain[same.view(np.int8)]
        np.maximum(fresh, row[:, 1:] + np.int32(GAP), out=fresh)
        np.maximum(fresh, 0, out=fresh)
        # gaps within the row: the running maximum of value + distance
        fresh += steps
        np.maximum.accumulate(fresh, axis=1, out=fresh)
        fresh -= steps
        row[:, 1:] = fresh
        run[:, 1:] = (run[:, :-1] + 1) * same
        np.maximum(score, fresh.max(axis=1), out=score)
        np.maximum(longest, run.max(axis=1), out=longest)
    return score, longest


def _blocks(items: DataFrame, id_col: str, fields: tuple[str, ...], block: int) -> Iterator[list[tuple[str, str, str]]]:
    """Items in blocks of bounded size, in the order of their ids; they reach the driver block by block."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), *[F.col(f).cast("string").alias(f) for f in fields]).where("id is not null").orderBy("id")
    out: list[tuple[str, str, str]] = []
    held = 0
    for row in rows.toLocalIterator():
        for f in fields:
            if row[f]:
                out.append((row["id"], f, row[f]))
                held += len(row[f])
        if held >= block:
            yield out
            out, held = [], 0
    if out:
        yield out


def _alignments(docs: DataFrame, kind: str, block: ItemBlock, margin: int) -> DataFrame:
    """(doc_id, item_id, field, run_words, score, item_words) of every document and field that the block's seeds join."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(doc, i, passage) for doc, i, passages in block.joined(batch.column(1).to_pylist(), margin) for passage in passages]
            pairs.sort(key=lambda x: (len(block.fields[x[1]][2]), len(x[2])))  # pairs of like lengths advance together
            out: dict[tuple, list[int]] = {}
            for k in range(0, len(pairs), 256):
                part = pairs[k : k + 256]
                for (doc, i, _), score, longest in zip(part, *align([block.fields[i][2] for _, i, _ in part], [p for _, _, p in part])):
                    best = out.setdefault((doc, i), [0, 0])
                    best[:] = max(best[0], int(longest)), max(best[1], int(score))
            at = list(out)
            columns = [batch.column(0).take(pa.array([r for r, _ in at], pa.int64()))]
            columns += [pa.array([block.fields[i][c] for _, i in at], pa.string()) for c in (0, 1)]
            columns += [pa.array([v[c] for v in out.values()], pa.int64()) for c in (0, 1)]
            columns.append(pa.array([len(block.fields[i][2]) for _, i in at], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "field", "run_words", "score", "item_words"])

    return docs.mapInArrow(hits, f"doc_id {kind}, item_id string, field string, run_words long, score long, item_words long")


def leaks(docs: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("question", "passage"), seed: int = 7, short: int = 3, rare: int = 2,
          margin: int = 8, least_run: int = 12, least_score: int = 16, coverage: float = 0.35, block: int = 8_000_000,
          doc_id: str = "doc_id", text: str = "text", item_id: str = "id") -> DataFrame:
    """(doc_id, item_id, field, run_words, score, item_words, coverage) of every document and item field that the alignment accepts.

    ``run_words`` is the longest run of equal words, ``score`` the Smith-Waterman score (2 a match, -1 a mismatch or
    gap), ``coverage`` the score as a share of that of a whole copy. A document holds a run of n >= ``least_run``
    words of an item exactly when ``run_words >= n``; an edited copy shows in ``coverage``.
    """
    kind = dict(docs.select(F.col(doc_id).alias("i")).dtypes)["i"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null and text != ''")
    found = None
    for part in _blocks(items, item_id, fields, block):
        one = _alignments(rows, kind, ItemBlock(part, seed, short, rare), margin)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id string, field string, run_words long, score long, item_words long, coverage double")
    found = found.withColumn("coverage", F.col("score") / (MATCH * F.col("item_words")))
    return found.where((F.col("run_words") >= least_run) | ((F.col("score") >= least_score) & (F.col("coverage") >= coverage)))
