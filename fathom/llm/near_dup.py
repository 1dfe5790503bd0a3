"""Near-duplicate records by PartEnum signatures: every pair of texts of Jaccard similarity >= gamma.

Method. A text is the set of the hashes of its runs of ``width`` tokens. Sets are put in size bands: band b takes
as the smaller side sizes in [1/gamma^b, 1/gamma^(b+1)) and as the larger side sizes up to 1/gamma times that, so a
set enters its own band and those of its possible smaller partners. Within a band two sets of similarity >= gamma
differ in at most k elements. The hashed domain is cut into n1 > k parts, so the two-level scheme leaves k2 = 0
differences to its second level and the subsets to enumerate are the single parts: similar sets agree in at
least n1 - k of them. Each set emits one signature, a hash of its elements there, for every part in which it has
any, and pairs that share enough signatures of a band are candidates.

A signature shared by more than ``cap`` different sets is hot and yields no pairs. A set keeps a margin: its parts
less k, its empty parts and its hot signatures. A similar pair shares at least as many cold signatures as the margin
of either set, so pairs are candidates from there on, with ``SHARED`` as the least, and a pair can only be missed if
both margins are below that. Such sets (some in a thousand) are joined among themselves by an exact prefix filter on their rarest elements, in which an element of more than
``cap`` sets is worked off in blocks. Candidates of both kinds are verified on the whole sets.

Scale. Signatures (two longs) are the only thing shuffled for all records. Sets that are equal are one set from
the start; no signature yields more than cap^2/2 pairs. A signature that a task finds hot is no longer sent to its
group, and groups are streamed, so boilerplate in a third of all records makes neither a large group nor a long task.

Defined cases: null ids and null texts are left out; a text of fewer than ``width`` tokens has no runs and no
partners; an id delivered several times counts once; equal sets under different ids are pairs of similarity 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.components import connected_components
from fathom.llm.hashing import TokenHasher, mix, shingle_hashes
from fathom.session import materialize, scratch

TOKEN = re.compile(r"[a-z0-9_]+")
#: Signatures of a band that a candidate pair shares.
SHARED = 3
#: Up to so many keys (16 MB) are broadcast to pick their sets from the written ones; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, as the arrays made of one are many times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingle_sets(df: DataFrame, id_col: str = "id", text_col: str = "content", width: int = 3) -> DataFrame:
    """(id, key, n, elems): the set of each text; ``key`` is a hash of the set, ``elems`` its sorted hashes."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHasher(100_000)
        for batch in _slices(batches):
            ids, keys, ns, elems = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.unique(shingle_hashes(hasher(TOKEN.findall(text.lower())), width))
                if not len(s):
                    continue
                ids.append(i)
                keys.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                ns.append(len(s))
                elems.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.int64()), pa.array(ns, pa.int32()), pa.array(elems, pa.binary())], ["id", "key", "n", "elems"])

    return rows.mapInArrow(run, "id string, key long, n int, elems binary")


def _bands(n: int, gamma: float) -> Iterator[tuple[int, int, int]]:
    """(band, number of parts, largest difference from a similar set in the band) for a set of n elements."""
    top = math.floor(math.log(n) / -math.log(gamma) + 1e-9)
    least = math.ceil(n * gamma - 1e-9)
    low = math.floor(math.log(least) / -math.log(gamma) + 1e-9)
    share = (1 - gamma) / (1 + gamma)
    for b in range(low, top + 1):
        small = max(1, math.ceil(gamma ** -(b + 1) - 1e-9) - 1)  # the largest size on the smaller side
        k = math.floor(share * (small + math.floor(small / gamma + 1e-9)) + 1e-9)
        other = math.floor(n / gamma + 1e-9) if b == top else min(n, small)
        yield b, math.ceil(1.3 * (k + 1)) + 10, math.floor(share * (n + other) + 1e-9)


def signatures(s: np.ndarray, gamma: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The signatures of a sorted set of hashes, each with its band in the low six bits, and (band, margin) of its bands."""
    m = mix(s)
    out, margins = [], []
    for band, parts, k in _bands(len(s), gamma):
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sig = np.add.reduceat(m, starts) + mix(part[starts] * np.uint64(1_000_003) + np.uint64(band))
        out.append((sig & ~_BAND) | np.uint64(band % 64))
        margins.append((band % 64, len(starts) - k))
    return np.concatenate(out), margins


_BAND = np.uint64(63)


def _emit_signatures(gamma: float, cap: int):
    """(sig, key, band, margin) of the sets of a task: each signature, and without signature each band's margin.

    Once a signature is seen to be hot, it is no longer sent to its group: its sets come out as rows with neither
    signature nor margin, so that no group grows beyond ``cap + 1`` rows a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task emit once
        hot = np.empty(0, np.int64)
        for batch in _slices(batches):
            if len(seen) >= 1_000_000:
                seen.clear()  # between batches, so that a batch holds no set twice
            sigs, keys = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            own, bands, margins = [], [], []
            for key, elems in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                sig, places = signatures(np.frombuffer(elems, np.uint64), gamma)
                sigs.append(sig)
                for band, margin in places:
                    own.append(key)
                    bands.append(band)
                    margins.append(margin)
                keys.append(np.full(len(sig), key, np.int64))
            sig, key = np.concatenate(sigs).view(np.int64), np.concatenate(keys)
            order = np.argsort(sig, kind="stable")
            sig, key = sig[order], key[order]
            fresh = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.empty(0, bool)
            starts = np.flatnonzero(fresh)
            place = np.arange(len(sig)) - starts[np.cumsum(fresh) - 1] if len(sig) else starts
            spared = place > cap
            if len(hot):
                spared |= np.isin(sig, hot)
            if len(hot) < 100_000:
                hot = np.union1d(hot, sig[place > cap])
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[sig, np.zeros(n, np.int64)], mask=np.r_[spared, np.ones(n, bool)]),
                    pa.array(np.r_[key, np.array(own, np.int64)]),
                    pa.array(np.r_[(sig & 63).astype(np.int32), np.array(bands, np.int32)]),
                    pa.array(np.r_[np.zeros(len(sig), np.int32), np.array(margins, np.int32)], mask=np.r_[np.ones(len(sig), bool), np.zeros(n, bool)]),
                ],
                ["sig", "key", "band", "margin"],
            )

    return run


def _runs(cap: int):
    """From rows sorted by sig: the pairs of each signature, or its sets alone (``b`` null) beyond ``cap``;
    margins go through."""

    def flush(sig: np.ndarray, key: np.ndarray, hot: bool) -> pa.RecordBatch:
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
        sig, key = sig[fresh], key[fresh]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        lengths = np.diff(np.r_[starts, len(sig)])
        left, right, band, alone = [], [], [], [np.empty(0, np.int64)]
        for size in np.unique(lengths if hot else lengths[lengths > 1]):
            at = starts[lengths == size]
            if size > cap or hot:
                alone += [np.arange(x, x + size) for x in at]
                continue
            i, j = np.triu_indices(int(size), 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
        one = np.concatenate(alone)
        a, b = np.concatenate([*left, one]), np.concatenate([*right, one])
        return pa.RecordBatch.from_arrays(
            [pa.array(key[a]), pa.array(key[b], mask=np.arange(len(b)) >= len(b) - len(one)), pa.array((sig[a] & 63).astype(np.int32)), pa.nulls(len(a), pa.int32())],
            ["a", "b", "band", "margin"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, key = np.empty(0, np.int64), np.empty(0, np.int64)
        hot = None  # the signature at the end of what was read, once it has too many sets
        for batch in batches:
            spared = batch.column(0).null_count  # they sort first
            if spared:
                rest = batch.slice(0, spared)
                yield pa.RecordBatch.from_arrays([rest.column(1), pa.nulls(spared, pa.int64()), rest.column(2), rest.column(3)], ["a", "b", "band", "margin"])
                batch = batch.slice(spared)
            if not batch.num_rows:
                continue
            sig = np.r_[sig, batch.column(0).to_numpy()]
            key = np.r_[key, batch.column(1).to_numpy()]
            if hot is not None:
                rest = np.searchsorted(sig, hot, side="right")
                if rest:
                    yield flush(sig[:rest], key[:rest], True)
                    sig, key = sig[rest:], key[rest:]
                    if not len(sig):
                        continue
                hot = None
            last = np.searchsorted(sig, sig[-1])  # the last signature may go on in the next batch
            if last:
                yield flush(sig[:last], key[:last], False)
                sig, key = sig[last:], key[last:]
            if len(sig) > cap and len(np.unique(key)) > cap:
                hot = sig[-1]
                yield flush(sig, key, True)
                sig, key = sig[:0], key[:0]
        if len(sig):
            yield flush(sig, key, False)

    return run


def _verify(gamma: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ea, eb = (batch.column(i).to_pylist() for i in range(4))
            keep, sim = [], []
            for i in range(len(a)):
                x, y = np.frombuffer(ea[i], np.uint64), np.frombuffer(eb[i], np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                if both >= gamma * either - 1e-9:
                    keep.append(i)
                    sim.append(both / either)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    return run


def _prefix(gamma: float):
    """(key, elem, pos) of the elements among which any partner has one: all but ceil(gamma n) + 1 of the rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for key, elems in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                e = np.asarray(elems, np.int64)
                e = e[: len(e) - math.ceil(gamma * len(e) - 1e-9) + 1]
                keys.append(np.full(len(e), key, np.int64))
                out.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(np.concatenate(out) if out else [], pa.int64())], ["key", "elem"])

    return run


def _explode_elems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, out = [], []
        for key, elems in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            e = np.frombuffer(elems, np.int64)
            keys.append(np.full(len(e), key, np.int64))
            out.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(np.concatenate(out) if out else [], pa.int64())], ["key", "elem"])


def _sets_of(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, elems) of the distinct ``keys`` (written before, so they are counted without computing them again)."""
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return sets.select("key", "elems").join(keys, "key", "left_semi").groupBy("key").agg(F.first("elems").alias("elems"))


def _fallback_pairs(sets: DataFrame, some: DataFrame, gamma: float, cap: int) -> DataFrame:
    """Candidate pairs among the sets ``some`` (key): an exact prefix-filter join on their rarest elements.

    An element in more than ``cap`` prefixes is worked off in blocks: its sets are dealt to blocks by hash and
    every two blocks meet in a task of their own, so no task holds more than two blocks.
    """
    own = materialize(_sets_of(sets, some), "fallback")
    flat = own.mapInArrow(_explode_elems, "key long, elem long")
    df = flat.groupBy("elem").agg(F.count(F.lit(1)).alias("df"))
    order = flat.join(df, "elem").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "elem"))), lambda x: x["elem"]).alias("elems"))
    prefix = materialize(order.mapInArrow(_prefix(gamma), "key long, elem long"), "prefix")
    size = prefix.groupBy("elem").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = prefix.join(size, "elem")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / cap)).cast("int")
    rows = rows.select("elem", "key", blocks.alias("nb")).withColumn("blk", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("blk", o).alias("lo"), F.greatest("blk", o).alias("hi")))
    rows = rows.withColumn("meet", F.explode(meets)).select("elem", F.col("meet.lo").alias("lo"), F.col("meet.hi").alias("hi"), "blk", "key")
    left = rows.where("blk = lo").select("elem", "lo", "hi", F.col("key").alias("a"))
    right = rows.where("blk = hi").select("elem", "lo", "hi", F.col("key").alias("b"))
    met = left.join(right, ["elem", "lo", "hi"]).where("a != b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_sets(sets: DataFrame, gamma: float = 0.7, cap: int = 16) -> DataFrame:
    """(a, b, similarity): every pair a < b of keys of different sets of similarity >= gamma.

    ``sets`` is the materialised result of ``shingle_sets``; ``cap`` only decides which way a pair is found.
    """
    rows = sets.select("key", "elems").mapInArrow(_emit_signatures(gamma, cap), "sig long, key long, band int, margin int")
    rows = rows.repartition(F.coalesce("sig", "key")).sortWithinPartitions("sig")  # one column, which Spark sorts by radix
    found = materialize(rows.mapInArrow(_runs(cap), "a long, b long, band int, margin int"), "shared")
    hot = found.where("b is null and margin is null").groupBy(F.col("a").alias("key"), "band").agg(F.count(F.lit(1)).alias("hot"))
    margins = found.where("margin is not null").select(F.col("a").alias("key"), "band", "margin").distinct()
    least = margins.join(hot, ["key", "band"], "left").select("key", "band", (F.col("margin") - F.coalesce("hot", F.lit(0))).alias("least"))
    least = materialize(least, "least")
    shared = found.where("b is not null").groupBy("a", "b", "band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED)
    for side in ("a", "b"):
        shared = shared.join(least.select(F.col("key").alias(side), "band", "least"), [side, "band"]).where("n >= least").drop("least")
    pairs = shared.select("a", "b")
    short = materialize(least.where(F.col("least") < SHARED).select("key").distinct(), "short")
    if not short.isEmpty():
        pairs = pairs.unionByName(_fallback_pairs(sets, short, gamma, cap))
    near = materialize(pairs.distinct(), "near")
    wanted = materialize(near.select(F.col("a").alias("key")).union(near.select("b")).distinct(), "wanted")
    full = materialize(_sets_of(sets, wanted), "sets")
    both = near.join(full.select(F.col("key").alias("a"), F.col("elems").alias("ea")), "a").join(full.select(F.col("key").alias("b"), F.col("elems").alias("eb")), "b")
    return both.select("a", "b", "ea", "eb").mapInArrow(_verify(gamma), "a long, b long, similarity double")


def near_duplicates(df: DataFrame, id_col: str = "id", text_col: str = "content", gamma: float = 0.7, width: int = 3, cap: int = 16) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, key) give the set class of every text, links (a, b, similarity) the pairs of classes."""
    with scratch() as keep:
        sets = materialize(shingle_sets(df, id_col, text_col, width), "shingles")
        links = keep(materialize(similar_sets(sets, gamma, cap), "links"))
        members = keep(materialize(sets.select("id", "key").distinct(), "members"))
    return members, links


def _blocked(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): members (id, key, blk) dealt by hash to blocks of about ``block``, and (key, m, nb) of each class."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).withColumn("nb", F.ceil(F.col("m") / block).cast("int"))
    rows = members.join(sizes, "key").select("id", "key", "m", "nb", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("blk"))
    return rows, sizes


def near_duplicate_pairs(df: DataFrame, block: int = 1000, **params) -> DataFrame:
    """(id_a, id_b, similarity): all pairs of ids, id_a < id_b, those of equal sets included.

    The classes are expanded block against block, so a text under very many ids makes many tasks, not a long one.
    """
    members, links = near_duplicates(df, **params)
    rows, sizes = _blocked(members, block)
    many = rows.where("m > 1")
    others = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("blk", o).alias("lo"), F.greatest("blk", o).alias("hi")))
    met = many.withColumn("x", F.explode(others)).select("id", "key", "blk", "x.lo", "x.hi")
    left = met.where("blk = lo").select("key", "lo", "hi", F.col("id").alias("ia"))
    right = met.where("blk = hi").select("key", "lo", "hi", F.col("id").alias("ib"))
    # within a block the order of ids decides, between two blocks each pair meets once
    same = left.join(right, ["key", "lo", "hi"]).where("lo < hi or ia < ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), F.lit(1.0).alias("similarity"))
    wide = links
    for side in ("a", "b"):
        n = sizes.select(F.col("key").alias(side), "nb")
        wide = wide.join(n, side).withColumn(f"blk_{side}", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb")
    for side in ("a", "b"):
        wide = wide.join(rows.select(F.col("id").alias(f"i{side}"), F.col("key").alias(side), F.col("blk").alias(f"blk_{side}")), [side, f"blk_{side}"])
    cross = wide.where("ia != ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity")
    return same.unionByName(cross)


def near_duplicate_groups(df: DataFrame, **params) -> DataFrame:
    """(id, class_id, group_id, links): one row per text with a partner.

    ``class_id`` is the smallest id with the same set, ``links`` the number of other classes similar to the text's
    class, ``group_id`` the smallest id in its connected component.
    """
    with scratch() as keep:
        members, links = near_duplicates(df, **params)
        classes = materialize(members.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "classes")
        ca = classes.select(F.col("key").alias("a"), F.col("class_id").alias("u"))
        cb = classes.select(F.col("key").alias("b"), F.col("class_id").alias("v"))
        edges = materialize(links.join(ca, "a").join(cb, "b").select("u", "v"), "edges")
        degree = edges.select(F.col("u").alias("class_id")).unionByName(edges.select(F.col("v").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
        groups = connected_components(edges).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
        info = classes.join(degree, "class_id", "left").join(groups, "class_id", "left").where("copies > 1 or links is not null")
        info = info.select("key", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
        return keep(materialize(members.join(info, "key").select("id", "class_id", "group_id", "links"), "groups"))
