"""Filling fixed-capacity windows with texts by Karmarkar-Karp multiway differencing.

Method. Every text is sized in tokens of a public tokenizer. A text larger than the capacity is cut into full
windows and a rest; everything else stays whole. The items are dealt by hash into blocks of about ``block_items``
items, and each block is packed on its own: with m windows, the two partial partitions of the greatest imbalance
are merged, the fullest window of one with the emptiest of the other, until one partition of m near-equal windows
is left. Windows that exceed the capacity are differenced again with the emptiest ones. m starts at the total over
the capacity, and rises while a window still exceeds it.

Scale. Tokens are counted where the texts are; only (text, size) is shuffled, once, to the blocks. A block holds a
bounded number of items whatever the data, copies of one text or one id included, because the hash is over the
item's place in the written table of sizes. Blocks cost at most one partly filled window each.

Defined cases: rows without id, null texts and texts of no token are not placed; repeated rows are items of their
own; a text of exactly the capacity fills a window; no rows give no rows.
"""

from __future__ import annotations

import base64
import heapq
import math
import sys
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialize


def default_vocabulary() -> str:
    """The place of the multilingual byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _encoding(path: str):
    """The tokenizer of a rank file, built once in each worker process."""
    import tiktoken

    cache = sys.__dict__.setdefault("_fathom_encodings", {})
    if path not in cache:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every text that is not null; special tokens in a text are ordinary text."""
    path = vocabulary or default_vocabulary()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, tokens long")


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """(sum, items) of each non-empty window by Karmarkar-Karp differencing into ``windows`` windows.

    A partial partition is the ascending list of its non-empty windows (sum, tie, items); as long as it has
    fewer than ``windows`` of them, the others are empty and its imbalance is its fullest window.
    """
    heap: list[tuple[int, int, list]] = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, i, [i])]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        # b's fullest windows meet a's emptiest; empty windows are used up first
        free = min(windows - len(a), len(b))
        met = [(a[j], b[-1 - free - j]) for j in range(len(b) - free)]
        rest = a[len(met) :]
        for w in b[len(b) - free :]:
            insort(rest, w)
        for (s, _, x), (t, _, y) in met:
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            tie += 1
            insort(rest, (s + t, tie, x))
        tie += 1
        spread = rest[-1][0] - (rest[0][0] if len(rest) == windows else 0)
        heapq.heappush(heap, (-spread, tie, rest))
    return [(s, items) for s, _, items in heap[0][2]] if heap else []


def rebalance(packed: list[tuple[int, list[int]]], sizes: list[int], capacity: int, sweeps: int) -> list[tuple[int, list[int]]]:
    """Difference the fullest window with the emptiest anew, the next fullest with the next emptiest and so on,
    in at most ``sweeps`` rounds, until no window exceeds the capacity or a round changes nothing."""
    for _ in range(sweeps):
        packed.sort(key=lambda w: w[0])
        if not packed or packed[-1][0] <= capacity:
            break
        changed = False
        for lo in range(len(packed) // 2):
            hi = len(packed) - 1 - lo
            (a, x), (b, y) = packed[lo], packed[hi]
            if b <= capacity:
                break
            pool = x + y
            new = [(s, [pool[i] for i in members]) for s, members in differencing([sizes[i] for i in pool], 2)]
            if len(new) == 2 and max(s for s, _ in new) < b:
                packed[lo], packed[hi] = new
                changed = True
        if not changed:
            break
    return packed


def pack_block(sizes: list[int], capacity: int, sweeps: int = 24) -> list[tuple[int, list[int]]]:
    """Windows of at most ``capacity``: from the total over the capacity on, the first number for which differencing
    fits, the windows that it leaves too full being differenced again with the emptiest."""

    def attempt(windows: int) -> tuple[list[tuple[int, list[int]]], int]:
        packed = rebalance(differencing(sizes, windows), sizes, capacity, sweeps)
        return packed, sum(1 for s, _ in packed if s > capacity)

    windows = max(1, math.ceil(sum(sizes) / capacity))
    failed = windows - 1
    while True:
        packed, over = attempt(windows)
        if not over:
            break
        failed = windows
        # far off, the excess tells how many more windows are needed about
        windows += max(1, over // 8)
    # a jump may have gone too far: halve the way back to the last number that failed
    while windows - failed > 1:
        middle = (windows + failed) // 2
        fewer, over = attempt(middle)
        if over:
            failed = middle
        else:
            packed, windows = fewer, middle
    return packed


def pack(df: DataFrame, capacity: int = 2048, block_items: int = 4096, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(window, doc_id, piece, first_token, tokens): the window of every text or piece of a text."""
    counts = token_counts(df, id_col, text_col, vocabulary).where("tokens > 0")
    # the place in the written table tells equal rows apart and does not change if a task runs again
    counts = materialize(counts.withColumn("place", F.monotonically_increasing_id()), "sizes")
    kind = counts.schema["doc_id"].dataType.simpleString()
    full = F.floor(F.col("tokens") / capacity).cast("int")
    rest = F.col("tokens") % capacity
    whole = counts.where(full > 0).select("doc_id", "place", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    whole = whole.select(
        F.concat_ws("-", F.lit("full"), F.col("place"), F.col("piece")).alias("window"), "doc_id", F.col("piece").cast("long").alias("piece"),
        (F.col("piece") * capacity).cast("long").alias("first_token"), F.lit(capacity).cast("long").alias("tokens"),
    )
    items = counts.where(rest > 0).select("doc_id", "place", full.cast("long").alias("piece"), rest.alias("tokens"))
    blocks = max(1, math.ceil(counts.count() / block_items))
    items = items.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int"))

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tokens, pieces = block["tokens"].to_pylist(), block["piece"].to_pylist()
        window = [""] * len(tokens)
        for w, (_, members) in enumerate(pack_block(tokens, capacity)):
            for i in members:
                window[i] = f"{key[0].as_py()}-{w}"
        return pa.table({"window": window, "doc_id": block["doc_id"], "piece": pieces, "first_token": [p * capacity for p in pieces], "tokens": tokens})

    # a number of partitions of its own, so that small but costly blocks are not merged into few tasks
    at_once = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = items.repartition(min(blocks, max(at_once, math.ceil(blocks / 16))), "block")
    packed = items.groupBy("block").applyInArrow(run, f"window string, doc_id {kind}, piece long, first_token long, tokens long")
    return whole.unionByName(packed)
