"""Text chunking as folds over lines; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import chunk_id, embedding_text

_BLANKS = "[ \\t\\n\\u000B\\f\\r\\u00A0\\uFEFF]"


def trimmed(text: Column) -> Column:
    """``text`` without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"^{_BLANKS}+|{_BLANKS}+$", "")


def fold_ranges(lines: Column, limit: int) -> Column:
    """Line ranges (from 1) of a text: a range closes where it has ``limit`` characters at a blank line, or 1.2 times that anywhere.

    One pass with a state of three numbers; line breaks count as one character.
    """
    ranges = "array<struct<s:int,e:int>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("s"), F.lit(-1).cast("long").alias("size"), F.array().cast(ranges).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        size = acc["size"] + 1 + F.length(line)
        i = acc["i"] + 1
        close = (size >= limit) & ((trimmed(line) == "") | (size >= int(limit * 1.2)))
        return F.struct(
            i.alias("i"),
            F.when(close, i + 1).otherwise(acc["s"]).alias("s"),
            F.when(close, F.lit(-1).cast("long")).otherwise(size).cast("long").alias("size"),
            F.when(close, F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), i.alias("e"))))).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["s"] <= acc["i"], F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["i"].alias("e"))))).otherwise(acc["done"])

    return F.aggregate(lines, start, step, finish)


def window_ranges(lines: Column, limit: int) -> Column:
    """(first line, last line, slice) from 0: greedy packing of lines into pieces of at most ``limit`` characters.

    A longer line is cut into slices of ``limit`` (``slice`` >= 0, at its own line); other pieces have slice -1.
    """
    kind = "array<struct<a:int,b:int,c:int>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).cast("long").alias("size"), F.array().cast(kind).alias("done"))

    def piece(a: Column, b: Column, c: Column) -> Column:
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))

    def step(acc: Column, line: Column) -> Column:
        n = F.length(line)
        long = n > limit
        held = acc["s"] < acc["i"]
        flush = held & (long | (acc["size"] + n + 1 > limit))
        done = F.when(flush, F.concat(acc["done"], F.array(piece(acc["s"], acc["i"] - 1, F.lit(-1))))).otherwise(acc["done"])
        slices = F.transform(F.sequence(F.lit(0), F.ceil(n / limit).cast("int") - 1), lambda j: piece(acc["i"], acc["i"], j))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(long, acc["i"] + 1).when(flush, acc["i"]).otherwise(acc["s"]).alias("s"),
            F.when(long, F.lit(0)).when(flush | ~held, n).otherwise(acc["size"] + n + 1).cast("long").alias("size"),
            F.when(long, F.concat(done, slices)).otherwise(done).alias("done"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["s"] < acc["i"], F.concat(acc["done"], F.array(piece(acc["s"], acc["i"] - 1, F.lit(-1))))).otherwise(acc["done"])

    return F.aggregate(lines, start, step, finish)


def window_split(df: DataFrame, limit: int, text: str = "text", first_line: str | None = None) -> DataFrame:
    """Rows of ``df`` times their pieces: (part from 1, piece_start, piece_end, piece); lines count from ``first_line`` or 1."""
    base = F.col(first_line) if first_line else F.lit(1)
    rows = df.withColumn("_lines", F.split(F.col(text), "\n", -1))
    rows = rows.select("*", F.posexplode(window_ranges(F.col("_lines"), limit)).alias("_p", "_r"))
    whole = F.array_join(F.slice("_lines", F.col("_r.a") + 1, F.col("_r.b") - F.col("_r.a") + 1), "\n")
    cut = F.substr(F.element_at("_lines", F.col("_r.a") + 1), F.col("_r.c") * limit + 1, F.lit(limit))
    return rows.select(
        *df.columns, (F.col("_p") + 1).alias("part"), (base + F.col("_r.a")).cast("int").alias("piece_start"), (base + F.col("_r.b")).cast("int").alias("piece_end"),
        F.when(F.col("_r.c") >= 0, cut).otherwise(whole).alias("piece"),
    )


def fold_text(df: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """Rows of ``df`` times their text chunks: (start_line, end_line, content), trimmed, empty ones dropped, oversized ones window-split."""
    rows = df.where(F.col(text).isNotNull()).withColumn("_lines", F.split(F.col(text), "\n", -1))
    rows = rows.select("*", F.explode(fold_ranges(F.col("_lines"), limit)).alias("_r"))
    content = trimmed(F.array_join(F.slice("_lines", F.col("_r.s"), F.col("_r.e") - F.col("_r.s") + 1), "\n"))
    rows = rows.select(*df.columns, F.col("_r.s").alias("_s"), F.col("_r.e").alias("_e"), content.alias("_c")).where("_c != ''")
    big = F.length("_c") > int(limit * 1.2)
    # a chunk that fits is its own only window, so one pass serves both
    lines = F.split(F.col("_c"), "\n", -1)
    one = F.array(F.struct(F.lit(0).alias("a"), (F.size(lines) - 1).cast("int").alias("b"), F.lit(-1).alias("c")))
    pieces = rows.withColumn("_lines", lines).select("*", F.explode(F.when(big, window_ranges(F.col("_lines"), limit)).otherwise(one)).alias("_w"))
    whole = F.array_join(F.slice("_lines", F.col("_w.a") + 1, F.col("_w.b") - F.col("_w.a") + 1), "\n")
    cut = F.substr(F.element_at("_lines", F.col("_w.a") + 1), F.col("_w.c") * limit + 1, F.lit(limit))
    return pieces.select(
        *df.columns,
        F.when(big, F.col("_s") + F.col("_w.a")).otherwise(F.col("_s")).cast("int").alias("start_line"),
        F.when(big, F.col("_s") + F.col("_w.b")).otherwise(F.col("_e")).cast("int").alias("end_line"),
        F.when(F.col("_w.c") >= 0, cut).otherwise(whole).alias("content"),
    )


def merge_tiny(pieces: Column, least: int = 120) -> Column:
    """Left fold over array<struct<name,start,end,content>>: a piece joins the one before when both are unnamed and shorter than ``least``.

    The merged length counts from then on; contents are joined by a blank line.
    """

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        join = (F.size(acc) > 0) & last["name"].isNull() & p["name"].isNull() & (F.length(last["content"]) < least) & (F.length(p["content"]) < least)
        merged = F.struct(last["name"].alias("name"), last["start"].alias("start"), p["end"].alias("end"), F.concat(last["content"], F.lit("\n\n"), p["content"]).alias("content"))
        return F.when(join, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(pieces, F.array().cast("array<struct<name:string,start:int,end:int,content:string>>"), lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(step(a, p)))


def text_chunks(files: DataFrame, limit: int = 3000) -> DataFrame:
    """Chunks (repo, path, start_line, end_line, content, id, embedding_text) of files (repo, path, text)."""
    out = fold_text(files.select("repo", "path", "text"), limit).drop("text")
    none = F.lit(None).cast("string")
    return out.withColumns({
        "id": chunk_id(F.col("repo"), F.col("path"), F.col("start_line"), F.col("content")),
        "embedding_text": embedding_text(F.col("path"), none, none, F.array().cast("array<string>"), F.col("content")),
    })
