"""Splitting oversized source chunks between the units of their kind.

Method. A scanner marks the lines on which a unit may begin (a boundary): the members of a class, the statements of
a function, the elements of a literal, the top-level declarations of a file. Every boundary is joined to its
farthest legal successor, the first unit that no longer fits in a piece begun at the boundary. The successor
tables of all texts of a batch form one array; squaring it (``nxt = nxt[nxt]``) doubles the reach, and the cuts
reached so far are carried along, so all greedy cuts of all texts come out in log2(units) rounds without walking
any text.

A piece repeats whole lines of the piece before it, at most ``overlap`` characters and never beyond ``size_limit``;
the repeated lines do not move a cut. A unit longer than the limit is never cut and makes a piece of its own. With
``cut_units`` one longer than ``size_limit`` is cut at its line ends, and a line longer than ``limit`` into slices, which
repeat characters instead of lines; then every piece is within ``size_limit``.

Defined cases: rows with null id, content or start line are left out; a text within ``size_limit`` stays whole and is no
row, nor is one of one line unless ``cut_units`` slices it; CRLF line ends count as they are; an id delivered
several times comes out once; a text whose brackets do not balance is split by indentation alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.scan import CLOSER, CONTINUES, indent, language_family, scan

_MEMBERS, _STATEMENTS, _ELEMENTS, _TOP = "members", "statements", "elements", "top"
_UNITS = {
    "class": _MEMBERS, "interface": _MEMBERS, "type": _MEMBERS, "function": _STATEMENTS, "method": _STATEMENTS,
    "component": _STATEMENTS, "constant": _ELEMENTS, "file": _TOP,
}
def unit_lines(text: str, kind: str | None, language: str | None) -> tuple[list[int], list[int]]:
    """The first and last line (from 0) of each unit, its comment lines included.

    The opening line belongs to the first unit, the closing line to the last. Blank lines between units and
    comments that stand by themselves belong to none.
    """
    lines = text.split("\n")
    language = language_family(language)
    units = _UNITS.get((kind or "file").lower(), _TOP)
    depth, inside, comment, low = scan(lines, language)
    code = [i for i, x in enumerate(lines) if x.strip() and not comment[i] and not inside[i]]
    whole = [0], [max([i for i, x in enumerate(lines) if x.strip()], default=0)]
    if not code:
        return whole
    python = language == "python"
    balanced = depth[-1] == 0 and min(depth) >= 0
    body = 0
    if units != _TOP:
        # the opening line ends where the body's indentation begins
        head = next((i for i in code if not lines[i].lstrip().startswith("@")), code[0])
        if python and units != _ELEMENTS:
            while head < len(lines) - 1 and (depth[head + 1] > depth[code[0]] or not lines[head].split("#")[0].rstrip().endswith(":")):
                head += 1
        elif depth[head + 1] <= depth[head]:
            opened = next((i for i in code if depth[i + 1] > depth[head]), None)
            if opened is None:
                return whole
            head = opened
        else:
            # a parameter list over several lines closes before the body opens
            base = depth[head]
            while (close := next((i for i in code if i > head and low[i] <= base), None)) is not None and depth[close + 1] > base:
                head = close
        body = head + 1
    inner = [i for i in code if i >= body]
    if not inner:
        return whole
    if units == _TOP or (python and units != _ELEMENTS):
        level = 0 if units != _TOP or balanced else None
        pad = min(indent(lines[i]) for i in inner)
    else:
        level = depth[body] if balanced or depth[body] > 0 else None
        pad = indent(lines[inner[0]])
    starts = []
    previous = None
    for i in inner:
        s = lines[i].lstrip()
        free = level is None or depth[i] == level
        at = indent(lines[i]) == pad if python or level is None else indent(lines[i]) <= pad or depth[i] == level
        begins = free and at and not CLOSER.match(s) and not CONTINUES.match(s)
        if begins and units == _ELEMENTS and previous is not None and not (language == "go" and "(" in lines[body - 1] and "{" not in lines[body - 1]):
            begins = _bare(lines[previous]).endswith((",", ";"))
        if begins and previous is not None and (lines[previous].lstrip().startswith("@") and indent(lines[previous]) == pad and previous in starts):
            begins = False  # a decorator belongs to what it decorates
        if begins:
            starts.append(i)
        previous = i
    out = []
    for i in starts:
        # where indentation makes blocks, a comment set deeper ends the block above and does not belong to the unit below
        reach = indent(lines[i]) if python else math.inf
        while i > body and comment[i - 1] and lines[i - 1].strip() and indent(lines[i - 1]) <= reach:
            i -= 1
        out.append(i)
    if not out:
        return whole
    out[0] = 0
    out = sorted(set(out))
    last = []
    for start, following in zip(out, [*out[1:], len(lines)]):
        end = following - 1
        while end > start and (not lines[end].strip() or (following < len(lines) and comment[end] and indent(lines[end]) <= pad + 1)):
            end -= 1
        last.append(end)
    return out, last


def _bare(line: str) -> str:
    """The line without a trailing comment."""
    return re.sub(r"\s*(?://[^\"'`]*|#[^\"'`]*)?\r?$", "", line)


def greedy_cuts(units: list[tuple[np.ndarray, np.ndarray]], limit: int) -> list[np.ndarray]:
    """For each text, given the (first, last+1) offsets of its units, the units that begin a piece after the first.

    One successor table over the units of all texts; each text ends in a fixed point of its own.
    """
    if not units:
        return []
    nxt, marked, offsets = [], [], [0]
    for first, end in units:
        n, base = len(first), offsets[-1]
        far = np.searchsorted(end, first + limit, side="right")  # the first unit that no longer fits
        nxt.append(base + np.append(np.maximum(far, np.arange(n) + 1), n))
        m = np.zeros(n + 1, bool)
        m[0] = True
        marked.append(m)
        offsets.append(base + n + 1)
    table, mark = np.concatenate(nxt), np.concatenate(marked)
    while True:
        reached = mark.copy()
        reached[table[mark]] = True
        squared = table[table]
        if (reached == mark).all() and (squared == table).all():
            break
        table, mark = squared, reached
    return [np.flatnonzero(mark[a + 1 : b - 1]) + 1 for a, b in zip(offsets, offsets[1:])]


def _atoms(lines: list[str], at: np.ndarray, ends: np.ndarray, starts, last, limit: int, size_limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(first character, end, first line, last line) of each unit, or of the lines and slices of one that exceeds ``size_limit``."""
    for a, z in zip(starts, last):
        if ends[z] - at[a] <= size_limit:
            yield at[a], ends[z], a, z
            continue
        for i in range(a, z + 1):
            if ends[i] - at[i] <= limit:
                if i == a or lines[i].strip():
                    yield at[i], ends[i], i, i
            else:
                step = limit - overlap
                for o in range(at[i], ends[i], step):
                    yield o, min(o + step, ends[i]), i, i


def _split_batch(rows: list[dict], limit: int, overlap: int, size_limit: int, cut_units: bool) -> Iterator[tuple]:
    prepared, spans = [], []
    for row in rows:
        lines = row["text"].split("\n")
        at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
        ends = np.array([at[i] + len(x.rstrip("\r")) for i, x in enumerate(lines)])
        starts, last = unit_lines(row["text"], row["kind"], row["language"])
        atoms = np.array(list(_atoms(lines, at, ends, starts, last, limit, size_limit if cut_units else 1 << 62, overlap)))
        prepared.append((row, lines, at, ends, atoms))
        spans.append((atoms[:, 0], atoms[:, 1]))
    for (row, lines, at, ends, atoms), cuts in zip(prepared, greedy_cuts(spans, limit)):
        begin = np.concatenate([[0], cuts])
        until = np.append(cuts, len(atoms)) - 1
        for p, (b, e) in enumerate(zip(begin, until)):
            start, first = int(atoms[b, 0]), int(atoms[b, 2])
            end, final = (int(atoms[e, 1]), int(atoms[e, 3])) if p < len(cuts) else (int(ends[-1]), len(lines) - 1)
            if p == len(cuts) and cut_units and end - start > size_limit:
                end, final = int(atoms[e, 1]), int(atoms[e, 3])  # blank lines at the end do not make a piece too long
            lead, before = first, int(atoms[begin[p - 1], 0]) if p else start
            text_start = start
            if start > at[first]:  # within a line
                text_start = max(start - min(overlap, size_limit - (end - start)), before)
            else:
                while p and lead > 0 and at[lead - 1] > before and start - at[lead - 1] <= overlap and end - at[lead - 1] <= size_limit:
                    lead -= 1
                text_start = int(at[lead])
            yield row["id"], p, row["start_line"] + first, row["start_line"] + final, row["start_line"] + lead, row["text"][text_start:end]


def split_chunks(df: DataFrame, size_limit: int = 3000, limit: int = 2800, overlap: int = 200, cut_units: bool = False,
                 id_col="id", text_col="content", start_col="start_line", kind_col="symbol_kind", language_col="language") -> DataFrame:
    """(id, piece, start_line, end_line, text_start_line, text) of every chunk longer than ``size_limit``.

    ``start_line`` and ``end_line`` are the file lines of the piece's own units, ``text_start_line`` that of its
    first repeated line. The size is tested in the JVM, so only oversized texts reach Python.
    """
    rows = df.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(start_col).cast("long").alias("start_line"),
        F.col(kind_col).cast("string").alias("kind"), F.col(language_col).cast("string").alias("language"),
    ).where((F.length("text") > size_limit) & F.col("id").isNotNull() & F.col("start_line").isNotNull())
    rows = (rows if cut_units else rows.where(F.col("text").contains("\n"))).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(zip(*_split_batch(batch.to_pylist(), limit, overlap, size_limit, cut_units))) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["id", "piece", "start_line", "end_line", "text_start_line", "text"])

    return rows.mapInArrow(run, "id string, piece long, start_line long, end_line long, text_start_line long, text string")
