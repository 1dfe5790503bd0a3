"""Structural chunks of source files: one for each top-level declaration, large ones split by what they hold.

The files are scanned by lines (brackets, strings, templates, comments), not parsed, so broken code still yields
chunks; a file in which no declaration is found goes through the text fold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.scan import CLOSER, CONTINUES, indent, language_family, scan
from fathom.functions.text import chunk_id, embedding_text, language_for_path, should_index


@dataclass
class Piece:
    """A chunk before it has an id; lines count from 1."""

    name: str | None
    kind: str | None
    start: int
    end: int
    content: str


_SCRIPT = re.compile(
    r"(?P<export>export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    r"(?P<word>function\*?|class|interface|type|enum|const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)?"
)
_DEFAULT = re.compile(r"export\s+default\s+(?:async\s+)?(?P<word>function\*?|class)\b")
_GO = re.compile(r"(?P<word>func|type)\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>[A-Za-z_]\w*)?")
_PYTHON = re.compile(r"(?:async\s+)?(?P<word>def|class)\s+(?P<name>\w+)")
_KINDS = {"class": "class", "interface": "interface", "type": "type", "enum": "type", "def": "function"}
_FUNCTION_VALUE = re.compile(r"=\s*(?:async\s+)?(?:function\b|(?:<[^>]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)")
_CALL_WITH_FUNCTION = re.compile(r"(?:^|=\s*|await\s+)[\w$.]+(?:<[^>]*>)?\((?:[^()]*,)?\s*(?:async\s+)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)", re.M)
_DATA_VALUE = re.compile(r"=\s*(?:[\[{`]|.*\b(?:as|satisfies)\b)", re.S)
_PART = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[()\[\]{}]|[^"'`/()\[\]{}]+|.""", re.S)
_ASSIGN = re.compile(r"(?<![=!<>])=(?![=>])")
_ARROW = re.compile(r"=\s*(?:async\s+)?(?:function\b|(?:<[^=]*>\s*)?\(\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)")
_HEADER = re.compile(r"import\b|from\s|package\s")
_CALLEE = re.compile(r"([\w$.]+)(?:<[^>]*>)?\(")
_IMPORT = re.compile(r"^\s*(?:import\s+(?:[^'\"\n]*?from\s+)?['\"]([^'\"\n]+)['\"]|(from\s+[\w.]+\s+import\s+[^\n]*|import\s+[\w., ]+)$)", re.M)
_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*(?:\*\s*)?(?P<name>[#\w$]+)\s*(?:<[^>]*>)?\(|(?:async\s+)?def\s+(?P<py>\w+)")


def imports_of(text: str) -> list[str]:
    """The sources of a file's import statements, without quotes."""
    return [(a or b).strip() for a, b in _IMPORT.findall(text)]


def _statements(lines: list[str], language: str, first: int, last: int, level: int | None = None) -> list[tuple[int, int]]:
    """(first, last) lines from 0 of the statements between two lines at one bracket level (that of ``first``, if not given)."""
    family = language_family(language)
    depth, inside, comment, _ = scan(lines, family)
    level = depth[first] if level is None else level
    code = [i for i in range(first, last + 1) if lines[i].strip() and not comment[i] and not inside[i]]
    if not code:
        return []
    pad = min(indent(lines[i]) for i in code)
    starts, decorated = [], False
    for i in code:
        s = lines[i].lstrip()
        flat = depth[i] == level and (indent(lines[i]) == pad or family != "python")
        if flat and not CLOSER.match(s) and not CONTINUES.match(s):
            if not decorated:
                starts.append(i)
            decorated = s.startswith("@")
    out = []
    for a, following in zip(starts, [*starts[1:], last + 1]):
        b = following - 1
        while b > a and (not lines[b].strip() or (comment[b] and indent(lines[b]) <= pad)):
            b -= 1
        out.append((a, b))
    return out


def _value(body: str) -> str:
    """A declaration from its top-level ``=`` on, without comments and what stands in brackets, strings and templates."""
    out, level = [], 0
    for m in _PART.finditer(body):
        x = m.group()
        if x in (")", "]", "}"):
            level -= 1
        if level <= 0 and not x.startswith(("//", "/*")):
            out.append(x[0] + x[-1] if len(x) > 1 and x[0] in "\"'`" else x)
        if x in ("(", "[", "{"):
            level += 1
    flat = "".join(out)
    m = _ASSIGN.search(flat)
    return flat[m.start() :] if m else ""


def _declaration(text: str, language: str) -> tuple[str | None, str, bool] | None:
    """(name, kind, exported) of a top-level statement that makes a chunk, or None."""
    family = language_family(language)
    body = re.sub(r"\A(?:\s*@[^\n]*\n)+", "", text).lstrip()
    if family == "python":
        m = _PYTHON.match(body)
        return (m["name"], _KINDS[m["word"]], False) if m else None
    if family == "go":
        m = _GO.match(body)
        return (m["name"], "method" if m["recv"] is not None else "function" if m["word"] == "func" else "type", False) if m else None
    m = _SCRIPT.match(body)
    if not m:
        m = _DEFAULT.match(body)
        return (None, "class" if m["word"] == "class" else "function", True) if m else None
    word, name, exported = m["word"], m["name"], bool(m["export"])
    if word in ("const", "let", "var"):
        if _FUNCTION_VALUE.search(body.split("\n", 1)[0] if "\n" in body and "=>" in body.split("\n", 1)[0] else body[:400]) or _CALL_WITH_FUNCTION.search(body):
            kind = "function"
        elif exported and _DATA_VALUE.search(body[:400]):
            return name, "constant", exported
        elif _ARROW.match(value := _value(body)):  # the tests above see its beginning only
            kind = "function"
        elif exported and _DATA_VALUE.match(value):
            return name, "constant", exported
        else:
            return None
    else:
        kind = _KINDS.get(word, "function")
    if language == "tsx" and kind == "function" and name and name[0].isupper():
        kind = "component"
    return name, kind, exported


def window_pieces(name: str | None, kind: str | None, lines: list[str], start: int, limit: int) -> list[Piece]:
    """Greedy packing of lines into pieces within ``limit``; a longer line is sliced and keeps its line number."""
    out: list[Piece] = []
    held: list[int] = []
    size = 0

    def add(a: int, b: int, content: str) -> None:
        out.append(Piece(f"{name} (part {len(out) + 1})" if name else None, kind, start + a, start + b, content))

    def flush() -> None:
        nonlocal size
        if held:
            add(held[0], held[-1], "\n".join(lines[i] for i in held))
            held.clear()
        size = 0

    for i, line in enumerate(lines):
        if len(line) > limit:
            flush()
            for j in range(0, len(line), limit):
                add(i, i, line[j : j + limit])
            continue
        if held and size + len(line) + 1 > limit:
            flush()
        size = size + len(line) + 1 if held else len(line)
        held.append(i)
    flush()
    return out


def _body_bounds(lines: list[str], language: str) -> tuple[int, int] | None:
    """Lines of the body of a declaration: after the line that opens it, before the one that closes it."""
    family = language_family(language)
    depth, *_ = scan(lines, family)
    if family == "python":
        head = next((i for i, x in enumerate(lines) if x.split("#")[0].rstrip().endswith(":") and depth[i + 1] == 0 and not x.lstrip().startswith("@")), None)
        return (head + 1, len(lines) - 1) if head is not None and head + 1 < len(lines) else None
    head = next((i for i, x in enumerate(lines) if x.rstrip().endswith(("{", "(")) and depth[i + 1] > 0 and (x.rstrip().endswith("{") or "=>" in x)), None)
    if head is None or head + 1 >= len(lines) - 1:
        return None
    return head + 1, len(lines) - 2


def _split_class(name: str | None, kind: str, lines: list[str], start: int, language: str) -> list[Piece]:
    bounds = _body_bounds(lines, language)
    if not bounds:
        return []
    methods, rest = [], []
    for a, b in _statements(lines, language, *bounds):
        m = _METHOD.match(re.sub(r"\A(?:\s*@[^\n]*\n)+", "", "\n".join(lines[a : b + 1])).lstrip())
        (methods if m and b > a else rest).append((a, b, (m["name"] or m["py"]) if m else None))
    if not methods:
        return []
    head = "\n".join(lines[: bounds[0]])
    fields = ["  " + lines[a].strip() for a, _, _ in rest]
    outline = "\n".join([head, *fields, *[f"  {n}(...)" for _, _, n in methods], *([] if language_family(language) == "python" else ["}"])])
    out = [Piece(name, kind, start, start + len(lines) - 1, outline)]
    for a, b, n in methods:
        out.append(Piece(f"{name}.{n}" if name else n, "method", start + a, start + b, "\n".join(lines[a : b + 1])))
    return out


def _split_function(name: str | None, kind: str, lines: list[str], start: int, language: str, limit: int) -> list[Piece]:
    """An outline, each inner declaration, the remaining statements and the returned markup, so that no line is lost."""
    bounds = _body_bounds(lines, language)
    if not bounds:
        return []
    inner, setup, render = [], [], None
    for a, b in _statements(lines, language, *bounds):
        text = "\n".join(lines[a : b + 1]).strip()
        found = _declaration(text, language)
        if found and found[1] in ("function", "component", "class"):
            inner.append((a, b, found[0]))
        elif _CALL_WITH_FUNCTION.match(text):
            m = _CALLEE.match(text)
            inner.append((a, b, m[1] if m else None))
        elif text.startswith("return") and render is None and b > a:
            render = (a, b)
        else:
            setup.append((a, b))
    if not inner and render is None:
        return []
    head = "\n".join(lines[: bounds[0]])
    outline = [head, *["  " + lines[a].strip() for a, _ in setup], *["  " + lines[a].strip() for a, _, _ in inner], *(["  return ( ... )"] if render else [])]
    if language_family(language) != "python":
        outline.append("}")
    label = name or "default"
    out = [Piece(name, kind, start, start + len(lines) - 1, "\n".join(outline))]
    wide = [(a, b) for a, b in setup if b > a]
    for a, b in wide:
        out.append(Piece(f"{label} (setup)", "method", start + a, start + b, "\n".join(lines[a : b + 1])))
    for a, b, n in inner:
        out.append(Piece(f"{label}.{n or 'inner'}", "method", start + a, start + b, "\n".join(lines[a : b + 1])))
    if render:
        out.append(Piece(f"{label} (render)", kind, start + render[0], start + render[1], "\n".join(lines[render[0] : render[1] + 1])))
    done: list[Piece] = []
    for i, p in enumerate(out):
        parts = window_pieces(p.name, p.kind, p.content.split("\n"), p.start, limit) if len(p.content) > limit else [p]
        if i == 0:  # an outline stands for the whole declaration
            for q in parts:
                q.start, q.end = p.start, p.end
        done += parts
    return done


def _split_literal(name: str | None, lines: list[str], start: int, language: str, limit: int) -> list[Piece]:
    """Elements of a large literal packed into parts within the limit, each under a line with its name and part."""
    if len(lines) < 4:
        return []
    elements = _statements(lines, language, 1, len(lines) - 2)
    if len(elements) < 2:
        return []
    out: list[Piece] = []
    held: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            head = f"{name} [part {len(out) + 1}]"
            out.append(Piece(f"{name} (part {len(out) + 1})", "constant", start + held[0][0], start + held[-1][1], "\n".join([head, *["\n".join(lines[a : b + 1]) for a, b in held]])))
            held.clear()

    size = 0
    for a, b in elements:
        n = sum(len(x) + 1 for x in lines[a : b + 1])
        if held and size + n > limit:
            flush()
            size = 0
        held.append((a, b))
        size += n
    flush()
    return out


def merge_tiny_pieces(pieces: list[Piece], least: int) -> list[Piece]:
    out: list[Piece] = []
    for p in pieces:
        if out and out[-1].name is None and p.name is None and len(out[-1].content) < least and len(p.content) < least:
            last = out[-1]
            out[-1] = Piece(None, last.kind, last.start, p.end, last.content + "\n\n" + p.content)
        else:
            out.append(p)
    return out


def fold_pieces(lines: list[str], limit: int) -> list[Piece]:
    """The text fold (see ``fathom.operators.chunking.fold_text``) over lines."""
    out, buf, start, size = [], [], 1, -1

    def emit(end: int) -> None:
        content = "\n".join(buf).strip(" \t\n\x0b\f\r\xa0﻿")
        if content and len(content) > int(limit * 1.2):
            out.extend(window_pieces(None, "file", content.split("\n"), start, limit))
        elif content:
            out.append(Piece(None, "file", start, end, content))

    for i, line in enumerate(lines):
        buf.append(line)
        size += 1 + len(line)
        if size >= limit and (not line.strip() or size >= int(limit * 1.2)):
            emit(i + 1)
            buf, start, size = [], i + 2, -1
    if buf:
        emit(len(lines))
    return out


def code_pieces(text: str, language: str | None, limit: int = 3000, least: int = 120) -> list[Piece]:
    """The chunks of one file. Beside declarations, other statements go through the text fold, but for imports and short lines."""
    lines = text.split("\n")
    out: list[Piece] = []
    declared = False
    if language:
        for a, b in _statements(lines, language, 0, len(lines) - 1, 0):
            body = lines[a : b + 1]
            content = "\n".join(body)
            found = _declaration(content, language)
            if not found:
                if (b > a or len(content) >= least) and not _HEADER.match(content):
                    out += [Piece(p.name, p.kind, a + p.start, a + p.end, p.content) for p in fold_pieces(body, limit)]
                continue
            declared = True
            name, kind, _ = found
            pieces: list[Piece] = []
            if len(content) > limit:
                if kind == "constant":
                    pieces = _split_literal(name, body, a + 1, language, limit)
                elif kind == "class":
                    pieces = _split_class(name, kind, body, a + 1, language)
                elif kind in ("function", "component", "method"):
                    pieces = _split_function(name, kind, body, a + 1, language, limit)
                pieces = pieces or window_pieces(name, kind, body, a + 1, limit)
            out += pieces or [Piece(name, kind, a + 1, b + 1, content)]
    return merge_tiny_pieces(out if declared else fold_pieces(lines, limit), least)


def chunk_files(files: DataFrame, git_sha: str = "", model: str = "none", dim: int = 0, limit: int = 3000, least: int = 120, include_unparsable: bool = False) -> DataFrame:
    """Chunks (CHUNK_SCHEMA) of files (repo, path, text): ignored paths and null texts give none."""
    rows = files.where(should_index(F.col("path"), include_unparsable) & F.col("text").isNotNull()).select("repo", "path", "text", language_for_path(F.col("path")).alias("language"))

    schema = "repo string, path string, language string, symbol_name string, symbol_kind string, start_line int, end_line int, content string, imports array<string>"
    text, number = pa.string(), pa.int32()
    kinds = [text, text, text, text, text, number, number, text, pa.list_(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                language = row["language"]
                uses = imports_of(row["text"]) if language else []
                for p in code_pieces(row["text"], language, limit, least):
                    out.append((row["repo"], row["path"], language or "text", p.name, p.kind, p.start, p.end, p.content, uses))
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])

    pieces = rows.mapInArrow(run, schema)
    c = F.col
    return pieces.select(
        chunk_id(c("repo"), c("path"), c("start_line"), c("content")).alias("id"), "repo", "path", "language", "symbol_name", "symbol_kind", "start_line", "end_line", "content",
        embedding_text(c("path"), c("symbol_name"), c("symbol_kind"), c("imports"), c("content")).alias("embedding_text"), "imports",
        F.lit(git_sha).alias("git_sha"), F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dim"),
    )
