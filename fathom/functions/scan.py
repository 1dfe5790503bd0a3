"""A line scanner for source code: bracket depth, strings, templates and comments of several languages."""

from __future__ import annotations

import re

# Names of languages that are not scanned as brace languages.
_FAMILIES = {"py": "python", "python": "python", "go": "go", "golang": "go"}
CLOSER = re.compile(r"[)\]}>]|</|(?:else|catch|finally|elif|except)\b")
CONTINUES = re.compile(r"(?:\.\w|\?[^.]|:\s|&&|\|\||[-+*/%=<>|&^]\s|=>)")
_REGEX_BEFORE = re.compile(r"(?:^|[=(,:;!&|?{}\[]|\breturn|\bcase|=>)\s*$")


def scan(lines: list[str], language: str) -> tuple[list[int], list[bool], list[bool], list[int]]:
    """Bracket depth at the start of each line, whether the line starts inside a string or comment, whether it is a comment line, and the lowest depth on it."""
    depth, inside, comment, low = [], [], [], []
    level = 0
    stack: list[int] = []  # levels at which a template's ${ } began
    state = ""  # "", "block", "template", '"""', "'''"
    python, go = language == "python", language == "go"
    for line in lines:
        depth.append(level)
        low.append(level)
        inside.append(state != "")
        s = line.strip()
        comment.append(state == "block" or (state == "" and (s.startswith("#") if python else s.startswith(("//", "/*")))))
        i, n = 0, len(line)
        while i < n:
            c = line[i]
            if state == "block":
                j = line.find("*/", i)
                if j < 0:
                    break
                state, i = "", j + 2
                continue
            if state in ('"""', "'''"):
                j = line.find(state, i)
                if j < 0:
                    break
                state, i = "", j + 3
                continue
            if state == "template":
                if c == "\\" and not go:
                    i += 2
                    continue
                if c == "`":
                    state = ""
                elif c == "$" and not go and line.startswith("${", i):
                    stack.append(level)
                    level += 1
                    state = ""
                    i += 1
                i += 1
                continue
            if python and c == "#":
                break
            if not python and c == "/" and i + 1 < n:
                if line[i + 1] == "/":
                    break
                if line[i + 1] == "*":
                    state, i = "block", i + 2
                    continue
                if not go and _REGEX_BEFORE.search(line, 0, i):
                    m = re.compile(r"/(?:[^/\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])+/").match(line, i)
                    if m:
                        i = m.end()
                        continue
            if c in "\"'":
                if python and line.startswith(c * 3, i):
                    state, i = c * 3, i + 3
                    continue
                j = i + 1
                while j < n and line[j] != c:
                    j += 2 if line[j] == "\\" else 1
                # an unclosed quote is an apostrophe in markup text
                i = j + 1 if j < n else i + 1
                continue
            if c == "`" and not python:
                state = "template"
            elif c in "([{":
                level += 1
            elif c in ")]}":
                level -= 1
                low[-1] = min(low[-1], level)
                if stack and c == "}" and level == stack[-1]:
                    stack.pop()
                    state = "template"
            i += 1
    depth.append(level)
    return depth, inside, comment, low


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def language_family(language: str | None) -> str:
    """``python``, ``go`` or ``braces``."""
    return _FAMILIES.get((language or "").lower(), "braces")
