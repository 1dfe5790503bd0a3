"""Column functions over paths, queries and text; all run in the JVM."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and files that an index leaves out, and the suffixes of the languages with a grammar.
IGNORE_DIRS = ("node_modules", ".git", ".next", "dist", "build", "out", "coverage", ".turbo", ".vercel", "__snapshots__", ".pnpm-store")
IGNORE_FILES = (
    r"\.min\.(js|css)$", r"-lock\.(json|yaml)$", r"\.lock$", r"\.d\.ts$",
    r"(?i)\.(png|jpe?g|gif|webp|svg|ico|wav|mp3|mp4|woff2?|ttf|eot|pdf|zip|gz)$",
)
LANGUAGE_SUFFIXES = {
    "tsx": (".tsx", ".jsx"), "typescript": (".ts", ".mts", ".cts"), "javascript": (".js", ".mjs", ".cjs"), "python": (".py",), "go": (".go",),
}
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįıłñńňòóôõöøōőŕřśšşťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiiilnnnoooooooorrssstuuuuuuuyyzzz"
# What counts as quoted code, and what of it is a mere name.
FENCED = r"```[a-z]*\n([\s\S]*?)```"
FENCE = r"```[\s\S]*?```"
INLINE = r"`([^`\n]+)`"
BARE_NAME = "^[A-Za-z_$][A-Za-z0-9_$]*$"
#: White space as scripts mean it, no-break and other Unicode spaces included.
SPACES = "[ \\t\\n\\u000B\\f\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def language_for_path(path: Column) -> Column:
    """The language of a file by its suffix (case-sensitive), or null."""
    out = None
    for language, suffixes in LANGUAGE_SUFFIXES.items():
        hit = path.endswith(suffixes[0])
        for s in suffixes[1:]:
            hit = hit | path.endswith(s)
        out = F.when(hit, language) if out is None else out.when(hit, language)
    return out


def should_index(path: Column, include_unparsable: bool = False) -> Column:
    """Whether a walk keeps the file: no ignored directory, no ignored name, and a known language unless all are wanted."""
    keep = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORE_DIRS)))
    for pattern in IGNORE_FILES:
        keep = keep & ~path.rlike(pattern)
    return keep if include_unparsable else keep & language_for_path(path).isNotNull()


def normalize_path_prefix(prefix: Column, root: str) -> Column:
    """A path filter relative to the repository: forward slashes, no root, no leading ``./`` or ``/``; the root gives ""."""
    base = root.replace("\\", "/").rstrip("/")
    p = F.translate(F.trim(prefix), "\\", "/")
    p = F.when(p == base, "").when(p.startswith(base + "/"), F.substr(p, F.lit(len(base) + 2))).otherwise(p)
    return F.regexp_replace(F.regexp_replace(p, r"^(?:\./)+", ""), r"^/+", "")


def clamp_k(value: Column, fallback: int, most: int) -> Column:
    """A result count from an untrusted number: not a number or infinite gives the fallback, null counts as 0, else truncated into [1, most]."""
    v = F.coalesce(value.try_cast("double"), F.when(value.isNull(), F.lit(0.0)))
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.greatest(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), whole.cast("long")))).otherwise(F.lit(fallback).cast("long"))


def fold(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Index tokens: maximal runs of letters and digits of the folded text, in order."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


_FOLD = str.maketrans(ACCENTED, PLAIN)
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+")


def plain_tokens(text: str) -> list[str]:
    """What ``tokens`` gives, for code that has the text in Python."""
    low = text.lower()
    return _ASCII_TOKEN.findall(low) if low.isascii() else _TOKEN.findall(low.translate(_FOLD))


def query_terms(query: Column) -> Column:
    """Query terms: runs of ASCII letters, digits and underscores longer than one; repeats stay and count again."""
    return F.filter(F.split(query, "[^A-Za-z0-9_]+"), lambda t: F.length(t) > 1)


def phrase(term: Column) -> Column:
    """The index tokens of a query term: an underscore separates, so ``a_b`` is the phrase of a and b."""
    return F.filter(F.split(F.lower(term), "_+"), lambda t: t != "")


def normalise(text: Column) -> Column:
    """Text for literal comparison: straight quotes, white space runs as one space, trimmed."""
    straight = F.translate(text, "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(straight, SPACES + "+", " "))


def extract_quotes(text: Column) -> Column:
    """The quoted code of a claim: bodies of fenced blocks, then inline backtick spans, normalised.

    Bare identifiers and empty spans are left out. A fence with another tag than lower-case letters is removed
    without being extracted; an inline span ends with its line.
    """
    fenced = F.regexp_extract_all(text, F.lit(FENCED), F.lit(1))
    rest = F.regexp_replace(text, FENCE, " ")
    inline = F.regexp_extract_all(rest, F.lit(INLINE), F.lit(1))
    quotes = F.transform(F.concat(fenced, inline), normalise)
    return F.filter(quotes, lambda q: (q != "") & ~q.rlike(BARE_NAME))


def embedding_text(path: Column, name: Column, kind: Column, imports: Column, content: Column) -> Column:
    """What is embedded for a chunk: file, symbol, the first twelve imports, a rule, the content."""
    symbol = F.when(name.isNotNull() & (name != ""), F.concat(F.lit("Symbol: "), name, F.lit(" ("), F.coalesce(kind, F.lit("unknown")), F.lit(")")))
    uses = F.when(F.size(imports) > 0, F.concat(F.lit("Imports: "), F.array_join(F.slice(imports, 1, 12), ", ")))
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), symbol, uses, F.lit("---"), content)


def chunk_id(repo: Column, path: Column, start_line: Column, content: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of repository, path, start line and content, parted by NUL."""
    nul = F.char(F.lit(0))
    return F.substring(F.sha2(F.concat(repo, nul, path, nul, start_line.cast("string"), nul, content), 256), 1, 16)


def content_hash(source: Column) -> Column:
    return F.substring(F.sha2(source, 256), 1, 16)


def matches(repo: str = "", path_prefix: str = "", language: str = "", symbol_kind: str = "") -> Column:
    """The predicate of a retrieval filter; an empty field filters nothing, the prefix is case-sensitive."""
    out = F.lit(True)
    if repo:
        out = out & (F.col("repo") == repo)
    if path_prefix:
        out = out & F.col("path").startswith(path_prefix)
    if language:
        out = out & (F.col("language") == language)
    if symbol_kind:
        out = out & (F.col("symbol_kind") == symbol_kind)
    return out
