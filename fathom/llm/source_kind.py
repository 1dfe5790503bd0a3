"""Generated, compacted, vendored and data files among stored source chunks.

Method. One pass gives each chunk what its path, the notices in its leading comments and its token composition show,
and the hashes of its significant lines. The lines of the chunks of all repositories make an inverted index. A line
of at most ``rare`` chunks is rare; rare lines lead every chunk, known to be foreign or not, to the foreign files (by
path or notice) that may hold it, and the exact containment is the share of its significant lines that one such file
has (common lines lead to two files only, and see below). A chunk of which ``containment`` or more stands in a foreign file is a copy of it, edited or not. A file without
evidence of its own is found in this way alone; for the others it tells which are copies across repositories. What
no foreign file holds is left to the rules of composition: templates filled in by a program, compacted code, data.

Containment alone does not show which side is foreign: people of one company copy code between repositories too. So
a group of copies in which no member has a notice or a tell-tale path stays.

Scale. Only line hashes are shuffled. Chunks with the same lines are one class and foreign files with the same lines
one file, a line is one row of the index, and only rare lines are expanded to files. Lines that are not rare (a library
with many variants) are counted in each variant, the files with the same such lines, for the chunks which hold enough of them.
A file's lines are bounded by the file.

Defined cases: rows without repo or path are left out; null or empty content leaves the path rules; repeated rows
count once; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialize, scratch

GENERATED, COMPACTED, VENDORED, DATA = "generated", "compacted", "vendored", "data"

_VENDOR_DIRS = frozenset("vendor third_party third-party thirdparty extern external externals deps node_modules bower_components site-packages jspm_packages".split())
_GENERATED_DIRS = frozenset("gen generated __generated__ autogen autogenerated".split())
_PATH_GENERATED = re.compile(r"(?:\.(?:gen|generated|g|pb|pb\.gw|designer)\.\w+|_pb2(?:_grpc)?\.pyi?|[._](?:gen|generated|string_gen)\.\w+|/zz_generated\.[\w.]+)$")
_PATH_COMPACTED = re.compile(r"(?:[.-](?:min|bundle|prod|umd\.min)\.(?:js|mjs|cjs|css)|[.-](?=[0-9a-f]*\d)[0-9a-f]{6,20}\.(?:js|mjs|css))$")
_VERSIONED_DIR = re.compile(r"/[a-z][\w.]*(?:-[a-z]\w*)*[-@]v?\d+\.\d+\.\d+[\w.+-]*/")

_NOTICE_GENERATED = re.compile(
    r"""^\W*(?:
      Code\ generated\b.*\bDO\ NOT\ EDIT
    | (?:@|This\ (?:file|code)\ (?:was|is|has\ been)\ )(?:auto(?:matically|-)?\ ?)?generated\b(?:\ by|\ from|;|,|\.|$)
    | AUTO-?\ ?GENERATED\b
    | [Aa]uto(?:matically)?[- ](?:built|created|generated)\b.*\b[Dd]o(?:\ not|n't)\ (?:touch|edit|modify)
    | source:\ \S+\.\w+\ +tool:\ .*\bchecksum\ [0-9a-f]+
    | Diese\ Datei\ wurde\ automatisch\ (?:erzeugt|generiert)
    | (?:Ce\ )?[Ff]ichier\ (?:produit|g[eé]n[eé]r[eé])\ (?:par|automatiquement)\b
    | (?:Este\ )?[Aa]rchivo\ generado\ (?:por|autom)
    | Generated\ by\ .*\b(?:do\ not|don't)\ (?:edit|touch|modify)
    | <auto-generated
    )""",
    re.X,
)
_LICENCE = r"(?:MIT|ISC|BSD(?:-\d-Clause)?|Apache(?:-\d\.\d|\ License)?|[AL]?GPL[\w.+-]*|MPL-\d\.\d|Unlicense|Zlib)"
_NOTICE_VENDORED = re.compile(
    rf"""^\W*(?:
      @licen[sc]e\b
    | @preserve\b
    | SPDX-License-Identifier:
    | [\w.@/-]+\ v?\d+\.\d+[\w.]*\ \|\ (?:\(c\)|©)
    | Copyright\ (?:\(c\)|©)?\ ?[\d, -]+\ .*\b(?:Authors|Contributors|contributors|Foundation)\b
    | .*\bgoverned\ by\ (?:the|a)\ {_LICENCE}[\w -]*\ license
    | [\w.@/-]+\ .*\bcopied\ from\ upstream\b
    | Taken\ from\ [\w.@/-]+[=@ ]=?v?\d
    | [\w.@/-]+\ v?\d+\.\d+[\w.]*\ --?\ {_LICENCE}\ licen[sc]ed\b
    )""",
    re.X,
)

# A line as token classes: identifiers and dotted names are one class, numbers and strings another, marks stay.
_TOKEN = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
_COMMENT = re.compile(r"[ \t]*(?://|#|\*|/\*|--|<!--)")
_REMARK = re.compile(r"[ \t]+(?://|#)[^\"'`]*$|/\*[^*]*\*/")
_WIDTH = re.compile(r"(?:u?int|float|complex)\d+$")
_MODIFIERS = frozenset("*&?[]!")
_ALIKE = re.compile(r"((?:a:)?[a0\"],?;?)(?:\1)+")
_WORDS = re.compile(r"[A-Za-z_$][\w$]*")
_BLOB = re.compile(r"(?:[A-Za-z0-9+/=_-]|\\n){120,}|(?:^[A-Za-z0-9+/=]{40,}\r?$\n?)+", re.M)
_NUMBERS = re.compile(r"(?:[-+]?(?:0x[0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)\s*,\s*){6,}")
_RECORDS = re.compile(r"""[(=]\s*[`'"]\s*[\[{]\s*(?:\{\s*)?\\?".*""", re.S)
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_LINE = re.compile(r"[^\n]+")
_SIGNIFICANT = re.compile(r"[A-Za-z]{3}")


def path_kind(path: str) -> str | None:
    """What the path alone shows, or None."""
    dirs = set(path.split("/")[:-1])
    if dirs & _GENERATED_DIRS or _PATH_GENERATED.search(path):
        return GENERATED
    if dirs & _VENDOR_DIRS or _VERSIONED_DIR.search("/" + path):
        return VENDORED
    if _PATH_COMPACTED.search(path):
        return COMPACTED
    return None


def _leading_comments(text: str) -> list[str]:
    out = []
    block = False
    for m in _LINE.finditer(text):
        s = m.group().strip()
        if not s:
            continue
        if block:
            out.append(s)
            block = "*/" not in s
        elif s.startswith("/*"):
            out.append(s)
            block = "*/" not in s
        elif s.startswith(("//", "#", "<!--", "--")):
            out.append(s)
        else:
            break
    return out


def _shape(line: str) -> tuple[str, list[str], set[str], bool, bool]:
    """(token classes, identifiers, numbers at the end of names, whether a plain integer stands in the line, whether a
    number with a point, a separator or a unit does) of a line of code."""
    out: list[str] = []
    names = []
    numbered: set[str] = set()
    plain = measured = False
    for t in _TOKEN.findall(line):
        c = t[0]
        if c in "\"'`":
            out.append('"')
            plain = plain or (c == "`" and any(map(str.isdigit, t)))
        elif c.isdigit():
            out.append("0")
            if t.isdigit():
                plain = True
            else:
                measured = True
        elif c.isalpha() or c in "_$":
            if not out or out[-1] != "a":
                out.append("a")
            names.append(t)
            if t[-1].isdigit() and len(t) > 3 and not _WIDTH.match(t):
                numbered.add(t[len(t.rstrip("0123456789")) :])
        elif c not in _MODIFIERS and not (c == "." and out and out[-1] == "a"):
            out.append(c)
    return _ALIKE.sub(r"\1", "".join(out)), names, numbered, plain, measured


def template_share(text: str, period: int = 6, least_records: int = 4) -> float:
    """How far the code of ``text`` is one template filled in again and again, from 0 to 1.

    The lines are read as records of 1 to ``period`` lines. The result is the least of three shares, for the best
    period: lines whose token classes recur one period on, records that carry a tag (one number at the end of names,
    or else a plain integer) and no measured number, and records that bring identifiers not seen before. People write
    tables too, but with settings, strings or names that recur; a program that numbers its output shows in all three.
    Fewer than ``least_records`` records prove nothing.
    """
    lines = [x for x in text.split("\n") if x.strip() and not _COMMENT.match(x)]
    if len(lines) < least_records:
        return 0.0
    shapes = [_shape(_REMARK.sub("", x)) for x in lines]
    best = 0.0
    for p in range(1, min(period, len(lines) // least_records) + 1):
        pairs = len(lines) - p
        recurs = sum(shapes[i][0] == shapes[i + p][0] for i in range(pairs)) / pairs
        if recurs <= best:
            continue
        seen: set[str] = set()
        records = tagged = fresh = 0
        for i in range(0, pairs + 1, p):
            own = shapes[i : i + p]
            names = {x for s in own for x in s[1]}
            numbers = {x for s in own for x in s[2]}
            records += 1
            tagged += (len(numbers) == 1 if numbers else any(s[3] for s in own)) and not any(s[4] for s in own)
            fresh += not names <= seen
            seen |= names
        best = max(best, min(recurs, tagged / records, fresh / records))
    return best


def content_kind(text: str, template: float = 0.9, least_chars: int = 80) -> tuple[str, str] | None:
    """(kind, ``notice`` or ``composition``) of a chunk by its notices and its token composition, or None.

    ``least_chars`` keeps short literals from being data; notices and templates count whatever the length.
    """
    for s in _leading_comments(text):
        if _NOTICE_GENERATED.match(s):
            return GENERATED, "notice"
        if _NOTICE_VENDORED.match(s):
            return VENDORED, "notice"
    n = len(text)
    if template_share(text) >= template:
        return GENERATED, "composition"
    if n < least_chars:
        return None
    blob = sum(len(m.group()) for m in _BLOB.finditer(text))
    numbers = sum(len(m.group()) for m in _NUMBERS.finditer(text))
    if blob + numbers >= 0.75 * n:
        return DATA, "composition"
    if (m := _RECORDS.search(text)) and len(m.group()) >= 0.8 * n and text.count('":') * 12 > n / 4:
        return DATA, "composition"
    bare = _STRING.sub('""', text)
    spaces = sum(bare.count(c) for c in " \t\n\r")
    if spaces < 0.1 * len(bare):  # wrapped or not
        words = _WORDS.findall(bare)
        if len(words) >= 20 and sum(1 for w in words if len(w) <= 2) >= 0.4 * len(words):
            return COMPACTED, "composition"
    return None


def _lines(text: str) -> list[int]:
    """Hashes of the distinct significant lines: white space reduced, at least 16 characters with a word, no comment."""
    out = set()
    for line in text.split("\n"):
        s = "".join(line.split())
        if len(s) >= 16 and not s.startswith(("//", "#", "*", "/*")) and _SIGNIFICANT.search(s):
            out.add(xxhash.xxh3_64_intdigest(s) - (1 << 63))
    return list(out)


def chunk_verdicts(df: DataFrame, repo="repo", path="path", content="content", template: float = 0.9) -> DataFrame:
    """(repo, path, kind, way, lines) of each chunk; data and compacted chunks have no lines worth comparing."""
    rows = df.select(F.col(repo).alias("repo"), F.col(path).alias("path"), F.col(content).alias("content")).where("repo is not null and path is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ways, lines = [], [], []
            for p, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by_path = path_kind(p)
                kind, way = (by_path, "path") if by_path else (content_kind(text, template) if text else None) or (None, None)
                kinds.append(kind)
                ways.append(way)
                lines.append(_lines(text) if text and kind not in (COMPACTED, DATA) else [])
            columns = [batch.column(0), batch.column(1), pa.array(kinds, pa.string()), pa.array(ways, pa.string()), pa.array(lines, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["repo", "path", "kind", "way", "lines"])

    return rows.mapInArrow(run, "repo string, path string, kind string, way string, lines array<long>")


def source_kinds(df: DataFrame, containment: float = 0.6, rare: int = 20, least_lines: int = 4, template: float = 0.9, **names) -> DataFrame:
    """(repo, path, kind, way, containment): every file that is not hand-written.

    ``way`` is ``containment`` where a chunk of the file is contained in a foreign file of another repository (for a
    file without evidence of its own: of any), else what showed it: ``path``, ``notice`` or ``composition``.
    ``containment`` is the greatest share of a chunk's lines that one such file holds.
    """
    with scratch() as keep:
        chunks = materialize(chunk_verdicts(df, template=template, **names), "verdicts")
        first = F.min(F.struct(F.when(F.col("way") == "path", 0).when(F.col("way") == "notice", 1).otherwise(2).alias("o"), "kind", "way"))
        foreign = F.col("kind").isin(VENDORED, GENERATED) & (F.col("way") != "composition")
        ruled = chunks.where("kind is not null").groupBy("repo", "path").agg(
            first["kind"].alias("kind"), first["way"].alias("way"), F.max(F.when(foreign, F.col("kind"))).alias("origin"))
        ruled = materialize(ruled, "ruled")

        # chunks with the same lines are one class, whatever number of files hold it
        rows = chunks.where(F.size("lines") > 0).select("repo", "path", F.array_sort("lines").alias("lines")).withColumn("chunk", F.xxhash64("lines"))
        rows = materialize(rows.dropDuplicates(["repo", "path", "chunk"]), "rows")
        classes = rows.groupBy("chunk").agg(F.first("lines").alias("lines"))
        files = rows.join(ruled.where("origin is not null").select("repo", "path", "origin"), ["repo", "path"])
        files = files.groupBy("repo", "path", "origin").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("whole"))
        # a foreign file is one in the index, however many copies; ``only`` is its repository if there is but one
        library = files.groupBy(F.xxhash64("whole").alias("file")).agg(
            F.first("whole").alias("whole"), F.max("origin").alias("origin"), F.when(F.min("repo") == F.max("repo"), F.min("repo")).alias("only"))
        library = materialize(library, "library")

        # the inverted index: of each line, in how many chunks of all repositories it stands, and whether foreign files hold it
        flat = materialize(classes.where(F.size("lines") >= least_lines).select("chunk", F.size("lines").alias("size"), F.explode("lines").alias("line")), "flat")
        index = library.select("file", F.explode("whole").alias("line"))
        both = flat.select("line", F.lit(None).cast("long").alias("file")).unionByName(index.select("line", "file"))
        known = both.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.count("file").alias("held"), F.min("file").alias("lo"), F.max("file").alias("hi")).where("held > 0")
        known = materialize(known.select("line", F.greatest(F.col("n") - F.col("held"), "held").alias("df"), "lo", "hi"), "known")
        common = F.col("df") > rare
        part = flat.join(known.select("line", "df"), "line").groupBy("chunk", "size").agg(F.count(F.lit(1)).alias("shared"), F.sum(common.cast("int")).alias("hot"))
        # containment in one file cannot exceed that in all of them
        part = materialize(part.where((F.col("shared") >= containment * F.col("size")) & (F.col("shared") >= least_lines)), "contained")

        # rare lines lead a chunk to all files that may hold it, common ones to two; the whole sets give the exact containment
        lines = flat.join(part.select("chunk", "hot"), "chunk")
        leads = index.join(known.where(~common).select("line"), "line").select("line", "file")
        leads = leads.unionByName(known.where(common).select("line", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("file")))
        hits = lines.select("chunk", "line").join(leads, "line").select("chunk", "file").distinct()
        exact = hits.join(classes, "chunk").join(library, "file")
        exact = exact.select("chunk", "origin", "only", (F.size(F.array_intersect("lines", "whole")) / F.size("lines")).alias("share"), F.size("lines").alias("size"))

        # a file that shares no rare line with the chunk can hold common ones only; files with the same common lines are one variant
        variants = index.join(known.where(common).select("line"), "line").groupBy("file").agg(F.array_sort(F.collect_list("line")).alias("common"))
        variants = variants.join(library.select("file", "origin", "only"), "file").groupBy(F.xxhash64("common").alias("variant")).agg(
            F.first("common").alias("common"), F.max("origin").alias("origin"), F.when((F.min("only") == F.max("only")) & (F.count("only") == F.count(F.lit(1))), F.min("only")).alias("only"))
        unmarked = rows.join(ruled.select("repo", "path"), ["repo", "path"], "left_anti").select("chunk")
        most = lines.where(F.col("hot") >= containment * F.col("size")).join(unmarked, "chunk", "left_semi")
        most = most.join(variants.select("variant", "origin", "only", F.explode("common").alias("line")), "line")
        most = most.groupBy("chunk", "variant", "size", "origin", "only").agg(F.count(F.lit(1)).alias("n")).select("chunk", "origin", "only", (F.col("n") / F.col("size")).alias("share"), "size")

        # of each chunk the best container, and the best one that is not of the same single repository
        copies = exact.unionByName(most).where((F.col("share") >= containment) & (F.round(F.col("share") * F.col("size")) >= least_lines))
        copies = materialize(copies.groupBy("chunk", "only").agg(F.max(F.struct("share", "origin")).alias("best")), "copies")
        pick = F.max(F.struct("best", "only"))
        first = copies.groupBy("chunk").agg(pick.alias("first"))
        second = copies.join(first, "chunk").where(~F.col("only").eqNullSafe(F.col("first.only"))).groupBy("chunk").agg(pick.alias("second"))
        copies = first.join(second, "chunk", "left").select("chunk", F.filter(F.array("first", "second"), lambda t: t.isNotNull()).alias("tops"))
        met = rows.join(ruled.select("repo", "path", "kind", "way"), ["repo", "path"], "left").join(copies, "chunk")
        top = F.filter("tops", lambda t: F.col("kind").isNull() | t["only"].isNull() | (t["only"] != F.col("repo")))
        met = met.select("repo", "path", F.get(F.transform(top, lambda t: t["best"]), 0).alias("best")).where("best is not null")
        met = met.groupBy("repo", "path").agg(F.max("best").alias("best"))
        out = ruled.select("repo", "path", "kind", "way").join(met, ["repo", "path"], "full")
        out = out.select(
            "repo", "path", F.coalesce("kind", "best.origin").alias("kind"),
            F.when(F.col("best").isNotNull(), "containment").otherwise(F.col("way")).alias("way"), F.col("best.share").alias("containment"),
        )
        return keep(materialize(out, "kinds"))
