"""Files of a source tree and small JSON documents."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import IGNORE_DIRS, content_hash, should_index

MAX_FILE_BYTES = 400_000


def read_tree(spark: SparkSession, root: str, repo: str, max_bytes: int = MAX_FILE_BYTES, include_unparsable: bool = False) -> DataFrame:
    """(repo, path, text, content_hash, modified) of every file worth indexing under ``root``.

    Size and path are tested before any content is read; bytes that are no UTF-8 become replacement characters.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).where(F.col("length") <= max_bytes)
    local = F.regexp_replace("path", "^file:/*", "/")
    inner = F.substr(local, F.length(F.lit("/" + base.removeprefix("file:").lstrip("/"))) + 1)
    rows = raw.select(inner.alias("path"), "content", F.col("modificationTime").alias("modified")).where(should_index(F.col("path"), include_unparsable))
    text = F.expr("decode(content, 'UTF-8')")
    return rows.select(F.lit(repo).alias("repo"), "path", text.alias("text"), content_hash(text).alias("content_hash"), "modified")


def walk(root: str, ignore_dirs: tuple[str, ...] = IGNORE_DIRS) -> list[str]:
    """Relative paths of the regular files under ``root``, depth first; ignored directory names are not entered and
    unreadable directories skipped."""
    out = []
    for at, dirs, names in os.walk(root, onerror=lambda _: None):
        dirs[:] = sorted(x for x in dirs if x not in ignore_dirs)
        out += [os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/") for n in sorted(names) if os.path.isfile(os.path.join(at, n)) and not os.path.islink(os.path.join(at, n))]
    return out


def stale_files(tree: DataFrame, indexed_at: float, most: int = 50) -> int:
    """How many files changed after the index was written, counted up to ``most``."""
    return tree.where(F.col("modified").cast("double") > indexed_at).limit(most).count()


def load_json(path: str, default=None):
    """A JSON document, or ``default`` if it is missing or broken."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default


def save_json(path: str, document) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(document, indent=2, ensure_ascii=False) + "\n")


def load_ground_truth(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(meta, questions) of a ground-truth file; every problem found is named in one error."""
    from fathom.operators.evaluate import ground_truth_problems
    from fathom.schema import QUESTION_SCHEMA

    data = load_json(path)
    if not isinstance(data, dict) or not isinstance(data.get("questions"), list):
        raise ValueError(f"{path} is no ground-truth document")
    snake = lambda k: "".join("_" + c.lower() if c.isupper() else c for c in k)
    rows = [{snake(k): v for k, v in q.items()} for q in data["questions"]]
    questions = spark.createDataFrame([tuple(r.get(f) for f in QUESTION_SCHEMA.names) for r in rows], QUESTION_SCHEMA)
    problems = ground_truth_problems(questions).collect()
    if problems:
        raise ValueError("; ".join(f"{p['id'] or 'all'}: {p['problem']}" for p in problems))
    return data.get("meta", {}), questions


def repository_root(start: str) -> str:
    """The nearest directory upwards that holds .git, .hg or .svn, else ``start``."""
    here = Path(start).resolve()
    for p in (here, *here.parents):
        if any((p / m).exists() for m in (".git", ".hg", ".svn")):
            return str(p)
    return str(here)


def index_path(root: str, fallback: str, env: dict[str, str] | None = None) -> tuple[str, bool]:
    """(folder of the index, whether it was named explicitly): FATHOM_INDEX, else inside the repository, else a slug under ``fallback``."""
    env = os.environ if env is None else env
    if env.get("FATHOM_INDEX"):
        return env["FATHOM_INDEX"], True
    if os.access(root, os.W_OK):
        return os.path.join(root, ".fathom", "index"), False
    return os.path.join(fallback, root.strip("/").replace("/", "-")), False
