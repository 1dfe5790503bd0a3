"""The engine as a tool server: JSON-RPC, one message a line, with the tools of the model context protocol."""

from __future__ import annotations

import json
import os
from typing import IO

from pyspark.sql import functions as F

from fathom.api import CANDIDATES, TOP_K, Engine, format_answer, format_hits

VERSION = "2024-11-05"


def _schema(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": required}


_TEXT, _FLAG = {"type": "string"}, {"type": "boolean"}
TOOLS = {
    "search_code": (
        "Search the indexed code by meaning and words; gives places with their first lines. For exact names a plain text search is surer, and a miss proves nothing.",
        _schema(["query"], query=_TEXT, k={"type": "integer", "minimum": 1, "maximum": 30}, path_prefix=_TEXT),
    ),
    "ask_codebase": (
        "Answer a question from the indexed code. Every claim cites its source and is checked; what the sources do not support is refused.",
        _schema(["question"], question=_TEXT, top_k={"type": "integer", "minimum": 1, "maximum": 20}),
    ),
    "index_repo": ("Build the index of this repository or bring it up to date; unchanged files are skipped.", _schema([], force=_FLAG)),
    "index_status": ("What the index holds.", _schema([])),
}


def clamp(value, default: int, most: int) -> int:
    """A whole number from 1 to ``most``; what is no number counts as ``default``."""
    if not isinstance(value, (int, float)) or isinstance(value, bool) or value != value or abs(value) == float("inf"):
        return default
    return max(1, min(most, int(value)))


class Server:
    def __init__(self, engine: Engine, root: str, repo: str):
        self.engine, self.root, self.repo = engine, os.path.abspath(root.removeprefix("file://")), repo

    def prefix(self, path: str) -> str:
        """A path prefix relative to the repository; an absolute one is turned into that."""
        from fathom.functions.text import normalize_path_prefix

        row = self.engine.spark.createDataFrame([(path,)], "p string").select(normalize_path_prefix(F.col("p"), self.root).alias("p")).first()
        return row["p"]

    def _one(self, text: str):
        return self.engine.spark.createDataFrame([("q", text)], "qid string, query string")

    def search_code(self, query: str, k=None, path_prefix: str = "") -> str:
        prefix = self.prefix(path_prefix) if path_prefix else ""
        rows = self.engine.search(self._one(query), clamp(k, TOP_K, 30), path_prefix=prefix, rewrite=self.engine.client is not None).collect()
        return format_hits(rows) if rows else self.engine.explain_empty(prefix)

    def ask_codebase(self, question: str, top_k=None) -> str:
        if self.engine.client is None:
            raise RuntimeError("no answering model is set; start the server with --model")
        one = self._one(question)
        sources = self.engine.sources(one, clamp(top_k, TOP_K, 20))
        row = self.engine.ask(one, sources=sources).first()
        text = format_answer(row, sources.orderBy("ref").limit(CANDIDATES).collect())
        return text if row["kind"] == "answer" else text + "\n\nThe answer may still be there: search with other words, or for an exact name."

    def index_repo(self, force: bool = False) -> str:
        if hasattr(self.engine.embedder, "check"):
            self.engine.embedder.check()
        done = self.engine.index("file://" + self.root, self.repo, force=bool(force))
        stats = self.engine.store.stats()
        changed = done.get("add", 0) + done.get("update", 0)
        return f"indexed {self.root}: {changed} files written, {done.get('skip', 0)} unchanged; the index holds {stats['chunks']} chunks of {stats['files']} files\nindex: {self.engine.store.root}"

    def index_status(self) -> str:
        s = self.engine.status()
        if s["index"] is None:
            return f"repository: {self.root}\nno index yet; call index_repo to build one"
        return "\n".join([
            f"repository: {self.root}", f"index: {self.engine.store.root}", f"files: {s['files']}", f"chunks: {s['chunks']}", f"vectors: {s['vectors']}",
            f"embedding: {s['index']['model']} ({s['index']['dim']}-d)", "The index is a snapshot; call index_repo after changes.",
        ])

    def call(self, name: str, arguments: dict) -> dict:
        """The result of a tool; an error is a result that says so, never the end of the server."""
        try:
            if name not in TOOLS:
                raise ValueError(f"there is no tool {name!r}")
            schema = TOOLS[name][1]
            if missing := [x for x in schema["required"] if not isinstance(arguments.get(x), str)]:
                raise ValueError(f"{name} needs {', '.join(missing)}")
            if name in ("search_code", "ask_codebase") and self.engine.store.info() is None:
                text = "there is no index of this repository yet; call index_repo, then ask again"
            else:
                text = getattr(self, name)(**{k: v for k, v in arguments.items() if k in schema["properties"]})
        except OSError as e:
            return {"isError": True, "content": [{"type": "text", "text": f"{name} failed: {e}; name a folder that can be written with --index"}]}
        except Exception as e:  # noqa: BLE001
            return {"isError": True, "content": [{"type": "text", "text": f"{name} failed: {e}"}]}
        return {"content": [{"type": "text", "text": text}]}

    def handle(self, message: dict) -> dict | None:
        """The reply to a message, None to a notification."""
        if "id" not in message:
            return None
        reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "fathom", "version": "1"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]}}
        if method == "tools/call":
            return reply | {"result": self.call(params.get("name"), params.get("arguments") or {})}
        return reply | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}

    def run(self, lines: IO[str], out: IO[str]) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                reply = self.handle(json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
            if reply is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()
