"""Embedders and model clients. The transport is a function, so tests need no network."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.schema import EmbeddingMismatchError

Transport = Callable[[str, dict, dict], dict]

# Dimensions of known embedding models.
KNOWN_DIMS = {
    "nomic-embed-text": 768, "qwen3-embedding:4b": 2560, "mxbai-embed-large": 1024, "bge-m3": 1024, "all-minilm": 384,
    "snowflake-arctic-embed": 1024, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072,
}


#: Prefixes that a model's makers ask for before a query or a document; none of these models gains from one here, so all are empty.
TASK_PREFIXES = {name: ("", "") for name in ("nomic-embed-text", "bge-m3", "mxbai-embed-large")}
Fetch = Callable[[str], dict]


def http(url: str, body: dict, headers: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=120) as reply:  # noqa: S310
        return json.loads(reply.read())


def http_get(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=20) as reply:  # noqa: S310
        return json.loads(reply.read())


def may_pass(error: Exception) -> bool:
    """Whether a call that failed so may succeed later: anything but a refusal of the request itself."""
    return not (isinstance(error, urllib.error.HTTPError) and 400 <= error.code < 500 and error.code not in (408, 429))


def with_retry(call: Callable[[], dict], waits: tuple[float, ...] = (0.25, 0.5)) -> dict:
    """The result of ``call``, tried again after each of ``waits`` while the error may pass; the last error is raised."""
    for wait in waits:
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if not may_pass(e):
                raise
            time.sleep(wait)
    return call()


def in_parallel(call: Callable, items: list, at_once: int) -> list:
    """``call`` of every item, at most ``at_once`` at a time, results in the order of the items."""
    if at_once <= 1 or len(items) < 2:
        return [call(x) for x in items]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(call, items))


def require_installed(model: str, url: str, fetch: Fetch = http_get) -> None:
    """Raise unless the service at ``url`` answers and has the model, by its name or its name with any tag."""
    try:
        names = [m.get("name", "") for m in fetch(f"{url}/api/tags").get("models") or []]
    except Exception as e:
        raise RuntimeError(f"no model service answers at {url}; start it first ({e})") from e
    if not any(n == model or n.startswith(model + ":") for n in names):
        raise RuntimeError(f"the model {model} is not installed; there are {', '.join(names) or 'none'}")


@dataclass
class HashingEmbedder:
    """A deterministic embedder of word hashes, for tests and for runs without a model."""

    dim: int = 64
    model: str = "hashing"
    query_prefix: str = ""
    document_prefix: str = ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out


@dataclass
class HttpEmbedder:
    """An embedding service: ``ollama`` (POST /api/embed, 16 texts a call) or ``openai`` (POST /embeddings, 64 a call, key required)."""

    provider: str
    model: str
    dim: int
    url: str
    key: str = ""
    query_prefix: str = ""
    document_prefix: str = ""
    transport: Transport = http
    wait: float = 0.25
    at_once: int = 1
    fetch: Fetch = http_get

    def __post_init__(self) -> None:
        if self.provider == "openai" and not self.key:
            raise ValueError("this embedding service needs a key")

    @property
    def batch(self) -> int:
        return 64 if self.provider == "openai" else 16

    def _call(self, part: list[str]) -> list[list[float]]:
        if self.provider == "openai":
            reply = self.transport(f"{self.url}/embeddings", {"model": self.model, "input": part}, {"Authorization": f"Bearer {self.key}"})
            return [x["embedding"] for x in reply["data"]]
        return self.transport(f"{self.url}/api/embed", {"model": self.model, "input": part}, {})["embeddings"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        parts = [texts[i : i + self.batch] for i in range(0, len(texts), self.batch)]
        waits = (self.wait, 2 * self.wait)
        out = [v for part in in_parallel(lambda p: with_retry(lambda: self._call(p), waits), parts, self.at_once) for v in part]
        for v in out:
            if len(v) != self.dim:
                raise EmbeddingMismatchError((self.model, self.dim), (self.model, len(v)))
        return out

    def check(self) -> None:
        """Look for the model and embed one text, so that a missing service or model is named before a long run."""
        if self.provider == "ollama" and self.transport is http:
            require_installed(self.model, self.url, self.fetch)
        try:
            self.embed(["probe"])
        except EmbeddingMismatchError:
            raise
        except Exception as e:
            raise RuntimeError(f"the embedding model {self.model} at {self.url} cannot be used: {e}") from e


def create_embedder(spec: str, url: str | None = None, key: str = "", transport: Transport = http) -> HttpEmbedder | HashingEmbedder:
    """``provider:model``, parted at the first colon only; a bare model means ollama, ``hashing`` the local stand-in."""
    head, _, rest = spec.partition(":")
    if head in ("ollama", "openai", "hashing"):
        provider, model = head, rest
    elif spec in KNOWN_DIMS or ":" not in spec:
        provider, model = "ollama", spec
    else:
        raise ValueError(f"unknown embedding provider {head!r}")
    if provider == "hashing":
        return HashingEmbedder()
    if model not in KNOWN_DIMS:
        raise ValueError(f"the dimension of {model!r} is unknown")
    default = "https://api.openai.com/v1" if provider == "openai" else "http://127.0.0.1:11434"
    query, document = TASK_PREFIXES.get(model, ("", ""))
    return HttpEmbedder(provider, model, KNOWN_DIMS[model], url or default, key, query, document, transport)


def embed_column(df: DataFrame, embedder, text: str, prefix: str = "", out: str = "embedding") -> DataFrame:
    """``df`` with a vector for each text, embedded in the tasks, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder.embed([prefix + (t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*batch.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<float>")


@dataclass
class HttpModel:
    """A generating model behind POST /api/generate with JSON output, temperature 0 and no streaming."""

    model: str
    url: str = "http://127.0.0.1:11434"
    transport: Transport = http
    fetch: Fetch = http_get
    waits: tuple[float, ...] = (0.25, 0.5)

    def generate(self, prompt: str) -> str:
        body = {"model": self.model, "prompt": prompt, "format": "json", "stream": False, "options": {"temperature": 0}}
        return with_retry(lambda: self.transport(f"{self.url}/api/generate", body, {}), self.waits)["response"]

    def check(self, installed: list[str] | None = None) -> None:
        """Whether the model is among the installed ones, those named or those that the service names."""
        require_installed(self.model, self.url, self.fetch if installed is None else lambda _: {"models": [{"name": n} for n in installed]})


def generate_column(prompts: DataFrame, client, key: str = "qid", at_once: int = 1) -> DataFrame:
    """(key, reply, error) of prompts (key, prompt), ``at_once`` calls at a time in each task; a failing call becomes an
    error of its row, not of the task."""
    kind = dict(prompts.dtypes)[key]

    def ask(prompt: str) -> tuple[str | None, str | None]:
        try:
            return client.generate(prompt), None
        except Exception as e:  # noqa: BLE001
            return None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = in_parallel(ask, batch.column(1).to_pylist(), at_once)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r for r, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.string())], [key, "reply", "error"])

    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {kind}, reply string, error string")


@dataclass
class Telemetry:
    calls: int = 0
    parsed: int = 0
    failed: int = 0
    unparsed: int = 0
    cached: int = 0
    sample: str | None = None


@dataclass
class ModelReranker:
    """Scores batches of snippets with a model; what was scored before is looked up by the batch's key."""

    client: HttpModel
    cache: dict[str, list[tuple[int, float]]] = field(default_factory=dict)
    telemetry: Telemetry = field(default_factory=Telemetry)

    def score(self, key: str, query: str, snippets: list[dict]) -> list[tuple[int, float]]:
        from fathom.operators.answer import parse_scores, rerank_prompt

        if key in self.cache:
            self.telemetry.cached += 1
            return self.cache[key]
        self.telemetry.calls += 1
        try:
            reply = self.client.generate(rerank_prompt(query, snippets))
        except Exception:  # noqa: BLE001
            self.telemetry.failed += 1
            return []
        scores = parse_scores(reply, len(snippets))
        if scores:
            self.telemetry.parsed += 1
            self.cache[key] = scores
        else:
            self.telemetry.unparsed += 1
            self.telemetry.sample = self.telemetry.sample or reply[:200]
        return scores


@dataclass
class ModelRewriter:
    """Search variants of a query from a model; failures and unusable replies give none, only usable ones are kept."""

    client: HttpModel
    variants: int = 2
    cache: dict[str, list[str]] = field(default_factory=dict)

    def rewrite(self, query: str) -> list[str]:
        from fathom.operators.answer import parse_variants, rewrite_prompt

        if query in self.cache:
            return self.cache[query]
        try:
            found = parse_variants(self.client.generate(rewrite_prompt(query, self.variants)), self.variants)
        except Exception:  # noqa: BLE001
            return []
        if found:
            self.cache[query] = found
        return found
