"""Record schemas and errors."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}


def fields(spec: str) -> T.StructType:
    """A schema from ``name type, ...``; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in spec.split(","))])


CHUNK_SCHEMA = fields(
    "id string, repo string, path string, language string, symbol_name string, symbol_kind string, start_line int, end_line int, "
    "content string, embedding_text string, imports array<string>, git_sha string, embedding_model string, embedding_dim int"
)
HIT_SCHEMA = fields("qid string, source string, rank int, chunk_id string, score double")
QUESTION_SCHEMA = fields(
    "id string, category string, difficulty string, question string, answerable boolean, verified boolean, near_miss boolean, "
    "refusal_reason string, expected_files array<string>, expected_symbols array<string>, answer_sketch array<string>, tags array<string>, notes string"
)
SYMBOL_KINDS = ("function", "class", "method", "interface", "type", "component", "constant", "file")
SOURCES = ("vector", "keyword", "fused", "reranked")


class EmbeddingMismatchError(ValueError):
    """The index was built with another embedding model, dimension or prefix than the one in use."""

    def __init__(self, indexed: tuple[str, int], current: tuple[str, int]):
        super().__init__(
            f"the index holds vectors of {indexed[0]} ({indexed[1]}-d) but {current[0]} ({current[1]}-d) is in use; "
            "index again with one of them"
        )
        self.indexed, self.current = indexed, current
