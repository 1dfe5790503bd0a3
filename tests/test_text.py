import hashlib

from pyspark.sql import functions as F

from fathom.functions import text as tx


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_language_for_path(spark):
    cases = {"a/b.tsx": "tsx", "b.jsx": "tsx", "c.mts": "typescript", "d.cjs": "javascript", "e.py": "python", "f.go": "go", "g.TS": None, "h.rs": None}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", tx.language_for_path(F.col("p")).alias("l")).collect()
    assert {r["p"]: r["l"] for r in rows} == cases


def test_should_index(spark):
    keep = {"src/a.ts": True, "node_modules/x/a.ts": False, "src/dist/a.ts": False, "a.min.js": False, "types.d.ts": False, "yarn.lock": False, "logo.PNG": False, "readme.md": False, ".hidden/a.ts": True}
    rows = spark.createDataFrame([(k,) for k in keep], "p string").select("p", tx.should_index(F.col("p")).alias("k")).collect()
    assert {r["p"]: r["k"] for r in rows} == keep
    assert one(spark, "readme.md", lambda c: tx.should_index(c, True))


def test_normalize_path_prefix(spark):
    for value, want in {"/r/src": "src", "/r": "", "/r/": "", "./src": "src", "././a": "a", "/src": "src", "a\\b": "a/b", " src ": "src", "/rest/a": "rest/a"}.items():
        assert one(spark, value, lambda c: tx.normalize_path_prefix(c, "/r")) == want, value


def test_clamp_k(spark):
    for value, want in {"5": 5, "0": 1, "-3": 1, "99": 30, "2.9": 2, "-0.5": 1, "abc": 8, "": 8, "Infinity": 8, None: 1}.items():
        assert one(spark, value, lambda c: tx.clamp_k(c, 8, 30)) == want, value


def test_tokens_fold_and_split(spark):
    assert one(spark, "Réseau get_sub, fooBar-2 — дом 中文", tx.tokens) == ["reseau", "get", "sub", "foobar", "2", "дом", "中文"]
    assert one(spark, "  ", tx.tokens) == []
    assert one(spark, None, tx.tokens) is None


def test_query_terms_keep_repeats_and_drop_short(spark):
    assert one(spark, "a get_sub get réseau get", tx.query_terms) == ["get_sub", "get", "seau", "get"]
    assert one(spark, "?! .", tx.query_terms) == []
    assert one(spark, "Get__sub_", lambda c: tx.phrase(c)) == ["get", "sub"]


def test_quotes(spark):
    text = "see `const a = 1` and `name`, also ```ts\nreturn  x;\n``` but ```TS\nno\n``` and ` `"
    assert one(spark, text, tx.extract_quotes) == ["return x;", "const a = 1"]
    assert one(spark, "plain", tx.extract_quotes) == []


def test_normalise(spark):
    assert one(spark, " “a”\n\t ‘b’ ", tx.normalise) == "\"a\" 'b'"


def test_embedding_text_and_id(spark):
    df = spark.createDataFrame([("r", "p.ts", "f", None, [f"i{n}" for n in range(15)], "body", 3), ("r", "p.ts", None, "file", [], "body", 3)], "repo string, path string, n string, k string, i array<string>, c string, s int")
    rows = df.select(tx.embedding_text(*map(F.col, ("path", "n", "k", "i", "c"))).alias("t"), tx.chunk_id(*map(F.col, ("repo", "path", "s", "c"))).alias("id")).collect()
    assert rows[0]["t"] == "File: p.ts\nSymbol: f (unknown)\nImports: " + ", ".join(f"i{n}" for n in range(12)) + "\n---\nbody"
    assert rows[1]["t"] == "File: p.ts\n---\nbody"
    assert rows[0]["id"] == hashlib.sha256(b"r\0p.ts\x003\0body").hexdigest()[:16]


def test_matches_empty_fields_filter_nothing(spark):
    df = spark.createDataFrame([("a", "src/x", "go", "function"), ("b", "lib/y", "py", "class")], "repo string, path string, language string, symbol_kind string")
    assert df.where(tx.matches()).count() == 2
    assert df.where(tx.matches(path_prefix="src/")).count() == 1
    assert df.where(tx.matches(path_prefix="SRC/")).count() == 0
    assert df.where(tx.matches(repo="b", language="py", symbol_kind="class")).count() == 1


def test_inline_quotes_end_with_their_line(spark):
    assert one(spark, "a stray ` here\nand `f(x)` there", tx.extract_quotes) == ["f(x)"]
    assert one(spark, "`a +\nb` then `c + d`", tx.extract_quotes) == []  # the span between is the name `then`
    assert one(spark, "`a +\nb` or else `c + d`", tx.extract_quotes) == ["or else"]


def test_plain_tokens_equal_the_column_function(spark):
    for text in ("Crème brûlée_x 12a", "ΑΣ Straße İx ǆ", "áb 日本語。テスト ไทย", "", "__", "x²½ ①"):
        assert tx.plain_tokens(text) == one(spark, text, tx.tokens)
