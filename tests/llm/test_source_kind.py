import random

import pytest

from fathom.llm.source_kind import COMPACTED, DATA, GENERATED, VENDORED, content_kind, path_kind, source_kinds, template_share

HAND = "export function take(a, b) {\n  const wide = build(a.left, 39_000);\n  if (!wide) throw new Error('gateway } lobby');\n  for (const x of b.rows) {\n    wide.push(reduce(x));\n  }\n  return wide;\n}\n"


@pytest.mark.parametrize("path, want", [
    ("gen/src/a.ts", GENERATED), ("src/__generated__/a.ts", GENERATED), ("a/b.pb.go", GENERATED), ("a/b_pb2.py", GENERATED), ("src/x.gen.tsx", GENERATED), ("a/b_gen.py", GENERATED),
    ("vendor/kit/a.go", VENDORED), ("src/third_party/a.py", VENDORED), ("lib/zonely-0.4.17/a.py", VENDORED), ("node_modules/x/a.js", VENDORED),
    ("public/a.min.js", COMPACTED), ("public/a.bundle.js", COMPACTED), ("public/a.757122f.js", COMPACTED), ("static/road-0862da.js", COMPACTED),
    ("src/pages/generated_at.tsx", None), ("src/vendor.go", None), ("src/vendors/a.ts", None), ("apps/vendor-portal/a.js", None), ("src/autogen-cli/a.go", None), ("lib/minify/a.ts", None),
    ("src/pages/bundle.tsx", None), ("packages/deps-graph/a.go", None), ("lib/external-links/a.py", None), ("tools/codegen/a.js", None), ("src/lib/feedback.js", None), ("src/a-decade.js", None),
])
def test_paths(path, want):
    assert path_kind(path) == want


@pytest.mark.parametrize("text, want", [
    ("// Code generated by x v1.2. DO NOT EDIT.\npackage a\n", GENERATED), ("/*\n * AUTOGENERATED - run `make x`\n */\nlet a\n", GENERATED), ("# Auto-built on 2023-01-01 out of 9 definitions. Do not touch.\n", GENERATED),
    ("// Diese Datei wurde automatisch erzeugt (x)\n", GENERATED), ("// Fichier produit par x a partir de y.yaml : ne pas modifier\n", GENERATED), ("// @generated by x from y.schema\n", GENERATED),
    ("// source: a/b.idl  tool: x 4.15  checksum a26b95\n", GENERATED), ("# This file was automatically generated by x; any change will be lost.\n", GENERATED),
    ("/**\n * @license MIT\n * kit - words\n */\n" + HAND, VENDORED), ("/*! kit v1.2.3 | (c) the kit contributors | MIT */\n" + HAND, VENDORED), ("// kit@1.2.3 - copied from upstream, MIT\n" + HAND, VENDORED),
    ("# Taken from kit==5.3.0 (MPL-2.0); upstream copy\n", VENDORED), ("# kit 1.2.3 -- MIT licensed, see the upstream project\n", VENDORED), ("/*\n * Copyright (c) 2022 The kit Authors. All rights reserved.\n */\n", VENDORED),
    (HAND, None), ("// Copyright (c) 2022 the tower-cover-36 team. mask graph\n" + HAND, None), ("// rows generated by the lens service, do not edit the order below\n" + HAND, None),
    ("// minified bundle of x is loaded from vendor/y at start\n" + HAND, None), ('out.push("// Code generated by x. DO NOT EDIT.");\n' + HAND, None), ("", None),
    ("".join(f'  someName_{i} = "UPPER_CASE_{i}",\n' for i in range(9)), GENERATED), ("".join(f"export interface ThingMsg{i} {{ a?: B; c: string; }}\n" for i in range(9)), GENERATED),
    ("".join(f'  someName_{i} = "UPPER_{i}",\n' for i in range(8)) + HAND, None),
    ("export const A = [\n" + "  0x6c, 0xf4, 0x5a, 0x63, 0x97, 0x3e, 0xc4, 0xf4,\n" * 9 + "];\n", DATA), ('export const B = "' + "aZ09+/b" * 60 + '";\n', DATA),
    ("var x = mustDecode(`[" + ",".join(f'{{"id":{i},"name":"some words","code":"{i}"}}' for i in range(30)) + "]`)\n", DATA),
    ("const table = [\n  1, 2, 3, 4, 5, 6, 7, 8, 9, 10,\n];\n" + HAND, None), ("const t = {\n" + "".join(f'  "name {i}": ("words here", 0.{i}),\n' for i in range(20)) + "}\n", None),
    ("!function(e,t){" + "a.x=function(b){for(var c=0;c<b.length;c++)d.push(b[c])},var e=t[9],f=e.g(e);" * 8 + "}({});", COMPACTED), (f'const q = "{"SELECT name FROM rows WHERE value " * 12}";\n' + HAND, None),
])
def test_contents(text, want):
    assert (content_kind(text) or (None,))[0] == want


def library(seed, n=30):
    r = random.Random(seed)
    return [f"  const value{r.randint(0, 9999)} = compute{r.randint(0, 9999)}(argument{r.randint(0, 9999)});" for _ in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], "repo string, path string, content string, kind string, lines string")
    return {(r["repo"], r["path"]): (r["kind"], r["containment"]) for r in source_kinds(df, **kw).collect()}


def test_vendored_edits_by_containment(spark):
    lib = library(1)
    edited = [x if i % 10 else "  const local = changed(here);" for i, x in enumerate(lib)]
    own = library(2)
    rows = [("r1", "vendor/kit/a.ts", "\n".join(lib)), ("r2", "src/lib/a.ts", "\n".join(edited)), ("r3", "src/own.ts", "\n".join(own)), ("r4", "src/own.ts", "\n".join(own)),
            ("r5", "src/some.ts", "\n".join(own[:20] + lib[:8])), ("r2", "src/lib/a.ts", "\n".join(edited))]
    got = run(spark, rows)
    assert set(got) == {("r1", "vendor/kit/a.ts"), ("r2", "src/lib/a.ts")} and got[("r2", "src/lib/a.ts")][0] == VENDORED and 0.9 <= got[("r2", "src/lib/a.ts")][1] < 1


def test_popular_library_with_many_variants(spark):
    lib = library(3)
    rows = [(f"r{i}", "vendor/kit/a.ts", "\n".join([*lib, f"const only{i} = variant{i}(of{i});"])) for i in range(30)] + [("s", "src/a.ts", "\n".join(lib[2:]))]
    assert ("s", "src/a.ts") in run(spark, rows, rare=5)


def test_one_chunk_is_enough_and_defined_cases(spark):
    rows = [("r", "a.ts", HAND), ("r", "a.ts", "// Code generated by x. DO NOT EDIT.\n"), ("r", "b.ts", None), ("r", "vendor/x/c.ts", None), (None, "vendor/d.ts", "x"), ("r", None, "x"), ("r", "e.ts", ""), ("r", "f.ts", "z" * 200_000)]
    got = run(spark, rows + rows)
    assert {k: v[0] for k, v in got.items()} == {("r", "a.ts"): GENERATED, ("r", "vendor/x/c.ts"): VENDORED, ("r", "f.ts"): DATA}
    assert run(spark, []) == {}


def test_wrapped_compacted_code_of_one_chunk(spark):
    code = "!function(e,t){" + "a.x=function(b){for(var c=0;c<b.length;c++)d.push(b[c])},var e=t[9],f=e.g(e);" * 8 + "}({});"
    wrapped = "\n".join(code[i : i + 150] for i in range(0, len(code), 150))
    assert run(spark, [("r", "src/a.js", wrapped), ("r", "src/b.js", HAND)]) == {("r", "src/a.js"): (COMPACTED, None)}


def test_notice_far_down_the_leading_comment():
    words = "".join(f" * about part {i} of it\n" for i in range(60))
    assert content_kind(f"/*\n{words} * @generated by x from y.schema\n */\n" + HAND) == (GENERATED, "notice")
    assert content_kind("// note\n" * 60 + "// kit@1.2.3 - copied from upstream, MIT\n" + HAND) == (VENDORED, "notice")
    assert content_kind(f"/*\n{words} */\n{HAND}// @generated by x from y.schema\n") is None


def test_popular_lines_of_many_libraries_are_no_copy(spark):
    libs = [library(10 + i) for i in range(3)]
    rows = [(f"r{i}-{j}", "vendor/kit/a.ts", "\n".join([*lib, f"const only{j} = variant{j}(of{i});"])) for i, lib in enumerate(libs) for j in range(9)]
    mixed = "\n".join(x for lib in libs for x in lib[:10])
    copy = "\n".join(libs[1][:24] + library(20, 6))
    got = run(spark, [*rows, ("s", "src/mixed.ts", mixed), ("s", "src/copy.ts", copy)], rare=5)
    assert ("s", "src/mixed.ts") not in got and got[("s", "src/copy.ts")] == (VENDORED, 0.8)


def test_templates_of_no_known_shape():
    """Records that a program numbers, in forms that stand in no list, against tables that people write."""
    r = random.Random(7)
    name = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    assert template_share("".join(f"register({name()}, slot({i * 7}), {name()}::handler);\n" for i in range(12))) >= 0.9
    assert template_share("".join(f"case {i}:\n    out.put{name()}(in.read());\n    break;\n" for i in range(12))) >= 0.9
    assert template_share("".join(f"  {name()}: {{ {name()}: 0.{i}, {name()}: 'two words' }},\n" for i in range(12))) < 0.9
    assert template_share("".join("  run(first, 1);\n" for _ in range(12))) < 0.9
    assert template_share(HAND) < 0.9 and template_share("") == 0.0


def test_copies_across_repositories_whatever_their_evidence(spark):
    """Every copy is found through the index: marked or not, edited or not; the company's own copies are not."""
    lib, own = library(31, 40), library(32, 40)
    rows = [("r1", "vendor/kit/a.ts", "\n".join(lib)), ("r2", "extern/kit/a.ts", "\n".join(lib[:36])), ("r1", "third_party/kit/b.ts", "\n".join(library(33)))]
    r = random.Random(3)
    for share in (0.1, 0.2, 0.3):
        for i in range(10):
            edited = [x if r.random() > share else f"  const local{r.random()} = changed(here);" for x in lib]
            rows.append((f"s{i}", f"src/{share}/a.ts", "\n".join(edited)))
            rows.append((f"s{i}", f"src/{share}/own.ts", "\n".join(x if r.random() > share else f"  mine{r.random()}();" for x in own)))
    got = {(x["repo"], x["path"]): x for x in source_kinds(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert got["r1", "vendor/kit/a.ts"]["way"] == got["r2", "extern/kit/a.ts"]["way"] == "containment"
    assert got["r1", "third_party/kit/b.ts"]["way"] == "path"  # in one repository only
    assert not any(p.endswith("own.ts") for _, p in got)
    assert sum(p.endswith("/a.ts") and p.startswith("src") for _, p in got) >= 29


def test_a_stripped_notice_of_a_generated_file(spark):
    lib = library(41)
    rows = [("r1", "gen/a.ts", "\n".join(lib)), ("r2", "src/a.ts", "\n".join(lib[2:]))]
    assert run(spark, rows)["r2", "src/a.ts"] == (GENERATED, 1.0)
