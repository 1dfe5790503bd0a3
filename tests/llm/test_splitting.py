import random

import numpy as np

from fathom.llm.splitting import greedy_cuts, split_chunks, unit_lines

SCHEMA = "id string, content string, start_line int, symbol_kind string, language string, piece string, text string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "p", "t") for r in rows], SCHEMA)
    out = {}
    for r in split_chunks(df, **kw).collect():
        out.setdefault(r["id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece"]) for k, v in out.items()}


def test_pointer_doubling_is_greedy():
    r = random.Random(2)
    texts = []
    for _ in range(60):
        at, units = 0, []
        for _ in range(r.randint(1, 40)):
            n = r.randint(1, 60)
            units.append((at, at + n))
            at += n + r.randint(0, 3)
        texts.append(units)
    got = greedy_cuts([(np.array([a for a, _ in u]), np.array([b for _, b in u])) for u in texts], 100)
    for u, cuts in zip(texts, got):
        want, first = [], 0
        for i, (a, b) in enumerate(u):
            if i > first and b - u[first][0] > 100:
                want.append(i)
                first = i
        assert list(cuts) == want
    assert greedy_cuts([], 10) == []


def body(n, size=60):
    return [f"  const v{i} = build({'x' * size});" for i in range(n)]


def test_units_of_each_kind():
    ts = "// about\nexport class A extends B {\n  x = 1;\n\n  /** m */\n  @Dec()\n  run(a: T) {\n    if (a) {\n      go(`} ${a} {`);\n    } else {\n      stop();\n    }\n  }\n\n  // tail\n  last() {}\n}\n"
    assert unit_lines(ts, "class", "typescript") == ([0, 4, 14], [2, 12, 16])
    fn = "function f(\n  a,\n  b,\n) {\n  const x = a\n    .b();\n  // c\n  try {\n    y();\n  } catch (e) {\n    z('} ');\n  }\n  return (\n    <p>don't</p>\n  );\n}"
    assert unit_lines(fn, "function", "tsx") == ([0, 6, 12], [5, 11, 15])
    const = "export const D = [\n  {\n    a: 1,\n  },\n  // two\n  { b: '}' },\n  `\n{\n`,\n];"
    assert unit_lines(const, "constant", "javascript") == ([0, 4, 6], [3, 5, 9])
    py = "@dec\nclass A(B):\n    x = {\n        'a': 1,\n    }\n\n    # about\n    def f(self,\n          b):\n        if b:\n            return \"\"\"\n    x = 1\n\"\"\"\n        else:\n            pass\n\n    def g(self):\n        pass\n"
    assert unit_lines(py, "class", "python") == ([0, 6, 16], [4, 14, 17])
    go = "// f\nfunc f(a int) error {\n\tif err := g(); err != nil {\n\t\treturn err\n\t} else {\n\t\th()\n\t}\n\tswitch a {\n\tcase 1:\n\tdefault:\n\t}\n\treturn nil\n}"
    assert unit_lines(go, "function", "go") == ([0, 7, 11], [6, 10, 12])
    top = "import a\n\n# x\ndef f():\n    pass\n\ny = [\n  1,\n]\n"
    assert unit_lines(top, None, "py") == ([0, 2, 6], [0, 4, 8])


def test_pieces(spark):
    lines = ["export function f(a) {", *body(80), "}"]
    text = "\n".join(lines)
    got = run(spark, [("c", text, 11, "function", "typescript")])["c"]
    assert len(got) > 1 and got[0]["start_line"] == 11 and got[-1]["end_line"] == 11 + 81
    for a, b in zip(got, got[1:]):
        assert b["start_line"] == a["end_line"] + 1 and 0 < b["start_line"] - b["text_start_line"] <= 3
    assert all(len(p["text"]) <= 3000 for p in got)
    for p in got:
        assert p["text"] == "\n".join(lines[p["text_start_line"] - 11 : p["end_line"] - 10])


def test_crlf_counts(spark):
    text = "\r\n".join(["function f() {", *body(60, 40), "}"])
    got = run(spark, [("c", text, 1, "function", "js")])["c"]
    at, cuts, first = 0, [], 0
    spans = []
    for line in text.split("\n"):
        spans.append((at, at + len(line.rstrip("\r"))))
        at += len(line) + 1
    for i in range(2, len(spans)):
        end = spans[i][1] if i < len(spans) - 2 else spans[-1][1]
        if i < len(spans) - 1 and end - spans[first][0] > 2800:
            cuts.append(i + 1)
            first = i
    assert [p["start_line"] for p in got[1:]] == cuts


def test_defined_cases(spark):
    big = "\n".join(["{", *body(100), "}"])
    rows = [("short", "a\nb", 1, "function", "go"), ("line", "x" * 5000, 1, None, None), ("null", None, 1, "file", "go"), (None, big, 1, "file", "go"), ("start", big, None, "file", "go"),
            ("twice", big, 1, "file", "js"), ("twice", big, 1, "file", "js"), ("odd", "(((\n" + "'\n" * 3000, 1, "class", "ts"), ("blank", "\n" * 4000, 1, "class", "py"), ("unit", "f(" + "\n" + "a,\n" * 2000 + ")", 1, "file", "ts")]
    got = run(spark, rows)
    assert set(got) == {"twice", "odd", "blank", "unit"} and len({p["piece"] for p in got["twice"]}) == len(got["twice"])
    assert len(got["unit"]) == 1 and got["unit"][0]["end_line"] == 2002  # one statement is never cut
    assert run(spark, []) == {}


def test_every_piece_within_the_limit_when_units_may_be_cut(spark):
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    long_lines = "\n".join(["f(", *(noise(2000) for _ in range(5)), noise(9000), ")"])
    rows = [("line", noise(9000), 7, None, None), ("unit", "f(" + "\n" + "".join(f"a{i},\n" for i in range(2000)) + ")", 1, "file", "ts"), ("mixed", long_lines, 1, "file", "js"),
            ("edge", "x" * 3001, 1, None, None), ("whole", "x" * 3000, 1, None, None), ("class", "class A {\n" + "\n".join(body(90)) + "\n}\n\n\n", 1, "class", "ts")]
    got = run(spark, rows, cut_units=True)
    assert set(got) == {"line", "unit", "mixed", "edge", "class"}
    texts = {r[0]: r[1] for r in rows}
    for name, pieces in got.items():
        assert all(len(p["text"]) <= 3000 for p in pieces) and len(pieces) > 1
        rest, reach = texts[name], 0
        for p in pieces:  # every piece begins within what was read and carries it on, so nothing is lost
            at = max(i for i in range(max(0, reach - 201), reach + 2) if rest.startswith(p["text"], i))
            assert at <= reach + 1
            reach = max(reach, at + len(p["text"]))
        assert not rest[reach:].strip()
    line = [p["text"] for p in got["line"]]
    assert all(b.startswith(a[-200:]) for a, b in zip(line, line[1:])) and {p["start_line"] for p in got["line"]} == {7}
    assert len(run(spark, rows)["unit"]) == 1 and "line" not in run(spark, rows)


def test_a_comment_that_ends_a_python_block_stays_in_it():
    py = "def f(a):\n    x = 1\n    for b in a:\n        g(b)\n        # last of the block\n    for c in a:\n        h(c)\n        # last too\n    # about the next\n    return x\n"
    assert unit_lines(py, "function", "python") == ([0, 2, 5, 8], [1, 4, 7, 9])
    ts = "function f(a) {\n  x = 1;\n      // set askew, but about the next\n  y = 2;\n}"
    assert unit_lines(ts, "function", "ts") == ([0, 2], [1, 4])
