import random

from pyspark.sql import functions as F

from fathom.operators import chunking
from fathom.operators.code_chunks import chunk_files, code_pieces, fold_pieces, imports_of, window_pieces

TSX = '''import { useState } from "react";
import x from './y';

export default function Menu({ a, b }: Props) {
  const [s, set] = useState(0);
  useEffect(() => {
    set(1);
  }, []);
  const onClick = useCallback(async (e) => {
    await go(e);
  }, [a]);
  function helper() {
    return 1;
  }
  const wide = {
    a: 1,
  };
  return (
    <div onClick={onClick}>don't</div>
  );
}

export const Row = (props: P) => <li>{props.x}</li>;
const MAX = 5;
export const LIST = [
  { a: 1 },
  { a: 2 },
];
export const Fw = React.forwardRef<HTML, P>((p, ref) => <a ref={ref} />);
export class Foo extends Bar {
  x = 1;
  private async run(a: string) {
    return a;
  }
}
'''


def fold(text, limit):
    return [(p.start, p.end, p.content) for p in fold_pieces(text.split("\n"), limit)]


def random_text(seed):
    r = random.Random(seed)
    return "\n".join(r.choice(["", "  ", "x" * r.randint(1, 60), "word " * r.randint(1, 12), "y" * 300]) for _ in range(r.randint(0, 60)))


def test_fold_matches_sequential_version(spark):
    texts = [(i, random_text(i)) for i in range(40)] + [(100, ""), (101, "\n\n"), (102, "a"), (103, "z" * 5000), (104, None)]
    df = spark.createDataFrame(texts, "n int, text string")
    got = {}
    for r in chunking.fold_text(df, 120).collect():
        got.setdefault(r["n"], []).append((r["start_line"], r["end_line"], r["content"]))
    want = {n: fold(t, 120) for n, t in texts if t is not None}
    assert got == {n: w for n, w in want.items() if w}


def test_window_split_bounds_and_covers(spark):
    texts = [(i, random_text(i)) for i in range(30)]
    rows = chunking.window_split(spark.createDataFrame(texts, "n int, text string"), 100).collect()
    for n, t in texts:
        mine = sorted((r for r in rows if r["n"] == n), key=lambda r: r["part"])
        assert [r["part"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(len(r["piece"]) <= 100 for r in mine)
        assert "".join(r["piece"] for r in mine).replace("\n", "") == t.replace("\n", "")
        assert [(p.start, p.end, p.content) for p in window_pieces(None, None, t.split("\n"), 1, 100)] == [(r["piece_start"], r["piece_end"], r["piece"]) for r in mine]


def test_merge_tiny(spark):
    p = [(None, 1, 1, "a"), (None, 2, 2, "b"), ("n", 3, 3, "c"), (None, 4, 4, "d"), (None, 5, 5, "e" * 200), (None, 6, 6, "f")]
    df = spark.createDataFrame([(p,)], "p array<struct<name:string,start:int,end:int,content:string>>")
    got = [(m["name"], m["start"], m["end"], m["content"]) for m in df.select(chunking.merge_tiny(F.col("p"), 120).alias("m")).first()["m"]]
    assert got == [(None, 1, 2, "a\n\nb"), ("n", 3, 3, "c"), (None, 4, 4, "d"), (None, 5, 5, "e" * 200), (None, 6, 6, "f")]
    empty = spark.createDataFrame([([],)], "p array<struct<name:string,start:int,end:int,content:string>>")
    assert empty.select(chunking.merge_tiny(F.col("p")).alias("m")).first()["m"] == []


def test_declarations_and_lines():
    got = [(p.name, p.kind, p.start, p.end) for p in code_pieces(TSX, "tsx")]
    assert got == [("Menu", "component", 4, 21), ("Row", "component", 23, 23), ("LIST", "constant", 25, 28), ("Fw", "component", 29, 29), ("Foo", "class", 30, 35)]
    assert code_pieces(TSX, "tsx")[0].content.startswith("export default function Menu")
    assert imports_of(TSX) == ["react", "./y"]


def test_large_component_loses_no_line():
    pieces = code_pieces(TSX, "tsx", limit=200)
    names = {p.name for p in pieces}
    assert {"Menu.useEffect", "Menu.onClick", "Menu.helper", "Menu (render)", "Menu (setup)"} <= names
    text = "\n".join(p.content for p in pieces)
    for line in TSX.split("\n")[3:21]:
        assert line.strip() in text
    assert all(len(p.content) <= 200 for p in pieces)


def test_large_class_and_literal():
    methods = "\n".join(f"  m{i}(a) {{\n    return {i} + {'9' * 30};\n  }}" for i in range(8))
    pieces = code_pieces(f"class Big {{\n{methods}\n}}\n", "typescript", limit=200)
    assert [p.name for p in pieces] == ["Big"] + [f"Big.m{i}" for i in range(8)]
    literal = "export const D = [\n" + "\n".join(f"  {{ id: {i}, name: 'n{i}' }}," for i in range(40)) + "\n];\n"
    parts = code_pieces(literal, "typescript", limit=300)
    assert len(parts) > 3 and all(p.content.startswith(f"D [part {i + 1}]") for i, p in enumerate(parts))
    assert sum(p.content.count("id:") for p in parts) == 40


def test_python_and_go():
    py = "import os\n\n@dec\ndef f(a,\n      b):\n    return 1\n\n\nclass C(B):\n    x = 1\n\n    def m(self):\n        return '}'\n"
    assert [(p.name, p.kind, p.start) for p in code_pieces(py, "python")] == [("f", "function", 3), ("C", "class", 9)]
    go = 'package a\n\nfunc (r *T) Do() error {\n\treturn nil\n}\n\nfunc Run() {\n}\n\ntype T struct {\n\tA int\n}\n'
    assert [(p.name, p.kind) for p in code_pieces(go, "go")] == [("Do", "method"), ("Run", "function"), ("T", "type")]


def test_broken_code_and_text_fall_back():
    assert code_pieces("function ok() {\n  return 1;\n}\nfunction broken( {\n", "javascript")
    assert [p.kind for p in code_pieces("a { color: red }\n", None)] == ["file"]
    assert code_pieces("", "python") == [] and code_pieces("\n\n", None) == []


def test_chunk_files(spark):
    rows = [("r", "src/a.tsx", TSX, 1), ("r", "node_modules/b.ts", TSX, 2), ("r", "c.py", None, 3), ("r", "d.css", "a{}", 4), ("r", "e.py", "", 5)]
    df = spark.createDataFrame(rows, "repo string, path string, text string, language int")
    out = chunk_files(df, "sha", "m", 4).collect()
    assert {r["path"] for r in out} == {"src/a.tsx"} and len({r["id"] for r in out}) == len(out) == 5
    assert out[0]["embedding_text"].startswith("File: src/a.tsx\n") and out[0]["embedding_dim"] == 4
    assert {r["path"] for r in chunk_files(df, include_unparsable=True).collect()} == {"src/a.tsx", "d.css"}
    assert chunk_files(df.limit(0)).count() == 0


def test_long_heads_and_other_statements_are_kept():
    props = ",\n".join(f"  someProperty{i} = fallback({i})" for i in range(30))
    fields = ";\n".join(f"  someField{i}: string" for i in range(30))
    panel = f"export const Panel = ({{\n{props}\n}}: PanelProps) => {{\n  return 1;\n}};\n"
    table = f"export const table: {{\n{fields}\n}} = {{\n  a: 1,\n}};\n"
    other = "router.register({\n  path: '/a',\n});\n"
    text = "import {\n  x,\n} from 'y';\nfunction f() {\n  return 1;\n}\n" + panel + table + other + "const MAX = 5;\n"
    got = [(p.name, p.kind, p.start, p.end) for p in code_pieces(text, "tsx")]
    assert got == [("f", "function", 4, 6), ("Panel", "component", 7, 40), ("table", "constant", 41, 74), (None, "file", 75, 77)]
    assert code_pieces(text, "tsx")[-1].content == other.strip()
