"""Expressions and operators on small literals."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import paths as P
from millrace.functions import text as X
from millrace.operators import board, chunking, code, conversation, keyphrase, registry, vectors
from millrace.sources.files import word_list


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,place,tag", [("123", 0, "d"), ("12.5", 0, "d"), ("USA", 1, "a"), ("Rust", 1, "n"), ("Rust", 0, "p"), ("programming", 3, "p"), ("a1", 0, "u"), ("--", 0, "u")])
def test_tag(spark, word, place, tag):
    assert one(spark, X.tag(F.col("w"), F.col("i")), w=word, i=place) == tag


@pytest.mark.parametrize("word,out", [("languages", "language"), ("was", "was"), ("Rust", "rust")])
def test_normalise(spark, word, out):
    assert one(spark, X.normalise(F.col("w")), w=word) == out


def test_lexer_and_skeleton(spark):
    assert one(spark, X.lexer(F.lit('hello "world foo" bar-baz'))) == ["hello", '"world foo"', "bar-baz"]
    assert one(spark, X.lexer(F.lit("call std.io.print"))) == ["call", "std.io.print"]
    s = one(spark, X.skeleton(F.lit("parse config.toml"), F.array(F.lit("parse"))))
    assert (s["skeleton"], s["entities"]) == ("parse <ENT>", ["config.toml"])


def test_names(spark):
    assert one(spark, X.skill_file(F.lit("a/b/demo_index_3.idx"))) == "demo.md"
    assert one(spark, X.file_stem(F.lit(".knowledge/rust.md"))) == "rust"
    assert one(spark, X.skill_name(F.lit("My Skill-1"))) == "my_skill_1"
    assert one(spark, X.ensure_scheme(F.lit("x:1"))) == "http://x:1"


def test_frontmatter(spark):
    f = one(spark, X.frontmatter(F.lit("---\nname: a\ndescription: b c\nname: d\n---\nbody\nmore")))
    assert (f["name"], f["description"], f["body"]) == ("d", "b c", "body\nmore")
    assert one(spark, X.frontmatter(F.lit("---\nname: a\n"))) is None
    assert one(spark, X.strip_frontmatter(F.lit("---\nname: a\n---\nbody"))) == "body"
    assert one(spark, X.strip_frontmatter(F.lit("no front"))) == "no front"


def test_calls_and_rebukes(spark):
    calls = X.tool_calls(F.lit('x TOOL_CALLS: [{"name":"a","arguments":{"k":1}}]'))
    assert [c["name"] for c in one(spark, calls)] == ["a"]
    assert one(spark, X.tool_calls(F.lit("nothing"))) is None
    assert one(spark, X.rebukes(F.lit("---[1]--------\nfirst\n---[2]--------\nsecond."))) == ["first", "second."]
    assert one(spark, X.with_rebukes(F.lit("sys"), X.rebukes(F.lit("---[1]--------\nfirst")))) == "sys first."
    assert one(spark, X.strip_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert json.loads(one(spark, X.ok_content(F.lit("v")))) == {"ok": True, "content": "v"}
    assert one(spark, X.first_of(F.lit('{"B":2}'), "a", "B")) == "2"
    assert [one(spark, X.format_bytes(F.lit(n))) for n in (5, 2048, 3145728, 1280, 1792)] == ["5 B", "2.0 KB", "3.00 MB", "1.2 KB", "1.8 KB"]


@pytest.mark.parametrize(
    "pattern,path,ignored",
    [
        ("target", "a/b/target", True), ("target", "target/debug/foo.d", True), ("target", "src/main.rs", False), ("foo*", "a/foo123/x.txt", True),
        ("foo*", "barfoo", False), ("/foo*/bar/baz.txt", "foo123/bar/baz.txt", True), ("/foo*/bar/baz.txt", "x/foo1/bar/baz.txt", False),
        ("f?o", "foo", True), ("f?o", "fooo", False), ("/target", "target/debug", True),
    ],
)
def test_ignore(spark, pattern, path, ignored):
    assert one(spark, P.is_ignored(F.lit(path), P.parse_ignore(pattern))) is ignored


def test_paths(spark):
    assert one(spark, P.is_safe(F.lit("a/../b"))) is False
    assert one(spark, P.is_safe(F.lit("/a/./b"))) is True
    assert one(spark, P.is_safe(F.lit("/a"), absolute=False)) is False
    assert one(spark, P.prefixes(F.lit("a/b/c"))) == ["a", "a/b", "a/b/c"]
    assert one(spark, P.is_valid_id(F.lit("a_b\n"))) is False
    assert one(spark, P.is_valid_glob(F.lit("*.rs"))) is True


def test_snapshot(spark):
    cols = ["path", "mtime", "size"]
    index = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 1, 10)], cols)
    disk = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("d", 1, 5)], cols)
    assert {r["path"]: r["action"] for r in P.snapshot_diff(disk, index, "mtime", "size").collect()} == {"a": "keep", "b": "replace", "c": "remove", "d": "add"}


def test_tool_score(spark):
    rows = spark.createDataFrame([(1, 0.2), (4, 0.2), (0, 0.2)], ["h", "d"]).select(F.round(vectors.tool_score(F.col("h"), F.col("d")), 5)).collect()
    assert [r[0] for r in rows] == [0.53333, 0.71111, 0.0]
    hits = spark.createDataFrame([(0, "a", 0.2), (0, "b", 0.3), (1, "a", 0.15)], ["phrase", "name", "dist"])
    out = {r["name"]: (r["hits"], r["min_dist"]) for r in vectors.aggregate_hits(hits, "name").collect()}
    assert out == {"a": (2, 0.15), "b": (1, 0.3)}


def test_retention(spark):
    rows = [(1, i + 1, 1, b, True) for i, b in enumerate((100, 50, 60, 70))]
    turns = spark.createDataFrame(rows, ["conv_id", "turn_no", "n_messages", "bytes", "by_user"])
    kept = lambda budget: {(r["turn_no"], r["slot"]) for r in conversation.retained(turns, 1, 2, budget).collect()}
    assert kept(120) == {(1, "prefix"), (4, "tail")}
    assert kept(130) == {(1, "prefix"), (3, "tail"), (4, "tail")}


def test_turn_grouping(spark):
    roles = ["system", "assistant", "assistant", "user", "assistant", "user"]
    m = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], ["conv_id", "turn", "role", "text"])
    out = sorted((r["turn_no"], r["n_messages"], r["by_user"]) for r in conversation.turns(m).collect())
    assert out == [(1, 1, False), (2, 1, False), (3, 2, True), (4, 1, True)]


@pytest.mark.parametrize(
    "overlap,starts",
    [(3, [("aa bb cc", 0, 8), ("bb cc dd", 3, 11), ("cc dd ee", 6, 14), ("dd ee ff", 9, 17)]), (0, [("aa bb cc", 0, 8), ("cc dd ee", 6, 14), ("ee ff", 12, 17)])],
)
def test_chunks(overlap, starts):
    assert chunking.chunk_text("aa bb cc dd ee ff", 8, overlap) == starts
    assert chunking.chunk_text("", 8, overlap) == []
    assert chunking.chunk_text("   ", 8, overlap) == [("   ", 0, 3)]


def test_board(spark):
    log = spark.createDataFrame([(1, 10, 1, "pending"), (1, 20, 2, "in_progress"), (2, 5, 3, "completed"), (2, 5, 4, "failed")], ["task_id", "ts", "event_id", "status"])
    t = {r["task_id"]: r["status"] for r in board.latest(log).collect()}
    assert t == {1: "in_progress", 2: "failed"}
    assert [r["task_id"] for r in board.timed_out(board.latest(log), F.lit(1000), 300).collect()] == [1]
    assert {(r["task_id"], r["status"]) for r in board.recovered(board.latest(log), F.lit(100), 300).collect()} == {(1, "failed"), (2, "failed")}


@pytest.mark.parametrize(
    "ext,line,target,internal",
    [
        ("rs", "use crate::foo;", "crate::foo", True), ("rs", "use std::io;", "std::io", False), ("py", "from .foo import bar", ".foo", True),
        ("py", "import os", "os", False), ("js", "import x from './local'", "./local", True), ("js", "require('lodash')", "lodash", False),
        ("c", '#include "myheader.h"', "myheader.h", True), ("c", "#include <stdio.h>", "stdio.h", False),
    ],
)
def test_imports(spark, ext, line, target, internal):
    i = one(spark, code.imports(F.lit(ext), F.lit(line)))
    assert (i["target"], i["internal"]) == (target, internal)


def test_doc_comments(spark):
    text = "// one\n// two\nfn a() {}\n\n// far\n\nfn b() {}"
    lines = code.lines(spark.createDataFrame([("f", text)], ["file", "text"]), "file")
    assert {r["line"]: r["above"] for r in code.doc_comments(lines, "file").collect()} == {"fn a() {}": "one two", "fn b() {}": None}
    assert [r["name"] for r in code.symbols(lines).orderBy("line_no").collect()] == ["a", "b"]
    text = "/// Reads.\n#[inline]\n#[test]\npub fn c() {}\n/** All\n * of it */\n@Override\nclass D\n#[x]\nfn e() {}"
    lines = code.lines(spark.createDataFrame([("f", text)], ["file", "text"]), "file")
    assert {r["line"]: r["above"] for r in code.doc_comments(lines, "file").collect()} == {"pub fn c() {}": "Reads.", "class D": "All of it", "fn e() {}": None}


def test_exported(spark):
    text = "pub fn a() {}\nfn b() {}\n    pub fn c() {}\npub struct D;"
    lines = code.lines(spark.createDataFrame([("f", "rs", text)], ["file", "ext", "text"]), "file", "ext")
    assert [r["name"] for r in code.exported(code.symbols(lines), "ext", "line").orderBy("line_no").collect()] == ["a", "D"]
    kinds = [(code.is_source(F.lit(p)), code.is_config(F.lit(p))) for p in ("a.RS", "Cargo.toml", "x/Makefile", "b.txt")]
    assert [(one(spark, a), one(spark, b)) for a, b in kinds] == [(True, False), (False, True), (False, True), (False, False)]


def test_tokens_between_marks(spark):
    rows = keyphrase.tokens(spark.createDataFrame([(1, "One two, three four five. Six!")], "doc_id bigint, text string")).orderBy("sent", "at").collect()
    assert [(r["word"], r["y_word"], r["x_word"], r["tag"]) for r in rows] == [
        ("One", None, None, "p"), ("two", "One", None, "p"), ("three", None, None, "p"), ("four", "three", None, "p"), ("five", "four", "three", "p"), ("Six", None, None, "p"),
    ]


def test_key_phrases(spark):
    docs = spark.createDataFrame([(1, "Spark runs jobs. Spark runs big data jobs on clusters. Big data jobs need clusters."), (2, None), (3, "")], "doc_id bigint, text string")
    rows = keyphrase.key_phrases(docs, top=5).orderBy("doc_id", "rank").collect()
    assert rows and {r["doc_id"] for r in rows} == {1}
    assert "Big data jobs" in {r["phrase"] for r in rows} or any(r["phrase"] != r["phrase"].lower() for r in rows)  # as first written
    assert [r["score"] for r in rows] == sorted(r["score"] for r in rows)


def test_registry(spark):
    registry.load()
    registry.load()
    names = [d["name"] for d in registry.describe()]
    assert names == sorted(set(names))
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert registry.run("chunks", docs, '{"size": 3, "overlap": 0}').count() == 2
    with pytest.raises(KeyError):
        registry.run("missing", docs)


def test_knn_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    monkeypatch.setattr(vectors, "PART", 3)
    rows = [(i, [float(i % 5) + 1, float(i % 3), 1.0]) for i in range(12)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = vectors.knn(e, e.where("vec_id % 4 = 0"), 3).collect()
    assert len(out) == 9 and all(r["query_id"] != r["vec_id"] for r in out)


def test_docstrings_and_file_docs(spark):
    text = 'class A:\n\n  """One."""\n  def b(self, x):\n    pass\n  def c(self):\n    """\n    Two\n\n    three\n    """\ndef d():\n    """"""\ndef e():\n    \u0027\u0027\u0027never closed\n'
    files = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    found = [tuple(r) for r in code.docstrings(files, "id").orderBy("n").collect()]
    assert [(r[2], r[3]) for r in found] == [("A", "One."), ("c", "Two  three"), ("e", "never closed")]
    docs = ["\n/* A\n * b */\n\n// c\nfn x() {}\n// d", "fn x() {}\n// d", "", None, "\n".join(["// x"] * 40), "#!/bin/sh\n-- y"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t string").select("i", code.file_doc(F.col("t")).alias("d"))
    assert [r["d"] for r in rows.orderBy("i").collect()] == ["A b c", None, None, None, " ".join(["x"] * 30), "!/bin/sh y"]


def test_described_symbols(spark):
    files = spark.createDataFrame([(1, "py", "class A(B):\n  def f(self, x):\n    pass\ndef g():\n  def h(y):\n    pass")], "id int, ext string, text string")
    rows = code.described(code.symbols(code.lines(files, "id", "ext")), "id", "ext").orderBy("line_no").collect()
    assert [(r["name"], r["language"], r["signature"], r["scope"]) for r in rows] == [
        ("A", "Python", "(B)", None), ("f", "Python", "(self, x)", "A"), ("g", "Python", "()", None), ("h", "Python", "(y)", None),
    ]
    kinds = spark.createDataFrame([("Function",), ("method",), ("class",)], ["k"]).select(code.is_function(F.col("k")).alias("f")).collect()
    assert [r["f"] for r in kinds] == [True, True, False]


def test_pruned_and_gitignore(spark):
    assert P.parse_gitignore("# c\n\n!keep\n/target/\n*.log\n/*.log\n /// \n") == ["target", "*.log"]
    paths = [("a/node_modules/x",), ("node_modules",), (".git/x",), ("src/Target/x",), ("x",), ("",)]
    rows = spark.createDataFrame(paths, ["p"]).select(P.is_pruned(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in rows] == [True, False, True, False, False, False]


@pytest.mark.parametrize(
    "word,out",
    [("книга", "книг"), ("Книгами", "книг"), ("книг", "книг"), ("новая", "нов"), ("её", "её"), ("дом", "дом"), ("running", "runn"), ("cats", "cat"), ("is", "is"), ("", ""), (None, None)],
)
def test_stem(spark, word, out):
    assert spark.createDataFrame([(word,)], "w string").select(X.stem(F.col("w"))).first()[0] == out


def test_stopwords_of_languages(spark):
    words = keyphrase.stopwords("english", "russian")
    assert {"the", "и"} <= set(words) and list(words) == sorted(set(words))
    docs = spark.createDataFrame([(1, "Новая книга стоит на полке, новая книга и новая полка.")], "doc_id bigint, text string")
    found = keyphrase.scored_terms(docs, words).where("stop").select("term").collect()
    assert "на" in {r["term"] for r in found}


def test_skeleton_by_stems(spark, tmp_path):
    (tmp_path / "words").write_text("4\nlanguages/S\nкнига/X\nparse\n", encoding="utf-8")
    stems = [r["stem"] for r in word_list(spark, str(tmp_path / "words")).collect()]
    text = 'Parsed language "parse" книгами foo'
    s = spark.createDataFrame([(text, stems)], "t string, k array<string>").select(X.skeleton(F.col("t"), F.col("k"), X.stem).alias("s")).first()["s"]
    assert (s["skeleton"], s["entities"]) == ("<ENT> language <ENT> книгами <ENT>", ["parsed", "parse", "foo"])


@pytest.mark.parametrize(
    "text,parts",
    [('a "b c" d.e', ["a", '"b c"', "d.e"]), ('say "never ends here. x', ["say", '"never ends here. x']), ('x"y"', ["x", '"y"']), ('""', ['""']), ('"', ['"']), ("end.", ["end"])],
)
def test_quotes(spark, text, parts):
    row = spark.createDataFrame([(text,)], "t string").select(X.lexer(F.col("t")), X.skeleton(F.col("t"), F.array(F.lit("a"), F.lit("say")))["entities"]).first()
    assert row[0] == parts
    assert row[1] == [p.lower() if not (len(p) > 1 and p[0] == p[-1] == '"') else p[1:-1].lower() for p in parts if p not in ("a", "say")]


@pytest.mark.parametrize(
    "text,out",
    [(" x \n", "x"), ("```json\n{\"a\": 1}\n```", '{"a": 1}'), ("```\r\nb\n``` tail", "b"), ("```JSON\nopen", "open"), ("a ``` b", "a ``` b"), ("```a```b```", "a```b"), ("``````", "")],
)
def test_fences(spark, text, out):
    assert spark.createDataFrame([(text,)], "t string").select(X.without_fences(F.col("t"))).first()[0] == out


@pytest.mark.parametrize("text,out", [("abc", "abc"), ("abcd", "abcd"), ("abcde", "abcd..."), ("éé", "éé"), ("ééé", "ééé..."), (None, None)])
def test_shortened(spark, text, out):
    assert spark.createDataFrame([(text,)], "t string").select(X.shortened(F.col("t"), 4)).first()[0] == out
