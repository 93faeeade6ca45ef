"""Imports in order, once each, by language."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import board, catalogue, imports

FILES = {
    "rs": ("use crate::a::b;\n  use std::io;\nextern crate serde ;\nuse self::x; // y\nuse std::io;\n/* open\nuse no::no;\n  end */ use late::no;\nuse super::z;\n* use no;\n// use no;\nuse broken", ["crate::a::b", "self::x", "super::z"], ["std::io", "serde"]),
    "py": ("from . import a\nfrom .b import c\nimport os, sys as s,  re\nfrom os import path\nimport os\nfrom importlib", [".", ".b"], ["os", "sys", "re"]),
    "TSX": ("import a from './a';\nexport { b } from \"b\" ;\nconst c = require( '/c' ), d = require('d')\nimport 'side';\nimport e from `e`", ["./a", "/c"], ["b", "e"]),
    "hpp": ("#include <a/b.h>\n#include \"own.h\"\n#include  <c>\n#define X", ["own.h"], ["a/b.h", "c"]),
    "go": ("import \"fmt\"\nimport (\"github.com/a/b\")\nimport (\nimport `os/exec`", ["fmt", "os/exec"], ["github.com/a/b"]),
    "rb": ("require './x'\nrequire \"json\"\nrequire_relative 'no'", ["./x"], ["json"]),
    "cs": ("using System;\nusing A = B.C ;\nusing none", [], ["System", "A = B.C"]),
    "kts": ("import a.b.*;\nimport no.end", [], ["a.b.*"]),
}


@pytest.mark.parametrize("ext", list(FILES))
def test_ordered_imports(spark, ext):
    text, internal, external = FILES[ext]
    rows = [("f", ext, text, 1), ("g", ext, None, 1), ("h", ext, "", 1), ("i", "txt", text, 1)]
    got = imports.ordered_imports(spark.createDataFrame(rows, "file string, ext string, text string, at int"), "file").collect()
    assert [tuple(r) for r in got] == [("f", internal, external)]


def test_names_and_prompts(spark):
    names = spark.createDataFrame([("My Проект-1",), ("",), (None,), ("a_B9",)], "n string").select(X.project_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["my________1", "default", "default", "a_b9"]
    entries = spark.createDataFrame([("o", "b", "two"), ("o", "a", "one"), ("p", "c", "x")], "owner string, name string, description string")
    got = {(r["owner"], r["part"]): r["prompt"] for r in catalogue.catalogue_prompts(entries, ["owner"], 1).collect()}
    assert set(got) == {("o", 0), ("o", 1), ("p", 0)}
    assert got["o", 0] == catalogue.CATALOGUE_HEAD + "- a — one\n" + catalogue.CATALOGUE_TAIL
    assert catalogue.catalogue_prompts(entries.where("false"), ["owner"]).collect() == []


def test_admission_and_catch_up(spark):
    requests = spark.createDataFrame([("p", "x", "a"), ("p", " ", "a"), ("p/q", "x", "a"), ("p", "x", "b"), ("p", None, "a"), ("p", "x", None)], "project_id string, prompt string, to_agent string")
    connected = spark.createDataFrame([("a",), ("a",), (None,)], "agent string")
    assert [tuple(r) for r in board.admitted(requests, connected).collect()] == [("p", "x", "a")]
    tasks = spark.createDataFrame(
        [(1, "a", "completed", "r", None), (2, "a", "completed", None, None), (3, "a", "failed", "r", None), (4, "a", "in_progress", "r", None), (5, "b", "failed", None, "e"), (6, "a", "failed", None, "e")],
        "task_id int, from_agent string, status string, result string, error string",
    )
    waiting = spark.createDataFrame([(i, "a") for i in (1, 2, 3, 4, 5, 6, 6, 9)], "task_id int, agent string")
    assert sorted(tuple(r) for r in board.caught_up(waiting, tasks).collect()) == [(1, False, "r"), (3, True, ""), (6, True, "e")]
