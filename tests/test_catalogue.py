"""Logs of puts and deletes, sessions, notes, usage records and compaction verdicts on literal rows."""

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import catalogue as K
from millrace.operators import conversation as C
from millrace.operators import sessions as S

LOG = "op string, skill_file string, seq bigint, phrases array<string>"


def test_skills(spark):
    log = [
        ("put", "a.md", 1, ["old phrase one", "old phrase two", "old phrase three"]),
        ("put", "a.md", 2, ["new phrase", "single", " two words "]),
        ("delete", "a", 3, None),  # refused: no .md
        ("put", "b.md", 4, ["some words"]),
        ("delete", "b.md", 5, None),
        ("put", "c.md", 7, None),
        ("delete", "c.md", 6, None),
        ("put", "d.txt", 8, ["some words"]),
        ("put", None, 9, ["some words"]),
        ("move", "c.md", 10, None),  # no operation of this name
    ]
    files, rows = K.skills(spark.createDataFrame(log, LOG))
    assert sorted((r["skill_file"], r["seq"]) for r in files.collect()) == [("a.md", 2), ("c.md", 7)]
    assert sorted(tuple(r[c] for c in ("skill_file", "n", "phrase", "path")) for r in rows.collect()) == [
        ("a.md", 0, "new phrase", "a_index_0.idx"),
        ("a.md", 2, " two words ", "a_index_2.idx"),
    ]
    files, rows = K.skills(spark.createDataFrame([], LOG))
    assert files.count() == rows.count() == 0


def test_knowledge(spark):
    text = lambda name, body: f"---\nname: {name}\ndescription: d\n---\n{body}"
    log = [
        ("put", "x", 1, text("x", "first")),
        ("put", "x", 2, text("y", "of another name")),
        ("put", "x", 3, "no front matter"),
        ("put", "x", 4, None),
        ("put", "z", 5, text("z", "")),
        ("delete", "z", 6, None),
        ("put", "z", 7, text("z", "again")),
        ("delete", "never there", 8, None),
    ]
    found = K.knowledge(spark.createDataFrame(log, "op string, name string, seq bigint, content string")).collect()
    assert sorted(tuple(r) for r in found) == [("x", 1, "d", "first"), ("z", 7, "d", "again")]


def test_usage_totals(spark):
    rows = [
        ("s", '{"prompt_tokens": 5, "completion_tokens": 2, "cost": 0.1, "completion_tokens_details": {"reasoning_tokens": 1}}'),
        ("s", '{"prompt_tokens": 7, "completion_tokens": 3, "cost": 0.2, "completion_tokens_details": {}}'),
        ("s", '{"prompt_tokens": 1, "completion_tokens": 1}'),
        ("s", None),
        (None, '{"prompt_tokens": 4, "completion_tokens": 4}'),
        ("t", None),
    ]
    found = C.usage_totals(spark.createDataFrame(rows, "session string, usage string"), "session").collect()
    assert sorted((tuple(r) for r in found), key=str) == [("s", 3, 13, 6, 1, 0.3), (None, 1, 4, 4, 0, 0.0)]


def test_compaction_verdicts(spark):
    schema = "conv_id bigint, role string, text string"
    before = spark.createDataFrame([(i, "user", "éé") for i in range(1, 7)] + [(6, "system", None)], schema)
    after = [(2, "user", "é"), (2, "tool", ""), (3, "user", "é"), (3, "assistant", "ab"), (4, "user", "éa"), (5, None, "a"), (6, "assistant", None), (9, "user", "a")]
    found = C.compaction_verdicts(before, spark.createDataFrame(after, schema)).collect()
    assert sorted(tuple(r) for r in found) == [
        (1, 4, None, "empty"), (2, 4, 2, "role"), (3, 4, 4, "size"), (4, 4, 3, "accepted"), (5, 4, 1, "role"), (6, 4, 0, "accepted"),
    ]


def test_saved_sessions(spark):
    schema = "owner_agent string, session_id string, seq bigint, deleted boolean, context struct<engine_config: struct<api_key: string, model: string>, last: bigint>"
    saves = [
        (None, "s", 1, True, None),
        (None, "s", 2, False, (("secret", "m"), 7)),
        ("a", "s", 3, None, (("secret", "m"), 1)),
        ("a", "s", 2, False, None),
        ("a", "t", 4, False, (None, 5)),
        ("a", None, 5, False, None),
    ]
    found = {(r["owner_agent"], r["session_id"]): r for r in S.saved(spark.createDataFrame(saves, schema), "seq").collect()}
    assert set(found) == {(None, "s"), ("a", "s"), ("a", "t")}
    assert found[None, "s"]["deleted"] and found[None, "s"]["context"] == (("***", "m"), 7)
    assert not found["a", "s"]["deleted"] and found["a", "s"]["seq"] == 3
    assert found["a", "t"]["context"] == (None, 5)


def test_directory_notes(spark):
    writes = [("p", "d", "about", "old", 1), ("p", "d", "about", "", 3), ("p", "d", "summary", "s", 2), ("p", "e", "other", "x", 4), ("q", None, "summary", "t", 5)]
    found = S.directory_notes(spark.createDataFrame(writes, "project_id string, dir string, kind string, content string, seq bigint"), "seq").collect()
    assert sorted(tuple(r) for r in found) == [("p", "d", "", "s"), ("q", None, None, "t")]


def test_ordered_union(spark):
    row = spark.createDataFrame([(["b", "a", "b"], None, ["c", "a"])], "x array<string>, y array<string>, z array<string>")
    assert row.select(X.ordered_union(F.col("x"), F.col("y"), F.col("z"))).first()[0] == ["b", "a", "c"]
