"""Every query with an SQL form against DuckDB over the smallest tables."""

import pytest

from millrace.jobs import registry
from tests.compare import connect, differences
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert differences((df.columns, rows), (list(rel.columns), rel.fetchall())) == ""
    assert df.columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_more_names_than_a_broadcast_holds(spark, tmp_path):
    n = 50_001
    word = lambda i: f"w{i % n:05d}"
    items = [(i, f"{word(i)} {word(i + 1)}") for i in range(n)] + [(n, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["item_id"] for r in registry.queries()["tool_exclusion"](spark, str(tmp_path)).collect()}
    assert kept == {i for i in range(n) if (i + 1) % n % 3 != i % 2} | {n}
    parts = [(i, f"{word(i)} {word(i + 1)}", "b", "t") for i in range(n)] + [(n, f"{word(0)} {word(1)}", "b", "t"), (n + 1, "w", None, "t")]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = {r["name"]: r["mentions"] for r in registry.queries()["mentioned_names"](spark, str(tmp_path)).collect()}
    assert found == {word(i): 3 if i < 2 else 2 for i in range(n)} | {"w": n + 2}


def test_words_of_documents_are_not_broadcast(spark):
    plan = registry.queries()["entities_subset"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [word" in plan and "SortMergeJoin [doc_id" in plan
