import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sheetloom.plans import registry

from .oracle import rows, sql


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, data, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    want = sql(registry.SQL[name], data)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["q_boundaries", "q_cell_grid", "q_crop"])
@pytest.mark.parametrize("blank", [(22, 62), (None, None), (24, 63)])
def test_gaps_of_one_line_before_the_last(spark, tmp_path, name, blank):
    """A gap whose middle is the last line; images of 24 and of one line."""
    value = lambda y, x: -0.5 if y == blank[0] or x == blank[1] else 0.2
    lines = [(i * 25 + y, [value(y, x) for x in range(64)]) for i, h in enumerate((24, 25, 1)) for y in range(h)]
    table = pa.table({"vec_id": pa.array([i for i, _ in lines], pa.int64()), "embedding": pa.array([v for _, v in lines], pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(sql(registry.SQL[name], str(tmp_path)))


def test_variant_facts_deal_rows_once(spark, data):
    """Both ways start from one scan of the rows, dealt by session once."""
    facts = registry.QUERIES["q_variant_facts"](spark, data)
    facts.collect()
    ran = facts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[l_orderkey", ran)) == 1


def test_cascade_delete_sorts_no_rows(spark, data):
    """Where ids are too many to broadcast, rows pass hashed ids."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["q_cascade_delete"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "LeftAnti" in plan and "Sort" not in plan


@pytest.mark.parametrize("name", ["q_read_sheets", "q_heal"])
def test_sheets_of_repeated_documents(spark, data, tmp_path, name):
    """Tables in which documents stand again under the same id: cells at one place stay side by side, as in the SQL."""
    documents = pq.read_table(f"{data}/documents.parquet")
    pq.write_table(pa.concat_tables([documents, documents.slice(0, 200), documents.slice(100, 50)]), tmp_path / "documents.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(sql(registry.SQL[name], str(tmp_path)))


@pytest.mark.parametrize(("name", "deals"), [("q_read_sheets", 2), ("q_heal", 1)])
def test_cells_of_sheets_are_dealt_once(spark, data, name, deals):
    """By document, with neither joins nor another scan; rows are dealt once more after the call of the second recogniser."""
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == deals and "Join" not in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()
