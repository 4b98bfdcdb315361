"""Views as Spark builds them: the rows of the SQL text, with fewer moves."""

import pytest

from intakeloom.plans import views

LINES = [(1, 1, 5, 1), (1, 1, 5, 1), (2, 2, 6, 2), (3, 1, 7, 9), (None, 1, 5, 1), (1, 3, 5, None)]


@pytest.fixture
def folder(spark, tmp_path):
    rows = {
        "lineitem": ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                     "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(*line, 2.0, 10.5, "A", "F", None) for line in LINES]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(1, 4, "F", 9.0, None, "1-URGENT"), (1, 4, "O", 9.0, None, "5-LOW"), (2, None, "F", 9.0, None, "2-HIGH"), (3, 4, "P", 9.0, None, None)]),
        "customer": ("c_custkey bigint, c_name string, c_mktsegment string", [(4, "Ann", "A"), (4, "Bob", "B"), (None, "Eve", "E")]),
        "supplier": ("s_suppkey bigint, s_name string", [(1, "S1"), (1, "S1b"), (2, "S2"), (None, "S0")]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_documents_of_lines_are_the_rows_of_the_text(spark, folder):
    built = views.view(spark, folder, "jsons")
    text = views._TABLE.sub(r"intakeloom_\1", views.ALL["jsons"])
    wanted = spark.sql(text)
    assert built.columns == wanted.columns and built.count() == wanted.count() > 0
    assert sorted(map(str, built.collect())) == sorted(map(str, wanted.collect()))


def test_lines_move_once(spark, folder):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = views.view(spark, folder, "jsons")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 4


def test_letters_are_dealt_out_before_their_texts_are_made(spark, folder):
    letters = views.view(spark, folder, "letters")
    assert letters.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert letters.count() == 4


def test_lines_move_as_days_and_whole_numbers(spark, folder):
    plan = views.view(spark, folder, "jsons")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):]
    assert "as date) AS l_shipdate" in below and "as bigint) AS l_quantity" in below
