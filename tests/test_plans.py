"""What the plans push down, and what they do without."""

import pytest

from lakeloom.plans import flagship
from lakeloom.plans.engine import Engine
from lakeloom.plans.rewrite import Context
from lakeloom.operators import changes, joins
from lakeloom.sources import scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(Engine(spark, data).sql("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,300000.0)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_mapjoin_broadcasts(spark, data):
    text = plan(Engine(spark, data).sql("SELECT /*+ MAPJOIN(r) */ n_name FROM nation n JOIN region r ON n_regionkey = r_regionkey"))
    assert "BroadcastHashJoin" in text


def test_bucketed_join_has_no_exchange(spark, data):
    e, a, b = Engine(spark, data), scratch.table("x"), scratch.table("y")
    e.sql("SELECT * FROM customer").write.bucketBy(4, "c_custkey").sortBy("c_custkey").saveAsTable(a)
    e.sql("SELECT * FROM orders").write.bucketBy(4, "o_custkey").sortBy("o_custkey").saveAsTable(b)
    text = plan(e.sql(f"SELECT /*+ MERGE({a}) */ c_custkey, count(*) FROM {a} JOIN {b} ON c_custkey = o_custkey GROUP BY c_custkey"))
    assert "Exchange" not in text


def test_top_k_is_one_operator(spark, data):
    assert "TakeOrderedAndProject" in plan(Engine(spark, data).sql("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 20"))


def test_range_join_is_an_equi_join(spark, data):
    from pyspark.sql import functions as F

    bands = spark.range(0, 100, 10).select(F.col("id").cast("double").alias("lo"), (F.col("id") + 5).cast("double").alias("hi"))
    points = spark.range(0, 100).select(F.col("id").cast("double").alias("p"))
    df = joins.range_join(points, bands, "p", "lo", "hi", 10.0)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert df.count() == 60


def test_flagship(spark, data):
    assert 0 < flagship.run(spark, data).count() <= 50


def test_one_statement_only(spark, data):
    with pytest.raises(ValueError):
        Engine(spark, data).sql("SELECT 1; SELECT 2")


def test_table_bytes_for_samples(spark, data):
    e = Engine(spark, data)
    assert e.table_bytes("nation") > 0 and e.table_bytes("no_such_table") is None
    c = Context(table_bytes=lambda name: 4 << 20)
    from lakeloom.plans.rewrite import rewrite

    assert "25.000000 PERCENT" in rewrite("SELECT * FROM t TABLESAMPLE (1M)", c)


def test_delete_keeps_rows_of_unknown_truth(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert sorted(r.a or 0 for r in changes.delete(df, "a > 1").collect()) == [0, 1]


def test_merge_with_no_match(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    s = spark.createDataFrame([(2, "b"), (None, "c")], "k int, v string")
    out = changes.merge(t, s, "t.k = s.k", [(None, "delete", {})], [(None, {"k": "s.k", "v": "s.v"})])
    assert sorted((r.k or 0, r.v) for r in out.collect()) == [(0, "c"), (1, "a"), (2, "b")]
