"""Statements and operators at their edges."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import changes, joins, scripts
from lakeloom.plans.engine import Engine, Refused
from lakeloom.sources import scratch
from tests.compare import rows


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables_are_read_when_they_are_named(spark, data):
    e = Engine(spark, data)
    assert "nation" in e.waiting
    e.sql("SELECT count(*) FROM nation WHERE n_name <> 'orders'")
    assert "nation" not in e.waiting and {"orders", "lineitem"} <= e.waiting


def test_frames_against_duckdb(spark, duck, data):
    """Random frames and exclusions; frames of rows have an order without ties."""
    r, e = random.Random(8), Engine(spark, data)
    start, end = ["UNBOUNDED PRECEDING", "2 PRECEDING", "1 PRECEDING", "CURRENT ROW", "1 FOLLOWING"], ["1 PRECEDING", "CURRENT ROW", "1 FOLLOWING", "3 FOLLOWING", "UNBOUNDED FOLLOWING"]
    parts, at = [], 0
    while len(parts) < 24:
        a, b = r.randrange(5), r.randrange(5)
        if a > b + 2 or (a, b) in ((3, 0), (4, 1), (4, 0)):
            continue
        kind, out = r.choice(["GROUPS", "ROWS"]), r.choice(["", " EXCLUDE CURRENT ROW", " EXCLUDE GROUP", " EXCLUDE TIES", " EXCLUDE NO OTHERS"])
        f = r.choice(["sum(s_suppkey)", "count(*)", "avg(s_suppkey)"] + (["min(s_suppkey)", "max(s_suppkey)"] if kind == "GROUPS" else []))
        order = "s_nationkey % 3 DESC" if kind == "GROUPS" else "s_suppkey"
        cast = "CAST({} AS DOUBLE)" if f[0] in "sa" else "{}"
        parts.append(cast.format(f"{f} OVER ({r.choice(['PARTITION BY s_nationkey % 4 ', ''])}ORDER BY {order} {kind} BETWEEN {start[a]} AND {end[b]}{out})") + f" AS c{at}")
        at += 1
    sql = f"SELECT s_suppkey, {', '.join(parts)} FROM supplier"
    assert rows(e.sql(sql).toPandas()) == rows(duck.sql(sql).df())


def test_frames_that_cannot_be_made(spark, data):
    with pytest.raises(ValueError, match="EXCLUDE"):
        Engine(spark, data).sql("SELECT min(s_suppkey) OVER (ORDER BY s_suppkey ROWS 2 PRECEDING EXCLUDE GROUP) FROM supplier")


def test_function_ctes(spark, data):
    e = Engine(spark, data)
    assert values(e.sql("WITH plus(@a INT, @b INT) AS (@a + @b), twice(@a INT) AS (plus(@a, @a)) SELECT twice(3) AS v, plus(1, twice(2)) AS w")) == [(6, 5)]
    assert values(e.sql("WITH few(@n INT) AS (SELECT r_regionkey AS k FROM region WHERE r_regionkey < @n) SELECT a.k FROM few(2) a JOIN few(1) ON a.k = few.k")) == [(0,)]
    with pytest.raises(ValueError, match="2 arguments"):
        e.sql("WITH plus(@a INT, @b INT) AS (@a + @b) SELECT plus(1)")


def test_table_function_with_an_order_and_none(spark, data):
    e = Engine(spark, data)
    e.register("first_of", lambda key, part, n=1: part.head(n)[["n_regionkey", "n_name"]], "n_regionkey int, n_name string")
    got = e.sql("SELECT f.* FROM first_of(ON nation PARTITION BY n_regionkey ORDER BY n_name DESC) f").toPandas()
    want = spark.read.parquet(f"{data}/nation.parquet").groupBy("n_regionkey").agg(F.max("n_name")).collect()
    assert {tuple(x) for x in got.itertuples(index=False)} == {tuple(r) for r in want}
    assert e.sql("SELECT * FROM first_of(ON nation PARTITION BY n_regionkey ORDER BY n_name n(2)) f").count() == 10
    assert e.sql("SELECT * FROM first_of(ON nation DISTRIBUTE BY n_regionkey)").count() == 5


def test_merge_of_several_matches(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(1, "x", 1), (1, "y", 0), (3, "z", 1)], "k int, v string, use int")
    new = [(None, {"k": "s.k", "v": "s.v"})]
    with pytest.raises(Exception, match="several source rows"):
        changes.merge(t, s, "t.k = s.k", [(None, "update", {"v": "s.v"})], new).collect()
    got = changes.merge(t, s, "t.k = s.k", [("s.use = 1", "update", {"v": "s.v"})], new).collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, "n"), (1, "x"), (2, "b"), (3, "z")]
    got = changes.merge(t, s, "t.k = s.k", [("s.use = 5", "delete", {})], []).collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, "n"), (1, "a"), (2, "b")]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize("width", [None, 10.0, 0.5])
def test_range_joins(spark, how, width):
    """Points and intervals that meet none, one or several; repeated rows, nulls, and intervals thousands of buckets long."""
    r = random.Random(3)
    points = [(i, None if i % 11 == 0 else float(r.randint(-50, 200))) for i in range(60)] + [(1, 5.0), (1, 5.0)]
    bands = [(i, lo := float(r.randint(-100, 150)), lo + r.choice([0, 3, 30])) for i in range(25)] + [(90, -1000.0, -900.0), (91, None, 3.0), (92, 9.0, 1.0), (93, 0.0, 5000.0), (93, 0.0, 5000.0)]
    a, b = spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(bands, "j int, lo double, hi double")
    want = a.join(b, (F.col("p") >= F.col("lo")) & (F.col("p") <= F.col("hi")), how)
    key = lambda df: sorted(str(tuple(x)) for x in df.collect())
    assert key(joins.range_join(a, b, "p", "lo", "hi", width, how)) == key(want)


def test_salted_joins(spark):
    a, b = spark.createDataFrame([(i % 3, i) for i in range(20)], "k int, x int"), spark.createDataFrame([(0, "a"), (7, "b")], "k int, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert values(joins.salted_join(a, b, "k", 4, how).select(*a.columns)) == values(a.join(b, "k", how).select(*a.columns))
    for how in ("right", "full_outer"):
        with pytest.raises(ValueError):
            joins.salted_join(a, b, "k", 4, how)


def test_reduce_gets_all_of_a_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 5), (None, 1), (None, 2)], "k string, v int").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        seen = scripts.reduce_rows(df, ["k"], lambda key, frames: pd.DataFrame([(key[0], sum(int(f.v.sum()) for f in frames))], columns=["k", "s"]), "k string, s long")
        assert sorted((r.k or "", r.s) for r in seen.collect()) == [("", 3), ("a", 45), ("b", 5)]
        few = scripts.reduce_rows(df, ["k"], lambda key, frames: pd.DataFrame([(key[0], len(next(frames)))], columns=["k", "n"]), "k string, n long")
        assert few.count() == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_transform_is_one_process_a_task_and_keeps_values(spark):
    odd = [("tab\there", 1), ("line\nend", 2), ("back\\slash \\N \\t", 3), (None, None), ("", 5), ("é\r", 6)]
    df = spark.createDataFrame(odd, "s string, n int").coalesce(1)
    got = [(r.s, r.n) for r in scripts.transform(df, ["s", "n"], "cat", "s, n").collect()]
    assert got == [(s, None if n is None else str(n)) for s, n in odd]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert [r.n for r in scripts.transform(df, ["s"], "wc -l | tr -d ' '", "n").collect()] == ["6"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert scripts.transform(spark.range(200_000), ["id"], "head -n 1", "n").count() >= 1
    with pytest.raises(Exception, match="ended with 3"):
        scripts.transform(df, ["s"], "cat; exit 3", "s").collect()


def test_changed_tables_keep_their_shape(spark, data):
    e, t = Engine(spark, data), scratch.table("shape")
    e.sql(f"CREATE TABLE {t} USING ORC PARTITIONED BY (n_regionkey) TBLPROPERTIES ('owner.note' = 'it''s mine') AS SELECT n_name, n_nationkey, n_regionkey FROM nation")
    e.sql(f"UPDATE {t} SET n_name = 'x' WHERE n_regionkey = 2")
    e.sql(f"DELETE FROM {t} WHERE n_regionkey = 3")
    described = {r.col_name: r.data_type for r in e.sql(f"DESC EXTENDED {t}").collect()}
    assert described["Provider"].lower() == "orc" and "# Partition Information" in described and "owner.note" in described["Table Properties"]
    assert spark.table(t).where("n_name = 'x'").count() == 5 and spark.table(t).count() == 20
    assert not spark.catalog.tableExists(f"{t}__old") and not spark.catalog.tableExists(f"{t}__new")


def test_materialized_views_by_partition(spark, data):
    e, t, v = Engine(spark, data), scratch.table("base"), scratch.table("view")
    e.sql(f"CREATE TABLE {t} USING PARQUET AS SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey")
    e.sql(f"CREATE MATERIALIZED VIEW {v} PARTITIONED ON (k) AS SELECT n, k FROM {t}")
    e.sql(f"INSERT INTO {t} VALUES (1, 100), (2, 200)")
    e.sql(f"ALTER MATERIALIZED VIEW {v} REBUILD PARTITION (k = 1)")
    assert values(spark.table(v)) == [(5, 0), (5, 1), (5, 2), (5, 3), (5, 4), (100, 1)]
    e.sql(f"DROP MATERIALIZED VIEW {v}")
    assert not spark.catalog.tableExists(v)
    with pytest.raises(ValueError, match="no materialized view"):
        e.sql(f"ALTER MATERIALIZED VIEW {t} REBUILD")


def test_statements_of_a_service_are_refused(spark, data):
    for text in ("CREATE INDEX i ON TABLE nation (n_name)", "GRANT SELECT ON TABLE t TO USER u", "CREATE MODEL m AS SELECT 1", "INSTALL PACKAGE p", "KILL 2020"):
        with pytest.raises(Refused):
            Engine(spark, data).sql(text)


def test_sorts_lay_rows_out(spark, data):
    e = Engine(spark, data)
    part = F.spark_partition_id().alias("part")
    keys = e.sql("SELECT o_custkey, o_orderkey FROM orders DISTRIBUTE BY o_custkey SORT BY o_custkey, o_orderkey DESC").select("o_custkey", "o_orderkey", part).toPandas()
    assert keys.groupby("o_custkey").part.nunique().max() == 1
    for _, x in keys.groupby("part"):
        assert list(zip(x.o_custkey, -x.o_orderkey)) == sorted(zip(x.o_custkey, -x.o_orderkey))
    names = e.sql("SELECT n_name FROM nation CLUSTER BY n_name").select("n_name", part).toPandas()
    assert all(x.n_name.is_monotonic_increasing for _, x in names.groupby("part"))
