"""Sinks, table changes, functions, scripts and administration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.engine import Engine, Refused
from lakeloom.plans.registry import register
from lakeloom.sources import scratch
from lakeloom.sources.tables import read_source, read_table


def _table(e: Engine, query: str, name: str = "t", extra: str = "") -> str:
    t = scratch.table(name)
    e.sql(f"CREATE TABLE {t} USING PARQUET {extra} AS {query}")
    return t


# --- sinks

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@register("snk_01_insert_into", f"{_NATION} UNION ALL SELECT 100, 'x', 1 UNION ALL SELECT n_nationkey + 200, n_name, n_regionkey FROM nation WHERE n_regionkey = 0")
def insert_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = _table(e, _NATION)
    e.sql(f"INSERT INTO TABLE {t} (n_nationkey, n_name, n_regionkey) VALUES (100, 'x', 1)")
    e.sql(f"INSERT INTO {t} SELECT n_nationkey + 200, n_name, n_regionkey FROM nation WHERE n_regionkey = 0")
    return spark.table(t)


@register("snk_02_insert_overwrite", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 2")
def insert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = _table(e, _NATION)
    e.sql(f"INSERT OVERWRITE TABLE {t} {_NATION} WHERE n_regionkey < 2")
    return spark.table(t)


@register("snk_02_insert_overwrite_partition", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'only', 1")
def insert_overwrite_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = scratch.table("p")
    e.sql(f"CREATE TABLE {t} USING PARQUET PARTITIONED BY (n_regionkey) AS SELECT n_name, n_regionkey FROM nation")
    e.sql(f"INSERT OVERWRITE TABLE {t} PARTITION (n_regionkey = 1) SELECT 'only'")
    return spark.table(t).select("n_name", "n_regionkey")


@register("snk_03_insert_directory", "SELECT r_regionkey, r_name FROM region")
def insert_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.path(spark, "dir")
    Engine(spark, sf_dir).sql(f"INSERT OVERWRITE DIRECTORY '{at}' USING parquet SELECT r_regionkey, r_name FROM region")
    return spark.read.parquet(at)


@register("snk_04_multi_insert", "SELECT 'low' AS part, n_name FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'high', n_name FROM nation WHERE n_regionkey >= 2")
def multi_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    a, b = _table(e, "SELECT n_name FROM nation LIMIT 0", "a"), _table(e, "SELECT n_name FROM nation LIMIT 0", "b")
    e.sql(f"FROM nation INSERT INTO {a} SELECT n_name WHERE n_regionkey < 2 INSERT INTO {b} SELECT n_name WHERE n_regionkey >= 2")
    return spark.table(a).select(F.lit("low").alias("part"), "n_name").unionAll(spark.table(b).select(F.lit("high").alias("part"), "n_name"))


@register("snk_05_ctas", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = scratch.table("ctas")
    e.sql(f"CREATE TABLE {t} USING PARQUET COMMENT 'by status' LIFECYCLE 30 AS SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
    return spark.table(t)


@register("snk_05_bucketed_table", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides bucketed by the join key: the join and the aggregate need no exchange."""
    a, b = scratch.table("bc"), scratch.table("bo")
    read_table(spark, sf_dir, "customer").select("c_custkey").write.bucketBy(8, "c_custkey").sortBy("c_custkey").saveAsTable(a)
    read_table(spark, sf_dir, "orders").select("o_custkey").write.bucketBy(8, "o_custkey").sortBy("o_custkey").saveAsTable(b)
    return spark.table(a).join(spark.table(b), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@register("snk_06_create_like", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey = 3")
def create_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t, u = _table(e, "SELECT n_name, n_regionkey FROM nation"), scratch.table("like")
    e.sql(f"CREATE TABLE {u} LIKE {t}")
    e.sql(f"INSERT INTO {u} SELECT n_name, n_regionkey FROM nation WHERE n_nationkey = 3")
    return spark.table(u)


@register("snk_07_clone", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t, u = _table(e, "SELECT n_name, n_regionkey FROM nation"), scratch.table("clone")
    e.sql(f"CLONE TABLE {t} PARTITION (n_regionkey = 2) TO {u} IF EXISTS OVERWRITE")
    return spark.table(u)


@register("snk_08_unload", "SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def unload(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.path(spark, "unload")
    Engine(spark, sf_dir).sql(f"UNLOAD FROM (SELECT r_regionkey, upper(r_name) AS r_name FROM region) INTO LOCATION '{at}' STORED AS PARQUET")
    return spark.read.parquet(at)


@register("snk_09_export_import", "SELECT r_regionkey, r_name FROM region")
def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = Engine(spark, sf_dir), scratch.path(spark, "export")
    t, u = _table(e, "SELECT r_regionkey, r_name FROM region"), scratch.table("imported")
    e.sql(f"EXPORT TABLE {t} TO '{at}'")
    e.sql(f"IMPORT TABLE {u} FROM '{at}'")
    return spark.table(u)


@register("snk_10_delete", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 200000)")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = _table(e, "SELECT * FROM orders")
    e.sql(f"DELETE FROM {t} WHERE o_orderstatus = 'F' AND o_totalprice < 200000")
    return spark.table(t)


@register("snk_10_update", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size * 2 ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN upper(p_brand) ELSE p_brand END AS p_brand FROM part")
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = _table(e, "SELECT p_partkey, p_size, p_brand FROM part")
    e.sql(f"UPDATE {t} SET (p_size, p_brand) = (p_size * 2, upper(p_brand)) WHERE p_size > 25")
    return spark.table(t)


@register("snk_11_merge", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = _table(e, _NATION)
    e.sql(f"""MERGE INTO {t} AS t USING (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 3) s
        ON t.n_nationkey = s.k WHEN MATCHED AND t.n_regionkey = 2 THEN DELETE WHEN MATCHED THEN UPDATE SET n_name = concat(s.n_name, '!')
        WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name, n_regionkey) VALUES (s.k, s.n_name, s.n_regionkey)""")
    return spark.table(t)


@register("snk_12_json", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))


@register("src_28_row_format", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation")
def row_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.path(spark, "delimited")
    read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.options(sep="|").csv(at)
    return read_source(spark, "TEXTFILE", at, row_format={"fields": "|", "lines": "\n"}, schema="k string, v string")


@register("src_29_load_data", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def load_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = _table(e, "SELECT r_regionkey, r_name FROM region")
    e.sql(f"LOAD DATA INPATH '{sf_dir}/region.parquet' INTO TABLE {t}")
    return spark.table(t)


# --- functions

@register("udf_01_register", "SELECT n_name, length(n_name) * 2 AS v FROM nation")
def udf_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function written in Python, over Arrow batches."""
    @F.pandas_udf("long")
    def twice(s: pd.Series) -> pd.Series:
        return s.str.len() * 2

    spark.udf.register("twice_length", twice)
    return Engine(spark, sf_dir).sql("SELECT n_name, twice_length(n_name) AS v FROM nation")


@register("udf_02_drop", "SELECT false AS there")
def udf_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    e.sql("CREATE OR REPLACE TEMPORARY FUNCTION gone(x INT) RETURNS INT RETURN x")
    e.sql("DROP TEMPORARY FUNCTION gone")
    return spark.range(1).select(F.lit(spark.catalog.functionExists("gone")).alias("there"))


@register("udf_03_sql_function", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 1.1 AS DOUBLE) AS v FROM orders")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    e.sql("CREATE OR REPLACE TEMPORARY FUNCTION with_tax(x DECIMAL(14,2), rate DECIMAL(3,1) DEFAULT 0.1) RETURNS DOUBLE RETURN CAST(x * (1 + rate) AS DOUBLE)")
    return e.sql("SELECT o_orderkey, with_tax(CAST(o_totalprice AS DECIMAL(14,2))) AS v FROM orders")


@register("udf_04_script_function", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) >= 5")
def script_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).script("CREATE OR REPLACE TEMPORARY FUNCTION enough(n BIGINT) RETURNS BOOLEAN RETURN n >= 5; SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING enough(count(*))")


@register("udf_05_macro", "SELECT p_partkey, p_size * p_size + 1 AS v FROM part")
def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).script("CREATE TEMPORARY MACRO square_and_one(x INT) x * x + 1; SELECT p_partkey, square_and_one(p_size) AS v FROM part")


@register("udf_06_function_argument", "SELECT n_nationkey, n_regionkey + 1 + n_regionkey + 2 AS v FROM nation")
def function_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).sql("SELECT n_nationkey, aggregate(transform(array(1, 2), x -> x + n_regionkey), 0, FUNCTION(@a, @x) AS @a + @x) AS v FROM nation")


@register("udf_08_udtf", "SELECT n_nationkey, w FROM (SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w FROM nation)")
def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.functions import udtf as make

    class Words:
        def eval(self, s: str):
            for w in s.split("_"):
                yield (w,)

    spark.udtf.register("name_words", make(Words, returnType="w: string"))
    return Engine(spark, sf_dir).sql("SELECT n_nationkey, t.w FROM nation, LATERAL name_words(n_name) t")


@register("udf_09_udaf", "SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 2) AS v FROM orders GROUP BY 1")
def udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A geometric mean: a user's aggregate made of built-in ones, which combine before the exchange."""
    e = Engine(spark, sf_dir)
    return e.sql("SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 2) AS v FROM orders GROUP BY o_orderstatus")


@register("udf_09_udaf_pandas", "SELECT n_regionkey, CAST(max(length(n_name)) AS BIGINT) AS v FROM nation GROUP BY 1")
def udaf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def longest(s: pd.Series) -> int:
        return int(s.str.len().max())

    return read_table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(longest("n_name").alias("v"))


# --- scripts and administration

@register("ddl_01_script", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 150000")
def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).script("-- two steps; the first makes a view\nCREATE OR REPLACE TEMPORARY VIEW dear AS SELECT * FROM orders WHERE o_totalprice > 150000；\nSELECT count(*) AS n FROM dear;")


@register("ddl_02_control_flow", "SELECT 'many' AS v")
def control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).sql("BEGIN DECLARE n BIGINT; SET n = (SELECT count(*) FROM nation); IF n > 10 THEN SELECT 'many' AS v; ELSE SELECT 'few' AS v; END IF; END")


@register("ddl_03_assignment", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000")
def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).script("@least DOUBLE := 2500 * 2; @rich := CACHE ON SELECT * FROM customer WHERE c_acctbal > @least; SELECT count(*) AS n FROM @rich r")


@register("ddl_04_set", "SELECT 'spark.sql.ansi.enabled' AS key, 'true' AS value")
def set_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).sql("SET spark.sql.ansi.enabled")


@register("ddl_05_explain", "SELECT true AS pushed")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Engine(spark, sf_dir).sql("EXPLAIN FORMATTED SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
    return plan.select(F.col("plan").contains("PushedFilters: [IsNotNull(o_totalprice)").alias("pushed"))


@register("ddl_06_database", "SELECT true AS there")
def database(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, name = Engine(spark, sf_dir), scratch.table("db")
    e.sql(f"CREATE DATABASE {name}")
    there = spark.catalog.databaseExists(name)
    e.sql(f"DROP DATABASE {name}")
    return spark.range(1).select(F.lit(there and not spark.catalog.databaseExists(name)).alias("there"))


@register("ddl_07_alter_truncate", "SELECT n_nationkey, n_name, n_regionkey, NULL AS note FROM nation WHERE false UNION ALL SELECT 1, 'a', 2, 'b'")
def alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = _table(e, _NATION)
    return e.script(f"ALTER TABLE {t} ADD COLUMNS (note STRING); TRUNCATE TABLE {t}; INSERT INTO {t} VALUES (1, 'a', 2, 'b'); SELECT * FROM {t}")


@register("ddl_08_view", "SELECT n_name FROM nation WHERE n_regionkey = 4")
def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).script("CREATE OR REPLACE TEMPORARY VIEW fourth AS SELECT * FROM nation WHERE n_regionkey = 4; SELECT n_name FROM fourth")


@register("ddl_08_materialized_view", "SELECT o_orderstatus, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1 UNION ALL SELECT 'before', 0, 0")
def materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built of some rows; its base grows; rebuilt, it has them all. What it had before the rebuild is a row of its own."""
    e, v = Engine(spark, sf_dir), scratch.table("mv")
    t = _table(e, "SELECT * FROM orders WHERE false")
    e.sql(f"CREATE MATERIALIZED VIEW IF NOT EXISTS {v} LIFECYCLE 7 COMMENT 'by status' DISABLE REWRITE AS SELECT o_orderstatus, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS total FROM {t} GROUP BY o_orderstatus")
    before = spark.table(v).agg(F.lit("before").alias("o_orderstatus"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("total"))
    before = spark.createDataFrame(before.collect(), before.schema)
    e.script(f"INSERT INTO {t} SELECT * FROM orders; ALTER MATERIALIZED VIEW {v} REBUILD; ALTER MATERIALIZED VIEW {v} ENABLE REWRITE")
    return spark.table(v).unionByName(before)


@register("ddl_09_index_refused", "SELECT * FROM (VALUES ('CREATE INDEX'), ('CREATE MODEL'), ('GRANT SELECT')) v(refused)")
def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a service's administration are told from others, and refused by name."""
    out = []
    for text in ("CREATE INDEX i ON TABLE nation (n_name)", "CREATE MODEL m AS SELECT 1", "GRANT SELECT ON TABLE nation TO USER u"):
        try:
            Engine(spark, sf_dir).sql(text)
        except Refused as e:
            out.append((str(e).split(":")[0],))
    return spark.createDataFrame(out, "refused string")


@register("ddl_10_describe", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) v(col_name, data_type)")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).sql("DESC region").select("col_name", "data_type")


@register("ddl_11_analyze", "SELECT count(*) AS rows FROM supplier")
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    t = _table(e, "SELECT * FROM supplier")
    e.sql(f"ANALYZE TABLE {t} COMPUTE STATISTICS FOR ALL COLUMNS")
    stats = e.sql(f"DESC EXTENDED {t}").where("col_name = 'Statistics'")
    return stats.select(F.regexp_extract("data_type", r"(\d+) rows", 1).cast("bigint").alias("rows"))


@register("ddl_12_repair_partitions", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, t, e = scratch.path(spark, "parts"), scratch.table("parts"), Engine(spark, sf_dir)
    read_table(spark, sf_dir, "nation").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").parquet(at)
    e.sql(f"CREATE TABLE {t} (n_name STRING, n_regionkey INT) USING PARQUET PARTITIONED BY (n_regionkey) LOCATION '{at}'")
    return e.script(f"MSCK REPAIR TABLE {t}; SELECT n_regionkey, count(*) AS n FROM {t} GROUP BY n_regionkey")


@register("ext_01_event_windows", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows with a watermark; the same function serves a stream (see lakeloom.streaming)."""
    from lakeloom.streaming.windows import tumbling

    return tumbling(read_table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "1 day").select("event_type", "start", "n")
