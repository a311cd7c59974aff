"""Scans, projections, predicates, joins, aggregates, set operations, sorts, limits and hints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import joins, layout
from lakeloom.plans.engine import Engine
from lakeloom.plans.registry import dialect, register
from lakeloom.sources.tables import read_source, read_table

# --- sources

dialect("src_01_table_scan", "SELECT r_regionkey, r_name FROM region")
dialect("src_02_table_alias", "SELECT c.c_custkey, c.c_name FROM customer AS c WHERE c.c_acctbal > 9000")
dialect("src_03_column_alias_list", "SELECT a.k, a.n FROM region a(k, n)")
dialect("src_04_derived_table", "SELECT s.k, s.total FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) s WHERE s.total > 100000")
dialect("src_05_parenthesised_join", "SELECT n.n_name, r.r_name FROM (nation n JOIN region r ON n.n_regionkey = r.r_regionkey)")
dialect("src_06_values_table", "SELECT v.a, v.b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL) AS v(a, b)", "SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
dialect("src_08_table_function", "SELECT a.c AS c FROM explode(array(1, 2, 3)) a(c)", "SELECT unnest([1, 2, 3]) AS c")
dialect("src_11_tablesample_all", "SELECT count(*) AS n FROM nation TABLESAMPLE (100 PERCENT)", "SELECT count(*) AS n FROM nation")
dialect("src_12_tablesample_bytes", "SELECT count(*) AS n FROM nation TABLESAMPLE (900M)", "SELECT count(*) AS n FROM nation")
dialect("src_13_partition_spec", "SELECT o.o_orderstatus, count(*) AS n FROM orders PARTITION (o_orderstatus = 'F', o_orderpriority) o JOIN customer PARTITION(c_mktsegment='BUILDING') ON c_custkey = o_custkey GROUP BY o.o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' GROUP BY o_orderstatus")
dialect("src_14_scan_properties", "SELECT n.n_nationkey, n.n_name, r_name FROM nation('mergeSchema'='true', 'pathGlobFilter'='*.parquet') n JOIN region ('mergeSchema'='false') ON r_regionkey = n.n_regionkey", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
dialect("src_18_parameterised_cte", "WITH dear(@least DOUBLE, @status STRING) AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > @least AND o_orderstatus = @status), taxed(@x DOUBLE) AS (@x * 2), few AS (SELECT 1 AS one) SELECT d.o_orderkey, taxed(d.o_totalprice) AS twice FROM dear(100000 * 3, 'F') d JOIN few ON one = 1", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
dialect("src_15_from_first", "FROM nation SELECT n_name, n_regionkey WHERE n_regionkey = 2", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
dialect("src_16_cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), few AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c.c_name, f.n FROM few f JOIN customer c ON c.c_custkey = f.o_custkey")
dialect("src_17_cte_columns", "WITH t(k, v) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT k, v FROM t")
dialect("src_19_no_from", "SELECT 1 + 1 AS two, 'x' AS x")


@register("src_07_table_variable", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def table_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).script("@every := SELECT * FROM nation; SELECT v.n_regionkey, count(*) AS n FROM @every v GROUP BY v.n_regionkey")


@register("src_09_partitioned_table_function", "SELECT s_nationkey, count(*) * 10 AS n, max(s_acctbal) AS top, arg_max(s_name, s_acctbal) AS best FROM supplier GROUP BY s_nationkey")
def partitioned_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function over each partition of a table, its rows in order, with an argument."""
    def f(key, rows: pd.DataFrame, times: int) -> pd.DataFrame:
        return pd.DataFrame({"s_nationkey": [key[0]], "n": [times * len(rows)], "top": [rows.s_acctbal.iloc[0]], "best": [rows.s_name.iloc[0]]})

    e = Engine(spark, sf_dir)
    e.register("best_of", f, "s_nationkey int, n long, top double, best string")
    return e.sql("SELECT b.* FROM best_of(ON (SELECT s_nationkey, s_acctbal, s_name FROM supplier) q PARTITION BY s_nationkey ORDER BY s_acctbal DESC times(5 * 2)) b")


@register("src_10_tablesample_bucket", "SELECT count(*) AS n FROM orders")
def tablesample_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four buckets of a sample on a key make up the table."""
    e = Engine(spark, sf_dir)
    parts = [e.sql(f"SELECT o_orderkey FROM orders TABLESAMPLE (BUCKET {k} OUT OF 4 ON o_orderkey) s") for k in range(1, 5)]
    both = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return both.agg(F.count_distinct("o_orderkey").alias("n"))


@register("src_18_parameterised_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def parameterised_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with a typed parameter: a SQL table function."""
    e = Engine(spark, sf_dir)
    e.sql("CREATE OR REPLACE TEMPORARY FUNCTION over_price(least DOUBLE) RETURNS TABLE(o_orderkey BIGINT, o_totalprice DOUBLE) RETURN SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > least")
    return e.sql("SELECT * FROM over_price(300000)")


@register("src_27_external_format", "SELECT p_partkey, p_brand FROM part")
def external_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, "PARQUET", f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")


@register("src_30_read_preview", "SELECT count(*) AS n FROM (SELECT n_name FROM nation LIMIT 5)")
def read_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).sql("READ nation (n_name) 5").agg(F.count(F.lit(1)).alias("n"))


# --- projections and filters

dialect("prj_01_columns", "SELECT p_name, p.p_size FROM part p")
dialect("prj_02_alias", "SELECT s_name AS supplier_name, s_acctbal balance FROM supplier")
dialect("prj_03_multi_alias", "SELECT stack(2, 'a', 1, 'b', 2) AS (k, v)", "SELECT * FROM (VALUES ('a', 1), ('b', 2)) t(k, v)")
dialect("prj_04_star", "SELECT r.*, n.n_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")
dialect("prj_05_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect("prj_06_expressions", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS charge FROM lineitem")
dialect("flt_01_where", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5 AND l_discount > 0.05")
dialect("flt_02_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500")
dialect("flt_02_having_global", "SELECT count(*) AS n FROM nation HAVING count(*) > 10")


@register("prj_07_transform", "SELECT upper(n_name) AS name, CAST(n_regionkey AS VARCHAR) AS k FROM nation")
def transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.operators import scripts

    return scripts.transform(read_table(spark, sf_dir, "nation"), ["n_name", "n_regionkey"], "tr a-z A-Z", "name, k")


@register("prj_08_map_reduce", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1")
def map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP to (priority, 1); REDUCE each key's frames to its count."""
    from lakeloom.operators import scripts

    pairs = scripts.map_rows(read_table(spark, sf_dir, "orders").select("o_orderpriority"), lambda b: pd.DataFrame({"p": b.o_orderpriority, "one": 1}), "p string, one long")
    return scripts.reduce_rows(pairs, ["p"], lambda key, frames: pd.DataFrame({"p": [key[0]], "n": [sum(int(b.one.sum()) for b in frames)]}), "p string, n long")


dialect("prd_01_comparison", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <> 20 AND p_size != 30 AND p_retailprice < 1500 AND p_brand == 'Brand#13'", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <> 20 AND p_size <> 30 AND p_retailprice < 1500 AND p_brand = 'Brand#13'")
dialect("prd_02_null_safe_equal", "SELECT v.a FROM VALUES (1, 1), (NULL, NULL), (2, NULL) AS v(a, b) WHERE v.a <=> v.b", "SELECT a FROM (VALUES (1, 1), (NULL, NULL), (2, NULL)) v(a, b) WHERE a IS NOT DISTINCT FROM b")
dialect("prd_03_distinct_from", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS DISTINCT FROM 5")
dialect("prd_04_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_type NOT LIKE 'S%'")
dialect("prd_04_rlike", "SELECT c_custkey FROM customer WHERE c_mktsegment RLIKE '^[A-C]' AND c_name REGEXP '[05]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^[A-C]') AND regexp_matches(c_name, '[05]$')")
dialect("prd_05_in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 4)")
dialect("prd_05_in_tuples", "SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) IN ((1, 1), (2, 2), (0, 0))")
dialect("prd_06_in_subquery", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
dialect("prd_07_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_custkey NOT BETWEEN 10 AND 20")
dialect("prd_08_is_null", "SELECT count(*) AS n FROM (SELECT nullif(p_size, 5) AS s FROM part) t WHERE s IS NOT NULL OR s IS NULL AND 1 = 0")
dialect("prd_09_and_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 OR o_orderpriority = '1-URGENT' AND o_totalprice < 50000")
dialect("prd_10_not", "SELECT n_name FROM nation WHERE NOT n_regionkey = 1 AND !(n_nationkey > 10)", "SELECT n_name FROM nation WHERE NOT n_regionkey = 1 AND NOT (n_nationkey > 10)")
dialect("prd_11_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
dialect("prd_12_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")
dialect("prd_13_parentheses", "SELECT (p_size + 1) * (p_size - 1) AS v, p_partkey FROM part WHERE ((p_size > 10))")

# --- joins

dialect("jon_01_inner", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 250000")
dialect("jon_02_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
dialect("jon_03_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
dialect("jon_04_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000 GROUP BY c.c_custkey")
dialect("jon_05_right", "SELECT s.s_name, n.n_name FROM supplier s RIGHT OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
dialect("jon_06_full", "SELECT a.c_custkey AS a, b.o_custkey AS b FROM customer a FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders) b ON a.c_custkey = b.o_custkey AND a.c_acctbal > 0")
dialect("jon_07_semi", "SELECT c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", "SELECT c_custkey FROM customer c SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c.c_custkey = o.o_custkey")
dialect("jon_08_anti", "SELECT c_custkey FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey")
dialect("jon_09_natural", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y")
dialect("jon_10_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)")
dialect("jon_11_on_several", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey ON l.l_quantity > 45 AND o.o_totalprice > 150000", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45 AND o.o_totalprice > 150000")
dialect("jon_11_on_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
dialect("jon_16_left_deep", "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
dialect("jon_17_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
dialect("jon_19_lateral_in_chain", "SELECT x.n_name, t.w, r.r_name FROM nation x LATERAL VIEW explode(split(n_name, '_')) t AS w JOIN region r ON r.r_regionkey = x.n_regionkey", "SELECT x.n_name, x.w, r.r_name FROM (SELECT *, unnest(string_split(n_name, '_')) AS w FROM nation) x JOIN region r ON r.r_regionkey = x.n_regionkey")
# every key of both tables; that of a customer in debt is negative here, so that both sides have gaps
dialect("jon_14_uniquejoin", "SELECT a.k AS ak, b.k AS bk FROM UNIQUEJOIN PRESERVE (SELECT DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END AS k FROM customer) a (k), PRESERVE (SELECT DISTINCT o_custkey AS k FROM orders) b (k)", "SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k")


@register("jon_12_range", "SELECT s.s_suppkey, b.lo FROM supplier s JOIN (SELECT CAST(unnest(range(-1000, 10000, 500)) AS DOUBLE) AS lo) b ON s.s_acctbal BETWEEN b.lo AND b.lo + 700")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(-1000, 10000, 500).select(F.col("id").cast("double").alias("lo")).withColumn("hi", F.col("lo") + 700)
    return joins.range_join(read_table(spark, sf_dir, "supplier"), bands, "s_acctbal", "lo", "hi", 500.0).select("s_suppkey", "lo")


@register("jon_12_range_outer", "SELECT s.s_suppkey, b.lo FROM supplier s FULL JOIN (SELECT CAST(unnest(range(-30000, 30000, 1000)) AS DOUBLE) AS lo) b ON s.s_acctbal BETWEEN b.lo AND b.lo + CASE WHEN b.lo = 2000 THEN 1000000 ELSE 900 END")
def range_join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands without suppliers, suppliers between bands, and one band of a thousand times the others' length."""
    bands = spark.range(-30000, 30000, 1000).select(F.col("id").cast("double").alias("lo")).withColumn("hi", F.expr("lo + CASE WHEN lo = 2000 THEN 1000000 ELSE 900 END"))
    return joins.range_join(read_table(spark, sf_dir, "supplier"), bands, "s_acctbal", "lo", "hi", 300.0, "full").select("s_suppkey", "lo")


@register("jon_15_user_defined", "SELECT n_regionkey AS k, count(*) AS nations, min(n_name) AS first, max(r_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def user_defined_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN .. USING f(..): the function gets both sides' rows of a key, in order."""
    e = Engine(spark, sf_dir)
    e.register("matched", lambda a, b: pd.DataFrame({"k": a.k0[:1], "nations": [len(a)], "first": a.n_name[:1].tolist(), "name": b.r_name[:1].tolist()}), "k int, nations long, first string, name string")
    return e.sql("SELECT m.k, m.nations, m.first, m.name FROM (SELECT n_regionkey, n_name FROM nation) n JOIN region r ON n.n_regionkey = r.r_regionkey USING matched(n.n_name, r.r_name) m AS (k, nations, first, name) SORT BY n.n_name WHERE m.nations > 0")


@register("hnt_02_skewjoin_salted", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 100000")
def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    orders = read_table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"))
    return joins.salted_join(line, orders, "k", 4).agg(F.count(F.lit(1)).alias("n"))


# --- aggregates

dialect("agg_01_group_by", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
dialect("agg_01_group_by_expression", "SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
dialect("agg_02_ordinal", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
dialect("agg_03_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)")
dialect("agg_04_rollup", "SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 2) AS a FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")
dialect("agg_05_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS TINYINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
dialect("agg_05_nested_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS (ROLLUP(o_orderstatus, o_orderpriority), (o_orderpriority))")
dialect("agg_06_with_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority WITH ROLLUP", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")
dialect("agg_06_with_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority WITH CUBE", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)")
dialect("agg_06_sets_suffix", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority GROUPING SETS ((o_orderstatus), (o_orderpriority))", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
dialect("agg_07_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey, l_suppkey) AS ps FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT (l_partkey, l_suppkey)) AS ps FROM lineitem GROUP BY l_returnflag")
dialect("agg_08_count_star", "SELECT count(*) AS n FROM lineitem")
dialect("agg_09_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS dear, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 2) AS low FROM orders GROUP BY o_orderstatus")
dialect("agg_10_within_group", "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS med FROM orders GROUP BY o_orderstatus")
dialect("agg_11_global", "SELECT round(sum(o_totalprice), 2) AS s, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
dialect("agg_12_count", "SELECT count(nullif(p_size, 5)) AS n FROM part")
dialect("agg_13_sum", "SELECT p_brand, sum(p_size) AS s FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand")
dialect("agg_14_avg", "SELECT p_brand, round(avg(p_size), 6) AS a FROM part GROUP BY p_brand")
dialect("agg_15_min", "SELECT c_mktsegment, min(c_acctbal) AS m FROM customer GROUP BY c_mktsegment")
dialect("agg_16_max", "SELECT c_mktsegment, max(c_acctbal) AS m FROM customer GROUP BY c_mktsegment")
dialect("agg_17_group_concat", "SELECT n_regionkey, group_concat(n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
dialect("agg_18_stddev", "SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS s FROM customer GROUP BY c_mktsegment")
dialect("agg_19_variance", "SELECT c_mktsegment, round(variance(c_acctbal), 2) AS v FROM customer GROUP BY c_mktsegment")
dialect("agg_20_collect_list", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
dialect("agg_21_collect_set", "SELECT o_orderstatus, array_join(sort_array(collect_set(o_orderpriority)), ',') AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
dialect("agg_23_approximate", "SELECT abs(approx_count_distinct(l_partkey, 0.01) - count(DISTINCT l_partkey)) <= 0.05 * count(DISTINCT l_partkey) AS near FROM lineitem", "SELECT true AS near")


@register("agg_24_table_statistics", "SELECT 'orders' AS \"table\", * FROM (SELECT 'TABLE_COUNT' AS kind, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'DISTINCT_VALUE', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'COLUMN_MAX', max(o_totalprice) FROM orders UNION ALL SELECT 'NULL_VALUE', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders UNION ALL SELECT 'EXPRESSION_CONDITION', count(*) FILTER (WHERE o_totalprice > 1000) FROM orders)")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sf_dir)
    out = None
    for s in ("TABLE_COUNT", "DISTINCT_VALUE o_custkey", "COLUMN_MAX o_totalprice", "NULL_VALUE o_custkey", "EXPRESSION_CONDITION o_totalprice > 1000"):
        one = e.sql(f"ADD STATISTIC orders {s}")
        out = one if out is None else out.unionAll(one)
    return out


# --- set operations

_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"
dialect("set_01_union", f"{_A} UNION {_B}")
dialect("set_02_union_all", f"{_A} UNION ALL {_B}")
dialect("set_03_intersect", f"{_A} INTERSECT {_B}")
dialect("set_04_intersect_all", f"{_A} INTERSECT ALL {_B}")
dialect("set_05_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
dialect("set_06_except_all", f"{_A} EXCEPT ALL {_B}")
dialect("set_07_minus", "SELECT n_nationkey AS k FROM nation MINUS SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
dialect("set_07_minus_all", f"{_A} MINUS ALL {_B}", f"{_A} EXCEPT ALL {_B}")
dialect("set_08_parenthesised", f"(({_A}) UNION ({_B})) INTERSECT (SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3)")

# --- sorts, limits, layout

dialect("srt_01_order_by", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name ASC")
dialect("srt_02_nulls", "SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation ORDER BY k DESC NULLS FIRST, n_name NULLS LAST")
dialect("srt_03_sort_by", "SELECT n_name FROM nation SORT BY n_name", "SELECT n_name FROM nation")
dialect("srt_04_distribute_by", "SELECT n_name, n_regionkey FROM nation DISTRIBUTE BY n_regionkey", "SELECT n_name, n_regionkey FROM nation")
dialect("srt_05_cluster_by", "SELECT n_name, n_regionkey FROM nation CLUSTER BY n_regionkey", "SELECT n_name, n_regionkey FROM nation")
dialect("srt_06_zorder_by", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ZORDER BY o_custkey, o_totalprice", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
dialect("lim_01_limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7")
dialect("lim_02_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10")
dialect("lim_03_limit_pair", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10, 5", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10")
dialect("lim_04_expression", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 + 5")
dialect("lim_05_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")


@register("srt_06_z_value", "SELECT n_nationkey, (n_nationkey & 1) | ((n_regionkey & 1) << 1) | ((n_nationkey & 2) << 1) | ((n_regionkey & 2) << 2) | ((n_nationkey & 4) << 2) | ((n_regionkey & 4) << 3) AS z FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation)")
def z_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), layout.z_value([F.col("n_nationkey"), F.col("n_regionkey")], 3).alias("z"))


# --- hints

_J = "n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"
for _name, _hint in (("hnt_01_mapjoin", "MAPJOIN(r)"), ("hnt_02_skewjoin", "SKEWJOIN(n(n_regionkey)((1),(2)))"), ("hnt_03_dynamicfilter", "DYNAMICFILTER(n, r)"), ("hnt_04_selectivity", "SELECTIVITY(0.1)"), ("hnt_05_streamtable", "STREAMTABLE(n)")):
    dialect(_name, f"SELECT /*+ {_hint} */ {_J}", f"SELECT {_J}")
dialect("hnt_06_hint_after_from", "SELECT n.n_name, r.r_name FROM /*+ MAPJOIN(r) */ nation n JOIN region r ON n.n_regionkey = r.r_regionkey", f"SELECT {_J}")

# --- whole queries

dialect("q_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
dialect("q_customer_revenue", "SELECT c.c_custkey, c.c_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' GROUP BY c.c_custkey, c.c_name ORDER BY revenue DESC, c.c_custkey LIMIT 20")
dialect("q_region_volume", "SELECT r.r_name, n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS volume FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY r.r_name, n.n_name")
