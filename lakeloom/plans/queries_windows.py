"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import frames
from lakeloom.plans.registry import dialect, register
from lakeloom.sources.tables import read_table

_O = "o_orderkey, o_custkey"
dialect("win_01_call", f"SELECT {_O}, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rn FROM orders")
dialect("win_02_inline_spec", f"SELECT {_O}, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS run FROM orders")
dialect("win_03_named", f"SELECT {_O}, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
dialect("win_04_extended", f"SELECT {_O}, CAST(row_number() OVER (w ORDER BY o_orderkey) AS INT) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey)")
dialect("win_05_distribute_sort", f"SELECT {_O}, CAST(row_number() OVER (DISTRIBUTE BY o_custkey SORT BY o_orderkey) AS INT) AS rn FROM orders", f"SELECT {_O}, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS rn FROM orders")
dialect("win_06_rows", f"SELECT {_O}, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders")
dialect("win_07_range", f"SELECT {_O}, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS n FROM orders")
dialect("win_09_single_bound", f"SELECT {_O}, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 1 PRECEDING) AS m FROM orders")
dialect("win_10_bounds", f"SELECT {_O}, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM orders")
dialect("win_12_ranking", f"SELECT {_O}, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INT) AS a, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INT) AS b, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INT) AS c FROM orders")
dialect("win_13_aggregates", f"SELECT {_O}, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS a FROM orders")
dialect("win_14_analytic", f"SELECT {_O}, lag(o_totalprice) OVER w AS p, lead(o_totalprice, 2, 0) OVER w AS q, first_value(o_orderstatus) OVER w AS f, ntile(3) OVER w AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", f"SELECT {_O}, lag(o_totalprice) OVER w AS p, lead(o_totalprice, 2, 0) OVER w AS q, first_value(o_orderstatus) OVER w AS f, CAST(ntile(3) OVER w AS INTEGER) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
dialect("win_15_inside_expression", f"SELECT {_O}, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
dialect("agg_09_filter_over", f"SELECT {_O}, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 1 PRECEDING) AS s FROM orders", f"SELECT {_O}, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 1 PRECEDING) AS s FROM orders")


_G = "PARTITION BY o_custkey ORDER BY o_orderpriority DESC"
dialect("win_08_groups", f"SELECT {_O}, count(*) OVER ({_G} GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, round(sum(o_totalprice) OVER ({_G} GROUPS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 2) AS s FROM orders")
dialect("win_08_groups_named", f"SELECT {_O}, max(o_totalprice) OVER w AS m, min(o_orderkey) OVER (w) AS k FROM orders WINDOW w AS ({_G} GROUPS 1 PRECEDING)", f"SELECT {_O}, max(o_totalprice) OVER w AS m, min(o_orderkey) OVER w AS k FROM orders WINDOW w AS ({_G} GROUPS 1 PRECEDING)")


def _all(frame: str) -> str:
    each = (("sum(o_orderkey)", "s"), ("count(o_orderkey)", "c"), ("avg(o_orderkey)", "a"), ("min(o_orderkey)", "lo"), ("max(o_orderkey)", "hi"))
    cast = {"s": "CAST({} AS BIGINT)", "a": "round({}, 6)"}
    return ", ".join(f"{cast.get(n, '{}').format(f'{f} OVER ({frame})')} AS {n}" for f, n in each)


_WHOLE, _UNIQUE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "PARTITION BY o_custkey ORDER BY o_orderkey"
for _k in ("current row", "group", "ties", "no others"):
    dialect(f"win_11_exclude_{_k.replace(' ', '_')}", f"SELECT o_orderkey, {_all(f'{_G} {_WHOLE} EXCLUDE {_k.upper()}')} FROM orders")
    dialect(f"win_11_groups_exclude_{_k.replace(' ', '_')}", f"SELECT o_orderkey, {_all(f'{_G} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE {_k.upper()}')} FROM orders")
dialect("win_11_rows_exclude_current_row", f"SELECT o_orderkey, {_all(f'{_UNIQUE} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW')} FROM orders")
dialect("win_11_range_exclude_ties", "SELECT s_suppkey, CAST(sum(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 7 RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS BIGINT) AS s, count(*) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 7 RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS n FROM supplier")


@register("win_08_groups_frame", f"SELECT {_O}, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders")
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a DataFrame."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return frames.groups_frame(o, ["o_custkey"], ["o_orderpriority"], -1, 0, n=F.count(F.lit(1))).drop("o_orderpriority")
