"""The flagship query: one dialect text through rewriting, Catalyst and execution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans.engine import Engine

TEXT = """
WITH sold AS ( -- revenue of each order
  SELECT o.o_custkey, o.o_orderkey, sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  WHERE o.o_orderdate >= DATETIME '1995-01-01 00:00:00'
  GROUP BY o.o_custkey, o.o_orderkey
)
SELECT c.c_custkey, c.c_name, round(sum(s.revenue), 2) AS revenue, count(*) AS orders
FROM customer c LEFT JOIN sold s ON s.o_custkey = c.c_custkey
WHERE c.c_acctbal > 0
GROUP BY c.c_custkey, c.c_name
HAVING count(*) > 1
ORDER BY revenue DESC NULLS LAST, c.c_custkey
LIMIT 0, 50
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).sql(TEXT)
