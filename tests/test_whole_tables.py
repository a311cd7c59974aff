"""Join and variable queries take in every key of their tables, with gaps on the sides that may have them."""

from lakeloom.plans import registry


def run(name, spark, data):
    return registry.queries()[name](spark, data).toPandas()


def keys(spark, data, table, column):
    return {r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(column).collect()}


def test_full_join_and_unique_join(spark, data):
    customers, buyers = keys(spark, data, "customer", "c_custkey"), keys(spark, data, "orders", "o_custkey")
    for name in ("jon_06_full", "jon_14_uniquejoin"):
        got = run(name, spark, data)
        left, right = got.columns
        assert {abs(int(x)) for x in got[left].dropna()} == customers and set(got[right].dropna()) == buyers
        assert got[left].isna().any() and got[right].isna().any() and (got[left] == got[right]).any()


def test_left_deep_join(spark, data):
    got = run("jon_16_left_deep", spark, data)
    assert set(got.c_custkey) == keys(spark, data, "customer", "c_custkey") and set(got.o_orderkey.dropna()) == keys(spark, data, "orders", "o_orderkey")


def test_table_variable(spark, data):
    assert run("src_07_table_variable", spark, data).n.sum() == len(keys(spark, data, "nation", "n_nationkey"))
