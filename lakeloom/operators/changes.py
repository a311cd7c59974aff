"""DELETE, UPDATE and MERGE on plain tables, as one pass that gives the table's new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delete(df: DataFrame, where: str | Column) -> DataFrame:
    """Rows for which the condition is not true."""
    cond = F.expr(where) if isinstance(where, str) else where
    return df.where(~F.coalesce(cond, F.lit(False)))


def update(df: DataFrame, set_: dict[str, str], where: str | None = None) -> DataFrame:
    cond = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    types = dict(df.dtypes)
    return df.select(*(F.when(cond, F.expr(set_[c])).otherwise(F.col(c)).cast(types[c]).alias(c) if c in set_ else F.col(c) for c in df.columns))


def merge(target: DataFrame, source: DataFrame, on: str, matched: list[tuple[str | None, str, dict[str, str]]], missing: list[tuple[str | None, dict[str, str]]], t: str = "t", s: str = "s") -> DataFrame:
    """MERGE INTO target USING source: one full outer join, then the first clause that applies.

    ``matched``: (condition, "update" or "delete", assignments); ``missing``: (condition, values by column). A target row that several
    source rows would change is an error, as it is in SQL; one that several meet and one or none changes comes once. Whether any
    row is met by several is found first, by a join of the keys alone; only then are the rows of one target row brought together.
    """
    a = target.withColumn("__t", F.monotonically_increasing_id()).alias(t)
    b = source.withColumn("__s", F.lit(True)).alias(s)
    both = a.join(b, F.expr(on), "full_outer")
    is_t, is_s = F.col(f"{t}.__t").isNotNull(), F.col(f"{s}.__s").isNotNull()
    ok = lambda c: F.coalesce(F.expr(c), F.lit(False)) if c else F.lit(True)
    act = F.lit("keep")
    for k, (cond, _, _) in reversed(list(enumerate(matched))):
        act = F.when(is_t & is_s & ok(cond), f"m{k}").otherwise(act)
    for k, (cond, _) in reversed(list(enumerate(missing))):
        act = F.when(~is_t & ok(cond), f"i{k}").otherwise(act)
    both = both.withColumn("__act", F.when(~is_t & (act == "keep"), "drop").otherwise(act))
    if not a.join(b, F.expr(on)).groupBy("__t").count().where("count > 1").isEmpty():
        row = Window.partitionBy(F.coalesce(F.col(f"{t}.__t"), -1 - F.monotonically_increasing_id()))
        changes_ = F.col("__act").startswith("m")
        both = both.withColumn("__many", F.count_if(changes_).over(row)).withColumn("__n", F.row_number().over(row.orderBy(F.when(changes_, 0).otherwise(1))))
        error = F.raise_error(F.lit("MERGE: several source rows change one target row")).cast("string")
        both = both.withColumn("__act", F.when(is_t & (F.col("__many") > 1), error).when(is_t & (F.col("__n") > 1), "drop").otherwise(F.col("__act")))
    gone = [f"m{k}" for k, (_, what, _) in enumerate(matched) if what == "delete"] + ["drop"]
    types, cols = dict(target.dtypes), []
    for c in target.columns:
        v = F.col(f"{t}.{c}")
        for k, (_, what, set_) in enumerate(matched):
            if what == "update" and c in set_:
                v = F.when(F.col("__act") == f"m{k}", F.expr(set_[c])).otherwise(v)
        for k, (_, values) in enumerate(missing):
            v = F.when(F.col("__act") == f"i{k}", F.expr(values[c]) if c in values else F.lit(None)).otherwise(v)
        cols.append(v.cast(types[c]).alias(c))
    return both.where(~F.col("__act").isin(*gone)).select(*cols)
