"""Joins beyond the built-in types: user-defined, unique, range with bucket keys, skew by salt."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def user_defined_join(left: DataFrame, right: DataFrame, keys: list[str], f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, sort: list[str] | None = None) -> DataFrame:
    """``JOIN b ON k USING udj(...) AS (...)``: ``f`` gets both sides' rows of a key, sorted by ``sort`` where a side has those columns."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if sort:
            a, b = (x.sort_values([c for c in sort if c in x.columns], kind="stable") if any(c in x.columns for c in sort) else x for x in (a, b))
        return f(a, b)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def unique_join(sides: list[tuple[DataFrame, str, bool]], key: str = "k") -> DataFrame:
    """``UNIQUEJOIN``: (frame, key column, preserve) for each side, joined on the keys in order."""
    first, name, kept = sides[0]
    out = first.withColumnRenamed(name, key)
    for df, name, keep in sides[1:]:
        out = out.join(df.withColumnRenamed(name, key), key, "full" if kept and keep else "left" if kept else "right" if keep else "inner")
        kept = kept or keep
    return out


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float | None = None, how: str = "inner") -> DataFrame:
    """``ON point BETWEEN low AND high`` by buckets: an equi-join on the bucket, then the condition; any kind of join.

    Each interval enters the buckets of ``width`` that it covers; one of more than 64 goes to buckets 64 times as wide, and so on, so that
    none enters more than 65. Each point looks in its bucket of each width there is. So the work follows the rows that
    meet and not the product of the sides. Without a width, it is the mean length of the intervals. Rows with null bounds or points
    meet nothing. The widths come from one aggregate of ``right``.
    """
    length = (F.col(high) - F.col(low)).cast("double")
    mean, most = right.where(F.col(low) <= F.col(high)).agg(F.avg(length), F.max(length)).first()
    width = float(width or mean or 1.0)
    top = 0
    while most is not None and most > 64 * width * 64**top:
        top += 1
    kind = how.lower().replace("outer", "").replace("_", "")
    outer_left, outer_right = kind in ("left", "full"), kind in ("right", "full")
    level = F.lit(0)
    for k in range(top):
        level = F.when(length > 64 * width * 64**k, F.lit(k + 1)).otherwise(level)
    size = F.lit(width) * F.pow(F.lit(64.0), F.col("__l"))
    b = right.withColumn("__r", F.monotonically_increasing_id()).withColumn("__l", level)
    cells = F.when(F.col(low) <= F.col(high), F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))
    b = b.withColumn("__b", F.explode_outer(cells) if outer_right else F.explode(cells))
    a = left.withColumn("__a", F.monotonically_increasing_id()).withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(top))) if top else F.lit(0))
    a = a.withColumn("__b", F.floor(F.col(point) / size))
    met = (a["__l"] == b["__l"]) & (a["__b"] == b["__b"]) & (a[point] >= b[low]) & (a[point] <= b[high])
    if kind in ("leftsemi", "semi"):
        return _once(a.join(b, met, "left_semi"), "__a", None).drop("__a", "__l", "__b") if top else a.join(b, met, "left_semi").drop("__a", "__l", "__b")
    if kind in ("leftanti", "anti"):
        meets = F.max(F.col("__r").isNotNull()).over(Window.partitionBy("__a"))
        lone = _once(a.join(b.select("__l", "__b", low, high, "__r"), met, "left").withColumn("__met", meets).where("NOT __met"), "__a", None)
        return lone.select(*left.columns)
    out = a.join(b, met, kind if kind in ("inner", "left", "right", "full") else how).drop("__l", "__b")
    if outer_left and top:
        out = _once(out, "__a", "__r")
    if outer_right:
        out = _once(out, "__r", "__a")
    return out.drop("__a", "__r")


def _once(df: DataFrame, key: str, other: str | None) -> DataFrame:
    """Rows that met, and of each ``key`` that met nothing one row; without ``other``, one row of each key. Rows without a key stay."""
    own = Window.partitionBy(F.coalesce(F.col(key), -1 - F.monotonically_increasing_id()))
    some = F.lit(False) if other is None else F.col(other).isNotNull()
    marked = df.withColumn("__m", some).withColumn("__any", F.max(some).over(own)).withColumn("__n", F.row_number().over(own.orderBy(F.col(key))))
    return marked.where(F.col("__m") | F.col(key).isNull() | (~F.col("__any") & (F.col("__n") == 1))).drop("__m", "__any", "__n")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """``SKEWJOIN`` by hand: the left side's keys are dealt over ``salts`` parts, the right side is copied to each.

    A copied row can't be kept once for having met nothing, so right and full joins are refused; adaptive execution splits those.
    """
    if how.lower().replace("_", "").replace("outer", "") in ("right", "full"):
        raise ValueError(f"no salt for a {how} join: its unmatched rows would come {salts} times")
    a = left.withColumn("__s", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "__s"], how).drop("__s")
