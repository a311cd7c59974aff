"""GROUPS frames on a DataFrame, from built-in frames; in texts, and with exclusions, see ``plans.framing``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[str], start: int | None, end: int | None, **aggs: Column) -> DataFrame:
    """``GROUPS BETWEEN start AND end`` (peer groups, None: unbounded): a RANGE frame over the dense rank of the order.

    ``aggs`` are aggregate columns by name.
    """
    ranked = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy("__g").rangeBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)
    return ranked.select("*", *(a.over(w).alias(k) for k, a in aggs.items())).drop("__g")
