"""Row layout: z-order, bucket samples, partition specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def z_value(columns: list[Column], bits: int = 16) -> Column:
    """Interleaved bits of columns that are integers from 0 to 2**bits - 1."""
    n = len(columns)
    out = F.lit(0).cast("bigint")
    for b in range(min(bits, 63 // n)):
        for i, c in enumerate(columns):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("bigint"), b).bitwiseAND(F.lit(1)), b * n + i))
    return out


def z_order(df: DataFrame, names: list[str], partitions: int | None = None, bits: int = 16) -> DataFrame:
    """``ZORDER BY``: rows near in all of ``names`` come near in the files.

    Each column becomes its place among 2**bits steps of its range (numbers) or of its hash (other types); one aggregate finds
    the ranges. Then rows are range-partitioned and sorted by the interleaved value.
    """
    bits = min(bits, 63 // len(names))
    kinds = dict(df.dtypes)
    numeric = [c for c in names if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")]
    num = {c: (F.col(c).cast("timestamp").cast("double") if kinds[c] in ("date", "timestamp") else F.col(c).cast("double")) for c in numeric}
    edge = df.agg(*[f(num[c]).alias(f"{f.__name__}_{c}") for c in numeric for f in (F.min, F.max)]).first() if numeric else {}
    steps = []
    for c in names:
        if c in num:
            lo, hi = edge[f"min_{c}"], edge[f"max_{c}"]
            width = (hi - lo) if lo is not None and hi > lo else 1.0
            steps.append(F.coalesce(F.floor((num[c] - F.lit(lo or 0.0)) / F.lit(width) * ((1 << bits) - 1)), F.lit(0)))
        else:
            steps.append(F.pmod(F.xxhash64(c), F.lit(1 << bits)))
    z = df.withColumn("__z", z_value(steps, bits))
    z = z.repartitionByRange(partitions, "__z") if partitions else z.repartitionByRange("__z")
    return z.sortWithinPartitions("__z").drop("__z")


def bucket_sample(df: DataFrame, bucket: int, of: int, *on: str) -> DataFrame:
    """``TABLESAMPLE (BUCKET bucket OUT OF of ON ...)``: the rows whose hash falls in one bucket."""
    return df.where(F.pmod(F.hash(*on), F.lit(of)) == bucket - 1)


def partition_spec(df: DataFrame, spec: dict[str, object]) -> DataFrame:
    """``tab PARTITION (k = v, ...)``: a filter, which prunes folders where k is a partition column. A value of None means any."""
    for k, v in spec.items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    return df
