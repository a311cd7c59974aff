"""Shared plumbing: tables in the cluster's shared folder, connected components, Arrow helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors' Python workers, once for each Spark context.

    Arrow batches of long texts are wanted small (unless the session says otherwise): each task holds some of them, on both sides.
    """
    sc = spark.sparkContext
    if not spark._jsparkSession.conf().getAll().contains(_ROWS):
        spark.conf.set(_ROWS, "1000")
    if not getattr(sc, "_lakeloom_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        made = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lakeloom-")), "lakeloom_code.zip")
        with zipfile.ZipFile(made, "w") as z:
            for folder, _, names in os.walk(os.path.join(top, "lakeloom")):
                for name in names:
                    if name.endswith((".py", ".npz", ".txt")):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
        sc.addPyFile(made)
        sc._lakeloom_shipped = True
    return spark


class Workspace:
    """Parquet tables in the shared folder. They cut lineage, so a lost executor costs one step only.

    What ``drop`` and ``finish`` leave goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str = "snappy"):
        self.spark, self.codec = ship(spark), codec
        self.base = f"{shared_dir(spark)}/lakeloom-{name}-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", self.codec).parquet(path)
        fs, at = self._fs(self.base)
        fs.deleteOnExit(at)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark remove shuffle files of finished steps now: it does so when the driver's garbage goes."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            fs, at = self._fs(f"{self.base}/{name}")
            fs.delete(at, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Write the result, remove the other tables; the result goes when the session ends."""
        path = f"{self.base}-result"
        df.write.parquet(path)
        fs, at = self._fs(path)
        fs.deleteOnExit(at)
        fs, at = self._fs(self.base)
        fs.delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` narrow rows, in as few partitions as a million rows each need: small tables make few files."""
    return df.coalesce(1 + rows // 1_000_000)


def near(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``ids``, a table of few columns, marked for broadcast while its rows, which are counted, are at most ``most``."""
    return F.broadcast(ids) if ids.count() <= most else ids


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``left`` joined with ``right``: each key at most once in ``right``, with ``c``, how many rows of ``left`` have it.

    ``total`` is no less than the sum of ``c``, so at most 16 keys a partition can have more than their sixteenth of a partition's
    share. Those are broadcast, and the rows of ``left`` that have them stay where they are; the rest meets by shuffle. ``right`` is read
    several times and should be a table, or cheap.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(1, total // (16 * parts))
    hot, cold = right.where(F.col("c") > least).drop("c"), right.where(F.col("c") <= least).drop("c")
    if hot.isEmpty():
        return left.join(cold.hint("shuffle_hash"), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(cold.hint("shuffle_hash"), keys))


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), component the smallest node reachable.

    Alternates the large-star and small-star steps, each a grouped minimum and a join, until the edges stay
    the same; then every edge is (node, smallest). Nothing is gathered on the driver but two sums a round. The
    edges of a node of very many meet in one partition of a join, which adaptive execution splits where it is large.
    Nulls and loops are ignored; an empty input gives an empty result.
    """
    e = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")

    def mark(x: DataFrame):
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was, k = mark(e), 0
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        k += 1
        e_next = ws.save(few_files(low.select("u", F.col("m").alias("v")).unionByName(small).distinct(), was[0]), f"{name}{k}")
        ws.drop(f"{name}{k - 1}")
        e, now = e_next, mark(e_next)
        if now == was:
            break
        was = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return few_files(out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), 2 * was[0])


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of smallest hash of ``key``: the same at any partitioning.

    A first filter leaves little more than that of any number of rows, so the sort stays small.
    """
    share = min(1.0, (most + 6 * most**0.5 + 20) / max(1, df.count()))
    bound = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    return df.withColumn("__h", F.xxhash64(key)).where(F.col("__h") <= bound).orderBy("__h", key).limit(most).drop("__h")


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where a text column passes ``most`` bytes, so that memory follows bytes and not rows."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    at = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def long_list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))
