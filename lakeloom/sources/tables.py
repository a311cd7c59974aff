"""Loading tables: a folder of Parquet tables as views, and single sources by format."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: The tables of the test data.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def use_folder(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """A temporary view for each table of a folder (or those named): their footers are read, not their rows."""
    for name in names or TABLES:
        read_table(spark, folder, name).createOrReplaceTempView(name)


def read_source(spark: SparkSession, fmt: str, path: str, options: Mapping[str, str] | None = None, row_format: Mapping[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """``STORED AS fmt LOCATION path``. ``row_format``: fields, lines, null, as a delimited row format names them.

    SERDE-like row formats apply to text files; column types come from ``schema`` or the file.
    """
    kinds = {"textfile": "csv", "parquet": "parquet", "orc": "orc", "json": "json", "csv": "csv", "text": "text"}
    opts = dict(options or {})
    for name, key in (("fields", "sep"), ("lines", "lineSep"), ("null", "nullValue")):
        if row_format and name in row_format:
            opts[key] = row_format[name]
    reader = spark.read.format(kinds.get(fmt.lower(), fmt)).options(**opts)
    return (reader.schema(schema) if schema else reader).load(path)
