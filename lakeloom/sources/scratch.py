"""Places to write to: paths and table names that nothing else has, in the warehouse, which all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def path(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lakeloom_scratch/{name}_{uuid.uuid4().hex}"


def table(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:12]}"
