"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. On one machine a folder is made where it is unset; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="amberlode-core-"))
        at = _LOCAL[0]
    return at.rstrip("/")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written and read again: their lineage ends there."""
    path = f"{folder(rows.sparkSession)}/core-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
