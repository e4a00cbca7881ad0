"""Tables replaced as a whole: each version in a folder of its own, and a pointer that is moved when it is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scenegrain.sources import store

POINTER = "_current"


def current(spark: SparkSession, path: str) -> str | None:
    name = store.read_text(spark, f"{path.rstrip('/')}/{POINTER}")
    return f"{path.rstrip('/')}/{name.strip()}" if name else None


def publish(df: DataFrame, path: str) -> str:
    at = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(at)
    store.write_text(df.sparkSession, f"{path.rstrip('/')}/{POINTER}", at.rsplit("/", 1)[1])
    return at
