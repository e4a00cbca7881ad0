"""Incremental ingest: record tables that arrive as files are normalised and merged into a collection by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenegrain.ingest.normalize import normalise
from scenegrain.sources.versions import current, publish


def upsert(spark: SparkSession, path: str, batch: DataFrame, order: str = "ingested_at") -> None:
    """The newest row of each id, of the collection and the batch, as the collection's next version; readers see the old one until it is whole.

    Rows of one id that are equally new are told apart by their content, so that a batch ingested again changes nothing. The version
    is written as a whole: gather small batches before.
    """
    old = current(spark, path)
    both = batch if old is None else spark.read.parquet(old).unionByName(batch, allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last(order), F.desc(F.to_json(F.struct(*[F.col(f"`{c}`") for c in both.columns]))))
    publish(both.withColumn("r_", F.row_number().over(w)).filter("r_ = 1").drop("r_"), path)


def ingest_stream(spark: SparkSession, incoming: str, path: str, checkpoint: str, schema, order: str = "ingested_at", **kw):
    """A query that ingests what has arrived and ends; run it again for what comes later. A batch that is repeated after a failure changes nothing."""
    stream = spark.readStream.schema(schema).parquet(incoming)

    def each(batch: DataFrame, _: int) -> None:
        upsert(spark, path, normalise(batch, **kw), order)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


