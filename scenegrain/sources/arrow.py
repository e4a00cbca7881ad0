"""Tables of other Arrow producers as DataFrames."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession


def as_table(obj) -> pa.Table:
    """An Arrow table of a table, batch, reader, dataset, stream capsule, or an object with one of the usual export methods."""
    if isinstance(obj, pa.Table):
        return obj
    if isinstance(obj, pa.RecordBatch):
        return pa.Table.from_batches([obj])
    if isinstance(obj, pa.RecordBatchReader):
        return obj.read_all()
    if isinstance(obj, pads.Dataset):
        return obj.to_table()
    if hasattr(obj, "__arrow_c_stream__"):
        return pa.RecordBatchReader.from_stream(obj).read_all()
    for method in ("to_arrow_table", "fetch_arrow_table", "arrow", "to_arrow", "toArrow"):
        if hasattr(obj, method):
            return as_table(getattr(obj, method)())
    return pa.table(obj)


def as_dataframe(spark: SparkSession, obj) -> DataFrame:
    """DataFrames stay; paths are read as Parquet; all else goes through an Arrow table, which must fit the driver."""
    if isinstance(obj, DataFrame):
        return obj
    if isinstance(obj, str):
        return spark.read.parquet(obj)
    return spark.createDataFrame(as_table(obj))
