"""GeoParquet metadata: geometry types from WKB headers, and the ``geo`` key in file footers."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain.functions import wkb


def type_code(geometry: Column) -> Column:
    """The base type of WKB: the low byte of the code, in either byte order."""
    h = F.hex(geometry)
    return F.conv(F.when(F.substring(h, 1, 2) == "01", F.substring(h, 3, 2)).otherwise(F.substring(h, 9, 2)), 16, 10).try_cast("int")


def type_name(geometry: Column) -> Column:
    code, out = type_code(geometry), F.lit(None).cast("string")
    for k, v in wkb.TYPE_NAMES.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return F.when(F.length(geometry) >= 5, out)


def geometry_types(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Distinct type names, sorted."""
    return df.select(type_name(F.col(geometry)).alias("geometry_type")).filter("geometry_type IS NOT NULL").distinct().orderBy("geometry_type")


def geo_metadata(df: DataFrame, geometry: str = "geometry") -> dict:
    """The GeoParquet 1.1 document of a table with WKB in lon/lat, and its box column as covering."""
    column: dict = {"encoding": "WKB", "geometry_types": [r[0] for r in geometry_types(df, geometry).collect()]}  # at most seven names
    if "bbox" in df.columns:
        column["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    return {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}}


def stamp(spark: SparkSession, path: str, geo: dict) -> None:
    """Write the ``geo`` key into the footer of every file under ``path``, file by file, in parallel."""
    files = spark.read.parquet(path).inputFiles()

    def run(batches):
        for b in batches:
            done = []
            for f in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(f)
                with pq.ParquetFile(at, filesystem=system) as src:
                    schema = src.schema_arrow
                    schema = schema.with_metadata({**(schema.metadata or {}), b"geo": json.dumps(geo).encode()})
                    with pq.ParquetWriter(f"{at}.tmp", schema, filesystem=system, compression="zstd") as out:
                        for i in range(src.num_row_groups):
                            out.write_table(src.read_row_group(i).cast(schema))
                system.move(f"{at}.tmp", at)
                if isinstance(system, fs.LocalFileSystem):
                    import os

                    crc = os.path.join(os.path.dirname(at), f".{os.path.basename(at)}.crc")
                    if os.path.exists(crc):
                        os.remove(crc)
                done.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 64))).mapInArrow(run, "file string").count()
