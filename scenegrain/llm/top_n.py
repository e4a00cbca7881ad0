"""The N best items of every group (problem 7), by skipping row groups on their statistics.

``cluster_files`` writes the items once, ordered by group and score, in row groups of ``ROW_GROUP_ROWS`` rows. A row group with
several groups holds the best rows of all of them but perhaps the first, so it always has winners and is read. A
row group with one group is a stretch of that group's scores: ``top_n`` reads the footers, derives a bound on each group's
N-th score from the row groups that it has to itself, and reads only those that may still hold a winner, best first;
inside a file it also skips by the N-th score found so far. Clustered files can be asked again, for any N.

Defined cases
  * Lower score first; equal scores in ascending order of ``tie`` columns, so the result is one and the same.
  * A row group is skipped only if its best score is strictly worse than the bound: ties are always read.
  * Rows with a null group or a null or NaN score are no items. A group with fewer than N items keeps all.
  * Repeated rows count as items; remove them before if they must not. An empty table gives an empty result.
  * A group of any size is spread over files by score; no task holds a whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.llm.files import parquet_file
from scenegrain.session import scratch_path

ROW_GROUP_ROWS = 2048


def top_n_window(items: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The plain form for items that are read once: Spark limits each partition to N a group before the shuffle."""
    return items.withColumn("rank_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank_") <= n).drop("rank_")


def cluster_files(items: DataFrame, group: str, score: str, tie: list[str], partitions: int | None = None) -> str:
    """Write the items ordered by group and score into the shared folder; the path. Large groups go over several files."""
    spark = items.sparkSession
    path = scratch_path(spark, "clustered")
    kept = items.filter(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    order = [group, score, *tie]
    ranged = kept.repartitionByRange(partitions, *order) if partitions else kept.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(path)
    return path


def row_group_stats(df: DataFrame, group: str, score: str) -> DataFrame:
    """Rows (path, rg, rows, g_min, g_max, best, worst) from the footers of the files under ``df``."""
    spark = df.sparkSession
    files = df.inputFiles()
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism * 4)))

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                meta = parquet_file(path).metadata
                at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for k in range(meta.num_row_groups):
                    r = meta.row_group(k)
                    g, s = (r.column(at[c]).statistics for c in (group, score))
                    known = g is not None and s is not None and g.has_min_max and s.has_min_max
                    rows.append((path, k, r.num_rows, *((g.min, g.max, float(s.min), float(s.max)) if known else (None,) * 4)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["path", "rg", "rows", "g_min", "g_max", "best", "worst"])

    return listed.mapInArrow(run, "path string, rg int, rows long, g_min string, g_max string, best double, worst double")


def wanted_row_groups(stats: DataFrame, n: int) -> DataFrame:
    """The row groups that may hold a winner: all with several groups, and of a single group those not strictly worse than its bound.

    In order of their worst scores, as soon as a group's row groups hold N rows the worst score so far
    bounds its N-th.
    """
    single = F.coalesce(F.col("g_min") == F.col("g_max"), F.lit(False))
    w = Window.partitionBy("g_min").orderBy("worst", "path", "rg")
    own = stats.filter(single).withColumn("sum_", F.sum("rows").over(w))
    bound = own.filter(F.col("sum_") >= n).groupBy(F.col("g_min").alias("g_")).agg(F.min("worst").alias("bound_"))
    j = stats.join(bound, single & (F.col("g_min") == F.col("g_")), "left")
    return j.filter(~single | F.col("bound_").isNull() | (F.col("best") <= F.col("bound_"))).drop("g_", "bound_")


def top_n(path_df: DataFrame, group: str, score: str, tie: list[str], n: int, wanted: DataFrame | None = None) -> DataFrame:
    """The first ``n`` rows of each group of files written by ``cluster_files``; ``group`` is a string column."""
    schema = path_df.schema
    wanted = wanted_row_groups(row_group_stats(path_df, group, score), n) if wanted is None else wanted
    per_file = wanted.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("best", "rg", "g_min", "g_max"))).alias("rgs"))
    names = [f.name for f in schema]
    keys = [score, *tie]  # also the order in which the files are written

    def run(batches):
        for b in batches:
            for path, rgs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                file, nth = parquet_file(path), {}
                for r in rgs:  # best first
                    g = r["g_min"] if r["g_min"] == r["g_max"] else None
                    if g is not None and r["best"] > nth.get(g, np.inf):
                        continue
                    t = file.read_row_group(r["rg"], columns=names).select(names)
                    codes = t.column(group).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                    place = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes))))
                    t = t.take(pa.array(np.flatnonzero(place < n)))  # in order of group, score and ties, as written
                    if g is not None and len(t) == n:
                        nth[g] = min(nth.get(g, np.inf), t.column(score)[-1].as_py())
                    yield from t.combine_chunks().to_batches()

    found = per_file.repartition("path").mapInArrow(run, schema)
    return top_n_window(found, [group], [F.col(k).asc_nulls_first() for k in keys], n)


def latest_deliveries(records: DataFrame) -> DataFrame:
    """One row per ``fid``: (fid, id, bbox, cloud) of the delivery with the latest ``ingested_at``; equal times go to the larger remaining values."""
    row = F.struct(F.col("ingested_at"), F.col("`eo:cloud_cover`").alias("cloud"), F.col("id"), F.col("bbox"))
    return records.filter("fid IS NOT NULL").groupBy("fid").agg(F.max(row).alias("r")).select("fid", "r.id", "r.bbox", "r.cloud")


def clustered_places(records: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The latest deliveries with cloud cover in 0 to 100 clustered by place (bbox to 6 decimals) and cloud, their row groups, and those that may hold the ``n`` least cloudy of a place."""
    side = [F.round(F.col(f"bbox.{c}"), 6) + F.lit(0.0) for c in ("xmin", "ymin", "xmax", "ymax")]
    items = latest_deliveries(records).filter("bbox IS NOT NULL AND NOT isnan(cloud) AND cloud BETWEEN 0 AND 100")
    items = items.select(F.concat_ws(",", *[F.coalesce(s.cast("string"), F.lit("null")) for s in side]).alias("place"), "cloud", "id", "fid")
    read = records.sparkSession.read.schema(items.schema).parquet(cluster_files(items, "place", "cloud", ["id", "fid"]))
    stats = row_group_stats(read, "place", "cloud")
    return read, stats, wanted_row_groups(stats, n)


def least_cloudy(records: DataFrame, n: int = 3) -> DataFrame:
    """Rows (place, fid, id, cloud): for each place the ``n`` latest deliveries with the least cloud cover."""
    read, _, wanted = clustered_places(records, n)
    return top_n(read, "place", "cloud", ["id", "fid"], n, wanted)
