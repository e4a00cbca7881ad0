"""The queries on training data, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain.llm import grouped_split, language, mixing, similar_vectors, tokens, top_n
from scenegrain.session import settled


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.similar_pairs(spark.read.parquet(f"{d}/patch_vectors.parquet"), k=5, min_similarity=0.9)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.torn_groups(spark.read.parquet(f"{d}/records.parquet")).select(F.col("id").alias("fid")).distinct()


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    s = grouped_split.split_records(spark.read.parquet(f"{d}/records.parquet"), spark.read.parquet(f"{d}/split_targets.parquet"))
    return s.select(F.col("id").alias("fid"), F.col("group").alias("ground"), "split")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """The splits' rows beside those wanted, and how far their labels are from those of the whole."""
    targets = spark.read.parquet(f"{d}/split_targets.parquet")
    s = settled(spark, grouped_split.split_records(spark.read.parquet(f"{d}/records.parquet"), targets), "splits")
    return grouped_split.deviation(s, s.select("group", "split").distinct(), targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n.least_cloudy(spark.read.parquet(f"{d}/records.parquet"), 3).select("fid")


P7_SQL = """
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY fid ORDER BY ingested_at DESC NULLS LAST, "eo:cloud_cover" DESC NULLS LAST, id DESC) AS k FROM records WHERE fid IS NOT NULL
), ranked AS (
  SELECT fid, row_number() OVER (PARTITION BY round(bbox.xmin, 6), round(bbox.ymin, 6), round(bbox.xmax, 6), round(bbox.ymax, 6) ORDER BY "eo:cloud_cover", id NULLS FIRST, fid) AS r
  FROM latest WHERE k = 1 AND bbox IS NOT NULL AND NOT isnan("eo:cloud_cover") AND "eo:cloud_cover" BETWEEN 0 AND 100
)
SELECT fid FROM ranked WHERE r <= 3
"""


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.out_of_reach(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The report of the mix: wanted, reachable and actual shares."""
    return mixing.mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(spark.read.parquet(f"{d}/documents.parquet"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """The language of every whole sentence of every document."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return language.segments(docs, language.fit(docs)).select("doc_id", "segment", "lang", "confidence")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(spark.read.parquet(f"{d}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p3_found, p6_found, p6_splits, p6_shares, p7_found, p8_ids, p9_found, p9_mix, p10_found, p10_languages, p10_segments)}


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_SQL}
