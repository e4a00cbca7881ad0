"""Operations on embedding-like vectors, in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dequantise(v: Column, nodata: int = -128, scale: float = 127.5) -> Column:
    """(v / scale)^2 with the sign of v; nodata gives NaN."""
    return F.when(v == nodata, F.lit(float("nan"))).otherwise(F.pow(v / scale, 2) * F.signum(v.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NaN if either vector holds NaN or has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(float("nan")))


def long_form(df: DataFrame, key: Sequence[str], vector: str) -> DataFrame:
    """Rows (key, pos, v)."""
    return df.select(*key, F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def nan_mean(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean per position, NaN left out."""
    return long.groupBy(*by, "pos").agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("mean"))


def to_array(long: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Back to arrays in order of position."""
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda x: x.v).alias(value))


def unit(long: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Values scaled to length 1 within each group; a group of no length stays."""
    n = F.sqrt(F.sum(F.pow(value, F.lit(2))).over(Window.partitionBy(*by)))
    return long.withColumn(value, F.when(n > 0, F.col(value) / n).otherwise(F.col(value)))


def gem_pool(long: DataFrame, by: Sequence[str], p: float = 3.0) -> DataFrame:
    """Generalised-mean pooling per position: mean sign times the p-mean of the magnitudes, scaled to length 1.

    ``long`` should hold whole vectors only; drop vectors with NaN before.
    """
    v = F.col("v")
    g = long.groupBy(*by, "pos").agg((F.avg(F.signum(v)) * F.pow(F.avg(F.pow(F.abs(v), F.lit(p))), F.lit(1.0 / p))).alias("pooled"))
    return unit(g, by, "pooled")


def prototype(long: DataFrame, label: str, positive, negative) -> DataFrame:
    """Mean of the positives minus mean of the negatives per position, scaled to length 1."""
    v = F.when(~F.isnan("v"), F.col("v"))
    at = lambda x: F.avg(F.when(F.col(label) == x, v))
    g = long.groupBy("pos").agg((at(positive) - at(negative)).alias("d"), F.lit(1).alias("one"))
    return unit(g, ["one"], "d").drop("one")


def pivot_wide(long: DataFrame, key: str, band: str, value: str, bands: Sequence) -> DataFrame:
    """One column per band, by first value."""
    return long.groupBy(key).pivot(band, list(bands)).agg(F.first(value))


def threshold(df: DataFrame, score: str, percent: float) -> DataFrame:
    """Adds ``predicted``: the score reaches the given percentile (linear between ranks) of all scores."""
    cut = df.agg(F.percentile(score, percent / 100)).first()[0]
    return df.withColumn("predicted", F.col(score) >= F.lit(cut))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts, precision and recall."""
    t, p = F.col(truth), F.col(predicted)
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return c.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def finite_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    return df.groupBy(*by).agg(F.min(v).alias("lowest"), F.avg(v).alias("mean"), F.max(v).alias("highest"), F.count(v).alias("n"))
