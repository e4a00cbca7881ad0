"""Joins that hold when one key has a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from scenegrain.session import spread


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], per_task: int = 200_000, heavy: bool = False) -> DataFrame:
    """Inner equi-join; keys with more than ``per_task`` rows on the left are split into salts, and their right rows repeated once a salt.

    The counts come from a pre-aggregation; the table of hot keys has at most rows / per_task rows and
    Spark broadcasts it only if its measured size allows. Null keys match nothing. ``heavy``: keep to the session's number of tasks
    where many pairs come of few bytes.
    """
    hot = left.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") > per_task).select(*keys, F.ceil(F.col("n_") / per_task).cast("int").alias("salts_"))
    one = F.coalesce("salts_", F.lit(1))
    l = left.join(hot, keys, "left").withColumn("salt_", F.pmod(F.xxhash64(*left.columns), one).cast("int")).drop("salts_")
    r = right.join(hot, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts_")
    on = [*keys, "salt_"]
    return (spread(l, *on).join(spread(r, *on), on) if heavy else l.join(r, on)).drop("salt_")
