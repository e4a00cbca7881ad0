"""Parquet datasets on a hub, by ``hf://`` address; the listing of a repository is given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from scenegrain.functions.predicates import bbox_overlaps, dnf
from scenegrain.functions.text import parse_hf_uri

Lister = Callable[[str, str | None], Sequence[str]]


def resolve(uri: str, lister: Lister | None = None) -> list[str]:
    """Addresses of the Parquet files: the one named; else those under the sub-path; without one, ``data/`` before the rest."""
    repo, revision, inside = parse_hf_uri(uri)
    at = f"hf://datasets/{repo}{f'@{revision}' if revision else ''}"
    if inside.lower().endswith(".parquet"):
        return [f"{at}/{inside}"]
    if lister is None:
        raise ImportError("listing a repository needs a lister, e.g. of the hub's own client")
    files = sorted(f for f in lister(repo, revision) if f.lower().endswith(".parquet"))
    under = [f for f in files if f.startswith(f"{inside}/")] if inside else [f for f in files if f.startswith("data/")] or files
    if not under:
        raise FileNotFoundError(f"no Parquet files in {uri}")
    return [f"{at}/{f}" for f in under]


def read(spark: SparkSession, uri: str, filters=None, columns=None, bbox=None, lister: Lister | None = None, mount: Callable[[str], str] | None = None) -> DataFrame:
    """Row groups and columns are pruned by the Parquet scan. ``mount`` maps addresses to paths that Spark can read."""
    paths = [(mount or (lambda x: x))(p) for p in resolve(uri, lister)]
    df = spark.read.parquet(*paths)
    if filters:
        df = df.filter(dnf(filters))
    if bbox is not None:
        df = df.filter(bbox_overlaps(bbox))
    return df.select(*columns) if columns else df


def head(spark: SparkSession, uri: str, n: int, order: Sequence[str], **kw) -> DataFrame:
    return read(spark, uri, **kw).orderBy(*order).limit(n)
