"""Session settings and the few places where a plan is cut."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings a session."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scenegrain")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Over as many tasks as the session shuffles to: for steps whose work a row is large, which the adaptive planner, going by bytes, would put into few tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and Spark runs in this process (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="scenegrain-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; the rows survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder; ``sweep`` removes it, at the latest when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def sweep(keep: int = 0) -> None:
    """Remove the tables this process has written to the shared folder, but the first ``keep``; DataFrames that read them are void after it."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: S112  the session has ended before
            continue


atexit.register(sweep)


@contextlib.contextmanager
def scratch():
    """Tables written to the shared folder within go when it is left; what is to stay must have been written or collected by then."""
    held = len(_written)
    try:
        yield
    finally:
        sweep(held)


def settled(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the cut for tables that are read several times."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
