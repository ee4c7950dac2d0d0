"""Sessions, and the folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and small inputs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where a local session names none (as in tests), a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.getCheckpointDir() and context.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return named or context.getCheckpointDir() or ""


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it wherever it is installed."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("graphloom") / p.relative_to(root)))
    context.addPyFile(str(archive))
    context._graphloom_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores: for Python work on files too few or small to be split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_batches(df: DataFrame, work: Callable, schema: str, arrow: bool = False) -> DataFrame:
    """``work`` over the partitions of a table, in batches of pandas (or Arrow), with this package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema) if arrow else df.mapInPandas(work, schema)


_written: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a compressed table written to the shared folder, so that a lost executor costs no earlier stage.

    Results read these tables, so they stay until ``release`` is called or the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> int:
    """Delete the tables that ``cut_lineage`` wrote, once the results that read them are no longer needed; returns how many."""
    n = 0
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
        except Exception:  # noqa: BLE001, S112 - the session has ended; its folder is the cluster's to clear
            continue
    return n


atexit.register(release)
