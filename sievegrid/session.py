"""Session builder and the shared scratch folder that long jobs cut their lineage with."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session in UTC with adaptive execution; the other settings stay Spark's own."""
    return (
        SparkSession.builder.master(master)
        .appName("sievegrid")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once, so that they need no installed copy."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "sievegrid.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, Path(home.name) / f.relative_to(home))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is taken, which is right in local mode only; on a
    cluster an unset folder is an error, because executors cannot see each other's disks.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: a cut in the lineage that survives
    lost executors, and one computation for however many readers."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint where its counted size stays under ``max_bytes``; otherwise as it
    is, so the join shuffles. ``df`` should be materialised, as it is counted here."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def spread(scan: DataFrame) -> DataFrame:
    """A scan over fewer files or row groups than there are cores, dealt to all of them; a larger one as it is. ``scan`` must not hold a shuffle, as counting its
    partitions would run it."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
