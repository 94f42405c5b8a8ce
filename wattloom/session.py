"""Session defaults for local runs; on a cluster the session comes from outside."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def local_session(name: str, cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, into a folder under ``spark.checkpoint.dir``, and read back: lineage ends there.

    Where that is unset, a local master gets a temporary folder; on a cluster, whose executors share no local
    folder, it is an error.  Folders on a mounted file system go at exit.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wattloom-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for path in _made:
        parts = urlsplit(path)
        if parts.scheme in ("", "file"):
            shutil.rmtree(parts.path, ignore_errors=True)
