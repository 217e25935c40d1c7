"""SparkSession factory with the settings that all results assume: ANSI, UTC, adaptive execution."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "siftwell", memory: str = "8g") -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python once a session, so that they need no copy of their own."""
    context = spark.sparkContext
    if not getattr(context, "_siftwell_shipped", False):
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="siftwell-")) / "siftwell.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(path))
        context._siftwell_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; for a local master without one, a folder of this session.

    On a cluster the setting is required: a folder of one machine would not be seen by the others.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or getattr(context, "_siftwell_dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = context._siftwell_dir = tempfile.mkdtemp(prefix="siftwell-")
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that steps over it read it instead of computing it again."""
    path = f"{shared_dir(df.sparkSession)}/siftwell/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
