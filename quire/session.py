"""Sessions, and the package's way to the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    os.environ["PYTHONPATH"] = os.pathsep.join([str(_ROOT.parent), os.environ.get("PYTHONPATH", "")])
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable on the workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="quire-"), "quire.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(_ROOT.rglob("*.py")):
                z.write(p, p.relative_to(_ROOT.parent))
        sc.addPyFile(str(path))  # served to the executors by the driver
        _shipped.add(sc.applicationId)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared checkpoint folder and reads it from there, without what it was made from.

    The folder is the session's (``spark.checkpoint.dir``). Only a local session without one
    gets a temporary folder, removed at the end; on a cluster, whose executors share no such
    folder, a missing setting is an error. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes what is no longer used.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``cut`` for frames of long texts: a compressed table in the same folder."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
