"""Sessions, and what every session of this package needs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).parent


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; ``conf`` adds settings (dots written as __)."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tidemark-")  # workers fetch the file from the driver when they start
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in PACKAGE.rglob("*.py"):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._tidemark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the cluster names none, as in tests."""
    sc = spark.sparkContext
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        folder = sc._jsc.sc().getCheckpointDir()
        if not folder.isDefined() and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = folder.get() if folder.isDefined() else "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
