"""Session-level plumbing that every multi-stage operator shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of this application: the one ``spark.checkpoint.dir`` names; a local one only under a local master (tests)."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[str] = []


def _forget(sc) -> None:
    """Deletes the tables of this application; at its end, or by ``release``."""
    while _written:
        path = sc._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Frees the shared folder once no result of this session is read any more."""
    _forget(spark.sparkContext)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there.

    Later stages neither recompute it nor hang on an executor; the scan of the table has true sizes and column statistics, so
    that joins are planned by size and unused columns are not read.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_end, spark.sparkContext)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _end(sc) -> None:
    try:
        _forget(sc)
    except Exception:  # the application is gone already
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it from anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(root):  # it runs from an archive that was shipped already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    sc.addPyFile(path)  # the driver serves it; executors read no local path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
