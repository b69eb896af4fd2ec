"""Cutting lineage in storage that all executors share.

Iterative operators write their intermediate state to the folder named by
``spark.checkpoint.dir``: a lost executor then costs at most the tasks it ran,
never a recomputation of all earlier rounds.
"""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. On a cluster it must be set; a local session without it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="strandlake-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/strandlake-{label}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path of new_path(); a session that has ended leaves it to the folder's owner."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that they can load the functions that run in Python."""
    app = spark.sparkContext.applicationId
    home = Path(__file__).resolve().parent
    if app in _shipped or not home.is_dir():  # a package in an archive came with the application
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="strandlake-code-")  # the driver's own; executors fetch the file from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"strandlake-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    path = list(sys.path)
    spark.sparkContext.addPyFile(archive)
    sys.path[:] = path  # the driver keeps what it has loaded


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans start from those files."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandlake_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Removes the files of materialise()d tables that nothing will read any more."""
    for df in frames:
        if path := getattr(df, "_strandlake_path", None):
            drop_path(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def mark(spark: SparkSession, path: str) -> None:
    """Writes an empty file; its being there is the sign that what came before is complete."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True).close()
