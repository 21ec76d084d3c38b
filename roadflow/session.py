"""What every operator with a Python kernel needs of the session."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}
_LOCAL: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Executors of a cluster do not share the driver's folders, so the package goes to them
    as a zip through Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="roadflow-")
    path = os.path.join(os.path.abspath(folder), "roadflow.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path(here.name) / p.relative_to(here)))
    sc.addPyFile(path)
    _SHIPPED[sc.applicationId] = path
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; any other master is
    refused, because its executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="roadflow-shared-")
        _LOCAL[sc.applicationId] = f"file://{os.path.abspath(folder)}"
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _LOCAL[sc.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here.

    A lost executor costs the tasks that run on it, never what is already written. ``clean_up`` deletes an application's tables.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/roadflow/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.append(folder)
        atexit.register(_delete, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that are not read any more, and lets Spark delete the shuffle files of what has been written: it does so only when
    the driver's JVM has collected the plans, which may be long after."""
    spark = tables[0].sparkSession
    gateway = spark.sparkContext._gateway
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            folder = gateway.jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    release()


def release() -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to."""
    gc.collect()
    if SparkContext._gateway is not None:
        SparkContext._gateway.jvm.System.gc()


_FOLDERS: list[str] = []


def _delete(folder: str) -> None:
    """Through the file system that Spark wrote it with; it may outlive the session, but not the JVM."""
    gateway = SparkContext._gateway
    if folder not in _FOLDERS or gateway is None:
        return
    _FOLDERS.remove(folder)
    with contextlib.suppress(Exception):  # at the interpreter's end the JVM may be gone
        path = gateway.jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def clean_up() -> None:
    """Deletes the tables of this application's operators: for the end of a run, when no result is read any more. The end of the program does the same."""
    for folder in list(_FOLDERS):
        _delete(folder)
