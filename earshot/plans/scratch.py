"""Tables written in the shared folder, so that a lost executor costs no more than the running step; and shipping the package."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to Python workers that can't import it from their own path."""
    app = spark.sparkContext.applicationId
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _shipped or os.getcwd() == ROOT or ROOT in {os.path.abspath(p) for p in paths if p}:
        return
    to = os.path.join(tempfile.mkdtemp(prefix="earshot-"), "earshot_package.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.join(ROOT, "earshot")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, ROOT))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session in one process may do without: it has a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return shared.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses."""
    return f"{shared_root(spark)}/earshot/{label}-{uuid.uuid4().hex}"


_gathered: list[list[DataFrame]] = []


@contextmanager
def gathered() -> Iterator[list[DataFrame]]:
    """A list of the tables written inside, for a caller that knows when they are no longer read."""
    _gathered.append([])
    try:
        yield _gathered[-1]
    finally:
        _gathered.pop()


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _gathered:
        _gathered[-1].append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        path = df.__dict__.get("_scratch_path") if df is not None else None
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more, which it does after the driver's garbage is collected."""
    for _ in range(2):  # what the first round frees may hold plans itself
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
