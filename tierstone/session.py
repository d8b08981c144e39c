"""A Spark session's shared folder, tables written there, and sending this package to the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (as in tests) gets a temporary
    folder, and a cluster an error, because its executors would not see the driver's folders."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _local.get("dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local["dir"] = tempfile.mkdtemp(prefix="tierstone-")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder, deleted when Python ends."""
    path = f"{shared_dir(spark)}/tierstone/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone when Python ends
            return


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(path: str) -> None:
    with contextlib.suppress(OSError):
        os.remove(path)


def ship(spark: SparkSession) -> SparkSession:
    """Give Python workers this package once per Spark context, by Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_tierstone_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="tierstone-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tierstone", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._tierstone_shipped = True
    atexit.register(_remove, path)
    return spark
