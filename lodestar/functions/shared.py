"""Reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Applications whose folder is marked for deletion already.
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lodestar-")
        _delete_at_end(spark, path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return str(path)


def run_dir(spark: SparkSession) -> str:
    """A folder in the shared one for what this application writes between its stages; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/lodestar/{app}"
    if app not in _marked:
        _marked.add(app)
        _delete_at_end(spark, path)
    return path


def _delete_at_end(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder by columns and read again, for frames of very many rows."""
    path = f"{run_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
