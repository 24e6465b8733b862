"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Names of the folders made by this process, by application: only these are ever removed.
_MADE: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local session (as in tests) gets a temporary folder where it is unset; a cluster's machines share none, so
    there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    own = f"{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(own)
    return f"{shared_folder(spark)}/{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Remove a table made by ``written`` once nothing reads it any more; other tables are left alone."""
    spark = df.sparkSession
    made = _MADE.get(spark.sparkContext.applicationId, set())
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName() in made:
            made.discard(folder.getName())
            _delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Remove every table and folder that this process made for the session: call it when their results are kept elsewhere."""
    root = shared_folder(spark)
    for name in _MADE.pop(spark.sparkContext.applicationId, set()):
        _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"))
