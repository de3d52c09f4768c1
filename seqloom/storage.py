"""Written tables: the one way this library cuts lineage.

A written table lives in the folder that the cluster names in ``spark.checkpoint.dir``, so it
survives the loss of any executor. Only where that setting is unset and all tasks run on this
machine (tests, a laptop) a temporary folder is made and used for the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def stored(df: DataFrame, compression: str = "snappy", options: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with these options of the Parquet writer, and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored``, once nothing that is still to run reads it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
