"""Written intermediate tables: they cut lineage, and lost executors redo nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []


def written_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which all executors share.

    A local master without that setting uses the temporary folder; any other master must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    _paths.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def written(df: DataFrame, name: str = "step", packed: bool = False) -> DataFrame:
    """df, written and read again. packed: by zstd, which makes about half of ids that are hexadecimal hashes."""
    path = written_path(df.sparkSession, name)
    (df.write.option("compression", "zstd") if packed else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def clean(spark: SparkSession) -> int:
    """Deletes what this process has written so; for when no result is read any more. Returns the number of tables."""
    jvm, n = spark._jvm, len(_paths)
    while _paths:
        path = jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
