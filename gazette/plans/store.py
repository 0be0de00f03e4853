"""Materialising an intermediate table on storage that outlives executors."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="gazette-")


def scratch_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


def materialise(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once and read it back.

    The result has no lineage: losing an executor never recomputes it, and every
    later reader sees the very same rows, so values that depend on how rows were
    partitioned are stable. Columnar files let later passes prune columns. ``options`` are those of
    the parquet writer.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/gazette-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
