"""Scoring a whole table in chunks that survive an abort of the job.

A run lives in one folder that all executors reach: ``input`` (the rows, partitioned by chunk), ``output``
(scored rows, partitioned by chunk), ``completed`` (the chunks whose output is whole) and ``plan`` (how the rows were cut). Lost
tasks are Spark's to repeat; the chunks are for what Spark forgets, a job that ended. A rerun reads, scores and writes
the missing chunks only. A chunk that was being written when a run ended is not in ``completed``, so readers
never see it, and the rerun overwrites its partition.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gazette import columns as C
from gazette.plans.lists import as_keys

CHUNK = "chunk"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, if there is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _chunk_of(keys, n_chunks: int):
    return F.pmod(F.xxhash64(*keys), F.lit(n_chunks)).cast("int")


def _with_chunk(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CHUNK, T.IntegerType())])


def stage_chunks(df: DataFrame, path: str, key=C.IMPRESSION_ID, n_chunks: int = 64) -> None:
    """Cut ``df`` by a hash of ``key`` into ``n_chunks`` partitions below ``path``; rows of one key share a chunk.

    The rows are moved once, so that a chunk is later read without passing over the others. The plan is written
    last: without it a run starts anew.
    """
    keys = as_keys(key)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn(CHUNK, _chunk_of(keys, n_chunks)).repartition(parts, CHUNK, F.xxhash64(*keys, F.lit(1)) % 16)
    cut.write.mode("overwrite").partitionBy(CHUNK).parquet(f"{path}/input")
    plan = df.sparkSession.range(1).select(F.lit(n_chunks).alias("n_chunks"), F.lit(",".join(keys)).alias("keys"))
    plan.write.mode("overwrite").parquet(f"{path}/plan")


def completed_chunks(spark: SparkSession, path: str) -> set[int]:
    """The chunks of the run at ``path`` whose output is whole: at most as many numbers as there are chunks."""
    done = _stored(spark, f"{path}/completed")
    return set() if done is None else {r[CHUNK] for r in done.select(CHUNK).distinct().collect()}


def score_in_chunks(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, key=C.IMPRESSION_ID, n_chunks: int = 64, chunks_at_once: int = 8
) -> DataFrame:
    """``score`` over all of ``df``, in steps of ``chunks_at_once`` chunks, with their results kept at ``path``.

    ``score`` takes and returns a DataFrame; its rows must keep the ``key`` columns. A call for a ``path`` that holds a run goes
    on with that run: ``df`` is then not read again, and must be the table that it was started with. A run cut
    in another way fails. One job at a time may work on a path.
    """
    spark, keys = df.sparkSession, as_keys(key)
    plan = _stored(spark, f"{path}/plan")
    if plan is None:
        stage_chunks(df, path, key, n_chunks)
    else:
        made = plan.first()
        if (made["n_chunks"], made["keys"]) != (n_chunks, ",".join(keys)):
            raise ValueError(f"the run at {path} has {made['n_chunks']} chunks by {made['keys']}, not {n_chunks} by {','.join(keys)}")
    rows = spark.read.schema(_with_chunk(df.schema)).parquet(f"{path}/input")
    done = completed_chunks(spark, path)
    missing = [c for c in range(n_chunks) if c not in done]
    for at in range(0, len(missing), chunks_at_once):
        step = missing[at : at + chunks_at_once]
        scored = score(rows.filter(F.col(CHUNK).isin(step)).drop(CHUNK))
        placed = scored.withColumn(CHUNK, _chunk_of(keys, n_chunks))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(CHUNK).parquet(f"{path}/output")
        spark.createDataFrame([(c,) for c in step], f"{CHUNK} int").coalesce(1).write.mode("append").parquet(f"{path}/completed")
    return completed_scores(spark, path, _with_chunk(score(rows.drop(CHUNK)).schema))


def completed_scores(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The scored rows of all completed chunks; partitions of other chunks are not read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    done = sorted(completed_chunks(spark, path))
    return reader.parquet(f"{path}/output").filter(F.col(CHUNK).isin(done) if done else F.lit(False)).drop(CHUNK)
