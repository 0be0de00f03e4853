"""Scoring in chunks: what an aborted run leaves, and what the next one does."""

import pytest
from pyspark.sql import functions as F

from gazette.operators import inference
from gazette.operators.inference import completed_chunks, completed_scores, score_in_chunks


@pytest.fixture
def log(spark):
    return spark.range(500).select(F.col("id").alias("impression_id"), F.array(F.col("id") % 7, F.col("id") % 5).alias("x"))


def doubled(df):
    return df.select("impression_id", F.transform("x", lambda v: v * 2).alias("scores"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_whole_run(log, tmp_path):
    out = score_in_chunks(log, doubled, str(tmp_path), n_chunks=10, chunks_at_once=3)
    assert rows(out) == rows(doubled(log))
    assert completed_chunks(log.sparkSession, str(tmp_path)) == set(range(10))


def test_an_aborted_run_goes_on(spark, log, tmp_path):
    seen = []

    def failing(df):
        seen.append({r[0] for r in df.select("impression_id").collect()})
        if len(seen) == 3:
            raise RuntimeError("lost")
        return doubled(df)

    with pytest.raises(RuntimeError):
        score_in_chunks(log, failing, str(tmp_path), n_chunks=10, chunks_at_once=2)
    done = completed_chunks(spark, str(tmp_path))
    assert done == {0, 1, 2, 3}
    finished = seen[0] | seen[1]
    assert {r["impression_id"] for r in completed_scores(spark, str(tmp_path)).collect()} == finished

    # what a run wrote of a chunk before it ended is not seen, and does not stay
    torn = spark.createDataFrame([(-1, [9], 7)], "impression_id long, scores array<long>, chunk int")
    torn.write.mode("append").partitionBy("chunk").parquet(f"{tmp_path}/output")
    assert {r["impression_id"] for r in completed_scores(spark, str(tmp_path)).collect()} == finished

    again = []

    def counting(df):
        again.append({r[0] for r in df.select("impression_id").collect()})
        return doubled(df)

    out = score_in_chunks(log, counting, str(tmp_path), n_chunks=10, chunks_at_once=2)
    assert rows(out) == rows(doubled(log))
    # the steps of the rerun, then the call that only tells the columns
    assert not finished & set().union(*again[:-1]) and len(again) == 4
    assert rows(score_in_chunks(log, doubled, str(tmp_path), n_chunks=10)) == rows(doubled(log))


def test_a_chunk_reads_its_own_files(spark, log, tmp_path):
    inference.stage_chunks(log, str(tmp_path), n_chunks=10)
    one = spark.read.parquet(f"{tmp_path}/input").filter("chunk IN (3)")
    assert "PartitionFilters: [isnotnull(chunk#" in one._jdf.queryExecution().executedPlan().toString()
    files = {r[0] for r in one.select(F.input_file_name()).collect()}
    assert files and all("/chunk=3/" in f for f in files)


def test_another_cut_fails(log, tmp_path):
    score_in_chunks(log, doubled, str(tmp_path), n_chunks=4)
    with pytest.raises(ValueError, match="4 chunks"):
        score_in_chunks(log, doubled, str(tmp_path), n_chunks=5)


def test_empty_table(log, tmp_path):
    assert score_in_chunks(log.limit(0), doubled, str(tmp_path), n_chunks=3).collect() == []
