"""Row-local operators run on a stream as they do on a table."""

from gazette import columns as C
from gazette.operators import labels, sampling

SCHEMA = f"{C.IMPRESSION_ID} int, {C.INVIEW} array<int>, {C.CLICKED} array<int>"


def test_labels_and_sampling_on_a_stream(spark, tmp_path):
    rows = [(i, list(range(i, i + 6)), [i, i + 3]) for i in range(50)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "log"))

    def prepared(df):
        return labels.create_binary_labels_column(sampling.sampling_strategy_wu2019(df, 2, seed=1))

    stream = prepared(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log")))
    query = (
        stream.writeStream.format("memory").queryName("prepared").option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    query.processAllAvailable()
    query.stop()
    batch = prepared(spark.read.schema(SCHEMA).parquet(str(tmp_path / "log")))
    assert sorted(map(str, spark.table("prepared").collect())) == sorted(map(str, batch.collect()))
