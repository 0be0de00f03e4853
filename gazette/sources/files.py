"""Reading and writing the log, the catalogue, vectors, submissions and exchange files."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from gazette import columns as C
from gazette.operators.history import truncate_history
from gazette.plans.lookup import lookup_join


def scan(spark: SparkSession, path: str, columns=None, where=None) -> DataFrame:
    """A parquet scan with a filter and a projection, both pushed into the reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def join_history(behaviors, history, history_size=30, padding=0, user_col=C.USER, history_aids_col=C.HISTORY_IDS) -> DataFrame:
    """Attach each user's last ``history_size`` ids; lists are padded before the join, so a user
    without a history keeps null."""
    past = truncate_history(history.select(user_col, history_aids_col), history_aids_col, history_size, padding, enable_warning=False)
    return lookup_join(behaviors, past, user_col, "left").select(*behaviors.columns, history_aids_col)


def impressions_from_path(spark, path, history_size=30, padding=0, user_col=C.USER, history_aids_col=C.HISTORY_IDS) -> DataFrame:
    """Load ``behaviors.parquet`` and ``history.parquet`` of one split and join them."""
    return join_history(
        spark.read.parquet(f"{path}/behaviors.parquet"),
        spark.read.parquet(f"{path}/history.parquet"),
        history_size,
        padding,
        user_col,
        history_aids_col,
    )


def write_table(df, path, mode="overwrite") -> None:
    """One parquet table; tasks write its parts."""
    df.write.mode(mode).parquet(path)


def load_article_id_embeddings(df, path, item_col=C.ARTICLE_ID) -> DataFrame:
    """Attach the vectors stored at ``path`` (id first, vector last); one row per id on both sides."""
    return df.join(df.sparkSession.read.parquet(path), item_col, "left")


def load_join_embeddings(df, vectors, item_col=C.ARTICLE_ID) -> DataFrame:
    """Cut the vector table down to the ids in ``df``, then attach it."""
    needed = vectors.join(df.select(item_col), item_col, "left_semi")
    return df.join(needed, item_col, "left")


def submission_lines(df, ranks_col, key=C.IMPRESSION_ID) -> DataFrame:
    """``"<id> [r1,r2,...]"`` as one text column."""
    ranks = F.array_join(F.col(ranks_col).cast("array<string>"), ",")
    return df.select(F.concat(F.col(key).cast("string"), F.lit(" ["), ranks, F.lit("]")).alias("value"))


def write_submission_file(df, ranks_col, path, key=C.IMPRESSION_ID, mode="overwrite") -> None:
    submission_lines(df, ranks_col, key).write.mode(mode).text(path)


def parse_submission_lines(lines) -> DataFrame:
    """``(impression_id, values)`` from text lines."""
    words = F.split(F.trim("value"), r"\s+", 2)
    return lines.select(
        F.get(words, F.lit(0)).alias(C.IMPRESSION_ID), F.from_json(F.get(words, F.lit(1)), "array<double>").alias("values")
    )


def read_submission_file(spark, path) -> DataFrame:
    return parse_submission_lines(spark.read.text(path))


def write_json_file(df, path, mode="overwrite") -> None:
    """One JSON record per row."""
    df.write.mode(mode).json(path)


def read_json_file(spark, path, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
