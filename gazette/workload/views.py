"""The impression-log data model over the given star-schema tables, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from gazette import columns as C
from gazette.functions.arrays import field
from gazette.operators.history import fixed_histories
from gazette.plans.store import materialise

# Fixed values of the views.
READ_EVENTS = ("view", "click", "purchase")
FAR_FUTURE = "2100-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inview(spark, sf_dir) -> DataFrame:
    """One row per order: the parts shown and the parts returned, as sorted id lists."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias(C.IMPRESSION_ID)).agg(
        F.sort_array(F.collect_set("l_partkey")).alias(C.INVIEW),
        F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))).alias(C.CLICKED),
    )


def order_heads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(C.IMPRESSION_ID),
        F.col("o_custkey").alias(C.USER),
        F.col("o_orderdate").alias(C.IMPRESSION_TIME),
    )


def impressions(spark, sf_dir) -> DataFrame:
    return order_heads(spark, sf_dir).join(inview(spark, sf_dir), C.IMPRESSION_ID)


def impressions_all(spark, sf_dir) -> DataFrame:
    """Orders without a line keep null lists."""
    return order_heads(spark, sf_dir).join(inview(spark, sf_dir), C.IMPRESSION_ID, "left")


def scored(spark, sf_dir) -> DataFrame:
    """Impressions with parallel lists: ids, labels, a price score and a discount score with ties.

    Repeated lines are folded per (order, part) before the shuffle, so an order with very many
    lines is spread over tasks until only its distinct parts are left.
    """
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_partkey")
        .agg(
            F.max((F.col("l_returnflag") == "R").cast("tinyint")).alias("y"),
            F.max("l_extendedprice").alias("price"),
            F.max("l_discount").alias("discount"),
        )
    )
    lists = cells.groupBy(F.col("l_orderkey").alias(C.IMPRESSION_ID)).agg(
        F.array_sort(F.collect_list(F.struct("l_partkey", "y", "price", "discount"))).alias("c")
    )
    return lists.select(
        C.IMPRESSION_ID,
        field("c", "l_partkey").alias(C.INVIEW),
        field("c", "y").alias(C.LABELS),
        field("c", "price").alias("price_scores"),
        F.transform("c", lambda x: x["discount"] * 10).alias(C.SCORES),
    )


def clicks(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    article = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id",
        C.USER,
        F.col("ts").alias(C.IMPRESSION_TIME),
        F.col("value").alias(C.READ_TIME),
        F.when(F.col("event_type").isin(*READ_EVENTS), article).alias(C.ARTICLE_ID),
    )


def histories(spark, sf_dir) -> DataFrame:
    """Per user: all articles read with their times and read times; queries cut by their own sizes.

    A stored table, as it is in the data model: queries measure it and read it more than once.
    """
    return materialise(
        fixed_histories(
            clicks(spark, sf_dir),
            F.lit(FAR_FUTURE).cast("timestamp_ntz"),
            None,
            [C.ARTICLE_ID, C.IMPRESSION_TIME, C.READ_TIME],
            [C.HISTORY_IDS, C.HISTORY_TIMES, C.HISTORY_READ_TIMES],
            tie_cols=["event_id"],
        )
    )


def articles(spark, sf_dir) -> DataFrame:
    """The catalogue alone."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(C.ARTICLE_ID),
        F.col("p_name").alias(C.TITLE),
        F.col("p_brand").alias(C.CATEGORY_STR),
        F.array("p_type", "p_brand").alias(C.SUBCATEGORY),
        (F.col("p_size") / 50).alias(C.SENTIMENT_SCORE),
        F.col("p_size").alias("size"),
    )


def counters(spark, sf_dir) -> DataFrame:
    """In-views, clicks and read time per article."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias(C.ARTICLE_ID))
        .agg(
            F.count("*").alias(C.TOTAL_INVIEWS),
            F.count_if(F.col("l_returnflag") == "R").alias(C.TOTAL_PAGEVIEWS),
            F.sum("l_quantity").alias(C.TOTAL_READ_TIME),
        )
    )


def articles_full(spark, sf_dir) -> DataFrame:
    return articles(spark, sf_dir).join(counters(spark, sf_dir), C.ARTICLE_ID, "left")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(C.ARTICLE_ID), F.col("embedding").cast("array<double>").alias("vector")
    )


def stored_vectors(spark, sf_dir) -> DataFrame:
    """The vectors as stored, half as wide: for work that carries them through shuffles and widens them behind."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(C.ARTICLE_ID), F.col("embedding").alias("vector"))


def users(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(C.USER), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") < 0).alias("in_debt")
    )


def texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(C.ARTICLE_ID), F.col("text").alias(C.BODY), F.col("lang").alias(C.CATEGORY_STR), "source"
    )


# The same views for the SQL side, in dependency order.
SQL_VIEWS = {
    "inview": """
        SELECT l_orderkey AS impression_id,
               list_sort(list_distinct(list(l_partkey))) AS article_ids_inview,
               list_sort(list_distinct(coalesce(list(l_partkey) FILTER (WHERE l_returnflag = 'R'), []::BIGINT[]))) AS article_ids_clicked
        FROM lineitem GROUP BY l_orderkey""",
    "impressions": """
        SELECT o_orderkey AS impression_id, o_custkey AS user_id, o_orderdate AS impression_time,
               article_ids_inview, article_ids_clicked
        FROM orders JOIN inview ON o_orderkey = impression_id""",
    "impressions_all": """
        SELECT o_orderkey AS impression_id, o_custkey AS user_id, o_orderdate AS impression_time,
               article_ids_inview, article_ids_clicked
        FROM orders LEFT JOIN inview ON o_orderkey = impression_id""",
    "cells": """
        SELECT l_orderkey AS impression_id, l_partkey AS article_id,
               max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y,
               max(l_extendedprice) AS price, max(l_discount) * 10 AS score
        FROM lineitem GROUP BY 1, 2""",
    "clicks": """
        SELECT event_id, user_id, ts AS impression_time, value AS read_time,
               CASE WHEN event_type IN ('view', 'click', 'purchase')
                    THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) END AS article_id
        FROM events""",
    "past": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY impression_time, event_id) AS nr,
               row_number() OVER (PARTITION BY user_id ORDER BY impression_time DESC, event_id DESC) AS back
        FROM clicks WHERE article_id IS NOT NULL""",
    "histories": """
        SELECT user_id, list(article_id ORDER BY nr) AS article_id_fixed,
               list(impression_time ORDER BY nr) AS impression_time_fixed,
               list(read_time ORDER BY nr) AS read_time_fixed
        FROM past GROUP BY user_id""",
    "articles": """
        SELECT p_partkey AS article_id, p_name AS title, p_brand AS category_str, [p_type, p_brand] AS subcategory,
               p_size / 50 AS sentiment_score, p_size AS size FROM part""",
    "counters": """
        SELECT l_partkey AS article_id, count(*) AS total_inviews,
               count(*) FILTER (WHERE l_returnflag = 'R') AS total_pageviews, sum(l_quantity) AS total_read_time
        FROM lineitem GROUP BY 1""",
    "vectors": """
        SELECT vec_id AS article_id, list_transform(embedding, lambda x: x::DOUBLE) AS vector FROM embeddings""",
    "units": """
        SELECT article_id, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS u
        FROM vectors""",
    "texts": """
        SELECT doc_id AS article_id, text AS body, lang AS category_str, source FROM documents""",
    "words": """
        SELECT article_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (
            SELECT article_id, list_filter(string_split_regex(lower(body), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM texts)""",
}

_NEEDS = {
    "impressions": ["inview"],
    "impressions_all": ["inview"],
    "past": ["clicks"],
    "histories": ["past"],
    "units": ["vectors"],
    "words": ["texts"],
}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the named views and those they need."""
    wanted, todo = set(), names.split()
    while todo:
        n = todo.pop()
        wanted.add(n)
        todo += _NEEDS.get(n, [])
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in SQL_VIEWS if n in wanted)
    if not ctes:
        return body
    body = body.strip()
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"


def as_text(c):
    """A list as comma-separated text, null elements spelled out (Spark side)."""
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c.cast("array<string>"), ",", "null")


def sql_text(c: str) -> str:
    """A list as comma-separated text, null elements spelled out (SQL side)."""
    return f"array_to_string(list_transform({c}, lambda x: coalesce(x::VARCHAR, 'null')), ',')"


def sql_key(seed, *parts: str) -> str:
    """The digest of ``gazette.functions.draws.digest`` in SQL."""
    words = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"md5(concat_ws(':', '{seed}', {words}))"
