"""Descriptive statistics, vectors and decay, list helpers, text."""

from pyspark.sql import functions as F

from gazette import columns as C
from gazette.functions import arrays, text as X
from gazette.operators import beyond, checks, decay, describe, mapping, text as T
from gazette.plans.lookup import lookup_join
from gazette.workload import views as V
from gazette.workload.registry import query
from gazette.workload.views import as_text, sql_text, with_views

_EXPLODED = "e AS (SELECT impression_id, unnest(article_ids_inview) AS id, unnest(range(len(article_ids_inview))) AS pos FROM inview)"


def r(digits, *names):
    return {n: F.round(n, digits) for n in names}


# --- aggregates ----------------------------------------------------------------------------


# All p_type values, the columns of the wide table.
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    with_views(
        "impressions_all",
        """SELECT user_id AS ids FROM impressions_all UNION SELECT unnest(article_ids_inview) FROM impressions_all UNION SELECT unnest(article_ids_clicked) FROM impressions_all""",
    )
)
def unique_ids(spark, d):
    return describe.unique_article_ids_in_behaviors(V.impressions_all(spark, d), item_col=C.USER)


@query("SELECT min(o_orderdate) AS min, max(o_orderdate) AS max FROM orders")
def time_range(spark, d):
    return describe.min_max_impression_time_behaviors(V.order_heads(spark, d))


@query(with_views("past", "SELECT min(impression_time) AS min, max(impression_time) AS max FROM past"))
def time_range_lists(spark, d):
    return describe.min_max_impression_time_history(V.histories(spark, d))


@query(with_views("inview", f"WITH {_EXPLODED} SELECT id AS item, round(count(*) / (SELECT count(*) FROM inview), 9) AS popularity FROM e GROUP BY 1"))
def item_popularity(spark, d):
    return beyond.item_popularity(V.inview(spark, d), C.INVIEW).withColumns(r(9, "popularity"))


@query(
    """WITH w AS (SELECT l_returnflag AS value, sum(l_quantity / 1000) AS share FROM lineitem GROUP BY 1 UNION ALL
       SELECT l_linestatus, count(*) / sum(count(*)) OVER () FROM lineitem GROUP BY 1)
       SELECT value, round(sum(share), 6) AS share FROM w GROUP BY 1"""
)
def weighted_distribution(spark, d):
    lines = V.table(spark, d, "lineitem").withColumn("w", F.col("l_quantity") / 1000)
    prior = beyond.normalized_distribution(lines, "l_linestatus")
    return beyond.normalized_distribution(lines, "l_returnflag", "w", prior).withColumns(r(6, "share"))


@query(with_views("inview", f"WITH {_EXPLODED} SELECT id AS article_ids_inview, count(*) AS count FROM e GROUP BY 1"))
def inview_estimate(spark, d):
    return describe.inview_counts(V.inview(spark, d))


@query(
    """WITH c AS (SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1)
       SELECT value, count, round(count / sum(count) OVER (), 9) AS share, round(sum(count) OVER (ORDER BY count DESC, value) / sum(count) OVER (), 9) AS running_share FROM c"""
)
def category_share(spark, d):
    return describe.value_shares(V.articles(spark, d), C.CATEGORY_STR).withColumns(r(9, "share", "running_share"))


@query(
    with_views(
        "impressions past articles",
        """SELECT n_impressions, n_pos, n_neg, n_users, n_sso_users, n_subscribers, n_history, n_impressions + n_history AS n_interactions,
            (SELECT count(*) FROM part) AS n_articles, (SELECT count(DISTINCT p_brand) FROM part) AS n_categories,
            (SELECT count(*) FROM (SELECT p_type FROM part UNION SELECT p_brand FROM part)) AS n_subcategories,
            round(n_neg / n_pos, 2) AS np_ratio, round(n_impressions / n_users, 2) AS impressions_per_user
        FROM (SELECT count(*) AS n_impressions, sum(len(article_ids_clicked))::BIGINT AS n_pos, sum(len(article_ids_inview) - len(article_ids_clicked))::BIGINT AS n_neg,
                count(DISTINCT user_id) AS n_users, count(DISTINCT CASE WHEN len(article_ids_inview) > 6 THEN user_id END) AS n_sso_users,
                count(DISTINCT CASE WHEN len(article_ids_clicked) > 2 THEN user_id END) AS n_subscribers FROM impressions),
             (SELECT count(*) AS n_history FROM (SELECT DISTINCT user_id, impression_time FROM past))""",
    )
)
def overview(spark, d):
    log = V.impressions(spark, d).withColumns({C.IS_SSO_USER: F.size(C.INVIEW) > 6, C.IS_SUBSCRIBER: F.size(C.CLICKED) > 2})
    return describe.dataset_overview(log, V.histories(spark, d), V.articles(spark, d))


@query(
    """WITH f AS (SELECT u, max(t) AS t, max(v) AS v, max(s) AS s FROM (
            SELECT o_custkey AS u, 1 AS t, 0 AS v, 0 AS s FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
            UNION ALL SELECT o_custkey, 0, 1, 0 FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
            UNION ALL SELECT user_id, 0, 0, 1 FROM events) GROUP BY 1)
       SELECT unnest(['train vs val', 'train vs test', 'val vs test', 'train vs val+test', 'val vs train+test', 'test vs train+val']) AS pair,
              unnest([round(sum(t) / sum(greatest(t, v)), 9), round(sum(t) / sum(greatest(t, s)), 9), round(sum(v) / sum(greatest(v, s)), 9),
                      round(sum(t) / count(*), 9), round(sum(v) / count(*), 9), round(sum(s) / count(*), 9)]) AS overlap FROM f"""
)
def overlap(spark, d):
    log = V.order_heads(spark, d)
    early, late = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("2000-01-01").cast("timestamp_ntz")
    when = F.col(C.IMPRESSION_TIME)
    splits = {
        "train": log.filter(when < early).select(C.USER),
        "val": log.filter((when >= early) & (when < late)).select(C.USER),
        "test": V.clicks(spark, d).select(C.USER),
    }
    pairs = [
        (("train",), ("val",)),
        (("train",), ("test",)),
        (("val",), ("test",)),
        (("train",), ("val", "test")),
        (("val",), ("train", "test")),
        (("test",), ("train", "val")),
    ]
    return describe.overlaps(splits, pairs).withColumns(r(9, "overlap"))


@query(
    """WITH f AS (SELECT o_custkey, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nr
                  FROM orders WHERE o_orderstatus <> 'P')
       SELECT value, count(*) AS n_users, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM f WHERE nr = 1 GROUP BY 1"""
)
def first_segment_share(spark, d):
    orders = V.table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    out = describe.first_value_share(orders, "v", "o_custkey", ["o_orderdate", "o_orderkey"])
    return out.withColumns(r(9, "share"))


@query(with_views("past", "SELECT user_id, count(DISTINCT impression_time) AS n_times FROM past GROUP BY 1"))
def history_interactions(spark, d):
    return describe.unique_history_times(V.histories(spark, d))


@query(
    """WITH n AS (SELECT CASE WHEN text <> '' THEN len(string_split(text, ' ')) ELSE 0 END AS t, CASE WHEN source <> '' THEN len(string_split(source, ' ')) ELSE 0 END AS s FROM documents)
       SELECT 'text' AS "column", round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS std, min(t)::INT AS min, max(t)::INT AS max FROM n
       UNION ALL SELECT 'source', round(avg(s), 6), round(stddev_samp(s), 6), min(s)::INT, max(s)::INT FROM n"""
)
def word_stats(spark, d):
    return describe.word_statistics(V.table(spark, d, "documents"), ["text", "source"]).withColumns(r(6, "mean", "std"))


@query(
    with_views(
        "inview articles",
        f"""WITH {_EXPLODED}, s AS (SELECT impression_id, avg(sentiment_score) AS x FROM e JOIN articles ON article_id = id GROUP BY 1)
        SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM s""",
    )
)
def metric_mean_std(spark, d):
    lists = V.inview(spark, d).select(F.col(C.IMPRESSION_ID).alias("list_id"), F.col(C.INVIEW).alias("items"))
    scores = beyond.sentiment(lists, V.articles(spark, d))
    return beyond.mean_std(scores, "sentiment").withColumns(r(6, "mean", "std"))


@query(
    """WITH b AS (SELECT floor(value / 25)::BIGINT AS bin, count(*) AS count FROM events GROUP BY 1)
       SELECT bin, bin * 25.0::DOUBLE AS bin_start, count, round(count / (sum(count) OVER () * 25), 9) AS density FROM b"""
)
def histogram(spark, d):
    return describe.histogram(V.clicks(spark, d), C.READ_TIME, bin_width=25).withColumns(r(9, "density"))


@query(
    """WITH b AS (SELECT least(floor(value / 10), 19)::BIGINT AS bin, count(*) AS count FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1)
       SELECT bin, bin * 10.0::DOUBLE AS bin_start, count, round(count / (sum(count) OVER () * 10), 9) AS density FROM b"""
)
def histogram_range(spark, d):
    out = describe.histogram(V.clicks(spark, d), C.READ_TIME, n_bins=20, low=0, high=200)
    return out.withColumns(r(9, "density"))


@query(
    """WITH f AS (SELECT c_nationkey AS nation, c_mktsegment, count(*)::DOUBLE AS f FROM customer GROUP BY 1, 2),
       s AS (SELECT nation, count(*) AS k, sum(f) AS n, sum(f * f) AS ff FROM f GROUP BY 1)
       SELECT nation, round(CASE WHEN k > 1 THEN k * (n * n - ff) / (n * n * (k - 1)) WHEN n = 1 THEN 'nan'::DOUBLE ELSE 0 END, 9) AS dispersion FROM s"""
)
def dispersion(spark, d):
    return beyond.index_of_dispersion(V.users(spark, d), "segment", ["nation"]).withColumns(r(9, "dispersion"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    with_views(
        "inview articles",
        f"""WITH l AS (SELECT len(article_ids_inview)::VARCHAR AS name, unnest(article_ids_inview) AS id FROM inview),
        c AS (SELECT name, subcategory[1] AS value, count(*) AS n FROM l JOIN articles ON article_id = id GROUP BY 1, 2)
        SELECT name, {", ".join(f"round(max(n) FILTER (WHERE value = '{v}') / sum(n), 9) AS {v}" for v in P_TYPES)} FROM c GROUP BY 1""",
    )
)
def distribution_wide(spark, d):
    lists = V.inview(spark, d).select(F.size(C.INVIEW).cast("string").alias("name"), F.col(C.INVIEW).alias("items"))
    items = V.articles(spark, d).withColumn("type", F.get(C.SUBCATEGORY, F.lit(0)))
    shares = beyond.distribution(lists, items, "type", group=["name"])
    wide = beyond.distribution_table(shares, "name", P_TYPES)
    return wide.withColumns(r(9, *P_TYPES))


# --- decay, vectors, lists -----------------------------------------------------------------


def _weights(spark, d, weights):
    lists = V.histories(spark, d).select(C.USER, F.posexplode(weights(F.size(C.HISTORY_IDS))).alias("pos", "weight"))
    return lists.withColumns(r(9, "weight"))


@query(with_views("histories", "SELECT user_id, i::INT AS pos, round((i + 1) / n, 9) AS weight FROM (SELECT user_id, len(article_id_fixed) AS n, unnest(range(len(article_id_fixed))) AS i FROM histories)"))
def decay_linear(spark, d):
    return _weights(spark, d, arrays.linear_decay_weights)


@query(with_views("histories", "SELECT user_id, i::INT AS pos, round(pow(0.8, i), 9) AS weight FROM (SELECT user_id, unnest(range(len(article_id_fixed))) AS i FROM histories)"))
def decay_exp(spark, d):
    return _weights(spark, d, lambda n: arrays.exponential_decay_weights(n, 0.8, ascending=False))


@query(
    with_views(
        "impressions_all",
        """SELECT impression_id, len(coalesce(article_ids_clicked, []))::INT AS n, round(coalesce(list_sum(list_transform(range(len(coalesce(article_ids_clicked, []))), lambda i: pow(0.5, i))), 0), 9) AS total FROM impressions_all""",
    )
)
def decay_add(spark, d):
    out = decay.add_decay_weights(V.impressions_all(spark, d), C.CLICKED, arrays.exponential_decay_weights, lambda_factor=0.5)
    weights = f"{C.CLICKED}_weights"
    return out.select(C.IMPRESSION_ID, F.size(weights).alias("n"), F.round(arrays.array_sum(weights), 9).alias("total"))


@query(
    with_views(
        "inview vectors",
        f"""WITH {_EXPLODED}, n AS (SELECT impression_id, len(article_ids_inview) AS n FROM inview)
        SELECT impression_id, pos::INT AS pos, round(vector[1] * (pos + 1) / n, 6) AS v0, round(vector[64] * (pos + 1) / n, 6) AS v63
        FROM e JOIN n USING (impression_id) LEFT JOIN vectors ON article_id = id""",
    )
)
def decay_apply(spark, d):
    cells = mapping.map_list_article_id_to_value(V.inview(spark, d).select(C.IMPRESSION_ID, C.INVIEW), C.INVIEW, V.stored_vectors(spark, d))
    weighted = decay.add_decay_weights(cells, C.INVIEW)
    scaled = decay.decay_weighting_nested_lists(weighted, C.INVIEW, f"{C.INVIEW}_weights")
    rows = scaled.select(C.IMPRESSION_ID, F.posexplode(C.INVIEW).alias("pos", "v"))
    at = lambda i: F.round(F.get("v", F.lit(i)), 6)
    return rows.select(C.IMPRESSION_ID, "pos", at(0).alias("v0"), at(63).alias("v63"))


@query(with_views("histories", f"""SELECT user_id, c::INT AS chunk, {sql_text('list_slice(h, c * 7 + 1, c * 7 + 7)')} AS ids FROM
    (SELECT user_id, article_id_fixed AS h, unnest(range((len(article_id_fixed) + 6) // 7)) AS c FROM histories)"""))
def chunk_list(spark, d):
    out = V.histories(spark, d).select(C.USER, F.posexplode(arrays.chunked(C.HISTORY_IDS, 7)).alias("chunk", "ids"))
    return out.withColumn("ids", as_text("ids"))


@query(
    with_views(
        "inview",
        f"""WITH {_EXPLODED} SELECT impression_id, pos::INT AS pos, unnest(range(len(article_ids_inview)))::INT AS copy, round(coalesce(embedding[1]::DOUBLE, 0), 6) AS v0
        FROM e JOIN inview USING (impression_id) LEFT JOIN embeddings ON vec_id = id""",
    )
)
def gather_repeat(spark, d):
    """Each gathered vector once per candidate of its impression."""
    rows = V.inview(spark, d).select(C.IMPRESSION_ID, F.size(C.INVIEW).alias("n"), F.posexplode(C.INVIEW).alias("pos", C.ARTICLE_ID))
    out = mapping.repeat_vectors(rows, C.ARTICLE_ID, V.vectors(spark, d), "n", spread=[C.IMPRESSION_ID, "pos"])
    return out.select(C.IMPRESSION_ID, "pos", "copy", F.round(F.get("vector", F.lit(0)), 6).alias("v0"))


@query(
    with_views(
        "clicks vectors",
        """WITH p AS (SELECT c.event_id, a.vector AS a, b.vector AS b FROM clicks c JOIN vectors a ON a.article_id = c.article_id JOIN vectors b ON b.article_id = c.user_id),
        q AS (SELECT event_id, list_sum(list_transform(range(1, 65), lambda k: a[k] * b[k])) AS ab, list_sum(list_transform(a, lambda x: x * x)) AS aa, list_sum(list_transform(b, lambda x: x * x)) AS bb,
              list_sum(list_transform(range(1, 65), lambda k: (a[k] - b[k]) * (a[k] - b[k]))) AS d2, list_sum(list_transform(range(1, 65), lambda k: abs(a[k] - b[k]))) AS d1 FROM p)
        SELECT event_id, round(1 - ab / sqrt(aa * bb), 6) AS cosine, round(sqrt(d2), 6) AS euclidean, round(d1, 6) AS manhattan FROM q""",
    )
)
def pair_distances(spark, d):
    vectors = V.vectors(spark, d)
    pairs = lookup_join(V.clicks(spark, d).select("event_id", C.USER, C.ARTICLE_ID), vectors.withColumnRenamed("vector", "a"), C.ARTICLE_ID, "inner")
    pairs = lookup_join(pairs, vectors.select(F.col(C.ARTICLE_ID).alias(C.USER), F.col("vector").alias("b")), C.USER, "inner")
    return pairs.select("event_id", *[F.round(fn("a", "b"), 6).alias(n) for n, fn in arrays.DISTANCES.items()])


@query(
    with_views(
        "inview",
        f"""SELECT impression_id, len(article_ids_inview)::INT AS n, article_ids_inview[1] AS first, list_sum(article_ids_inview)::BIGINT AS total,
        {sql_text('list_slice(article_ids_inview, greatest(len(article_ids_inview) - 1, 1), len(article_ids_inview))')} AS tail,
        {sql_text('list_reverse(article_ids_inview)')} AS backwards, {sql_text('list_transform(article_ids_inview, lambda x: x * 2)')} AS doubled FROM inview""",
    )
)
def list_ops(spark, d):
    c = F.col(C.INVIEW)
    return V.inview(spark, d).select(
        C.IMPRESSION_ID,
        F.size(c).alias("n"),
        F.get(c, F.lit(0)).alias("first"),
        F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        as_text(arrays.tail(c, 2)).alias("tail"),
        as_text(F.reverse(c)).alias("backwards"),
        as_text(F.transform(c, lambda x: x * 2)).alias("doubled"),
    )


@query(
    """SELECT c_custkey AS user_id, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer) * 4 + 1, 6) AS own,
              round((c_acctbal - 0) / 10000, 6) AS given FROM customer"""
)
def scale_minmax(spark, d):
    rows = V.table(spark, d, "customer").select(F.col("c_custkey").alias(C.USER), "c_acctbal")
    own = describe.scale_range(rows, "c_acctbal", t_min=1.0, t_max=5.0, out="own")
    return describe.scale_range(own, "c_acctbal", r_min=0, r_max=10000, out="given").select(C.USER, *[F.round(c, 6).alias(c) for c in ("own", "given")])


@query(with_views("counters", "SELECT article_id, round(total_inviews / (SELECT max(total_inviews) FROM counters), 9) AS share FROM counters"))
def normalise_max(spark, d):
    out = describe.normalise_max(V.counters(spark, d), C.TOTAL_INVIEWS, out="share")
    return out.select(C.ARTICLE_ID, F.round("share", 9).alias("share"))


@query('SELECT c_custkey, c_name AS "name-who", c_mktsegment AS "segment-where-who", c_nationkey AS "nation-where-who" FROM customer')
def flatten_struct(spark, d):
    nested = V.table(spark, d, "customer").select(
        "c_custkey",
        F.struct(
            F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("where")
        ).alias("who"),
    )
    return checks.flatten_struct(nested)


# --- text and dates ------------------------------------------------------------------------


@query("SELECT p_partkey AS article_id, p_name || ' ' || p_brand || ' ' || CASE WHEN p_size > 10 THEN p_type END AS text FROM part")
def concat_text(spark, d):
    parts = V.table(spark, d, "part").withColumn("t", F.when(F.col("p_size") > 10, F.col("p_type")))
    out, name = T.concat_str_columns(parts, ["p_name", "p_brand", "t"])
    return out.select(F.col("p_partkey").alias(C.ARTICLE_ID), F.col(f"`{name}`").alias("text"))


@query("SELECT p_partkey AS article_id, CASE WHEN p_size > 10 THEN p_type || ' ' ELSE '' END || p_brand AS text FROM part")
def join_list_text(spark, d):
    parts = V.table(spark, d, "part").withColumn("l", F.array(F.when(F.col("p_size") > 10, F.col("p_type")), "p_brand"))
    return T.concat_list_str(parts, "l").select(F.col("p_partkey").alias(C.ARTICLE_ID), F.col("l").alias("text"))


@query("SELECT doc_id, CASE WHEN text <> '' THEN len(string_split(text, ' ')) ELSE 0 END::INT AS n_words FROM documents")
def word_count(spark, d):
    return describe.add_word_count_column(V.table(spark, d, "documents"), "text", "n_words").select("doc_id", "n_words")


@query(
    """SELECT o_orderkey AS impression_id, o_orderdate::DATE AS day, o_orderdate::DATE - 7 AS week_before, o_orderdate::DATE = (SELECT max(o_orderdate::DATE) FROM orders) AS is_last FROM orders"""
)
def date_ops(spark, d):
    log = V.order_heads(spark, d)
    day = F.to_date(C.IMPRESSION_TIME)
    last = log.agg(F.max(day)).scalar()
    return log.select(C.IMPRESSION_ID, day.alias("day"), F.date_sub(day, 7).alias("week_before"), (day == last).alias("is_last"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, s // 86400 || ' days ' || s % 86400 // 3600 || ':' || s % 3600 // 60 || ':' || s % 60 AS delta
       FROM (SELECT *, date_diff('second', TIMESTAMP '1990-01-01', l_shipdate) + l_partkey * 37 AS s FROM lineitem)"""
)
def format_delta(spark, d):
    seconds = X.seconds_between("l_shipdate", F.lit("1990-01-01").cast("timestamp_ntz")) + F.col("l_partkey") * 37
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", X.format_delta(seconds).alias("delta"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS text FROM events")
def format_ts(spark, d):
    return V.clicks(spark, d).select("event_id", X.timestamp_text(C.IMPRESSION_TIME).alias("text"))


_VOCAB = "vocab AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM words GROUP BY 1)"


@query(with_views("words", f"WITH {_VOCAB} SELECT token, n, id FROM vocab"))
def vocab(spark, d):
    return T.vocabulary(V.texts(spark, d), C.BODY)


@query(
    with_views(
        "words",
        f"""WITH {_VOCAB} SELECT article_id, count(*)::INT AS n, sum(id * (pos + 1))::BIGINT AS checksum FROM words JOIN vocab USING (token) GROUP BY 1
        UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT article_id FROM words)""",
    )
)
def encode_text(spark, d):
    texts = V.texts(spark, d)
    out, name = T.convert_text2encoding(texts, T.vocabulary(texts, C.BODY), C.BODY)
    checksum = F.aggregate(F.transform(name, lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select(C.ARTICLE_ID, F.size(name).alias("n"), checksum.alias("checksum"))


@query(
    with_views(
        "words",
        f"""WITH {_VOCAB}, kept AS (SELECT article_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids, count(*) AS n FROM words JOIN vocab USING (token) WHERE pos < 32 GROUP BY 1)
        SELECT doc_id AS article_id, coalesce(ids, '') || CASE WHEN ids IS NULL THEN '0' || repeat(',0', 31) ELSE repeat(',0', 32 - n) END AS ids
        FROM documents LEFT JOIN kept ON article_id = doc_id""",
    )
)
def encode_text_padded(spark, d):
    texts = V.texts(spark, d)
    out, name = T.convert_text2encoding(texts, T.vocabulary(texts, C.BODY), C.BODY, max_length=32)
    return out.select(C.ARTICLE_ID, as_text(name).alias("ids"))


@query(
    with_views(
        "words",
        """WITH placed AS (SELECT article_id, CAST('0x' || substr(md5('0:' || token), 1, 8) AS BIGINT) % 256 AS dim FROM words),
        counts AS (SELECT article_id, dim, count(*)::DOUBLE AS n FROM placed GROUP BY 1, 2),
        lengths AS (SELECT article_id, sqrt(sum(n * n)) AS len FROM counts GROUP BY 1)
        SELECT article_id, dim::INT AS dim, round(n / len, 6) AS x FROM counts JOIN lengths USING (article_id)""",
    )
)
def hash_embeddings(spark, d):
    out = T.hashed_embeddings(V.texts(spark, d), C.BODY, dim=256, dtype="float64")
    return out.select(C.ARTICLE_ID, F.posexplode("embedding").alias("dim", "x")).filter("x <> 0").withColumns(r(6, "x"))


@query(
    with_views(
        "words",
        """WITH ctx AS (SELECT a.token, b.token AS other FROM words a JOIN words b ON a.article_id = b.article_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 2),
        pairs AS (SELECT token, other, count(*) AS n FROM ctx GROUP BY 1, 2),
        signed AS (SELECT token, CAST('0x' || substr(md5('0:' || other), 1, 8) AS BIGINT) % 64 AS dim, CASE WHEN substr(md5('0:' || other), 9, 1) < '8' THEN n ELSE -n END AS n FROM pairs),
        sums AS (SELECT token, dim, sum(n)::DOUBLE AS x FROM signed GROUP BY 1, 2),
        lengths AS (SELECT token, sqrt(sum(x * x)) AS len FROM sums GROUP BY 1)
        SELECT token, dim::INT AS dim, round(CASE WHEN len = 0 THEN 0 ELSE x / len END, 6) AS x FROM sums JOIN lengths USING (token) WHERE x <> 0""",
    )
)
def word_vectors(spark, d):
    out = T.token_vectors(V.texts(spark, d), C.BODY, dim=64, window=2)
    return out.select("token", F.posexplode("vector").alias("dim", "x")).filter("x <> 0").withColumns(r(6, "x"))
