"""Loading, filtering, mapping, histories, splitting and sampling."""

import uuid

from pyspark.sql import functions as F

from gazette import columns as C


from gazette.functions import ranking
from gazette.functions.arrays import binary_labels
from gazette.operators import checks, filters, history, mapping, sampling, scoring
from gazette.plans.numbering import row_index as number_rows, row_position
from gazette.plans.store import materialise, scratch_folder
from gazette.sources import files
from gazette.workload import views as V
from gazette.workload.registry import query
from gazette.workload.views import as_text, sql_key, sql_text, with_views

SEED = 42


def scratch(spark):
    return f"{scratch_folder(spark).rstrip('/')}/gazette-{uuid.uuid4().hex}"


def sql_tail(c, n):
    return f"list_slice({c}, greatest(len({c}) - {n} + 1, 1), len({c}))"


def small_articles(spark, d):
    """Half of the catalogue: the id set of the operators that keep or drop ids by a set."""
    return V.articles(spark, d).filter("size <= 25")


# --- sources and sinks ---------------------------------------------------------------------


@query(
    with_views(
        "impressions histories",
        f"""
        SELECT impression_id, i.user_id, len(article_ids_inview)::INT AS n_inview,
               CASE WHEN article_id_fixed IS NULL THEN NULL ELSE
               {sql_text(f"list_concat(list_transform(range(greatest(30 - len(article_id_fixed), 0)), lambda x: 0::BIGINT), {sql_tail('article_id_fixed', 30)})")}
               END AS history
        FROM impressions i LEFT JOIN histories h ON i.user_id = h.user_id""",
    )
)
def impressions_with_history(spark, d):
    past = V.histories(spark, d)
    out = files.join_history(V.impressions(spark, d), past, history_size=30, padding=0)
    return out.select(C.IMPRESSION_ID, C.USER, F.size(C.INVIEW).alias("n_inview"), as_text(C.HISTORY_IDS).alias("history"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 40")
def scan_select(spark, d):
    path = scratch(spark)
    files.write_table(
        files.scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"], F.col("l_quantity") > 40), path
    )
    return files.scan(spark, path)


_RANKED = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY price DESC, article_id DESC) AS rank,
                      row_number() OVER (PARTITION BY impression_id ORDER BY article_id) - 1 AS pos FROM cells)"""


@query(
    with_views(
        "cells",
        f"""WITH {_RANKED}
        SELECT impression_id || ' [' || string_agg(rank::VARCHAR, ',' ORDER BY pos) || ']' AS value FROM ranked GROUP BY impression_id""",
    )
)
def submission_lines(spark, d):
    ranked = scoring.rank_predictions_by_score(V.scored(spark, d), "price_scores", "ranks")
    return files.submission_lines(ranked, "ranks")


@query(with_views("cells", f"WITH {_RANKED} SELECT impression_id::VARCHAR AS impression_id, pos::INT AS pos, rank::DOUBLE AS value FROM ranked"))
def submission_roundtrip(spark, d):
    path = scratch(spark)
    ranked = scoring.rank_predictions_by_score(V.scored(spark, d), "price_scores", "ranks")
    files.write_submission_file(ranked, "ranks", path)
    return files.read_submission_file(spark, path).select(C.IMPRESSION_ID, F.posexplode("values").alias("pos", "value"))


@query(
    with_views(
        "histories",
        "SELECT user_id, unnest(range(len(article_id_fixed)))::INT AS pos, unnest(article_id_fixed) AS article_id, unnest(read_time_fixed) AS read_time FROM histories",
    )
)
def json_roundtrip(spark, d):
    path = scratch(spark)
    past = V.histories(spark, d).select(C.USER, C.HISTORY_IDS, C.HISTORY_READ_TIMES)
    files.write_json_file(past, path)
    back = files.read_json_file(spark, path, past.schema)
    zipped = F.arrays_zip(F.col(C.HISTORY_IDS).alias("a"), F.col(C.HISTORY_READ_TIMES).alias("r"))
    return back.select(C.USER, F.posexplode(zipped).alias("pos", "z")).select(
        C.USER, "pos", F.col("z.a").alias(C.ARTICLE_ID), F.col("z.r").alias(C.READ_TIME)
    )


@query(
    """SELECT p_partkey AS article_id, p_name AS title, label, len(embedding)::INT AS width, round(embedding[1]::DOUBLE, 6) AS v0
       FROM part LEFT JOIN embeddings ON p_partkey = vec_id"""
)
def join_embeddings(spark, d):
    catalogue = V.articles(spark, d).withColumnRenamed(C.ARTICLE_ID, "vec_id")
    out = files.load_article_id_embeddings(catalogue, f"{d}/embeddings.parquet", "vec_id")
    width = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return out.select(F.col("vec_id").alias(C.ARTICLE_ID), C.TITLE, "label", width.alias("width"), first.alias("v0"))


@query(
    """SELECT p_partkey AS article_id, round(embedding[1]::DOUBLE, 6) AS v0, round(embedding[64]::DOUBLE, 6) AS v63
       FROM part LEFT JOIN embeddings ON p_partkey = vec_id WHERE p_size <= 25"""
)
def join_embeddings_semi(spark, d):
    out = files.load_join_embeddings(small_articles(spark, d), V.vectors(spark, d))
    at = lambda i: F.round(F.get("vector", F.lit(i)), 6)
    return out.select(C.ARTICLE_ID, at(0).alias("v0"), at(63).alias("v63"))


# --- filters -------------------------------------------------------------------------------


@query(with_views("inview", "SELECT impression_id, len(article_ids_inview) = len(article_ids_clicked) AS same FROM inview"))
def list_len_check(spark, d):
    return V.inview(spark, d).select(C.IMPRESSION_ID, checks.equal_list_lengths(C.INVIEW, C.CLICKED).alias("same"))


@query("SELECT c_custkey AS user_id, c_mktsegment AS segment, c_nationkey FROM customer")
def rename_cols(spark, d):
    customers = V.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return checks.rename_columns(customers, {"c_custkey": C.USER, "c_mktsegment": "segment", "absent": "x"})


@query(with_views("inview", "SELECT impression_id FROM inview WHERE len(article_ids_inview) - len(article_ids_clicked) >= 3"))
def min_negatives(spark, d):
    return filters.filter_minimum_negative_samples(V.inview(spark, d), 3).select(C.IMPRESSION_ID)


@query("SELECT event_id, value AS read_time FROM events WHERE value >= 60")
def read_time_filter(spark, d):
    return filters.filter_read_times(V.clicks(spark, d), 60).select("event_id", C.READ_TIME)


@query(with_views("inview", f"SELECT impression_id, {sql_text('article_ids_inview')} AS ids FROM inview WHERE len(article_ids_inview) >= 5"))
def min_len(spark, d):
    return filters.filter_minimum_lengths_from_list(V.inview(spark, d), 5).select(C.IMPRESSION_ID, as_text(C.INVIEW).alias("ids"))


@query(with_views("impressions_all", f"SELECT impression_id, {sql_text('article_ids_inview')} AS ids FROM impressions_all WHERE len(article_ids_inview) <= 3"))
def max_len(spark, d):
    return filters.filter_maximum_lengths_from_list(V.impressions_all(spark, d), 3).select(C.IMPRESSION_ID, as_text(C.INVIEW).alias("ids"))


@query(
    with_views(
        "impressions_all articles",
        """WITH kept AS (
            SELECT impression_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids
            FROM (SELECT impression_id, unnest(article_ids_inview) AS id FROM impressions_all)
            WHERE id IN (SELECT article_id FROM articles WHERE size <= 25) GROUP BY 1)
        SELECT o_orderkey AS impression_id, ids FROM orders LEFT JOIN kept ON o_orderkey = impression_id""",
    )
)
def filter_list_elements(spark, d):
    out = filters.filter_list_elements(V.impressions_all(spark, d), C.INVIEW, small_articles(spark, d).select(C.ARTICLE_ID))
    return out.select(C.IMPRESSION_ID, as_text(C.INVIEW).alias("ids"))


@query(
    with_views(
        "clicks articles",
        "SELECT event_id, CASE WHEN article_id IN (SELECT article_id FROM articles WHERE size <= 25) THEN article_id END AS article_id FROM clicks",
    )
)
def filter_elements(spark, d):
    return filters.filter_elements(V.clicks(spark, d), C.ARTICLE_ID, small_articles(spark, d).select(C.ARTICLE_ID)).select(
        "event_id", C.ARTICLE_ID
    )


@query("SELECT conv_id, turn FROM conversations WHERE length(text) > 0")
def nonempty_text(spark, d):
    return filters.filter_empty_text_column(V.table(spark, d, "conversations"), "text").select("conv_id", "turn")


@query("SELECT o_orderkey AS impression_id, o_custkey IN (SELECT user_id FROM events) AS is_known_user FROM orders")
def known_users(spark, d):
    out = filters.add_known_user_column(V.order_heads(spark, d), V.clicks(spark, d).select(C.USER))
    return out.select(C.IMPRESSION_ID, C.KNOWN_USER)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS flag FROM lineitem")
def binarise(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ranking.binarise("l_discount", 0.05).alias("flag"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 'flagged' ELSE 'rest' END AS side FROM events")
def flag_split(spark, d):
    flagged, rest = filters.split_on_flag(V.clicks(spark, d).withColumn("flag", F.col(C.READ_TIME) > 50), "flag")
    sides = flagged.withColumn("side", F.lit("flagged")).unionByName(rest.withColumn("side", F.lit("rest")))
    return sides.select("event_id", "side")


@query(
    with_views(
        "clicks",
        """SELECT count(*) AS n_rows, count(*) FILTER (WHERE article_id IS NULL) AS n_front, count(article_id) AS n_article,
            round(count(*) FILTER (WHERE article_id IS NULL) / count(*), 9) AS front_share, round(count(article_id) / count(*), 9) AS article_share,
            count(*) FILTER (WHERE article_id IS NULL AND read_time < 20) AS n_front_short,
            count(*) FILTER (WHERE article_id IS NOT NULL AND read_time < 20) AS n_article_short FROM clicks""",
    )
)
def frontpage_share(spark, d):
    out = filters.page_share(V.clicks(spark, d), read_time_cut=20)
    return out.withColumns({c: F.round(c, 9) for c in ("front_share", "article_share")})


@query(
    """WITH c AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
       SELECT p_partkey AS article_id, coalesce(n, 1) AS total_inviews, coalesce(r, 1) AS total_pageviews FROM part LEFT JOIN c ON p_partkey = l_partkey"""
)
def fill_defaults(spark, d):
    lines = V.table(spark, d, "lineitem")
    counted = lines.groupBy(F.col("l_partkey").alias(C.ARTICLE_ID)).agg(
        F.count("*").alias(C.TOTAL_INVIEWS), F.count_if(F.col("l_returnflag") == "R").alias(C.TOTAL_PAGEVIEWS)
    )
    joined = V.articles(spark, d).select(C.ARTICLE_ID).join(counted, C.ARTICLE_ID, "left")
    return filters.fill_counters(joined)


@query(
    with_views(
        "impressions_all",
        f"""SELECT impression_id, article_ids_inview[1] AS article_ids_clicked,
            CASE WHEN article_ids_inview IS NOT NULL THEN {sql_text('list_transform(article_ids_inview, lambda x: 0)')} END AS labels FROM impressions_all""",
    )
)
def placeholders(spark, d):
    out = filters.with_placeholders(V.impressions_all(spark, d))
    return out.select(C.IMPRESSION_ID, C.CLICKED, as_text(C.LABELS).alias(C.LABELS))


@query(with_views("impressions", f"SELECT impression_id, user_id, impression_time, {sql_text('article_ids_clicked')} AS clicked FROM impressions"))
def working_set(spark, d):
    return V.impressions(spark, d).select(C.IMPRESSION_ID, C.USER, C.IMPRESSION_TIME, as_text(C.CLICKED).alias("clicked"))


# --- joins and mappings --------------------------------------------------------------------


@query(
    with_views(
        "histories",
        f"""SELECT o_orderkey AS impression_id, CASE WHEN article_id_fixed IS NOT NULL THEN {sql_text(sql_tail('article_id_fixed', 50))} END AS history
            FROM orders LEFT JOIN histories ON o_custkey = user_id""",
    )
)
def join_history(spark, d):
    out = files.join_history(V.order_heads(spark, d), V.histories(spark, d), history_size=50, padding=None)
    return out.select(C.IMPRESSION_ID, as_text(C.HISTORY_IDS).alias("history"))


_MAPPED = """
    mapped AS (
        SELECT e.impression_id, e.pos, a.category_str AS v
        FROM (SELECT impression_id, unnest(article_ids_inview) AS id, unnest(range(len(article_ids_inview))) AS pos FROM impressions_all) e
        LEFT JOIN articles a ON a.article_id = e.id)"""


def _mapped(spark, d, **options):
    mapping_df = mapping.create_article_id_to_value_mapping(V.articles(spark, d), C.CATEGORY_STR)
    out = mapping.map_list_article_id_to_value(V.impressions_all(spark, d), C.INVIEW, mapping_df, **options)
    return out.select(C.IMPRESSION_ID, as_text(C.INVIEW).alias("mapped"))


@query(
    with_views(
        "impressions_all articles",
        f"""WITH {_MAPPED}, lists AS (SELECT impression_id, string_agg(coalesce(v, 'Unknown'), ',' ORDER BY pos) AS m FROM mapped GROUP BY 1)
        SELECT o_orderkey AS impression_id, coalesce(m, 'Unknown') AS mapped FROM orders LEFT JOIN lists ON o_orderkey = impression_id""",
    )
)
def map_list_fill(spark, d):
    return _mapped(spark, d, fill_nulls="Unknown")


@query(
    with_views(
        "impressions_all articles",
        f"""WITH {_MAPPED}, lists AS (SELECT impression_id, string_agg(v, ',' ORDER BY pos) AS m FROM mapped WHERE v IS NOT NULL GROUP BY 1)
        SELECT o_orderkey AS impression_id, m AS mapped FROM orders LEFT JOIN lists ON o_orderkey = impression_id""",
    )
)
def map_list_drop(spark, d):
    return _mapped(spark, d, drop_nulls=True)


@query(
    with_views(
        "impressions_all articles",
        f"""WITH {_MAPPED}, lists AS (SELECT impression_id, string_agg(coalesce(v, 'null'), ',' ORDER BY pos) AS m FROM mapped GROUP BY 1)
        SELECT o_orderkey AS impression_id, coalesce(m, 'null') AS mapped FROM orders LEFT JOIN lists ON o_orderkey = impression_id""",
    )
)
def map_list_null(spark, d):
    return _mapped(spark, d)


@query(
    with_views(
        "inview counters",
        """WITH e AS (SELECT impression_id, unnest(article_ids_inview) AS id, unnest(range(len(article_ids_inview))) AS pos FROM inview)
        SELECT impression_id, pos::INT AS pos, coalesce(total_pageviews, 0)::DOUBLE AS score
        FROM e LEFT JOIN counters c ON c.article_id = id""",
    )
)
def score_lookup(spark, d):
    scores = V.counters(spark, d).select(C.ARTICLE_ID, F.col(C.TOTAL_PAGEVIEWS).alias("score"))
    out = mapping.score_lists(V.inview(spark, d), materialise(scores))
    return out.select(C.IMPRESSION_ID, F.posexplode("score").alias("pos", "score"))


@query(
    """SELECT p_partkey AS article_id, CASE WHEN g.n > 0 THEN upper(p_brand) ELSE 'MSC' END AS coarse
       FROM part JOIN (SELECT p_brand AS b, count(*) FILTER (WHERE p_type = 'PROMO' AND p_size > 40) AS n FROM part GROUP BY 1) g ON b = p_brand"""
)
def category_map(spark, d):
    catalogue = V.articles(spark, d)
    promoted = catalogue.filter((F.get(C.SUBCATEGORY, F.lit(0)) == "PROMO") & (F.col("size") > 40))
    coarse = promoted.select(C.CATEGORY_STR).distinct().withColumn("coarse", F.upper(C.CATEGORY_STR))
    return mapping.map_column(V.articles(spark, d), C.CATEGORY_STR, coarse, default="MSC", out="coarse").select(C.ARTICLE_ID, "coarse")


@query(
    with_views(
        "clicks",
        "SELECT user_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nr FROM clicks) WHERE nr = 1",
    )
)
def mapping_table(spark, d):
    return mapping.create_lookup(V.clicks(spark, d), C.USER, C.ARTICLE_ID, order_col="event_id")


@query(
    with_views(
        "inview articles",
        """WITH e AS (SELECT impression_id, unnest(article_ids_inview) AS id, unnest(range(len(article_ids_inview))) AS pos FROM inview)
        SELECT impression_id, pos::INT AS pos, article_id, title FROM e JOIN articles ON article_id = id""",
    )
)
def known_items(spark, d):
    out = mapping.known_items(
        V.inview(spark, d), V.articles(spark, d), C.IMPRESSION_ID, C.INVIEW, C.ARTICLE_ID, columns=[C.TITLE]
    )
    return out.select(C.IMPRESSION_ID, "pos", C.ARTICLE_ID, C.TITLE)


@query(
    """SELECT unnest(['title', 'vector', 'label']) AS attribute, unnest([count(*) FILTER (WHERE p_name IS NULL),
        count(*) FILTER (WHERE embedding IS NULL), count(*) FILTER (WHERE label IS NULL)]) AS n_missing
       FROM part LEFT JOIN embeddings ON p_partkey = vec_id"""
)
def missing_attributes(spark, d):
    emb = V.table(spark, d, "embeddings").withColumnsRenamed({"vec_id": C.ARTICLE_ID, "embedding": "vector"})
    return checks.missing_attributes(V.articles(spark, d).join(emb, C.ARTICLE_ID, "left"), [C.TITLE, "vector", "label"])


# --- histories and time splits -------------------------------------------------------------


@query(with_views("histories", f"SELECT user_id, {sql_text(sql_tail('article_id_fixed', 5))} AS ids FROM histories"))
def truncate_history(spark, d):
    out = history.truncate_history(V.histories(spark, d), C.HISTORY_IDS, 5, enable_warning=False)
    return out.select(C.USER, as_text(C.HISTORY_IDS).alias("ids"))


@query(
    with_views(
        "histories",
        f"""SELECT user_id, {sql_text(f"list_concat(list_transform(range(greatest(45 - len(article_id_fixed), 0)), lambda x: -1::BIGINT), {sql_tail('article_id_fixed', 45)})")} AS ids
        FROM histories""",
    )
)
def pad_history(spark, d):
    out = history.truncate_history(V.histories(spark, d), C.HISTORY_IDS, 45, padding_value=-1, enable_warning=False)
    return out.select(C.USER, as_text(C.HISTORY_IDS).alias("ids"))


@query(
    with_views(
        "clicks",
        f"""SELECT event_id, coalesce({sql_text("list_filter(h, lambda x: x IS NOT NULL)")}, '') AS history FROM (
            SELECT event_id, list(article_id) OVER (PARTITION BY user_id ORDER BY impression_time, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM clicks)""",
    )
)
def dynamic_history(spark, d):
    out = history.create_dynamic_history(V.clicks(spark, d), 5, tie_cols=["event_id"])
    return out.select("event_id", as_text("history_dynamic").alias("history"))


_CUTOFF = "2024-01-20 00:00:00"
_FIXED = f"""
    before AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY impression_time DESC, event_id DESC) AS back
               FROM clicks WHERE article_id IS NOT NULL AND impression_time < TIMESTAMP '{_CUTOFF}'),
    lists AS (SELECT user_id, string_agg(article_id::VARCHAR, ',' ORDER BY back DESC) AS ids,
                     string_agg(coalesce(floor(read_time)::BIGINT::VARCHAR, 'null'), ',' ORDER BY back DESC) AS times
              FROM before WHERE back <= 10 GROUP BY 1)"""


def _cutoff():
    return F.lit(_CUTOFF).cast("timestamp_ntz")


@query(with_views("clicks", f"WITH {_FIXED} SELECT event_id, ids AS history FROM clicks LEFT JOIN lists USING (user_id)"))
def fixed_history(spark, d):
    out = history.create_fixed_history(V.clicks(spark, d), _cutoff(), 10, tie_cols=["event_id"])
    return out.select("event_id", as_text("history_fixed").alias("history"))


@query(with_views("clicks", f"WITH {_FIXED} SELECT event_id, ids AS history, times FROM clicks LEFT JOIN lists USING (user_id)"))
def fixed_history_multi(spark, d):
    log = V.clicks(spark, d)
    out = history.create_fixed_history_aggr_columns(log, _cutoff(), 10, columns=[C.READ_TIME], tie_cols=["event_id"])
    whole = F.transform(C.HISTORY_READ_TIMES, lambda x: F.floor(x))
    return out.select("event_id", as_text(C.HISTORY_IDS).alias("history"), as_text(whole).alias("times"))


@query(with_views("clicks", f"SELECT event_id, {sql_text('list_filter([article_id, user_id, article_id], lambda x: x IS NOT NULL)')} AS ids FROM clicks"))
def drop_list_nulls(spark, d):
    lists = V.clicks(spark, d).select("event_id", F.array(C.ARTICLE_ID, C.USER, C.ARTICLE_ID).alias("ids"))
    return history.drop_nulls_from_list(lists, "ids").select("event_id", as_text("ids").alias("ids"))


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {sql_key(SEED, 'event_id')}) AS nr FROM events) WHERE nr <= 10")
def downsample_users(spark, d):
    return history.down_sample_on_users(V.clicks(spark, d), 10, seed=SEED, key="event_id").select("event_id", C.USER)


def _sides(train, rest, *cols):
    return train.withColumn("side", F.lit("train")).unionByName(rest.withColumn("side", F.lit("validation"))).select(*cols, "side")


@query("SELECT event_id, CASE WHEN ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'train' ELSE 'validation' END AS side FROM events")
def split_last_day(spark, d):
    return _sides(*history.split_last_period(V.clicks(spark, d)), "event_id")


@query("SELECT event_id, CASE WHEN ts::DATE < (SELECT max(ts::DATE) FROM events) - 1 THEN 'train' ELSE 'validation' END AS side FROM events")
def split_by_date(spark, d):
    return _sides(*history.split_by_date(V.clicks(spark, d)), "event_id")


SWEEP_SIZES = [1, 2, 5, 10, 20, 40]


@query(
    with_views(
        "impressions histories vectors",
        """WITH rows AS (SELECT impression_id, i.user_id, article_ids_inview AS inview, article_ids_clicked AS clicked, article_id_fixed AS h
                 FROM impressions i JOIN histories USING (user_id) WHERE len(article_id_fixed) >= 20),
        sizes AS (SELECT unnest([1, 2, 5, 10, 20, 40]) AS size),
        heard AS (SELECT user_id, size, unnest(list_slice(h, greatest(len(h) - size + 1, 1), len(h))) AS article_id
                  FROM (SELECT DISTINCT user_id, h FROM rows), sizes),
        dims AS (SELECT user_id, size, dim, avg(vector[dim]) AS x FROM heard JOIN vectors USING (article_id), (SELECT unnest(range(1, 65)) AS dim) GROUP BY ALL),
        taste AS (SELECT user_id, size, list(x ORDER BY dim) AS u FROM dims GROUP BY 1, 2),
        shown AS (SELECT impression_id, user_id, unnest(inview) AS article_id, clicked FROM rows),
        s AS (SELECT impression_id, size, CASE WHEN list_contains(clicked, article_id) THEN 1 ELSE 0 END AS y,
                     coalesce(list_sum(list_transform(range(1, 65), lambda k: u[k] * vector[k])), 0) AS p
              FROM shown JOIN taste USING (user_id) LEFT JOIN vectors USING (article_id)),
        pairs AS (SELECT a.impression_id, a.size, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS auc
                  FROM s a JOIN s b ON a.impression_id = b.impression_id AND a.size = b.size AND a.y = 1 AND b.y = 0 GROUP BY 1, 2)
        SELECT size AS history_size, count(*) AS n, round(avg(auc), 6) AS auc FROM pairs GROUP BY 1""",
    )
)
def history_sweep(spark, d):
    each = history.history_sweep(V.histories(spark, d).select(C.USER, C.HISTORY_IDS), SWEEP_SIZES, min_length=20)
    log = V.impressions(spark, d).join(each.select(C.USER, "history_size"), C.USER)
    scored = scoring.embedding_scores(
        log,
        each,
        V.vectors(spark, d),
        lambda n: F.array_repeat(F.lit(1.0), n),
        user_key=[C.USER, "history_size"],
        key=[C.IMPRESSION_ID, "history_size"],
    )
    auc = scored.select("history_size", ranking.auc(binary_labels(C.INVIEW, C.CLICKED), F.col("scores")).alias("auc"))
    return auc.groupBy("history_size").agg(F.count("auc").alias("n"), F.round(F.avg("auc"), 6).alias("auc"))


# --- set operations, splitting, numbering, sampling ----------------------------------------


@query("SELECT o_custkey AS user_id, o_orderdate AS impression_time FROM orders UNION ALL SELECT user_id, ts FROM events")
def union_all(spark, d):
    cols = [C.USER, C.IMPRESSION_TIME]
    return V.order_heads(spark, d).select(*cols).unionByName(V.clicks(spark, d).select(*cols))


@query("SELECT o_custkey AS user_id FROM orders UNION SELECT user_id FROM events")
def union_distinct(spark, d):
    return V.order_heads(spark, d).select(C.USER).unionByName(V.clicks(spark, d).select(C.USER)).distinct()


@query(with_views("inview", f"SELECT impression_id, {sql_text('list_filter(article_ids_inview, lambda x: NOT list_contains(article_ids_clicked, x))')} AS ids FROM inview"))
def remove_positives(spark, d):
    return sampling.remove_positives_from_inview(V.inview(spark, d)).select(C.IMPRESSION_ID, as_text(C.INVIEW).alias("ids"))


@query(with_views("histories", f"SELECT user_id, {sql_text('list_filter(article_id_fixed, lambda x, i: list_position(article_id_fixed, x) = i)')} AS ids FROM histories"))
def unique_list(spark, d):
    return sampling.keep_unique_values_in_list(V.histories(spark, d), C.HISTORY_IDS).select(C.USER, as_text(C.HISTORY_IDS).alias("ids"))


@query(f"SELECT o_orderkey AS impression_id, row_number() OVER (ORDER BY {sql_key(SEED, 'o_orderkey')}) - 1 AS row_nr FROM orders")
def shuffle_rows(spark, d):
    return row_position(sampling.shuffle_rows(V.order_heads(spark, d).select(C.IMPRESSION_ID), SEED, C.IMPRESSION_ID))


_SHUFFLED = f"""
    e AS (SELECT impression_id, unnest(article_ids_inview) AS id, unnest(range(len(article_ids_inview))) AS pos FROM inview),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY {sql_key(SEED, 'impression_id', 'pos')}) AS nr FROM e)"""


@query(with_views("inview", f"WITH {_SHUFFLED} SELECT impression_id, string_agg(id::VARCHAR, ',' ORDER BY nr) AS ids FROM drawn GROUP BY 1"))
def shuffle_lists(spark, d):
    return sampling.shuffle_list_column(V.inview(spark, d), C.INVIEW, SEED).select(C.IMPRESSION_ID, as_text(C.INVIEW).alias("ids"))


@query(
    f"""SELECT o_orderkey AS impression_id, CASE WHEN row_number() OVER (ORDER BY {sql_key(SEED, 'o_orderkey')}) <= floor((SELECT count(*) FROM orders) * 0.8)
        THEN 'train' ELSE 'validation' END AS side FROM orders"""
)
def split_fraction(spark, d):
    return _sides(*sampling.split_df_fraction(V.order_heads(spark, d), 0.8, SEED), C.IMPRESSION_ID)


@query(
    """SELECT o_orderkey AS impression_id, least((row_number() OVER (ORDER BY o_orderkey) - 1) // ((SELECT count(*) FROM orders) // 7), 6)::INT AS chunk FROM orders"""
)
def split_chunks(spark, d):
    return sampling.add_chunk_number(V.order_heads(spark, d).select(C.IMPRESSION_ID), 7)


@query(
    """SELECT o_orderkey AS impression_id, ((row_number() OVER (ORDER BY o_orderkey) - 1) // (((SELECT count(*) FROM orders) + 6) // 7))::INT AS chunk FROM orders"""
)
def split_n(spark, d):
    return sampling.add_split_number(V.order_heads(spark, d).select(C.IMPRESSION_ID), 7)


@query("SELECT event_id, row_number() OVER (ORDER BY user_id, ts DESC, event_id) - 1 AS row_nr FROM events")
def row_index(spark, d):
    log = V.clicks(spark, d).select("event_id", C.USER, C.IMPRESSION_TIME)
    return number_rows(log, [C.USER, F.col(C.IMPRESSION_TIME).desc(), "event_id"]).select("event_id", "row_nr")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM documents")
def batches(spark, d):
    return sampling.add_batch_id(V.table(spark, d, "documents").select("doc_id"), 64, "doc_id")


@query(
    with_views(
        "inview",
        f"""WITH {_SHUFFLED} SELECT impression_id, string_agg(id::VARCHAR, ',' ORDER BY nr) AS ids FROM drawn WHERE nr <= 2
        AND impression_id IN (SELECT impression_id FROM inview WHERE len(article_ids_inview) >= 2) GROUP BY 1""",
    )
)
def sample_list(spark, d):
    enough = filters.filter_minimum_lengths_from_list(V.inview(spark, d), 2)
    return sampling.sample_article_ids(enough, 2, False, SEED).select(C.IMPRESSION_ID, as_text(C.INVIEW).alias("ids"))


def _sql_int(digest_sql):
    return f"CAST('0x' || substr({digest_sql}, 1, 15) AS BIGINT)"


@query(
    with_views(
        "inview",
        f"""WITH draws AS (SELECT impression_id, article_ids_inview AS l, unnest(range(3)) AS i FROM inview)
        SELECT impression_id, string_agg(l[{_sql_int(sql_key(SEED, 'impression_id', 'i'))} % len(l) + 1]::VARCHAR, ',' ORDER BY i) AS ids FROM draws GROUP BY 1""",
    )
)
def sample_list_repl(spark, d):
    return sampling.sample_article_ids(V.inview(spark, d), 3, True, SEED).select(C.IMPRESSION_ID, as_text(C.INVIEW).alias("ids"))


@query(
    with_views(
        "inview",
        f"""WITH c AS (SELECT impression_id, list_filter(article_ids_inview, lambda x: NOT list_contains(article_ids_clicked, x)) AS l,
                      unnest(article_ids_clicked) AS click FROM inview),
        draws AS (SELECT *, unnest(range(4)) AS i FROM c)
        SELECT impression_id, click::VARCHAR AS clicked, string_agg(coalesce(CASE WHEN len(l) > 0
               THEN l[{_sql_int(sql_key(SEED, 'impression_id', 'click', 'i'))} % len(l) + 1]::VARCHAR END, 'null'), ',' ORDER BY i) || ',' || click AS ids
        FROM draws GROUP BY impression_id, click""",
    )
)
def wu_sampling(spark, d):
    out = sampling.sampling_strategy_wu2019(V.inview(spark, d), 4, False, True, SEED)
    return out.select(C.IMPRESSION_ID, as_text(C.CLICKED).alias("clicked"), as_text(C.INVIEW).alias("ids"))


@query(
    f"""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {sql_key(SEED, 'event_id')}) AS nr FROM events)
        WHERE nr <= floor((SELECT count(*) FROM events) * 0.1)"""
)
def sample_exact(spark, d):
    return sampling.sample_rows(V.clicks(spark, d), 0.1, seed=SEED, key="event_id").select("event_id")


def _sql_draws(n_lists, total, n, seed=SEED):
    """Distinct draws of ``distinct_draws`` unrolled: ``draws(list_id, pos, nr)``."""
    steps = [f"d_ AS (SELECT unnest(range({n_lists})) AS list_id, {total} AS total)"]
    prev = "d_"
    for j in range(n):
        top = f"(total - {n - j})"
        x = f"({_sql_int(sql_key(seed, 'list_id', str(j)))} % ({top} + 1))"
        taken = " OR ".join([f"c{i} = {x}" for i in range(j)]) or "false"
        steps.append(f"d{j} AS (SELECT *, CASE WHEN {taken} THEN {top} ELSE {x} END AS c{j} FROM {prev})")
        prev = f"d{j}"
    cols = ", ".join(f"c{i}" for i in range(n))
    steps.append(f"draws AS (SELECT list_id, unnest(range({n})) AS pos, unnest([{cols}]) AS nr FROM {prev})")
    return ",\n".join(steps)


@query(
    f"""WITH {_sql_draws('(SELECT count(*) FROM customer)', '(SELECT count(*) FROM part)', 5)},
        idx AS (SELECT p_partkey AS article_id, row_number() OVER (ORDER BY p_partkey) - 1 AS nr FROM part)
        SELECT list_id, pos::INT AS pos, article_id FROM draws JOIN idx USING (nr)"""
)
def random_candidates(spark, d):
    n_lists = V.users(spark, d).count()
    return sampling.random_candidates(V.articles(spark, d), 5, n_lists, SEED)


@query("SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS id FROM (SELECT DISTINCT o_custkey AS user_id FROM orders)")
def user_index(spark, d):
    return sampling.create_user_id_to_int_mapping(V.order_heads(spark, d))
