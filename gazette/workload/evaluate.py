"""Labels, example tables, scores, ranks, accuracy and beyond-accuracy metrics."""

import uuid

from pyspark.sql import functions as F

from gazette import columns as C
from gazette.functions import arrays
from gazette.operators import accuracy, beyond, describe, inference, labels as L, mapping, sampling, scoring
from gazette.plans.numbering import row_index
from gazette.plans.store import materialise, scratch_folder
from gazette.workload import views as V
from gazette.workload.prepare import SEED, _sql_draws
from gazette.workload.registry import query
from gazette.workload.views import as_text, sql_key, sql_text, with_views

_EXPLODED = "e AS (SELECT impression_id, unnest(article_ids_inview) AS id, unnest(range(len(article_ids_inview))) AS pos FROM inview)"


def r6(*names):
    return {n: F.round(n, 6) for n in names}


# --- labels and attached scores ------------------------------------------------------------


@query(with_views("inview", f"SELECT impression_id, {sql_text('list_transform(article_ids_inview, lambda x: CASE WHEN list_contains(article_ids_clicked, x) THEN 1 ELSE 0 END)')} AS labels FROM inview"))
def labels(spark, d):
    return L.create_binary_labels_column(V.inview(spark, d)).select(C.IMPRESSION_ID, as_text(C.LABELS).alias(C.LABELS))


@query(with_views("cells", "SELECT impression_id, (row_number() OVER (PARTITION BY impression_id ORDER BY article_id) - 1)::INT AS pos, price AS score FROM cells"))
def attach_scores(spark, d):
    rows = V.scored(spark, d).select(C.IMPRESSION_ID, F.posexplode("price_scores").alias("pos", "score"))
    out = scoring.add_prediction_scores(V.inview(spark, d), rows)
    return out.select(C.IMPRESSION_ID, F.posexplode(C.SCORES).alias("pos", "score"))


@query(
    with_views(
        "inview",
        f"""WITH {_EXPLODED} SELECT impression_id, pos::INT AS pos, ((row_number() OVER (ORDER BY impression_id, pos) - 1) % 97)::DOUBLE AS score FROM e""",
    )
)
def attach_flat_scores(spark, d):
    log = V.inview(spark, d)
    flat = row_index(log.select(C.IMPRESSION_ID, F.posexplode(C.INVIEW).alias("pos", "id")), [C.IMPRESSION_ID, "pos"], "nr")
    scores = flat.select("nr", (F.col("nr") % 97).cast("double").alias("score"))
    out = scoring.add_flat_prediction_scores(log, scores)
    return out.select(C.IMPRESSION_ID, F.posexplode(C.SCORES).alias("pos", "score"))


# --- example tables ------------------------------------------------------------------------

_INDEX = """
    idx AS (SELECT vec_id AS article_id, row_number() OVER (ORDER BY vec_id) AS idx FROM embeddings),
    hist AS (SELECT user_id, string_agg(coalesce(idx, 0)::VARCHAR, ',' ORDER BY nr) AS history
             FROM past LEFT JOIN idx USING (article_id) GROUP BY 1),
    shown AS (SELECT impression_id, user_id, unnest(article_ids_inview) AS id, unnest(range(len(article_ids_inview))) AS pos, article_ids_clicked AS c FROM impressions),
    cand AS (SELECT impression_id, user_id, pos, coalesce(idx, 0) AS idx, CASE WHEN list_contains(c, id) THEN 1 ELSE 0 END AS y
             FROM shown LEFT JOIN idx ON idx.article_id = id)"""


def _labelled(spark, d):
    return L.create_binary_labels_column(V.impressions(spark, d))


def _past(spark, d):
    return V.histories(spark, d).select(C.USER, C.HISTORY_IDS)


def _article_index(spark, d):
    return L.create_lookup_objects(V.vectors(spark, d))[0]


@query(
    with_views(
        "impressions past",
        f"""WITH {_INDEX} SELECT impression_id, coalesce(any_value(history), '0') AS history, string_agg(idx::VARCHAR, ',' ORDER BY pos) AS inview,
            string_agg(y::VARCHAR, ',' ORDER BY pos) AS labels, count(*)::INT AS n_samples FROM cand LEFT JOIN hist USING (user_id) GROUP BY 1""",
    )
)
def examples_train(spark, d):
    out = L.training_examples(_labelled(spark, d), _article_index(spark, d), histories=_past(spark, d))
    return out.select(
        C.IMPRESSION_ID, as_text(C.HISTORY_IDS).alias("history"), as_text(C.INVIEW).alias("inview"), as_text(C.LABELS).alias("labels"), "n_samples"
    )


@query(
    with_views(
        "impressions past",
        f"WITH {_INDEX} SELECT impression_id, pos::INT AS pos, coalesce(history, '0') AS history, idx AS candidate, y AS label FROM cand LEFT JOIN hist USING (user_id)",
    )
)
def examples_eval(spark, d):
    out = L.evaluation_examples(_labelled(spark, d), _article_index(spark, d), histories=_past(spark, d))
    return out.select(
        C.IMPRESSION_ID, "pos", as_text(C.HISTORY_IDS).alias("history"), F.col(C.INVIEW).alias("candidate"), F.col(C.LABELS).cast("int").alias("label")
    )


@query(
    with_views(
        "impressions past",
        f"""WITH {_INDEX}, known AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS nr FROM (SELECT DISTINCT user_id FROM clicks))
        SELECT impression_id, pos::INT AS pos, coalesce(nr, 0) AS user_index, idx AS candidate, y AS label FROM cand LEFT JOIN known USING (user_id)""",
    )
)
def examples_user(spark, d):
    users = sampling.create_user_id_to_int_mapping(V.clicks(spark, d), value_str="idx", offset=1)
    rows = L.evaluation_examples(_labelled(spark, d), _article_index(spark, d), histories=_past(spark, d))
    return L.with_user_index(rows, users).select(
        C.IMPRESSION_ID, "pos", "user_index", F.col(C.INVIEW).alias("candidate"), F.col(C.LABELS).cast("int").alias("label")
    )


@query(
    with_views(
        "impressions past articles",
        """WITH known AS (SELECT * FROM articles),
        h AS (SELECT user_id, string_agg(coalesce(title, '?'), ',' ORDER BY nr) AS title_history, string_agg(coalesce(category_str, '?'), ',' ORDER BY nr) AS category_history,
              string_agg(coalesce(size, 0)::VARCHAR, ',' ORDER BY nr) AS size_history FROM past LEFT JOIN known USING (article_id) GROUP BY 1),
        shown AS (SELECT impression_id, user_id, unnest(article_ids_inview) AS article_id, unnest(range(len(article_ids_inview))) AS pos FROM impressions),
        v AS (SELECT impression_id, any_value(user_id) AS user_id, string_agg(coalesce(title, '?'), ',' ORDER BY pos) AS title_inview, string_agg(coalesce(category_str, '?'), ',' ORDER BY pos) AS category_inview,
              string_agg(coalesce(size, 0)::VARCHAR, ',' ORDER BY pos) AS size_inview FROM shown LEFT JOIN known USING (article_id) GROUP BY 1)
        SELECT impression_id, coalesce(title_history, '?') AS title_history, coalesce(category_history, '?') AS category_history, coalesce(size_history, '0') AS size_history,
               title_inview, category_inview, size_inview FROM v LEFT JOIN h USING (user_id)""",
    )
)
def examples_multi(spark, d):
    attributes = V.articles(spark, d).select(C.ARTICLE_ID, C.TITLE, F.col(C.CATEGORY_STR).alias("category"), "size")
    out = L.attribute_examples(
        _labelled(spark, d), attributes, histories=_past(spark, d), unknown={C.TITLE: "?", "category": "?", "size": 0}
    )
    lists = [f"{a}_{s}" for a in (C.TITLE, "category", "size") for s in ("history", "inview")]
    return out.select(C.IMPRESSION_ID, *[as_text(c).alias(c) for c in lists])


@query(
    with_views(
        "impressions past articles",
        """WITH known AS (SELECT * FROM articles),
        h AS (SELECT user_id, string_agg(coalesce(title, '?'), ',' ORDER BY nr) AS title_history, string_agg(coalesce(size, 0)::VARCHAR, ',' ORDER BY nr) AS size_history
              FROM past LEFT JOIN known USING (article_id) GROUP BY 1),
        shown AS (SELECT impression_id, user_id, unnest(article_ids_inview) AS article_id, unnest(range(len(article_ids_inview))) AS pos, article_ids_clicked AS c FROM impressions)
        SELECT impression_id, pos::INT AS pos, coalesce(title_history, '?') AS title_history, coalesce(size_history, '0') AS size_history,
               coalesce(title, '?') AS title, coalesce(size, 0) AS size, CASE WHEN list_contains(c, article_id) THEN 1 ELSE 0 END AS label
        FROM shown LEFT JOIN known USING (article_id) LEFT JOIN h USING (user_id)""",
    )
)
def examples_multi_eval(spark, d):
    attributes = V.articles(spark, d).select(C.ARTICLE_ID, C.TITLE, "size")
    out = L.attribute_examples(_labelled(spark, d), attributes, histories=_past(spark, d), unknown={C.TITLE: "?", "size": 0}, eval_mode=True)
    return out.select(
        C.IMPRESSION_ID, "pos", *[as_text(f"{a}_history").alias(f"{a}_history") for a in (C.TITLE, "size")],
        F.col(f"{C.TITLE}_inview").alias("title"), F.col("size_inview").alias("size"), F.col(C.LABELS).cast("int").alias("label"),
    )


@query(
    with_views(
        "impressions past",
        f"""WITH {_INDEX} SELECT impression_id, pos::INT AS pos, idx AS candidate, y AS label, {sql_key(SEED, 'impression_id')} AS "order" FROM cand""",
    )
)
def examples_pointwise(spark, d):
    out = L.pointwise_examples(_labelled(spark, d), _article_index(spark, d), histories=_past(spark, d), seed=SEED)
    return out.select(C.IMPRESSION_ID, "pos", F.col(C.INVIEW).alias("candidate"), F.col(C.LABELS).cast("int").alias("label"), "order")


_MATRIX = """SELECT 0::BIGINT AS idx, dim::INT AS dim, {zero} AS x FROM range(64) t(dim)
    UNION ALL SELECT row_number() OVER (ORDER BY vec_id) AS idx, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"""


def _matrix(spark, d, unknown):
    matrix = L.create_lookup_objects(V.vectors(spark, d), unknown)[1]
    return matrix.select("idx", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"SELECT idx, dim, round(x, 6) AS x FROM ({_MATRIX.format(zero='0::DOUBLE')})")
def lookup_zero(spark, d):
    return _matrix(spark, d, "zeros")


@query(f"SELECT idx, dim, round(x, 6) AS x FROM ({_MATRIX.format(zero='(SELECT avg(embedding[dim + 1]::DOUBLE) FROM embeddings)')})")
def lookup_mean(spark, d):
    return _matrix(spark, d, "mean")


@query(
    with_views(
        "inview",
        f"""WITH {_EXPLODED} SELECT impression_id, pos::INT AS pos, round(coalesce(embedding[1]::DOUBLE, 0), 6) AS v0, round(coalesce(embedding[64]::DOUBLE, 0), 6) AS v63,
            coalesce(len(embedding), 64)::INT AS width FROM e LEFT JOIN embeddings ON vec_id = id""",
    )
)
def gather_vectors(spark, d):
    out = mapping.gather_vectors(V.inview(spark, d), C.INVIEW, V.stored_vectors(spark, d), out="vectors")
    rows = out.select(C.IMPRESSION_ID, F.posexplode("vectors").alias("pos", "v"))
    at = lambda i: F.round(F.get("v", F.lit(i)), 6)
    return rows.select(C.IMPRESSION_ID, "pos", at(0).alias("v0"), at(63).alias("v63"), F.size("v").alias("width"))


@query(
    with_views(
        "impressions past vectors",
        """WITH heard AS (SELECT user_id, vector, row_number() OVER (PARTITION BY user_id ORDER BY nr) AS w
                 FROM past JOIN vectors USING (article_id)),
        dims AS (SELECT user_id, dim, sum(vector[dim] * w) / sum(w) AS x FROM heard, (SELECT unnest(range(1, 65)) AS dim) GROUP BY ALL),
        taste AS (SELECT user_id, list(x ORDER BY dim) AS u FROM dims GROUP BY 1),
        shown AS (SELECT impression_id, user_id, unnest(article_ids_inview) AS article_id, unnest(range(len(article_ids_inview))) AS pos FROM impressions),
        s AS (SELECT impression_id, pos, coalesce(list_sum(list_transform(range(1, 65), lambda k: u[k] * vector[k])), 0) AS score
              FROM shown LEFT JOIN taste USING (user_id) LEFT JOIN vectors USING (article_id))
        SELECT impression_id, pos::INT AS pos, round(score, 6) AS score, round(1 / (1 + exp(-score)), 6) AS sigmoid,
               round(exp(score) / sum(exp(score)) OVER (PARTITION BY impression_id), 6) AS softmax FROM s""",
    )
)
def embedding_scores(spark, d):
    past = V.histories(spark, d).select(C.USER, C.HISTORY_IDS)
    out = scoring.embedding_scores(V.impressions(spark, d), past, V.vectors(spark, d), arrays.linear_decay_weights)
    rows = out.select(C.IMPRESSION_ID, F.posexplode(F.arrays_zip("scores", "sigmoid", "softmax")).alias("pos", "z"))
    return rows.select(C.IMPRESSION_ID, "pos", *[F.round(f"z.{c}", 6).alias(n) for c, n in (("scores", "score"), ("sigmoid", "sigmoid"), ("softmax", "softmax"))])


def _half_price(batch):
    return batch.assign(score=batch["price"] / 2)[["impression_id", "article_id", "score"]]


@query("SELECT l_orderkey AS impression_id, l_partkey AS article_id, l_extendedprice / 2 AS score FROM lineitem")
def batch_score(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias(C.IMPRESSION_ID), F.col("l_partkey").alias(C.ARTICLE_ID), F.col("l_extendedprice").alias("price")
    )
    return scoring.score_batches(rows, _half_price, "impression_id bigint, article_id bigint, score double")


def _offer_value(batch):
    return batch.assign(score=batch["price"] * (1 - batch["discount"] / 10))[["impression_id", "pos", "score"]]


def _ranked_offers(chunk):
    """Scores by a model in Arrow batches, regrouped to lists and ranked."""
    offers = F.arrays_zip(F.col("price_scores").alias("price"), F.col(C.SCORES).alias("discount"))
    rows = chunk.select(C.IMPRESSION_ID, F.posexplode(offers).alias("pos", "z")).select(C.IMPRESSION_ID, "pos", "z.*")
    scored = scoring.score_batches(rows, _offer_value, "impression_id bigint, pos int, score double")
    lists = scoring.add_prediction_scores(chunk.select(C.IMPRESSION_ID, C.INVIEW), scored, "value")
    return scoring.rank_predictions_by_score(lists, "value", "ranks")


@query(
    with_views(
        "cells",
        """WITH s AS (SELECT impression_id, article_id, price * (1 - score / 10) AS score FROM cells)
        SELECT impression_id, article_id, round(score, 6) AS score,
               row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, article_id DESC)::INT AS rank FROM s""",
    )
)
def batch_rank(spark, d):
    """The whole chain: score in chunks, rank, write, and read back what the run has completed."""
    run = f"{scratch_folder(spark).rstrip('/')}/gazette-run-{uuid.uuid4().hex}"
    out = inference.score_in_chunks(V.scored(spark, d), _ranked_offers, run, n_chunks=16, chunks_at_once=8)
    rows = out.select(C.IMPRESSION_ID, F.inline(F.arrays_zip(F.col(C.INVIEW).alias(C.ARTICLE_ID), F.col("value").alias("score"), F.col("ranks").alias("rank"))))
    return rows.withColumns({**r6("score"), "rank": F.col("rank").cast("int")})


# --- ranks ---------------------------------------------------------------------------------


@query(
    with_views(
        "cells",
        "SELECT impression_id, article_id, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, article_id DESC)::INT AS rank FROM cells",
    )
)
def rank_scores(spark, d):
    out = scoring.rank_predictions_by_score(V.scored(spark, d), C.SCORES, "ranks")
    pairs = out.select(C.IMPRESSION_ID, F.explode(F.arrays_zip(C.INVIEW, "ranks")).alias("z"))
    return pairs.select(C.IMPRESSION_ID, F.col(f"z.{C.INVIEW}").alias(C.ARTICLE_ID), F.col("z.ranks").alias("rank"))


@query(
    with_views(
        "cells",
        "SELECT impression_id, article_id, row_number() OVER (PARTITION BY impression_id ORDER BY price DESC, article_id DESC)::INT AS rank FROM cells",
    )
)
def rank_rows(spark, d):
    rows = V.scored(spark, d).select(C.IMPRESSION_ID, F.posexplode(F.arrays_zip(C.INVIEW, "price_scores")).alias("pos", "z"))
    flat = rows.select(C.IMPRESSION_ID, "pos", F.col(f"z.{C.INVIEW}").alias(C.ARTICLE_ID), F.col("z.price_scores").alias("price"))
    return scoring.rank_rows_by_score(flat, "price").select(C.IMPRESSION_ID, C.ARTICLE_ID, "rank")


@query(
    with_views(
        "counters",
        "SELECT article_id, total_inviews, round(1 / row_number() OVER (ORDER BY total_inviews DESC, article_id), 9) AS prediction_score FROM counters",
    )
)
def sort_score(spark, d):
    out = scoring.create_sort_based_prediction_score(V.counters(spark, d), C.TOTAL_INVIEWS, desc=True)
    return out.withColumn("prediction_score", F.round("prediction_score", 9))


@query(
    with_views(
        "cells",
        "SELECT impression_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY price DESC, article_id) AS nr FROM cells) WHERE nr <= 3",
    )
)
def topn(spark, d):
    rows = V.scored(spark, d).select(C.IMPRESSION_ID, F.inline(F.arrays_zip(F.col(C.INVIEW).alias("article_id"), F.col("price_scores").alias("price"))))
    return sampling.top_n_per_group(rows, 3, C.IMPRESSION_ID, [F.col("price").desc(), C.ARTICLE_ID]).select(C.IMPRESSION_ID, C.ARTICLE_ID)


@query(
    with_views(
        "inview",
        f"SELECT count(DISTINCT article_ids_inview) AS n_lists, {sql_text('min(article_ids_inview)')} AS items FROM inview",
    )
)
def candidate_check(spark, d):
    return describe.same_candidate_list(V.inview(spark, d)).select("n_lists", as_text("items").alias("items"))


@query(
    with_views(
        "inview counters",
        f"""WITH {_EXPLODED}, est AS (SELECT id, count(*) AS n FROM e GROUP BY 1),
        s AS (SELECT impression_id, pos, coalesce(total_pageviews, 0) AS c, coalesce(total_inviews, 0) AS i, coalesce(n, 0) AS n, coalesce(total_read_time, 0) AS r
              FROM e LEFT JOIN counters k ON k.article_id = e.id LEFT JOIN est USING (id))
        SELECT impression_id, pos::INT AS pos,
            row_number() OVER (PARTITION BY impression_id ORDER BY c DESC, pos DESC)::INT AS clicked,
            row_number() OVER (PARTITION BY impression_id ORDER BY i DESC, pos DESC)::INT AS inview,
            row_number() OVER (PARTITION BY impression_id ORDER BY n DESC, pos DESC)::INT AS estimate,
            row_number() OVER (PARTITION BY impression_id ORDER BY r DESC, pos DESC)::INT AS read_time FROM s""",
    )
)
def popularity_baselines(spark, d):
    log = V.inview(spark, d)
    known = V.counters(spark, d)
    out = scoring.popularity_baselines(log, known, describe.inview_counts(log))
    names = dict(zip(scoring.POPULARITY_SCORES, ["clicked", "inview", "estimate", "read_time"]))
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in names.items()])
    return out.select(C.IMPRESSION_ID, F.posexplode(zipped).alias("pos", "z")).select(C.IMPRESSION_ID, "pos", "z.*")


@query(
    with_views(
        "counters",
        """WITH c AS (SELECT c.* FROM counters c JOIN embeddings ON vec_id = article_id)
        SELECT 'editorial' AS list_name, article_id, round(1 / row_number() OVER (ORDER BY total_inviews DESC, article_id), 9) AS prediction_score FROM c
        UNION ALL SELECT 'popular', article_id, round(1 / row_number() OVER (ORDER BY total_pageviews DESC, article_id), 9) FROM c""",
    )
)
def candidate_rankings(spark, d):
    candidates = V.counters(spark, d).join(V.vectors(spark, d).select(C.ARTICLE_ID), C.ARTICLE_ID, "left_semi")

    def ranking_by(name, column):
        out = scoring.create_sort_based_prediction_score(candidates, column, desc=True)
        return out.select(F.lit(name).alias("list_name"), C.ARTICLE_ID, F.round("prediction_score", 9).alias("prediction_score"))

    return ranking_by("editorial", C.TOTAL_INVIEWS).unionByName(ranking_by("popular", C.TOTAL_PAGEVIEWS))


@query(
    with_views(
        "inview",
        f"""WITH {_EXPLODED}, drawn AS (SELECT impression_id, pos, row_number() OVER (PARTITION BY impression_id ORDER BY {sql_key(SEED, 'impression_id', 'pos')}) AS nr FROM e)
        SELECT impression_id, string_agg((pos + 1)::VARCHAR, ',' ORDER BY nr) AS ranks FROM drawn GROUP BY 1""",
    )
)
def random_ranks(spark, d):
    return scoring.random_ranks(V.inview(spark, d), SEED).select(C.IMPRESSION_ID, as_text("ranks").alias("ranks"))


@query(
    with_views(
        "cells",
        """SELECT impression_id, article_id, round(1 / row_number() OVER (PARTITION BY impression_id ORDER BY price DESC, article_id DESC), 9) AS reciprocal FROM cells""",
    )
)
def reciprocal_list(spark, d):
    ranked = scoring.rank_predictions_by_score(V.scored(spark, d), "price_scores", "ranks")
    out = scoring.reciprocal_list(ranked, "ranks")
    pairs = out.select(C.IMPRESSION_ID, F.inline(F.arrays_zip(F.col(C.INVIEW).alias("article_id"), F.col("ranks").alias("reciprocal"))))
    return pairs.withColumn("reciprocal", F.round("reciprocal", 9))


# --- accuracy ------------------------------------------------------------------------------

# Ranks, class sizes and pair wins of every impression, then the metrics of each.
_METRICS = """
    t AS (SELECT *, sum(y) OVER w AS np, count(*) OVER w AS n,
                 row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, article_id DESC) AS r,
                 row_number() OVER (PARTITION BY impression_id ORDER BY y DESC, article_id) AS ideal,
                 rank() OVER (PARTITION BY impression_id ORDER BY score) + (count(*) OVER (PARTITION BY impression_id, score) - 1) / 2 AS mid,
                 rank() OVER (PARTITION BY impression_id ORDER BY score) - 1 AS below,
                 rank() OVER (PARTITION BY impression_id, y ORDER BY score) - 1 AS below_same,
                 least(greatest(score, 1e-11), 1 - 1e-11) AS p FROM cells WINDOW w AS (PARTITION BY impression_id)),
    m AS (SELECT impression_id, any_value(np) AS np, any_value(n) AS n,
            CASE WHEN any_value(np) BETWEEN 1 AND any_value(n) - 1 THEN (sum(mid) FILTER (WHERE y = 1) - any_value(np) * (any_value(np) + 1) / 2) / (any_value(np) * (any_value(n) - any_value(np))) END AS auc,
            CASE WHEN any_value(np) BETWEEN 1 AND any_value(n) - 1 THEN sum(below - below_same) FILTER (WHERE y = 1) / (any_value(np) * (any_value(n) - any_value(np))) END AS auc_strict,
            CASE WHEN any_value(np) > 0 THEN sum(y / r) / any_value(np) END AS mrr,
            coalesce(1 / min(r) FILTER (WHERE y = 1), 1) AS reciprocal_rank,
            sum(CASE WHEN r <= 10 THEN y / log2(r + 1) ELSE 0 END) AS dcg,
            sum(CASE WHEN r <= 5 THEN y / log2(r + 1) ELSE 0 END) AS dcg5,
            sum(CASE WHEN ideal <= 10 THEN y / log2(ideal + 1) ELSE 0 END) AS best10,
            sum(CASE WHEN ideal <= 5 THEN y / log2(ideal + 1) ELSE 0 END) AS best5,
            CASE WHEN any_value(np) BETWEEN 1 AND any_value(n) - 1 THEN avg(-(y * ln(p) + (1 - y) * ln(1 - p))) END AS logloss,
            sqrt(avg((y - score) * (y - score))) AS rmse,
            avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS accuracy,
            coalesce(2 * sum(CASE WHEN score >= 0.5 AND y = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) + any_value(np), 0), 0) AS f1
          FROM t GROUP BY impression_id)"""


def _metric_query(name, metric, sql, where=None):
    body = f"WITH {_METRICS} SELECT impression_id, round({sql}, 6) AS value FROM m"

    def run(spark, d):
        rows = V.scored(spark, d)
        return rows.select(C.IMPRESSION_ID, F.round(F.nanvl(metric(F.col(C.LABELS), F.col(C.SCORES)), F.lit(None)), 6).alias("value"))

    query(with_views("cells", body), name)(run)


_metric_query("auc", accuracy.AucScore(), "auc")
_metric_query("auc_strict", accuracy.StrictAucScore(), "auc_strict")
_metric_query("mrr", accuracy.MrrScore(), "mrr")
_metric_query("reciprocal_rank", accuracy.ReciprocalRankScore(), "reciprocal_rank")
_metric_query("dcg", accuracy.DcgScore(10), "dcg")
_metric_query("ndcg5", accuracy.NdcgScore(5), "dcg5 / nullif(best5, 0)")
_metric_query("ndcg10", accuracy.NdcgScore(10), "dcg / nullif(best10, 0)")
_metric_query("logloss", accuracy.LogLossScore(), "logloss")
_metric_query("rmse", accuracy.RootMeanSquaredError(), "rmse")
_metric_query("accuracy", accuracy.AccuracyScore(), "accuracy")
_metric_query("f1", accuracy.F1Score(), "f1")

ALL_METRICS = [
    accuracy.AucScore(),
    accuracy.MrrScore(),
    accuracy.NdcgScore(5),
    accuracy.NdcgScore(10),
    accuracy.LogLossScore(),
    accuracy.RootMeanSquaredError(),
    accuracy.AccuracyScore(),
    accuracy.F1Score(),
]


@query(
    with_views(
        "cells",
        f"""WITH {_METRICS} SELECT round(avg(auc), 6) AS auc, round(avg(mrr), 6) AS mrr, round(avg(CASE WHEN np > 0 THEN dcg5 / best5 END), 6) AS ndcg5, round(avg(CASE WHEN np > 0 THEN dcg / best10 END), 6) AS ndcg10,
            round(avg(logloss), 6) AS logloss, round(avg(rmse), 6) AS rmse, round(avg(accuracy), 6) AS accuracy, round(avg(f1), 6) AS f1,
            count(*) AS n_rows, count(*) FILTER (WHERE auc IS NULL) AS n_skipped FROM m""",
    )
)
def evaluate_all(spark, d):
    out = accuracy.MetricEvaluator(V.scored(spark, d), ALL_METRICS).evaluate().withColumnsRenamed({"ndcg@5": "ndcg5", "ndcg@10": "ndcg10"})
    return out.withColumns(r6("auc", "mrr", "ndcg5", "ndcg10", "logloss", "rmse", "accuracy", "f1"))


@query(
    with_views(
        "cells",
        """WITH flat AS (SELECT *, (row_number() OVER (ORDER BY impression_id, article_id) - 1) // 20 AS g FROM cells),
        pairs AS (SELECT a.g, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc
                  FROM flat a JOIN flat b ON a.g = b.g AND a.y = 1 AND b.y = 0 GROUP BY 1)
        SELECT round(avg(auc), 6) AS auc, count(*) AS n_groups FROM pairs""",
    )
)
def auc_fixed_groups(spark, d):
    zipped = F.arrays_zip(F.col(C.LABELS).alias("label"), F.col(C.SCORES).alias("score"))
    flat = V.scored(spark, d).select(C.IMPRESSION_ID, F.posexplode(zipped).alias("pos", "z")).select(C.IMPRESSION_ID, "pos", "z.*")
    return accuracy.auc_from_fixed_groups(flat, 20, [C.IMPRESSION_ID, "pos"]).withColumns(r6("auc"))


def _sql_auc(rows, group):
    """AUC by average ranks over ``rows (g.., y, p)``."""
    part = f"PARTITION BY {group}" if group else ""
    first = f"{group}, " if group else ""
    return f"""WITH flat AS ({rows}),
        ranked AS (SELECT *, rank() OVER ({part} ORDER BY p) AS low, count(*) OVER (PARTITION BY {first}p) AS ties,
                          sum(1 - y) OVER (PARTITION BY {first}p) AS same FROM flat),
        sums AS (SELECT {first}sum(y)::BIGINT AS n_positive, sum(1 - y)::BIGINT AS n_negative,
                        sum((low + (ties - 1) / 2.0) * y) AS r, sum(same * y) / 2.0 AS half FROM ranked {f"GROUP BY {group}" if group else ""}),
        wins AS (SELECT *, r - n_positive * (n_positive + 1) / 2.0 AS w, n_positive::DOUBLE * n_negative AS pairs FROM sums)
        SELECT {first}CASE WHEN pairs > 0 THEN round(w / pairs, 6) END AS auc,
               CASE WHEN pairs > 0 THEN round((w - half) / pairs, 6) END AS auc_strict, n_positive, n_negative FROM wins"""


@query(_sql_auc("SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice AS p FROM lineitem", ""))
def auc_whole(spark, d):
    lines = V.table(spark, d, "lineitem")
    flat = lines.select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_extendedprice").alias("score"))
    return accuracy.auc_of_rows(flat).withColumns(r6("auc", "auc_strict"))


@query(
    _sql_auc(
        "SELECT l_discount AS discount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS p FROM lineitem", "discount"
    )
)
def auc_by_group(spark, d):
    lines = V.table(spark, d, "lineitem")
    flat = lines.select(
        F.col("l_discount").alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_quantity").alias("score")
    )
    return accuracy.auc_of_rows(flat, "discount").withColumns(r6("auc", "auc_strict"))


@query(
    with_views(
        "cells",
        f"""WITH {_METRICS} SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, round(avg(auc), 6) AS auc, count(auc) AS n
            FROM m JOIN orders ON o_orderkey = impression_id GROUP BY 1""",
    )
)
def auc_by_day(spark, d):
    log = V.scored(spark, d).join(V.order_heads(spark, d).select(C.IMPRESSION_ID, C.IMPRESSION_TIME), C.IMPRESSION_ID)
    out = accuracy.metric_by_time(log, accuracy.AucScore(), "1 day")
    return out.select(F.col("window_start").alias("day"), F.round("auc", 6).alias("auc"), "n")


# --- beyond accuracy -----------------------------------------------------------------------


def _lists(spark, d):
    return V.inview(spark, d).select(F.col(C.IMPRESSION_ID).alias("list_id"), F.col(C.INVIEW).alias("items"))


_LISTED = "l AS (SELECT impression_id AS list_id, unnest(article_ids_inview) AS article_id FROM inview)"
_POPULARITY = "pop AS (SELECT article_id, total_inviews / (SELECT max(total_inviews) FROM counters) AS p, size / 50 AS s FROM counters JOIN articles USING (article_id))"
# the diversity of lists given as ``l(list_id, article_id)``
_DIVERSITY = """
    sums AS (SELECT list_id, dim, sum(u[dim]) AS s FROM l JOIN units USING (article_id), (SELECT unnest(range(1, 65)) AS dim) GROUP BY ALL),
    sizes AS (SELECT list_id, count(*) AS n FROM l JOIN units USING (article_id) GROUP BY 1),
    div AS (SELECT list_id, CASE WHEN n > 1 THEN (n * n - ss - 0) / (n * (n - 1)) - 0 ELSE NULL END AS diversity
            FROM sizes JOIN (SELECT list_id, sum(s * s) AS ss FROM sums GROUP BY 1) USING (list_id))"""


@query(
    with_views(
        "inview units",
        f"""WITH {_LISTED}, {_DIVERSITY} SELECT impression_id AS list_id, coalesce(round(diversity, 6), 'nan'::DOUBLE) AS diversity
            FROM inview LEFT JOIN div ON list_id = impression_id""",
    )
)
def diversity(spark, d):
    return beyond.intralist_diversity(_lists(spark, d), V.stored_vectors(spark, d), "vector").withColumns(r6("diversity"))


@query(
    with_views(
        "inview vectors",
        f"""WITH {_LISTED}, v AS (SELECT list_id, article_id, vector FROM l JOIN vectors USING (article_id)),
        pairs AS (SELECT a.list_id, avg(sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.vector[k] - b.vector[k]) * (a.vector[k] - b.vector[k]))))) AS x
                  FROM v a JOIN v b ON a.list_id = b.list_id AND a.article_id <> b.article_id GROUP BY 1)
        SELECT impression_id AS list_id, coalesce(round(x, 6), 'nan'::DOUBLE) AS diversity FROM inview LEFT JOIN pairs ON list_id = impression_id""",
    )
)
def diversity_euclidean(spark, d):
    out = beyond.intralist_diversity(_lists(spark, d), V.vectors(spark, d), "vector", distance="euclidean")
    return out.withColumns(r6("diversity"))


@query(
    with_views(
        "units",
        f"""WITH {_sql_draws(20000, '(SELECT count(*) FROM part JOIN embeddings ON p_partkey = vec_id)', 5)},
        idx AS (SELECT vec_id AS article_id, row_number() OVER (ORDER BY vec_id) - 1 AS nr FROM part JOIN embeddings ON p_partkey = vec_id),
        l AS (SELECT list_id, article_id FROM draws JOIN idx USING (nr)), {_DIVERSITY}
        SELECT round(min(diversity), 6) AS min_diversity, round(max(diversity), 6) AS max_diversity FROM div""",
    )
)
def candidate_diversity(spark, d):
    items = V.vectors(spark, d)
    out = beyond.candidate_diversity(V.articles(spark, d), items, "vector", 5, method="sampled", seed=SEED)
    return out.withColumns(r6("min_diversity", "max_diversity"))


@query(
    with_views(
        "units",
        """WITH v AS MATERIALIZED (SELECT article_id, u FROM units JOIN part ON p_partkey = article_id),
        d AS MATERIALIZED (SELECT a.article_id AS a, b.article_id AS b, 1 - list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])) AS x
                           FROM v a JOIN v b ON a.article_id < b.article_id),
        trios AS (SELECT ab.x + ac.x + bc.x AS x FROM d ab JOIN d bc ON bc.a = ab.b JOIN d ac ON ac.a = ab.a AND ac.b = bc.b)
        SELECT round(min(x) / 3, 6) AS min_diversity, round(max(x) / 3, 6) AS max_diversity FROM trios""",
    )
)
def candidate_diversity_exact(spark, d):
    """Over every three of all articles with a vector."""
    items = V.vectors(spark, d)
    out = beyond.candidate_diversity(V.articles(spark, d), items, "vector", 3, method="exact")
    return out.withColumns(r6("min_diversity", "max_diversity"))


@query(
    with_views(
        "inview articles",
        f"WITH {_LISTED} SELECT category_str AS value, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM l JOIN articles USING (article_id) GROUP BY 1",
    )
)
def distribution(spark, d):
    out = beyond.distribution(_lists(spark, d), V.articles(spark, d), C.CATEGORY_STR)
    return out.withColumn("share", F.round("share", 9))


@query(
    with_views(
        "inview articles",
        f"""WITH {_LISTED}, v AS (SELECT unnest(subcategory) AS value FROM l JOIN articles USING (article_id))
        SELECT value, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM v GROUP BY 1""",
    )
)
def distribution_list(spark, d):
    out = beyond.distribution(_lists(spark, d), V.articles(spark, d), C.SUBCATEGORY)
    return out.withColumn("share", F.round("share", 9))


@query(
    with_views(
        "inview",
        f"WITH {_LISTED} SELECT count(DISTINCT article_id) AS coverage_count, round(count(DISTINCT article_id) / (SELECT count(DISTINCT p_partkey) FROM part), 9) AS coverage_fraction FROM l",
    )
)
def coverage(spark, d):
    return beyond.coverage(_lists(spark, d), V.articles(spark, d)).withColumn("coverage_fraction", F.round("coverage_fraction", 9))


@query(
    with_views(
        "inview articles",
        f"""WITH {_LISTED}, s AS (SELECT list_id, avg(sentiment_score) AS x FROM l JOIN articles USING (article_id) GROUP BY 1)
        SELECT impression_id AS list_id, coalesce(round(x, 6), 'nan'::DOUBLE) AS sentiment FROM inview LEFT JOIN s ON list_id = impression_id""",
    )
)
def sentiment(spark, d):
    return beyond.sentiment(_lists(spark, d), V.articles(spark, d)).withColumns(r6("sentiment"))


@query(
    """SELECT round((SELECT avg(s) FROM (SELECT p_size / 50 AS s FROM part ORDER BY s DESC, p_partkey LIMIT 25)), 6) AS mean_n_highest,
              round((SELECT avg(s) FROM (SELECT p_size / 50 AS s FROM part ORDER BY s, p_partkey LIMIT 25)), 6) AS mean_n_lowest"""
)
def candidate_sentiment(spark, d):
    catalogue = V.articles(spark, d)
    return beyond.candidate_sentiment(catalogue, catalogue, 25).withColumns(r6("mean_n_highest", "mean_n_lowest"))


@query(
    with_views(
        "impressions past units",
        """WITH l AS (SELECT impression_id, user_id, unnest(article_ids_inview) AS article_id FROM impressions),
        r AS (SELECT impression_id, any_value(user_id) AS user_id, dim, sum(u[dim]) / count(*) AS x FROM l JOIN units USING (article_id), (SELECT unnest(range(1, 65)) AS dim) GROUP BY 1, 3),
        h AS (SELECT user_id, dim, sum(u[dim]) / count(*) AS x FROM past JOIN units USING (article_id), (SELECT unnest(range(1, 65)) AS dim) GROUP BY 1, 2),
        s AS (SELECT impression_id, 1 - sum(r.x * h.x) AS x FROM r JOIN h USING (user_id, dim) GROUP BY 1)
        SELECT impression_id AS list_id, coalesce(round(x, 6), 'nan'::DOUBLE) AS serendipity FROM impressions LEFT JOIN s USING (impression_id)""",
    )
)
def serendipity(spark, d):
    lists = V.impressions(spark, d).select(F.col(C.IMPRESSION_ID).alias("list_id"), C.USER, F.col(C.INVIEW).alias("items"))
    past = V.histories(spark, d).select(C.USER, F.col(C.HISTORY_IDS).alias("history"))
    out = beyond.serendipity(lists, past, V.stored_vectors(spark, d), "vector", history_key=C.USER)
    return out.withColumns(r6("serendipity"))


def _popular_items(spark, d):
    """The stored popularity of each article, worked out from the log once."""
    scaled = describe.normalise_max(V.counters(spark, d), C.TOTAL_INVIEWS, out="popularity")
    return materialise(scaled.select(C.ARTICLE_ID, "popularity"))


@query(
    with_views(
        "inview counters articles",
        f"""WITH {_LISTED}, {_POPULARITY} SELECT list_id, round(avg(-log2(p)), 6) AS novelty FROM l JOIN pop USING (article_id) GROUP BY 1""",
    )
)
def novelty(spark, d):
    return beyond.novelty(_lists(spark, d), _popular_items(spark, d), "popularity").withColumns(r6("novelty"))


@query(
    with_views(
        "counters articles",
        f"""WITH {_POPULARITY} SELECT round((SELECT avg(-log2(p)) FROM (SELECT p FROM pop ORDER BY p DESC LIMIT 20)), 6) AS min_novelty,
            round((SELECT avg(-log2(p)) FROM (SELECT p FROM pop ORDER BY p LIMIT 20)), 6) AS max_novelty""",
    )
)
def candidate_novelty(spark, d):
    items = _popular_items(spark, d)
    return beyond.candidate_novelty(items, items, 20, "popularity").withColumns(r6("min_novelty", "max_novelty"))


TOP_N = 5


def _named_lists(spark, d):
    """The editorial and popular top lists, and one random list per user."""
    candidates = V.counters(spark, d).join(V.vectors(spark, d).select(C.ARTICLE_ID), C.ARTICLE_ID, "left_semi")

    def top(name, column):
        best = candidates.orderBy(F.col(column).desc(), C.ARTICLE_ID).limit(TOP_N)
        return best.agg(F.collect_list(C.ARTICLE_ID).alias("items")).select(
            F.lit(name).alias("list_name"), F.lit(-1).cast("bigint").alias("list_id"), "items", F.lit(True).alias("is_shared")
        )

    users = row_index(V.histories(spark, d).select(C.USER), [C.USER], "nr")
    drawn = sampling.random_candidates(candidates, TOP_N, users.count(), SEED, list_id="nr")
    random_lists = (
        drawn.groupBy("nr")
        .agg(F.collect_list(C.ARTICLE_ID).alias("items"))
        .join(users, "nr")
        .select(F.lit("random").alias("list_name"), F.col(C.USER).alias("list_id"), "items", F.lit(False).alias("is_shared"))
    )
    return top("editorial", C.TOTAL_INVIEWS).unionByName(top("popular", C.TOTAL_PAGEVIEWS)).unionByName(random_lists)


_NAMED = f"""
    cand AS (SELECT c.* FROM counters c JOIN embeddings ON vec_id = article_id),
    users AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS nr FROM (SELECT DISTINCT user_id FROM past)),
    {_sql_draws('(SELECT count(*) FROM users)', '(SELECT count(*) FROM cand)', TOP_N)},
    numbered AS (SELECT article_id, row_number() OVER (ORDER BY article_id) - 1 AS nr FROM cand),
    named AS (SELECT 'editorial' AS list_name, -1::BIGINT AS list_id, article_id FROM (SELECT article_id FROM cand ORDER BY total_inviews DESC, article_id LIMIT {TOP_N})
              UNION ALL SELECT 'popular', -1, article_id FROM (SELECT article_id FROM cand ORDER BY total_pageviews DESC, article_id LIMIT {TOP_N})
              UNION ALL SELECT 'random', user_id, article_id FROM (SELECT d.list_id AS nr, n.article_id FROM draws d JOIN numbered n ON n.nr = d.nr) JOIN users USING (nr))"""


@query(
    with_views(
        "past counters articles units",
        f"""WITH {_NAMED}, {_POPULARITY},
        v AS (SELECT list_name, list_id, dim, sum(u[dim]) AS s, count(*) AS n FROM named JOIN units USING (article_id), (SELECT unnest(range(1, 65)) AS dim) GROUP BY 1, 2, 3),
        h AS (SELECT user_id, dim, sum(u[dim]) / count(*) AS x FROM past JOIN units USING (article_id), (SELECT unnest(range(1, 65)) AS dim) GROUP BY 1, 2),
        per AS (SELECT list_name, 'diversity' AS metric, (any_value(n) * any_value(n) - sum(s * s)) / (any_value(n) * (any_value(n) - 1)) AS x FROM v GROUP BY list_name, list_id
                UNION ALL SELECT list_name, 'sentiment', avg(s) FROM named JOIN pop USING (article_id) GROUP BY list_name, list_id
                UNION ALL SELECT list_name, 'novelty', avg(-log2(p)) FROM named JOIN pop USING (article_id) GROUP BY list_name, list_id
                UNION ALL SELECT list_name, 'serendipity', 1 - sum(s / n * x) FROM v JOIN h ON h.dim = v.dim AND (list_id = -1 OR list_id = user_id) GROUP BY list_name, user_id)
        SELECT list_name, metric, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM per GROUP BY 1, 2
        UNION ALL SELECT list_name, 'coverage_count', count(DISTINCT article_id), NULL FROM named GROUP BY 1
        UNION ALL SELECT list_name, 'coverage_fraction', round(count(DISTINCT article_id) / (SELECT count(*) FROM cand), 6), NULL FROM named GROUP BY 1""",
    )
)
def beyond_table(spark, d):
    items = (
        V.articles(spark, d)
        .join(_popular_items(spark, d), C.ARTICLE_ID)
        .join(V.vectors(spark, d), C.ARTICLE_ID)
        .select(C.ARTICLE_ID, C.SENTIMENT_SCORE, "popularity", "vector")
    )
    past = V.histories(spark, d).select(F.col(C.USER).alias("list_id"), F.col(C.HISTORY_IDS).alias("history"))
    out = beyond.beyond_accuracy_table(
        _named_lists(spark, d), items, past, "vector", C.SENTIMENT_SCORE, "popularity", candidates=items
    )
    return out.withColumns(r6("mean", "std"))


SEGMENTS = ["segment", "nation", "in_debt"]
ATTRIBUTES = [C.CATEGORY_STR, C.SUBCATEGORY, C.SENTIMENT_LABEL]


def _report(spark, d):
    """All impressions' lists next to the shared popular list, by three user segments, with three attributes."""
    label = F.when(F.col("size") <= 15, "negative").when(F.col("size") <= 35, "neutral").otherwise("positive")
    items = materialise(
        V.articles(spark, d)
        .join(_popular_items(spark, d), C.ARTICLE_ID, "left")
        .join(V.stored_vectors(spark, d), C.ARTICLE_ID, "left")
        .select(C.ARTICLE_ID, C.CATEGORY_STR, C.SUBCATEGORY, C.SENTIMENT_SCORE, label.alias(C.SENTIMENT_LABEL), "popularity", "vector")
    )
    best = items.filter("popularity IS NOT NULL").orderBy(F.desc("popularity"), C.ARTICLE_ID).limit(TOP_N)
    popular = best.agg(F.collect_list(C.ARTICLE_ID).alias("items")).select(
        F.lit("popular").alias("list_name"), F.lit(-1).cast("bigint").alias("list_id"), F.lit(None).cast("bigint").alias(C.USER), "items", F.lit(True).alias("is_shared")
    )
    shown = V.impressions(spark, d).select(
        F.lit("inview").alias("list_name"), F.col(C.IMPRESSION_ID).alias("list_id"), C.USER, F.col(C.INVIEW).alias("items"), F.lit(False).alias("is_shared")
    )
    past = V.histories(spark, d).select(C.USER, F.col(C.HISTORY_IDS).alias("history"))
    return beyond.beyond_accuracy_report(
        shown.unionByName(popular), items, past, "vector", C.SENTIMENT_SCORE, "popularity", ATTRIBUTES, V.users(spark, d), SEGMENTS, candidates=items
    )


_REPORTED = f"""
    popular AS (SELECT article_id FROM counters JOIN articles USING (article_id) ORDER BY total_inviews DESC, article_id LIMIT {TOP_N}),
    groups AS (SELECT c_custkey AS user_id, unnest(['all', 'segment', 'nation', 'in_debt']) AS segment,
                      unnest([NULL, c_mktsegment, c_nationkey::VARCHAR, (c_acctbal < 0)::VARCHAR]) AS segment_value FROM customer),
    listed AS (SELECT 'inview' AS list_name, impression_id AS list_id, user_id, unnest(article_ids_inview) AS article_id FROM impressions
               UNION ALL SELECT 'popular', -1, NULL, article_id FROM popular)"""


@query(
    with_views(
        "impressions counters articles past units",
        f"""WITH {_REPORTED}, {_POPULARITY},
        v AS (SELECT list_name, list_id, dim, sum(u[dim]) AS s, count(*) AS n FROM listed JOIN units USING (article_id), (SELECT unnest(range(1, 65)) AS dim) GROUP BY 1, 2, 3),
        h AS (SELECT user_id, dim, sum(u[dim]) / count(*) AS x FROM past JOIN units USING (article_id), (SELECT unnest(range(1, 65)) AS dim) GROUP BY 1, 2),
        div AS (SELECT list_name, list_id, CASE WHEN any_value(n) > 1 THEN (any_value(n) * any_value(n) - sum(s * s)) / (any_value(n) * (any_value(n) - 1)) END AS diversity FROM v GROUP BY 1, 2),
        sen AS (SELECT list_name, list_id, avg(sentiment_score) AS sentiment FROM listed JOIN articles USING (article_id) GROUP BY 1, 2),
        nov AS (SELECT list_name, list_id, avg(-log2(p)) AS novelty FROM listed JOIN pop USING (article_id) GROUP BY 1, 2),
        lists AS (SELECT 'inview' AS list_name, impression_id AS list_id, user_id FROM impressions
                  UNION ALL SELECT 'popular', -1, user_id FROM (SELECT DISTINCT user_id FROM past)),
        ser AS (SELECT list_name, list_id, user_id, 1 - sum(s / n * x) AS serendipity FROM lists JOIN v USING (list_name, list_id) JOIN h USING (user_id, dim) GROUP BY 1, 2, 3),
        scores AS (SELECT * FROM lists LEFT JOIN div USING (list_name, list_id) LEFT JOIN sen USING (list_name, list_id)
                   LEFT JOIN nov USING (list_name, list_id) LEFT JOIN ser USING (list_name, list_id, user_id)),
        long AS (SELECT list_name, user_id, unnest(['diversity', 'sentiment', 'novelty', 'serendipity']) AS metric, unnest([diversity, sentiment, novelty, serendipity]) AS x FROM scores),
        placed AS (SELECT list_name, 'all' AS segment, NULL AS segment_value, metric, x FROM long
                   UNION ALL SELECT list_name, s.segment, g.segment_value, metric, x FROM long CROSS JOIN (VALUES ('segment'), ('nation'), ('in_debt')) s(segment)
                   LEFT JOIN groups g ON g.user_id = long.user_id AND g.segment = s.segment),
        ids AS (SELECT list_name, 'all' AS segment, NULL AS segment_value, article_id FROM listed
                UNION ALL SELECT list_name, segment, segment_value, article_id FROM listed JOIN groups USING (user_id) WHERE segment <> 'all'),
        cov AS (SELECT list_name, segment, segment_value, count(DISTINCT article_id) AS k, count(*) AS n FROM ids GROUP BY 1, 2, 3)
        SELECT list_name, segment, segment_value, metric, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) + 0 AS std, count(x) AS n FROM placed GROUP BY 1, 2, 3, 4
        UNION ALL SELECT list_name, segment, segment_value, 'coverage_count', k, NULL, n FROM cov
        UNION ALL SELECT list_name, segment, segment_value, 'coverage_fraction', round(k / (SELECT count(*) FROM articles), 6), NULL, n FROM cov""",
    )
)
def beyond_report(spark, d):
    return _report(spark, d)[0].withColumns(r6("mean", "std"))


@query(
    with_views(
        "impressions counters articles",
        f"""WITH {_REPORTED},
        told AS (SELECT article_id, 'category_str' AS attribute, category_str AS value FROM articles
                 UNION ALL SELECT article_id, 'subcategory', unnest(subcategory) FROM articles
                 UNION ALL SELECT article_id, 'sentiment_label', CASE WHEN size <= 15 THEN 'negative' WHEN size <= 35 THEN 'neutral' ELSE 'positive' END FROM articles),
        counted AS (SELECT list_name, user_id, attribute, value, count(*) AS n FROM listed JOIN told USING (article_id) GROUP BY 1, 2, 3, 4),
        placed AS (SELECT list_name, 'all' AS segment, NULL AS segment_value, attribute, value, n FROM counted
                   UNION ALL SELECT list_name, segment, segment_value, attribute, value, n FROM counted JOIN groups USING (user_id) WHERE segment <> 'all')
        SELECT list_name, segment, segment_value, attribute, value, round(sum(n) / sum(sum(n)) OVER (PARTITION BY list_name, segment, segment_value, attribute), 9) AS share
        FROM placed GROUP BY list_name, segment, segment_value, attribute, value""",
    )
)
def beyond_shares(spark, d):
    return _report(spark, d)[1].withColumn("share", F.round("share", 9))


@query(
    with_views(
        "inview counters articles past",
        """WITH needed AS (SELECT article_id FROM counters UNION SELECT article_id FROM past),
        kept AS (SELECT article_id, title, coalesce(total_inviews, 1) AS total_inviews, coalesce(total_pageviews, 1) AS v
                 FROM articles LEFT JOIN counters USING (article_id) WHERE article_id IN (SELECT article_id FROM needed))
        SELECT article_id, title, total_inviews, v AS total_pageviews, round(v / (SELECT max(v) FROM kept), 6) AS total_pageviews_normalized_max,
               round((v - (SELECT min(v) FROM kept)) / (SELECT max(v) - min(v) FROM kept) * (1.0 - 1e-4) + 1e-4, 6) AS total_pageviews_normalized_min_max,
               embedding IS NOT NULL AS has_vector FROM kept LEFT JOIN embeddings ON vec_id = article_id""",
    )
)
def item_table(spark, d):
    candidates = V.counters(spark, d)
    out = beyond.item_table(V.articles_full(spark, d), V.histories(spark, d), candidates, V.vectors(spark, d))
    scaled = [f"{C.TOTAL_PAGEVIEWS}_normalized_max", f"{C.TOTAL_PAGEVIEWS}_normalized_min_max"]
    out = out.withColumn("has_vector", F.col("vector").isNotNull()).withColumns(r6(*scaled))
    return out.select(C.ARTICLE_ID, C.TITLE, C.TOTAL_INVIEWS, C.TOTAL_PAGEVIEWS, *scaled, "has_vector")


@query(
    with_views(
        "impressions counters articles",
        f"""WITH l AS (SELECT impression_id, user_id, unnest(article_ids_inview) AS article_id FROM impressions), {_POPULARITY},
        s AS (SELECT impression_id, any_value(user_id) AS user_id, avg(-log2(p)) AS x FROM l JOIN pop USING (article_id) GROUP BY 1)
        SELECT c_mktsegment AS segment, round(avg(x), 6) AS novelty, count(*) AS n FROM s JOIN customer ON c_custkey = user_id GROUP BY 1""",
    )
)
def beyond_by_segment(spark, d):
    log = V.impressions(spark, d)
    lists = log.select(C.IMPRESSION_ID, C.USER, F.col(C.INVIEW).alias("items"))
    scores = beyond.novelty(lists, _popular_items(spark, d), "popularity", list_id=[C.IMPRESSION_ID, C.USER])
    return beyond.by_segment(scores, V.users(spark, d), "novelty", "segment", C.USER).withColumns(r6("novelty"))
