"""Attaching, computing and ranking candidate scores."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from gazette import columns as C
from gazette.functions.arrays import dot, field, sigmoid, softmax
from gazette.functions.draws import shuffled
from gazette.functions.ranking import ranks
from gazette.operators.mapping import score_lists
from gazette.plans.lists import as_keys
from gazette.plans.lookup import lookup_join
from gazette.plans.numbering import row_index, running_total
from gazette.plans.store import materialise


def add_prediction_scores(df, scores, prediction_scores_col=C.SCORES, inview_col=C.INVIEW, key=C.IMPRESSION_ID) -> DataFrame:
    """Regroup ``(key, pos, score)`` rows to one list per impression, aligned with the in-view list."""
    keys = as_keys(key)
    value = [c for c in scores.columns if c not in (*keys, "pos")][0]
    lists = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("__s"))
    aligned = field("__s", value)
    kept = [c for c in df.columns if c != prediction_scores_col]
    return df.join(lists, keys, "left").select(*kept, aligned.alias(prediction_scores_col))


def add_flat_prediction_scores(
    df, scores, prediction_scores_col=C.SCORES, inview_col=C.INVIEW, key=C.IMPRESSION_ID
) -> DataFrame:
    """Attach a flat score vector ``(nr, score)`` that follows the unfolded impressions in key order.

    Each impression's first place is the running total of the lengths before it, so a score finds
    its impression by an equi-join on its number.
    """
    keys = as_keys(key)
    nr, value = scores.columns[:2]
    sizes = df.select(*keys, F.greatest(F.size(inview_col), F.lit(0)).alias("__n"))
    first = running_total(sizes, keys, "__n", "__first", inclusive=False)
    places = first.filter("__n > 0").select(
        *keys, F.posexplode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)).alias("pos", nr)
    )
    keyed = places.join(scores.select(nr, value), nr).select(*keys, "pos", value)
    return add_prediction_scores(df, keyed, prediction_scores_col, inview_col, key)


def rank_predictions_by_score(df, scores_col=C.SCORES, out=None) -> DataFrame:
    """Replace a score list by its ranks, 1 for the highest."""
    return df.withColumn(out or scores_col, ranks(scores_col))


def rank_rows_by_score(df, score, key=C.IMPRESSION_ID, pos="pos", name="rank") -> DataFrame:
    """Rank rows inside each impression; ties go to the later position."""
    w = Window.partitionBy(*as_keys(key)).orderBy(F.col(score).desc(), F.col(pos).desc())
    return df.withColumn(name, F.row_number().over(w))


def create_sort_based_prediction_score(
    df, column, desc, article_id_col=C.ARTICLE_ID, prediction_score_col="prediction_score"
) -> DataFrame:
    """``1 / rank`` in the order of ``column``; nulls first, ties by id."""
    by = F.col(column).desc_nulls_first() if desc else F.col(column).asc_nulls_first()
    numbered = row_index(df.select(article_id_col, column), [by, article_id_col], "__rank", offset=1)
    return numbered.withColumn(prediction_score_col, 1 / F.col("__rank")).drop("__rank")


def popularity_scores(articles, inviews=None, article_col=C.ARTICLE_ID) -> DataFrame:
    """One row per article with the four popularity scores (clicks, in-views, estimate, read time)."""
    base = articles.select(
        article_col,
        F.col(C.TOTAL_PAGEVIEWS).alias("clicked_prediction_scores"),
        F.col(C.TOTAL_INVIEWS).alias("inview_prediction_scores"),
        F.col(C.TOTAL_READ_TIME).alias("readtime_prediction_scores"),
    )
    if inviews is None:
        return base
    estimate = inviews.select(F.col(inviews.columns[0]).alias(article_col), F.col(inviews.columns[1]).alias("inview_estimate_prediction_scores"))
    return base.join(estimate, article_col, "full")


POPULARITY_SCORES = [
    "clicked_prediction_scores",
    "inview_prediction_scores",
    "inview_estimate_prediction_scores",
    "readtime_prediction_scores",
]


def popularity_baselines(df, articles, inviews, inview_col=C.INVIEW, key=C.IMPRESSION_ID, **join_options) -> DataFrame:
    """Ranks of the in-view ids under the four popularity scores, looked up in one pass."""
    # the estimate reads the whole log: store the per-article table so that it is counted once
    scores = materialise(popularity_scores(articles, inviews))
    scored = score_lists(df, scores, inview_col, key=key, **join_options)
    return scored.select(*as_keys(key), *[ranks(c).alias(c) for c in POPULARITY_SCORES])


def random_ranks(df, seed, inview_col=C.INVIEW, key=C.IMPRESSION_ID, out="ranks") -> DataFrame:
    """A random permutation of 1..n per row."""
    size = F.size(inview_col)
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, shuffled(places, seed, *as_keys(key)))


def reciprocal_list(df, column) -> DataFrame:
    return df.withColumn(column, F.transform(column, lambda x: 1.0 / x))


def user_vectors(histories, vectors, weights, user_key=C.USER, history_col=C.HISTORY_IDS, out="user_vector", **join_options) -> DataFrame:
    """One vector per user: the weighted mean of the history's vectors.

    ``weights`` maps a length column to a list of weights (see the decay functions). Unknown ids
    are left out with their weights. Sums are combined on the map side.
    """
    id_col, vec_col = vectors.columns[:2]
    keys = as_keys(user_key)
    weighted = F.arrays_zip(F.col(history_col).alias("__id"), weights(F.size(history_col)).alias("__w"))
    rows = histories.filter(F.size(history_col) > 0).select(*keys, F.posexplode(weighted).alias("pos", "__z"))
    rows = rows.select(*keys, "pos", "__z.*")
    table = vectors.select(F.col(id_col).alias("__id"), F.col(vec_col).cast("array<double>").alias("__v"))
    found = lookup_join(rows, table.dropna(), "__id", "inner", spread=[*keys, "pos"], **join_options)
    mean = Summarizer.mean(array_to_vector(F.col("__v")), F.col("__w"))
    return found.groupBy(*keys).agg(vector_to_array(mean).alias(out))


def embedding_scores(
    df, histories, vectors, weights, user_key=C.USER, history_col=C.HISTORY_IDS, inview_col=C.INVIEW, key=C.IMPRESSION_ID, **join_options
) -> DataFrame:
    """Score candidates by the dot product with their user's vector.

    ``histories`` has one row per user, so a history is read once however often its user appears.
    Candidates meet both vectors as single rows, and only their scores are regrouped. A candidate
    or user without a vector scores 0. Adds the lists ``scores``, ``sigmoid`` and ``softmax``.
    """
    keys, users = as_keys(key), as_keys(user_key)
    id_col, vec_col = vectors.columns[:2]
    user = F.struct(*users).alias("__user")
    tastes = user_vectors(histories, vectors, weights, users, history_col, **join_options).select(user, F.col("user_vector").alias("__u"))
    items = vectors.select(F.col(id_col).alias("__id"), F.col(vec_col).cast("array<double>").alias("__v"))
    rows = df.select(*keys, user, F.posexplode(inview_col).alias("pos", "__id"))
    found = lookup_join(rows, items, "__id", "left", spread=[*keys, "pos"], **join_options)
    # user vectors come out of a join of their own: shuffle them rather than compute them twice
    both = lookup_join(
        found, tastes, "__user", "left", spread=[*keys, "pos"], **{**join_options, "broadcast_bytes": 0}, count_on=rows.select("__user")
    )
    scored = both.select(*keys, "pos", F.coalesce(dot("__u", "__v"), F.lit(0.0)).alias("__score"))
    return add_prediction_scores(df, scored, "scores", inview_col, keys).withColumns(
        {"sigmoid": F.transform("scores", lambda s: sigmoid(s)), "softmax": softmax("scores")}
    )


def score_batches(df, scorer, schema) -> DataFrame:
    """Score with a model given as a function from pandas batches to pandas batches.

    Spark's tasks are the chunks; a lost task is run again on its own.
    """

    def run(batches):
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(run, schema)
