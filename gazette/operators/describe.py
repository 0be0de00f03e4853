"""Descriptive statistics of the log and the catalogue."""

from pyspark.sql import Column, DataFrame, functions as F

from gazette import columns as C
from gazette.functions.text import word_count
from gazette.plans.numbering import running_total


def unique_article_ids_in_behaviors(df, col="ids", item_col=C.ARTICLE_ID, inview_col=C.INVIEW, clicked_col=C.CLICKED) -> DataFrame:
    """Distinct ids over the item, in-view and clicked columns, nulls dropped; one pass."""
    every = F.concat(
        F.array(item_col),
        F.coalesce(inview_col, F.array().cast(df.schema[inview_col].dataType)),
        F.coalesce(clicked_col, F.array().cast(df.schema[clicked_col].dataType)),
    )
    return df.select(F.explode(every).alias(col)).dropna().distinct()


def min_max_impression_time_behaviors(df, timestamp_col=C.IMPRESSION_TIME) -> DataFrame:
    return df.agg(F.min(timestamp_col).alias("min"), F.max(timestamp_col).alias("max"))


def min_max_impression_time_history(df, timestamp_col=C.HISTORY_TIMES) -> DataFrame:
    """Earliest and latest element over all lists."""
    return df.agg(F.min(F.array_min(timestamp_col)).alias("min"), F.max(F.array_max(timestamp_col)).alias("max"))


def inview_counts(df, inview_col=C.INVIEW, name="count") -> DataFrame:
    """How often each id was shown."""
    return df.select(F.explode(inview_col).alias(inview_col)).groupBy(inview_col).agg(F.count("*").alias(name))


def value_shares(df, column, name="value") -> DataFrame:
    """Counts, shares and running shares from the most frequent value down (ties by value)."""
    counts = df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*")).scalar()
    cumulated = running_total(counts, [F.col("count").desc(), name], "count", "__upto")
    return cumulated.select(
        name, "count", (F.col("count") / total).alias("share"), (F.col("__upto") / total).alias("running_share")
    )


def compute_npratio(n_pos, n_neg) -> Column:
    """Negatives per positive; null without positives."""
    return F.try_divide(n_neg, n_pos)


def dataset_overview(behaviors, histories, articles, user_flags=(C.IS_SSO_USER, C.IS_SUBSCRIBER)) -> DataFrame:
    """One row of dataset totals.

    A flag total counts distinct (user, flag) pairs with the flag set, so a user seen with and
    without it counts once. Null subcategories count as a value.
    """
    clicks, shown = F.size(C.CLICKED), F.size(C.INVIEW)
    ok = F.col(C.CLICKED).isNotNull()
    log = behaviors.agg(
        F.count("*").alias("n_impressions"),
        F.sum(F.when(ok, clicks)).alias("n_pos"),
        F.sum(F.when(ok, shown - clicks)).alias("n_neg"),
        F.count_distinct(C.USER).alias("n_users"),
        *[F.count_distinct(F.when(F.col(f), F.col(C.USER))).alias(f"n_{f[3:]}s") for f in user_flags],
    )
    past = histories.select(C.USER, F.explode(C.HISTORY_TIMES).alias("t")).distinct()
    catalogue = articles.agg(
        F.count_distinct(C.ARTICLE_ID).alias("n_articles"),
        F.count_distinct(F.coalesce(F.col(C.CATEGORY_STR), F.lit("\0"))).alias("n_categories"),
    )
    subcategories = articles.select(F.explode_outer(C.SUBCATEGORY).alias("s")).agg(
        F.count_distinct(F.coalesce("s", F.lit("\0"))).alias("n_subcategories")
    )
    n_history = past.agg(F.count("*")).scalar()
    facts = catalogue.agg(F.first(F.struct("n_articles", "n_categories"))).scalar()
    return (
        log.withColumn("n_history", n_history)
        .withColumn("n_interactions", F.col("n_impressions") + F.col("n_history"))
        .withColumn("__f", facts)
        .withColumn("n_articles", F.col("__f.n_articles"))
        .withColumn("n_categories", F.col("__f.n_categories"))
        .drop("__f")
        .withColumn("n_subcategories", subcategories.scalar())
        .withColumn("np_ratio", F.round(compute_npratio(F.col("n_pos"), F.col("n_neg")), 2))
        .withColumn("impressions_per_user", F.round(F.try_divide("n_impressions", "n_users"), 2))
    )


def compute_overlap(df1, df2, column=C.USER) -> DataFrame:
    """``count(df1) / count(distinct(df1 or df2))`` over distinct users."""
    return overlaps({"a": df1, "b": df2}, [(("a",), ("b",))], column).select("overlap")


def overlaps(splits: dict[str, DataFrame], pairs, column=C.USER) -> DataFrame:
    """Overlap for several (left names, right names) pairs at once.

    Each user is reduced to one flag per split first, so all pairs share a single shuffle.
    """
    rows = None
    for name in splits:
        part = splits[name].select(column, *[F.lit(n == name).alias(n) for n in splits])
        rows = part if rows is None else rows.unionByName(part)
    users = rows.groupBy(column).agg(*[F.max(n).alias(n) for n in splits])

    def member(names):
        out = F.lit(False)
        for n in names:
            out = out | F.col(n)
        return out

    cells = users.agg(
        *[
            F.try_divide(F.count_if(member(a)).cast("double"), F.count_if(member(a) | member(b))).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    label = ["+".join(a) + " vs " + "+".join(b) for a, b in pairs]
    return cells.select(
        F.inline(F.array(*[F.struct(F.lit(t).alias("pair"), F.col(f"p{i}").alias("overlap")) for i, t in enumerate(label)]))
    )


def first_value_share(df, value_col=C.GENDER, user_col=C.USER, order=(C.IMPRESSION_TIME,)) -> DataFrame:
    """Each user's first non-null value, users per value and their share."""
    known = df.select(user_col, value_col, *order).dropna()
    first = known.groupBy(user_col).agg(F.min_by(value_col, F.struct(*order)).alias("value"))
    counts = first.groupBy("value").agg(F.count("*").alias("n_users"))
    return counts.withColumn("share", F.col("n_users") / counts.agg(F.sum("n_users")).scalar())


def unique_history_times(histories, user_col=C.USER, time_col=C.HISTORY_TIMES) -> DataFrame:
    """Distinct history timestamps per user."""
    pairs = histories.select(user_col, F.explode(time_col).alias("t")).distinct()
    return pairs.groupBy(user_col).agg(F.count("*").alias("n_times"))


def add_word_count_column(df, column, column_alias=None) -> DataFrame:
    return df.withColumn(column_alias or f"n_words_{column}", word_count(column))


def word_statistics(df, columns) -> DataFrame:
    """Mean and sample standard deviation of word counts, one row per column."""
    cells = df.agg(
        *[F.struct(F.lit(c).alias("column"), F.avg(word_count(c)).alias("mean"), F.stddev_samp(word_count(c)).alias("std"), F.min(word_count(c)).alias("min"), F.max(word_count(c)).alias("max")).alias(c) for c in columns]
    )
    return cells.select(F.inline(F.array(*[F.col(c) for c in columns])))


def histogram(df, column, bin_width=None, n_bins=None, low=None, high=None) -> DataFrame:
    """Counts and density per bin: fixed ``bin_width``, or ``n_bins`` between ``low`` and ``high``.

    The bins are closed on the left; with ``n_bins`` the last one also takes ``high`` itself.
    Values outside the range are left out.
    """
    x = F.col(column).cast("double")
    if bin_width is not None:
        width = F.lit(float(bin_width))
        kept, index, start = df.filter(x.isNotNull()), F.floor(x / width), lambda b: b * width
    else:
        width = F.lit((high - low) / n_bins)
        kept = df.filter(x.between(low, high))
        index = F.least(F.floor((x - low) / width), F.lit(n_bins - 1))
        start = lambda b: F.lit(float(low)) + b * width
    counts = kept.groupBy(index.alias("bin")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("bin", start(F.col("bin")).alias("bin_start"), "count", (F.col("count") / (total * width)).alias("density"))


def scale_range(df, column, r_min=None, r_max=None, t_min=0.0, t_max=1.0, out=None) -> DataFrame:
    """Min-max scaling to ``[t_min, t_max]``; bounds default to the column's own."""
    x = F.col(column).cast("double")
    own = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    low = own["lo"] if r_min is None else F.lit(float(r_min))
    high = own["hi"] if r_max is None else F.lit(float(r_max))
    return df.withColumn(out or column, F.try_divide(x - low, high - low) * (t_max - t_min) + t_min)


def normalise_max(df, column, out=None) -> DataFrame:
    """``x / max(x)``."""
    x = F.col(column).cast("double")
    return df.withColumn(out or column, F.try_divide(x, df.agg(F.max(x)).scalar()))


def same_candidate_list(df, inview_col=C.INVIEW) -> DataFrame:
    """Number of different lists and the first of them; a shared candidate list has one.

    Lists are told apart by digests, so that no list but the first of each task is moved.
    """
    digest = F.when(F.col(inview_col).isNotNull(), F.sha2(F.to_json(F.struct(inview_col)), 256))
    return df.agg(F.count_distinct(digest).alias("n_lists"), F.min(inview_col).alias("items"))


def shared_candidates(df, inview_col=C.INVIEW, item_col=C.ARTICLE_ID) -> DataFrame:
    """The candidate list every row carries, one id per row; raises when rows differ."""
    # the least list is the greatest one only if all are equal
    check = df.agg(F.min(inview_col).alias("items"), F.max(inview_col).alias("last"))
    ok = F.when(F.col("items") == F.col("last"), F.col("items")).otherwise(F.raise_error(F.lit("rows carry different candidate lists")))
    return check.select(F.explode(ok).alias(item_col))
