"""Negative sampling, shuffles, exact splits, numbering of rows and random candidate lists."""

import random

from pyspark.sql import DataFrame, functions as F, types as T

from gazette import columns as C
from gazette.functions.arrays import without
from gazette.functions.draws import (
    digest,
    distinct_draws,
    sample_with_replacement,
    sample_without_replacement,
    shuffled,
)
from gazette.plans.lists import as_keys
from gazette.plans.lookup import lookup_join
from gazette.plans.numbering import digest_cut, digest_index, first_rows, row_index


def _seed(seed):
    return random.getrandbits(31) if seed is None else seed


def remove_positives_from_inview(df, inview_col=C.INVIEW, clicked_col=C.CLICKED) -> DataFrame:
    """In-view ids minus clicked ids; order and repeats are kept."""
    return df.withColumn(inview_col, without(inview_col, clicked_col))


def keep_unique_values_in_list(df, column) -> DataFrame:
    """Drop repeats inside each list, keeping first occurrences."""
    return df.withColumn(column, F.array_distinct(column))


def sample_article_ids(df, n, with_replacement=False, seed=None, inview_col=C.INVIEW, key=C.IMPRESSION_ID) -> DataFrame:
    """Draw ``n`` ids from each list. Without replacement a shorter list raises."""
    draw = sample_with_replacement if with_replacement else sample_without_replacement
    return df.withColumn(inview_col, draw(inview_col, n, _seed(seed), *as_keys(key)))


def sampling_strategy_wu2019(
    df,
    npratio,
    shuffle=False,
    with_replacement=True,
    seed=None,
    inview_col=C.INVIEW,
    clicked_col=C.CLICKED,
    key=C.IMPRESSION_ID,
    keep_empty=False,
) -> DataFrame:
    """One row per click: ``npratio`` negatives drawn from the impression, then the click.

    Row-local throughout (filter, explode, array expressions): the plan has no exchange.
    Impressions without a click yield no row unless ``keep_empty``.
    """
    if npratio < 0:
        raise ValueError("npratio must not be negative")
    seed = _seed(seed)
    explode = F.explode_outer if keep_empty else F.explode
    draw = sample_with_replacement if with_replacement else sample_without_replacement
    row = [*as_keys(key), "__click"]
    rest = [c for c in df.columns if c not in (inview_col, clicked_col)]
    clicks = df.select(*rest, without(inview_col, clicked_col).alias("__negatives"), explode(clicked_col).alias("__click"))
    inview = F.concat(draw("__negatives", npratio, seed, *row), F.array("__click"))
    out = clicks.withColumn(inview_col, inview).withColumn(clicked_col, F.array("__click"))
    if shuffle:
        out = out.withColumn(inview_col, shuffled(inview_col, seed, *row))
    return out.select(*df.columns)


def shuffle_list_column(df, column, seed=None, key=C.IMPRESSION_ID) -> DataFrame:
    """Permute each list."""
    return df.withColumn(column, shuffled(column, _seed(seed), *as_keys(key)))


def shuffle_rows(df, seed=None, key=None) -> DataFrame:
    """Rows in random order: a range sort on the digest of the key.

    Rows with one key follow a second digest of all their columns, so the order is the same for any
    partitioning; only rows equal in every column tie, and those cannot be told apart.
    """
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    every = F.md5(F.to_json(F.struct(*names)))
    return df.orderBy(digest(_seed(seed), *(as_keys(key) if key else [every])), every)


def shuffled_index(df, seed, key=C.IMPRESSION_ID, name="row_nr", offset=0) -> DataFrame:
    """The dense position of each row in shuffled order."""
    return digest_index(df, digest(seed, *as_keys(key)), name, offset)


def split_df_fraction(df, fraction=0.8, seed=None, shuffle=True, key=C.IMPRESSION_ID) -> tuple[DataFrame, DataFrame]:
    """Two parts, the first with exactly ``floor(n * fraction)`` rows.

    Shuffled, the parts are the rows below and above one digest; the data is filtered, not
    moved. Unshuffled, rows are split in the order of ``key``.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    keys = as_keys(key)
    if shuffle:
        d = digest(_seed(seed), *keys)
        cut = digest_cut(df, d, F.floor(F.col("total") * F.lit(fraction)))
        first = F.coalesce(d <= cut, F.lit(False))
        return df.filter(first), df.filter(~first)
    numbered = row_index(df, keys, "__nr")
    cut = F.floor(numbered.agg(F.count("*")).scalar() * F.lit(fraction))
    return numbered.filter(F.col("__nr") < cut).drop("__nr"), numbered.filter(F.col("__nr") >= cut).drop("__nr")


def sample_rows(df, fraction=None, n=None, seed=None, key=C.IMPRESSION_ID) -> DataFrame:
    """An exact-size random sample: ``n`` rows or ``floor(rows * fraction)`` of them."""
    d = digest(_seed(seed), *as_keys(key))
    size = F.least(F.lit(n), F.col("total")) if n is not None else F.floor(F.col("total") * F.lit(fraction))
    return df.filter(d <= digest_cut(df, d, size))


def add_chunk_number(df, n_chunks, key=C.IMPRESSION_ID, name="chunk") -> DataFrame:
    """Consecutive chunks of ``floor(n / n_chunks)`` rows in key order; the rest joins the last."""
    numbered = row_index(df, as_keys(key), "__nr")
    size = F.floor(numbered.agg(F.count("*")).scalar() / n_chunks)
    chunk = F.when(size > 0, F.least(F.floor(F.try_divide(F.col("__nr"), size)), F.lit(n_chunks - 1)))
    return numbered.withColumn(name, F.coalesce(chunk, F.lit(n_chunks - 1)).cast("int")).drop("__nr")


def split_df_chunks(df, n_chunks, key=C.IMPRESSION_ID) -> list[DataFrame]:
    numbered = add_chunk_number(df, n_chunks, key, "__chunk")
    return [numbered.filter(F.col("__chunk") == i).drop("__chunk") for i in range(n_chunks)]


def add_split_number(df, num_splits, key=C.IMPRESSION_ID, name="chunk") -> DataFrame:
    """Consecutive splits of ``ceil(n / num_splits)`` rows in key order; the last may be smaller."""
    numbered = row_index(df, as_keys(key), "__nr")
    size = F.ceil(numbered.agg(F.count("*")).scalar() / num_splits)
    return numbered.withColumn(name, F.floor(F.try_divide(F.col("__nr"), size)).cast("int")).drop("__nr")


def split_df_in_n(df, num_splits, key=C.IMPRESSION_ID) -> list[DataFrame]:
    numbered = add_split_number(df, num_splits, key, "__split")
    return [numbered.filter(F.col("__split") == i).drop("__split") for i in range(num_splits)]


def add_batch_id(df, batch_size, key=C.IMPRESSION_ID, name="batch_id") -> DataFrame:
    """Number consecutive batches of ``batch_size`` rows in key order."""
    return row_index(df, as_keys(key), "__nr").withColumn(name, F.floor(F.col("__nr") / batch_size)).drop("__nr")


def create_user_id_to_int_mapping(df, user_col=C.USER, value_str="id", offset=0) -> DataFrame:
    """Distinct users numbered from ``offset`` in user order."""
    return row_index(df.select(user_col).dropna().distinct(), [user_col], value_str, offset)


def random_candidates(candidates, n, n_lists, seed, item_col=C.ARTICLE_ID, list_id="list_id") -> DataFrame:
    """``n_lists`` lists of ``n`` different candidates as ``(list_id, pos, item)``.

    Candidates are numbered; each list draws its numbers on its own, then the numbers are
    joined to ids. Nothing holds all candidates or all lists in one place.
    """
    indexed = row_index(candidates.select(item_col).distinct(), [item_col], "__nr")
    total = indexed.count()
    if n > total:
        raise ValueError(f"cannot draw {n} different items from {total} candidates")
    draws = candidates.sparkSession.range(n_lists).select(
        F.col("id").alias(list_id), F.posexplode(distinct_draws(total, n, seed, "id")).alias("pos", "__draw")
    )
    rows = draws.withColumn("__nr", F.col("__draw").cast("bigint")).drop("__draw")
    return lookup_join(rows, indexed, "__nr", "inner", spread=[list_id, "pos"]).select(list_id, "pos", item_col)


def top_n_per_group(df, n, group, order, hot_rows=None) -> DataFrame:
    """The first ``n`` rows of each group, limited on the map side or ranked over many tasks (``first_rows``)."""
    return first_rows(df, n, as_keys(group), list(order), hot_rows)
