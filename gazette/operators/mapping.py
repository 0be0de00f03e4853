"""Replacing ids, alone or inside lists, by looked-up values."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from gazette import columns as C
from gazette.functions.arrays import col, empty_to_null, field, with_each
from gazette.plans.lists import as_keys, gathered
from gazette.plans.lookup import lookup_join


def create_lookup(df, key, value, order_col=None) -> DataFrame:
    """A two-column mapping, one row per key; on repeated keys the last one in ``order_col`` wins.

    Rows that tie, as all rows of a key do without ``order_col``, are settled by the greatest value, nulls
    least, so that the mapping does not depend on how rows are partitioned.
    """
    order = [] if order_col is None else [F.col(c) for c in as_keys(order_col)]
    last = F.max(F.struct(*[c.alias(f"__{i}") for i, c in enumerate(order)], F.col(value).alias("__value")))
    return df.groupBy(key).agg(last.alias("__last")).select(key, F.col("__last.__value").alias(value))


def create_article_id_to_value_mapping(df, value_col, article_col=C.ARTICLE_ID, order_col=None) -> DataFrame:
    """A two-column mapping from item to value, one row per item, as ``create_lookup`` settles it."""
    return create_lookup(df, article_col, value_col, order_col)


def map_list_article_id_to_value(
    behaviors, behaviors_column, mapping, drop_nulls=False, fill_nulls=None, key=C.IMPRESSION_ID, **join_options
) -> DataFrame:
    """Replace list elements by the second column of ``mapping``, looked up by its first.

    Unknown ids become null, or ``fill_nulls``, or are removed with ``drop_nulls`` (which wins);
    a list left empty by dropping becomes null. A null or empty list counts as one unknown
    element. The mapped column moves to the end. ``key`` identifies a row.
    """
    id_col, value_col = mapping.columns[:2]
    rest = [c for c in behaviors.columns if c != behaviors_column]
    wide = gathered(behaviors, [behaviors_column], mapping, id_col, [value_col], key, **join_options)
    values = field("cells", value_col)
    dtype = mapping.schema[value_col].dataType
    if drop_nulls:
        mapped = empty_to_null(F.array_compact(values))
    else:
        unknown = F.lit(fill_nulls).cast(dtype)
        if fill_nulls is not None:
            values = F.transform(values, lambda v: F.coalesce(v, unknown))
        mapped = F.when(F.size(values) > 0, values).otherwise(F.array(unknown))
    return wide.select(*rest, mapped.alias(behaviors_column))


def map_list_columns(df, columns, mapping, fill_nulls=None, key=C.IMPRESSION_ID, prefix="", **join_options) -> DataFrame:
    """Map several list columns through all value columns of ``mapping`` in one explode and join.

    With one value column the lists are replaced; with more, each list gets one new column per
    value, named ``<prefix><value>_<list>``. ``fill_nulls`` is a value or a dict by value column.
    As above, a null or empty list counts as one unknown element.
    """
    id_col, *value_cols = mapping.columns
    fills = fill_nulls if isinstance(fill_nulls, dict) else {v: fill_nulls for v in value_cols}
    wide = gathered(df, columns, mapping, id_col, value_cols, key, **join_options)
    out = {}

    def filled(values, unknown):
        return F.transform(values, lambda x: F.coalesce(x, unknown))

    def of_list(i):
        return F.filter("cells", lambda c: c["list"] == i)

    for i, name in enumerate(columns):
        for v in value_cols:
            dtype = mapping.schema[v].dataType
            fill = fills.get(v)
            unknown = (fill if not isinstance(fill, (int, float, str)) else F.lit(fill)) if fill is not None else F.lit(None)
            unknown = unknown.cast(dtype)
            each = filled(field(of_list(i), v), unknown)
            target = name if len(value_cols) == 1 else f"{prefix}{v}_{name}"
            out[target] = F.when(F.size(each) > 0, each).otherwise(F.array(unknown))
    return wide.withColumns(out).drop("cells")


def score_lists(df, scores, inview_col=C.INVIEW, unknown="zero", key=C.IMPRESSION_ID, **join_options) -> DataFrame:
    """Look up one list of scores per value column of ``scores`` for the in-view ids.

    A known id without a score gets 0. An unknown id gets 0, or itself with ``unknown='keep'``.
    """
    if unknown not in ("zero", "keep"):
        raise ValueError("unknown must be 'zero' or 'keep'")
    id_col, *score_cols = scores.columns
    wide = gathered(df, [inview_col], scores, id_col, score_cols, key, **join_options)

    def value(c, name):
        missing = F.lit(0.0) if unknown == "zero" else F.when(c["hit"], 0.0).otherwise(c["id"].cast("double"))
        return F.coalesce(c[name].cast("double"), missing)

    def values(name):
        return F.transform("cells", lambda c: value(c, name))

    return wide.withColumns({s: values(s) for s in score_cols}).drop("cells")


def map_column(df, column, mapping, default=None, out=None) -> DataFrame:
    """Replace a scalar column through a two-column mapping; unknown values get ``default``."""
    id_col, value_col = mapping.columns[:2]
    table = mapping.select(F.col(id_col).alias(column), F.col(value_col).alias("__value"))
    kept = [c for c in df.columns if c != (out or column)]
    joined = lookup_join(df, table, column, "left")
    value = F.col("__value") if default is None else F.coalesce("__value", F.lit(default))
    return joined.withColumn("__out", value).select(*kept, F.col("__out").alias(out or column))


def known_items(lists, items, list_id="list_id", items_col="items", item_col=C.ARTICLE_ID, columns=(), **join_options) -> DataFrame:
    """``(list_id, pos, item, <columns>)`` for the list elements found in the item table."""
    keys = as_keys(list_id)
    rows = lists.select(*keys, F.posexplode(items_col).alias("pos", item_col))
    table = items.select(item_col, *columns)
    return lookup_join(rows, table, item_col, "inner", spread=[*keys, "pos"], **join_options)


def gather_vectors(df, column, vectors, unknown="zeros", key=C.IMPRESSION_ID, out=None, **join_options) -> DataFrame:
    """Replace ids in a list by their vectors; unknown ids get zeros or the mean vector.

    Vectors travel in their own type and become doubles, as the stand-in is, once they are in their lists.
    """
    id_col, vec_col = vectors.columns[:2]
    fallback = unknown_vector(vectors, unknown)
    wide = gathered(df, [column], vectors, id_col, [vec_col], key, **join_options)
    cells = with_each("cells", F.col("__unknown"), lambda c, other: F.coalesce(c[vec_col], other))
    return wide.withColumn("__unknown", fallback).withColumn(out or column, cells).drop("cells", "__unknown")


def repeat_vectors(df, column, vectors, repeats, unknown="zeros", spread=None, out="vector", **join_options) -> DataFrame:
    """Look up one vector per row and repeat the row ``repeats`` times (a column or a number).

    Unknown ids get zeros or the mean vector. ``copy`` counts the repeats from 0.
    """
    id_col, vec_col = vectors.columns[:2]
    fallback = unknown_vector(vectors, unknown)
    table = vectors.select(F.col(id_col).alias(column), F.col(vec_col).alias("__v"))
    found = lookup_join(df, table, column, "left", spread=spread, **join_options)
    n = F.lit(repeats) if isinstance(repeats, int) else col(repeats)
    copies = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    filled = found.withColumn(out, F.coalesce("__v", fallback))
    return filled.withColumn("copy", F.explode(copies)).select(*df.columns, "copy", out)


def unknown_vector(vectors, how):
    """The stand-in vector for unknown ids as a scalar: zeros or the element-wise mean."""
    vec_col = vectors.columns[1]
    if how == "zeros":
        width = vectors.agg(F.max(F.size(vec_col))).scalar()
        return F.array_repeat(F.lit(0.0), width)
    if how == "mean":
        return mean_vector(vectors, vec_col).scalar()
    raise ValueError(f"{how!r} is not a way to represent unknown ids; use 'zeros' or 'mean'")


def mean_vector(df, vec_col) -> DataFrame:
    """Element-wise mean over all rows, combined on the map side."""
    dense = array_to_vector(F.col(vec_col).cast("array<double>"))
    return df.agg(vector_to_array(Summarizer.mean(dense)).alias(vec_col))
