"""Mapping the ids held in list columns through a table: explode once, join once, regroup once."""

from pyspark.sql import DataFrame, functions as F

from gazette import columns as C
from gazette.functions.arrays import named
from gazette.plans.lookup import lookup_join


def as_keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def gathered(
    df: DataFrame,
    list_columns: list[str],
    lookup: DataFrame,
    id_col: str,
    value_cols: list[str],
    key=C.IMPRESSION_ID,
    **join_options,
) -> DataFrame:
    """``df`` with a column ``cells``: one struct per list element, ordered by list and position.

    A cell holds ``(list, pos, id, hit, <value_cols>)``, where ``list`` is the index of the column
    in ``list_columns`` and ``hit`` tells whether the id is in ``lookup``. ``cells`` is empty for a
    row whose lists are all null or empty. ``key`` must identify a row and ``id_col`` a row of ``lookup``;
    where that is not so, the job fails instead of merging rows.

    One pass and one regrouping shuffle: the other columns ride on the first element of their row
    only, so nothing is joined back and no wide value is repeated. Each is carried by its own
    aggregate, which the optimizer drops when the column is not used later.
    """
    keys = as_keys(key)
    rest = [c for c in df.columns if c not in keys]

    def tagged(i, name):
        return F.transform(F.col(name), lambda x, p: named(list=F.lit(i), pos=p, __id=x))

    parts = [F.coalesce(tagged(i, c), F.array()) for i, c in enumerate(list_columns)]
    every = parts[0] if len(parts) == 1 else F.concat(*parts)
    exploded = df.select(*keys, *rest, F.posexplode_outer(every).alias("__place", "__cell"))
    first = F.coalesce(F.col("__place"), F.lit(0)) == 0
    rows = exploded.select(
        *keys,
        *[F.when(first, F.col(c)).alias(c) for c in rest],
        "__place",
        F.col("__cell.list").alias("__list"),
        F.col("__cell.pos").alias("__pos"),
        F.col("__cell.__id").alias("__id"),
    )
    table = lookup.select(
        F.col(id_col).alias("__id"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__v_{c}") for c in value_cols]
    )
    joined = lookup_join(rows, table, "__id", "left", spread=[*keys, "__place"], **join_options)
    cell = F.named_struct(
        F.lit("list"), F.col("__list"),
        F.lit("pos"), F.col("__pos"),
        F.lit("id"), F.col("__id"),
        F.lit("hit"), F.coalesce("__hit", F.lit(False)),
        *[part for c in value_cols for part in (F.lit(c), F.col(f"__v_{c}"))],
    )
    cells = F.array_sort(F.collect_list(F.when(F.col("__place").isNotNull(), cell)))
    # a second first element, or a place met twice, would merge rows or lengthen lists without a word
    firsts = F.count_if(F.coalesce(F.col("__place"), F.lit(0)) == 0)
    places = F.coalesce(F.max("__place") + 1, F.lit(0))
    sound = F.when(
        (firsts > 1) | (F.count("__place") > places),
        F.raise_error(F.lit("the key does not identify a row, or the lookup table repeats an id")),
    ).otherwise(cells)
    return joined.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest], sound.alias("cells")).select(
        *df.columns, "cells"
    )
