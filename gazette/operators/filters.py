"""Row filters, list filters, flags and placeholders."""

from pyspark.sql import Column, DataFrame, functions as F

from gazette import columns as C
from gazette.functions.arrays import empty_to_null, field
from gazette.plans.lists import gathered
from gazette.plans.lookup import lookup_join
from gazette.plans.store import materialise


def _active(df: DataFrame, n, column: str) -> bool:
    return column in df.columns and n is not None and n > 0


def filter_minimum_negative_samples(df, n=None, inview_col=C.INVIEW, clicked_col=C.CLICKED) -> DataFrame:
    """Keep impressions with at least ``n`` more in-view ids than clicks; no-op without ``n``."""
    if n is None or n <= 0:
        return df
    return df.filter((F.size(inview_col) - F.size(clicked_col) >= n) & F.col(clicked_col).isNotNull())


def filter_read_times(df, n=None, column=C.READ_TIME) -> DataFrame:
    """Keep rows with ``column >= n``; no-op without the column or ``n``."""
    return df.filter(F.col(column) >= n) if _active(df, n, column) else df


def filter_minimum_lengths_from_list(df, n=None, column=C.INVIEW) -> DataFrame:
    """Keep rows whose list has at least ``n`` elements; no-op without the column or ``n``."""
    return df.filter(F.size(column) >= n) if _active(df, n, column) else df


def filter_maximum_lengths_from_list(df, n=None, column=C.INVIEW) -> DataFrame:
    """Keep rows whose list has at most ``n`` elements (null lists go); no-op without the column or ``n``."""
    if not _active(df, n, column):
        return df
    return df.filter(F.col(column).isNotNull() & (F.size(column) <= n))


def filter_list_elements(df, column, ids, key=C.IMPRESSION_ID) -> DataFrame:
    """Keep the list elements found in ``ids``; a list without survivors becomes null.

    ``ids`` is a short Python list (row-local filter) or a DataFrame whose first column holds
    the ids (joined once on the exploded elements; needs ``key``).
    """
    if not isinstance(ids, DataFrame):
        wanted = F.array(*[F.lit(i) for i in ids])
        return df.withColumn(
            column,
            empty_to_null(F.filter(column, lambda x: F.coalesce(F.array_contains(wanted, x), F.lit(False)))),
        )
    table = _distinct_ids(ids, "__wanted")
    hits = field(F.filter("cells", lambda c: c["hit"]), "id")
    return gathered(df, [column], table, "__wanted", [], key).withColumn(column, empty_to_null(hits)).drop("cells")


def filter_elements(df, column, ids) -> DataFrame:
    """Null out values not in ``ids`` (list or one-column DataFrame); rows are kept."""
    return df.withColumn(column, F.when(F.col(column).isin(list(ids)), F.col(column))) if not isinstance(
        ids, DataFrame
    ) else _flagged(df, column, ids, "__hit").withColumn(column, F.when(F.col("__hit"), F.col(column))).drop("__hit")


def _distinct_ids(ids, name) -> DataFrame:
    """The ids once each, stored: they are measured and then joined, but only worked out once."""
    return materialise(ids.select(F.col(ids.columns[0]).alias(name)).dropna().distinct())


def _flagged(df, column, ids, flag) -> DataFrame:
    table = _distinct_ids(ids, column).withColumn("__in", F.lit(True))
    return (
        lookup_join(df, table, column, "left")
        .withColumn(flag, F.coalesce("__in", F.lit(False)))
        .select(*df.columns, flag)
    )


def filter_empty_text_column(df, column) -> DataFrame:
    """Keep rows with non-empty text."""
    return df.filter(F.length(column) > 0)


def add_known_user_column(df, known_users, user_col=C.USER, known_user_col=C.KNOWN_USER) -> DataFrame:
    """Flag users found in ``known_users`` (list or one-column DataFrame)."""
    if isinstance(known_users, DataFrame):
        return _flagged(df, user_col, known_users, known_user_col)
    return df.withColumn(known_user_col, F.coalesce(F.col(user_col).isin(list(known_users)), F.lit(False)))


def split_on_flag(df, flag) -> tuple[DataFrame, DataFrame]:
    """Rows with the flag set and the rest, the flag dropped."""
    is_set = F.coalesce(F.col(flag), F.lit(False))
    return df.filter(is_set).drop(flag), df.filter(~is_set).drop(flag)


def page_share(df, read_time_cut=None, item_col=C.ARTICLE_ID, read_time_col=C.READ_TIME) -> DataFrame:
    """Front-page (no article) and article-page counts and shares in one pass.

    With ``read_time_cut`` the rows read for less than it are counted per side as well.
    """
    front, total = F.col(item_col).isNull(), F.count("*")
    out = [
        total.alias("n_rows"),
        F.count_if(front).alias("n_front"),
        F.count_if(~front).alias("n_article"),
        F.try_divide(F.count_if(front).cast("double"), total).alias("front_share"),
        F.try_divide(F.count_if(~front).cast("double"), total).alias("article_share"),
    ]
    if read_time_cut is not None:
        short = F.col(read_time_col) < read_time_cut
        out += [
            F.count_if(front & short).alias("n_front_short"),
            F.count_if(~front & short).alias("n_article_short"),
        ]
    return df.agg(*out)


def fill_counters(df, columns=(C.TOTAL_INVIEWS, C.TOTAL_PAGEVIEWS), value=1) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def zero_labels(inview_col=C.INVIEW) -> Column:
    """Placeholder labels for rows whose clicks are unknown."""
    return F.transform(inview_col, lambda x: F.lit(0).cast("tinyint"))


def with_placeholders(df, inview_col=C.INVIEW, clicked_col=C.CLICKED, labels_col=C.LABELS) -> DataFrame:
    """Zero labels and the first in-view id as the click, for the unlabelled split."""
    return df.withColumns({clicked_col: F.get(inview_col, F.lit(0)), labels_col: zero_labels(inview_col)})


