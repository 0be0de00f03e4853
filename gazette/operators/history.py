"""Per-user reading histories and time splits."""

import warnings

from pyspark.sql import DataFrame, Window, functions as F

from gazette import columns as C
from gazette.functions.arrays import field, tail, tail_padded
from gazette.functions.draws import digest
from gazette.operators.checks import require_columns
from gazette.plans.lookup import HOT_ROWS, lookup_join
from gazette.plans.numbering import first_rows, row_index


def truncate_history(df, column, history_size, padding_value=None, enable_warning=True) -> DataFrame:
    """Keep the last ``history_size`` elements; a padding value fills shorter lists on the left."""
    if enable_warning:
        warnings.warn("truncate_history keeps the list tail: lists must be in ascending time order", stacklevel=2)
    if padding_value is None:
        return df.withColumn(column, tail(column, history_size))
    return df.withColumn(column, tail_padded(column, history_size, padding_value))


def drop_nulls_from_list(df, column) -> DataFrame:
    return df.withColumn(column, F.array_compact(column))


def _tie(df, tie_cols):
    return list(tie_cols) if tie_cols else []


def create_dynamic_history(
    df: DataFrame,
    history_size: int,
    history_col: str = "history_dynamic",
    user_col: str = C.USER,
    item_col: str = C.ARTICLE_ID,
    timestamp_col: str = C.IMPRESSION_TIME,
    tie_cols=None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Items of the user's previous ``history_size`` rows, nulls removed after framing.

    A window per user does it, except for users with more than ``hot_rows`` rows. Their rows are
    numbered along (user, time), cut into blocks, and the last ``history_size`` rows of a block
    are copied to the next one, so that every frame is complete inside one block and no user is
    sorted in one task. ``tie_cols`` settle rows with equal times.
    """
    require_columns(df, [user_col, item_col, timestamp_col])
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    order = [timestamp_col, *_tie(df, tie_cols)]

    def framed(rows, partition, by):
        frame = Window.partitionBy(*partition).orderBy(*by).rowsBetween(-history_size, -1)
        return rows.withColumn(history_col, F.collect_list(item_col).over(frame))

    hot = df.groupBy(user_col).count().filter(F.col("count") > hot_rows).select(user_col)
    if hot.isEmpty():
        return framed(df, [user_col], order)

    # at most rows / hot_rows users
    mark = F.broadcast(hot.select(F.col(user_col).alias("__hot_user"), F.lit(True).alias("__hot")))
    marked = df.join(mark, F.col(user_col).eqNullSafe(F.col("__hot_user")), "left").drop("__hot_user")
    cold = framed(marked.filter("__hot IS NULL").drop("__hot"), [user_col], order)
    block = max(history_size, hot_rows)
    numbered = row_index(marked.filter("__hot").drop("__hot"), [user_col, *order], "__nr").withColumn(
        "__block", F.floor(F.col("__nr") / block)
    )
    copies = F.when(
        F.pmod("__nr", F.lit(block)) >= block - history_size, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    haloed = numbered.withColumn("__ahead", F.explode(copies)).withColumn("__block", F.col("__block") + F.col("__ahead"))
    warm = framed(haloed, ["__block", user_col], ["__nr"]).filter("__ahead = 0").drop("__nr", "__block", "__ahead")
    return cold.unionByName(warm)


def fixed_histories(
    df: DataFrame,
    dt_cutoff,
    history_size: int | None,
    columns: list[str],
    names: list[str],
    user_col: str = C.USER,
    item_col: str = C.ARTICLE_ID,
    timestamp_col: str = C.IMPRESSION_TIME,
    tie_cols=None,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per user: parallel lists over the rows before the cut-off, in time order.

    With a ``history_size`` the latest rows are picked by ``first_rows``: up to 1000 a heavy user sends at
    most ``history_size`` rows per task, and beyond that a user with more than ``hot_rows`` rows is ranked
    over many tasks. Without one the list is the user's whole past, as long as that is.
    """
    order = [timestamp_col, *_tie(df, tie_cols)]
    before = F.lit(dt_cutoff)
    past = df.filter(F.col(item_col).isNotNull() & (F.col(timestamp_col) < before))
    past = past.select(*dict.fromkeys([user_col, *order, *columns]))
    if history_size is not None:
        past = first_rows(past, history_size, [user_col], [F.col(c).desc() for c in order], hot_rows)
    # one struct per row: separate lists would lose nulls and fall out of step
    row = F.struct(*order, *[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)])
    lists = past.groupBy(user_col).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    return lists.select(
        user_col, *[field("__rows", f"__{i}").alias(n) for i, n in enumerate(names)]
    )


def _with_past(df, past, user_col):
    """Spread each user's list over their rows. The lists come out of the whole log, so they are
    not computed a second time to be measured."""
    return lookup_join(df, past, user_col, "left", broadcast_bytes=0, count_on=df.select(user_col))


def create_fixed_history(
    df,
    dt_cutoff,
    history_size=None,
    history_col="history_fixed",
    user_col=C.USER,
    item_col=C.ARTICLE_ID,
    timestamp_col=C.IMPRESSION_TIME,
    tie_cols=None,
) -> DataFrame:
    """Attach each user's items before the cut-off to all their rows; null without any."""
    require_columns(df, [user_col, item_col, timestamp_col])
    past = fixed_histories(
        df, dt_cutoff, history_size, [item_col], [history_col], user_col, item_col, timestamp_col, tie_cols
    )
    return _with_past(df, past, user_col).select(*df.columns, history_col)


def create_fixed_history_aggr_columns(
    df,
    dt_cutoff,
    history_size=None,
    columns=(),
    suffix="_fixed",
    user_col=C.USER,
    item_col=C.ARTICLE_ID,
    timestamp_col=C.IMPRESSION_TIME,
    tie_cols=None,
) -> DataFrame:
    """As :func:`create_fixed_history` for the item column and further parallel columns."""
    require_columns(df, [user_col, item_col, timestamp_col, *columns])
    wanted = list(dict.fromkeys([item_col, *columns]))
    names = [c + suffix for c in wanted]
    past = fixed_histories(df, dt_cutoff, history_size, wanted, names, user_col, item_col, timestamp_col, tie_cols)
    return _with_past(df, past, user_col).select(*df.columns, *names)


def down_sample_on_users(df, n, user_col=C.USER, seed=None, key=C.IMPRESSION_ID, hot_rows=None) -> DataFrame:
    """At most ``n`` rows per user, picked by digest of ``key``; ``first_rows`` says how heavy users are ranked."""
    keys = [key] if isinstance(key, str) else list(key)
    return first_rows(df, n, [user_col], [digest(seed, *keys), *keys], hot_rows)


def split_last_period(df, period="INTERVAL 1 DAY", timestamp_col=C.IMPRESSION_TIME) -> tuple[DataFrame, DataFrame]:
    """Rows earlier than ``max(time) - period``, and the rest."""
    cut = df.agg(F.max(timestamp_col)).scalar() - F.expr(period)
    return df.filter(F.col(timestamp_col) < cut), df.filter(F.col(timestamp_col) >= cut)


def split_by_date(df, days=1, timestamp_col=C.IMPRESSION_TIME) -> tuple[DataFrame, DataFrame]:
    """Rows dated before ``max(date) - days``, and the rest (the last ``days + 1`` dates)."""
    cut = F.date_sub(df.agg(F.max(F.to_date(timestamp_col))).scalar(), days)
    date = F.to_date(timestamp_col)
    return df.filter(date < cut), df.filter(date >= cut)


def history_sweep(histories, sizes, history_col=C.HISTORY_IDS, min_length=100) -> DataFrame:
    """Long histories cut to each of several sizes: one row per user and ``history_size``.

    Scoring the result by ``history_size`` evaluates all sizes in one job.
    """
    long_enough = histories.filter(F.size(history_col) >= min_length)
    each = long_enough.withColumn("history_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return each.withColumn(history_col, tail(history_col, F.col("history_size")))
