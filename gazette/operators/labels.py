"""Binary labels and model-ready example tables."""

from pyspark.sql import DataFrame, functions as F

from gazette import columns as C
from gazette.functions.arrays import binary_labels
from gazette.functions.draws import digest, shuffled
from gazette.operators.mapping import map_column, map_list_columns, unknown_vector
from gazette.operators.sampling import _seed, create_user_id_to_int_mapping
from gazette.plans.lists import as_keys
from gazette.plans.lookup import lookup_join
from gazette.plans.numbering import row_index


def create_binary_labels_column(
    df, shuffle=False, seed=None, clicked_col=C.CLICKED, inview_col=C.INVIEW, label_col=C.LABELS, key=C.IMPRESSION_ID
) -> DataFrame:
    """Add a tinyint label per in-view id; with ``shuffle`` the in-view list is permuted first."""
    if shuffle:
        df = df.withColumn(inview_col, shuffled(inview_col, _seed(seed), *as_keys(key)))
    return df.withColumn(label_col, binary_labels(inview_col, clicked_col))


def create_lookup_objects(vectors, unknown_representation="zeros") -> tuple[DataFrame, DataFrame]:
    """Number a ``(id, vector)`` table 1..n in id order.

    Returns the index table ``(id, idx)`` and the matrix table ``(idx, vector)``, whose row 0
    stands for unknown ids: zeros or the element-wise mean.
    """
    id_col, vec_col = vectors.columns[:2]
    fallback = unknown_vector(vectors, unknown_representation)
    numbered = row_index(vectors.select(id_col, vec_col), [id_col], "idx", offset=1)
    zero = vectors.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("idx"), fallback.cast(vectors.schema[vec_col].dataType).alias(vec_col)
    )
    return numbered.select(id_col, "idx"), zero.unionByName(numbered.select("idx", vec_col))


def _mapped_lists(df, mapping, histories, history_col, inview_col, unknown, key, user_col):
    """Map the in-view list and the history.

    With a ``histories`` table (one row per user) each history is mapped once and then joined to
    its user's impressions. Otherwise the history is a column of ``df`` and both lists share one
    explode, join and regroup.
    """
    if histories is None:
        return map_list_columns(df, [history_col, inview_col], mapping, unknown, key)
    shown = map_list_columns(df, [inview_col], mapping, unknown, key)
    past = histories.select(user_col, history_col)
    mapped = map_list_columns(past, [history_col], mapping, unknown, user_col)
    joined = lookup_join(shown, mapped, user_col, "left", spread=as_keys(key), broadcast_bytes=0, count_on=df.select(user_col))
    # a user without a history has one unknown item, as an empty history does
    lists = [c for c in mapped.columns if c != user_col]
    fills = unknown if isinstance(unknown, dict) else {v: unknown for v in mapping.columns[1:]}
    by_list = {history_col: mapping.columns[1]} if len(mapping.columns) == 2 else {
        f"{v}_{history_col}": v for v in mapping.columns[1:]
    }

    def single(name):
        return F.array(F.lit(fills.get(by_list[name]))).cast(mapped.schema[name].dataType)

    return joined.withColumns({c: F.coalesce(c, single(c)) for c in lists if c in by_list})


def training_examples(
    df, article_index, history_col=C.HISTORY_IDS, inview_col=C.INVIEW, key=C.IMPRESSION_ID, histories=None, user_col=C.USER
) -> DataFrame:
    """History and in-view ids as table indices, unknown ids as 0, with ``n_samples`` per row.

    Store the result to train on it more than once.
    """
    mapped = _mapped_lists(df, article_index, histories, history_col, inview_col, 0, key, user_col)
    return mapped.withColumn("n_samples", F.size(inview_col))


def evaluation_examples(
    df, article_index, history_col=C.HISTORY_IDS, inview_col=C.INVIEW, labels_col=C.LABELS, key=C.IMPRESSION_ID, histories=None, user_col=C.USER
) -> DataFrame:
    """One row per candidate: its index, label and position next to the impression's history."""
    rows = training_examples(df, article_index, history_col, inview_col, key, histories, user_col)
    return unfolded(rows, inview_col, labels_col)


def unfolded(df, inview_col=C.INVIEW, labels_col=C.LABELS) -> DataFrame:
    """One row per in-view element with its label; all other columns ride along."""
    rest = [c for c in df.columns if c not in (inview_col, labels_col)]
    pair = F.arrays_zip(F.col(inview_col).alias("candidate"), F.col(labels_col).alias("label"))
    exploded = df.select(*rest, F.posexplode(pair).alias("pos", "__pair"))
    return exploded.select(*rest, "pos", F.col("__pair.candidate").alias(inview_col), F.col("__pair.label").alias(labels_col))


def with_user_index(df, user_index=None, known_users=None, user_col=C.USER, out="user_index") -> DataFrame:
    """Add the user's number; known users start at 1 and 0 means unknown."""
    if user_index is None:
        user_index = create_user_id_to_int_mapping(df if known_users is None else known_users, user_col, "idx", offset=1)
    return map_column(df, user_col, user_index, default=0, out=out)


def attribute_examples(
    df, articles, history_col=C.HISTORY_IDS, inview_col=C.INVIEW, labels_col=C.LABELS, unknown=None, key=C.IMPRESSION_ID, eval_mode=False, histories=None, user_col=C.USER
) -> DataFrame:
    """Map history and in-view ids to every attribute of ``articles`` (id first).

    All attributes come from one join per list. ``unknown`` gives a fill per attribute. The new
    lists are named ``<attribute>_history`` and ``<attribute>_inview``.
    """
    attributes = articles.columns[1:]
    names = {history_col: "history", inview_col: "inview"}
    past = None if histories is None else histories.withColumnsRenamed(names)
    wide = _mapped_lists(df.withColumnsRenamed(names), articles, past, "history", "inview", unknown or {}, key, user_col)
    if len(attributes) == 1:
        wide = wide.withColumnsRenamed({c: f"{attributes[0]}_{c}" for c in ("history", "inview")})
    else:
        wide = wide.drop("history", "inview")
    if not eval_mode:
        return wide
    lists = [f"{a}_inview" for a in attributes]
    rest = [c for c in wide.columns if c not in (*lists, labels_col)]
    zipped = F.arrays_zip(*lists, labels_col)
    return wide.select(*rest, F.posexplode(zipped).alias("pos", "__z")).select(*rest, "pos", "__z.*")


def pointwise_examples(
    df, article_index, history_col=C.HISTORY_IDS, inview_col=C.INVIEW, labels_col=C.LABELS, seed=None, key=C.IMPRESSION_ID, histories=None, user_col=C.USER
) -> DataFrame:
    """One row per candidate with impressions in shuffled order (``order`` is the sort key)."""
    rows = evaluation_examples(df, article_index, history_col, inview_col, labels_col, key, histories, user_col)
    return rows.withColumn("order", digest(_seed(seed), *as_keys(key)))
