"""Beyond-accuracy metrics of recommendation lists.

Lists are rows ``(list_id, items)`` with an array of ids; the item table has one row per id.
Ids missing from the item table are dropped first (coverage apart). Lists are exploded, joined
to the item table once and folded back with map-side partial aggregates.
"""

from functools import reduce
from operator import or_

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from gazette import columns as C
from gazette.functions.arrays import array_sum, dot, is_udf, norm, resolve_distance, with_each
from gazette.functions.draws import distinct_draws
from gazette.operators.checks import require_columns
from gazette.operators.extremes import diversity_bounds
from gazette.plans.lists import as_keys
from gazette.plans.lookup import is_small, lookup_join, shuffled_join
from gazette.plans.numbering import row_index
from gazette.plans.store import materialise

NAN = float("nan")


def _listed(lists, table, columns, list_id, items_col, item_col, **join_options):
    """One row per listed item with its looked-up columns, null where the item is unknown.

    A list without items keeps one such row, so a fold by list has every list and none is joined back.
    """
    keys = as_keys(list_id)
    rows = lists.select(*keys, F.posexplode_outer(items_col).alias("pos", item_col))
    return lookup_join(rows, table.select(item_col, *columns), item_col, "left", spread=[*keys, "pos"], **join_options)


def _or_nan(value):
    return F.coalesce(value, F.lit(NAN))


def _unit_items(items, vector_col, item_col, *extra):
    """Item id, its vector ``__v`` as given, the length ``__len`` to divide it by and the squared length ``__sq`` of
    the quotient; all null without a vector. A zero vector stays as it is."""
    length = norm(F.col(vector_col).cast("array<double>"))
    table = items.select(item_col, F.col(vector_col).alias("__v"), F.when(length == 0, F.lit(1.0)).otherwise(length).alias("__len"), *extra)
    return table.withColumn("__sq", dot(_unit(), _unit()))


def _unit():
    return with_each("__v", F.col("__len"), lambda x, length: x.cast("double") / length)


def _unit_rows(lists, table, columns, keys, items_col, item_col, broadcast_bytes=None, hot_rows=None, count_on=None):
    """The rows of ``_listed``, all rows of a list in one partition, where sums of vectors are as many as lists.

    Lines of one list seldom lie in one task before a shuffle, so sums hardly combine there, and each is as wide as a
    vector of doubles. So vectors travel as given, once per known item, and are added up behind. Spark joins partitions
    by the bytes they read, which tell nothing of the sums: a number of its own, twice the session's, keeps them small.
    """
    n = 2 * int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists, table = lists.select(*keys, items_col), table.select(item_col, *columns)
    place = F.posexplode_outer(items_col).alias("pos", item_col)
    small = is_small(table, broadcast_bytes)
    if small:
        joined = lists.repartition(n, *keys).select(*keys, place).join(F.broadcast(table), item_col, "left")
    else:
        joined = shuffled_join(lists.select(*keys, place), table, item_col, "left", [*keys, "pos"], hot_rows, count_on)
    # an item that tells nothing only has to name its list, for which the first one does
    told = reduce(or_, [F.col(c).isNotNull() for c in columns])
    rows = joined.filter(told | (F.coalesce("pos", F.lit(0)) == 0)).drop(item_col)
    return rows if small else rows.repartition(n, *keys)


# Vectors of up to this many components are summed place by place in generated code, which took a third of
# the time of the summarizer; beyond it Spark generates no code for so many sums.
_PLACES = 96


def _vector_sums(items, vector_col):
    """Aggregates that add up the unit vectors by list, unknown items left out, and the sum as one list made of them."""
    width = items.agg(F.max(F.size(vector_col))).first()[0] or 0
    none = F.array().cast("array<double>")
    if width <= _PLACES:
        sums = [F.sum(F.col("__v")[k].cast("double") / F.col("__len")).alias(f"__s{k}") for k in range(width)]
        return sums, F.array(*[F.coalesce(f"__s{k}", F.lit(0.0)) for k in range(width)]) if width else none
    # the summarizer takes no nulls and no empty group, but passes rows of weight 0 by before it looks at
    # them: unknown items weigh nothing, and the first place of a list adds zeros instead
    known, first = F.col("__v").isNotNull(), F.coalesce(F.col("pos") == 0, F.lit(True))
    vector = F.when(known, _unit()).when(first, F.array_repeat(F.lit(0.0), width)).otherwise(none)
    total = Summarizer.sum(array_to_vector(vector), F.when(known | first, F.lit(1.0)).otherwise(F.lit(0.0)))
    return [vector_to_array(total).alias("__s")], F.col("__s")


def _folded_units(lists, items, vector_col, list_id, items_col, item_col, **join_options):
    """Per list: known items ``n``, the sum ``s`` of their unit vectors and the sum ``sq`` of its squared lengths."""
    keys = as_keys(list_id)
    rows = _unit_rows(lists, _unit_items(items, vector_col, item_col), ["__v", "__len", "__sq"], keys, items_col, item_col, **join_options)
    sums, total = _vector_sums(items, vector_col)
    folded = rows.groupBy(*keys).agg(F.count("__sq").alias("n"), F.coalesce(F.sum("__sq"), F.lit(0.0)).alias("sq"), *sums)
    return folded.select(*keys, "n", "sq", total.alias("s"))


def _folded_vectors(lists, items, vector_col, list_id, items_col, item_col, **join_options):
    """Per list: the vectors ``vs`` of its known items."""
    table = items.select(item_col, F.col(vector_col).cast("array<double>").alias("__v"))
    rows = _listed(lists, table, ["__v"], list_id, items_col, item_col, **join_options)
    return rows.groupBy(*as_keys(list_id)).agg(F.collect_list("__v").alias("vs"))


def _with_total(df, keys, left, right, distance):
    """``df`` with ``total``: the distances between all vectors of two of its list columns, added up.

    Column functions run inside the row. A Python UDF cannot, so for one the pairs of each row are
    unfolded for the call and added up again; its lists should be recommendation lists, not catalogues.
    """
    measure = resolve_distance(distance)
    if not is_udf(distance):
        total = F.transform(left, lambda a: array_sum(F.transform(right, lambda b: measure(a, b))))
        return df.withColumn("total", array_sum(total))
    pairs = df.select(*keys, right, F.explode(left).alias("__a")).select(*keys, "__a", F.explode(right).alias("__b"))
    measured = pairs.select(*keys, measure(F.col("__a"), F.col("__b")).cast("double").alias("__d"))
    return df.join(measured.groupBy(*keys).agg(F.sum("__d").alias("total")), keys, "left")


def intralist_diversity(
    lists, items, vector_col, list_id="list_id", items_col="items", item_col=C.ARTICLE_ID, distance="cosine", name="diversity", **join_options
) -> DataFrame:
    """Mean pairwise distance inside each list; NaN below two known items.

    For cosine, the sum over pairs of unit vectors is ``n^2 - |sum|^2`` less the diagonal, so one
    vector sum per list is enough and no pair is formed. Other distances compare the vectors
    inside the list's own row.
    """
    require_columns(items, [vector_col])
    keys = as_keys(list_id)
    if distance == "cosine":
        folded = _folded_units(lists, items, vector_col, list_id, items_col, item_col, **join_options)
        total = _cosine_total()
    else:
        vectors = _folded_vectors(lists, items, vector_col, list_id, items_col, item_col, **join_options)
        folded = _with_total(vectors, keys, "vs", "vs", distance).withColumn("n", F.size("vs"))
        total = F.col("total")
    return folded.select(*keys, _mean_of_pairs(total).alias(name))


def _cosine_total():
    """Distances between all ordered pairs of a list's unit vectors, from their sum."""
    n = F.col("n").cast("double")
    # a zero vector is at distance 1 from all others and 0 from itself
    return F.greatest((n * n - dot("s", "s")) - (n - F.col("sq")), F.lit(0.0))


def _mean_of_pairs(total):
    n = F.col("n").cast("double")
    return _or_nan(F.when(n > 1, F.try_divide(total, n * (n - 1))))


def serendipity(
    lists, histories, items, vector_col, list_id="list_id", items_col="items", history_col="history", item_col=C.ARTICLE_ID,
    distance="cosine", name="serendipity", history_key=None, **join_options
) -> DataFrame:
    """Mean distance between the items of a list and of its history; NaN if either is empty or missing.

    ``histories`` is keyed like ``lists``, or by ``history_key``, columns of both (the user, say): then
    a history is read and folded once, however many lists refer to it. For cosine the mean is one minus
    the dot product of the two mean unit vectors, so each side is summed once and no pair is formed.
    """
    keys = as_keys(list_id)
    shared = as_keys(history_key) if history_key else keys
    fold = _folded_units if distance == "cosine" else _folded_vectors
    here = fold(lists, items, vector_col, [*keys, *(c for c in shared if c not in keys)], items_col, item_col, **join_options)
    past = fold(histories, items, vector_col, shared, history_col, item_col, **join_options)
    past = past.select(*shared, *[F.col(c).alias(f"past_{c}") for c in past.columns if c not in shared])
    if history_key:
        owner = F.struct(*shared).alias("__owner")
        past = past.select(owner, *[c for c in past.columns if c not in shared])
        # folded histories come out of a join of their own: shuffle them rather than compute them twice
        options = {**join_options, "broadcast_bytes": 0, "count_on": lists.select(owner)}
        both = lookup_join(here.withColumn("__owner", owner), past, "__owner", "left", spread=keys, **options)
    else:
        both = here.join(past, keys, "left")
    if distance == "cosine":
        score = 1 - F.try_divide(dot("s", "past_s"), F.col("n") * F.col("past_n"))
    else:
        both = _with_total(both, keys, "vs", "past_vs", distance)
        score = F.try_divide(F.col("total"), (F.size("vs") * F.size("past_vs")).cast("double"))
    return both.select(*keys, _or_nan(score).alias(name))


def unmatched_lists(lists, histories, list_id="list_id") -> DataFrame:
    """Keys present on one side only, for callers who need the two sides to match."""
    keys = as_keys(list_id)
    a = lists.select(*keys, F.lit(True).alias("__r"))
    b = histories.select(*keys, F.lit(True).alias("__h"))
    both = a.join(b, keys, "full")
    return both.filter("__r IS NULL OR __h IS NULL").select(*keys, F.col("__r").isNotNull().alias("has_list"))


def _mean_over(lists, items, value, list_id, items_col, item_col, name, **join_options):
    rows = _listed(lists, items.select(item_col, value.alias("__x")), ["__x"], list_id, items_col, item_col, **join_options)
    return rows.groupBy(*as_keys(list_id)).agg(_or_nan(F.avg("__x")).alias(name))


def sentiment(lists, items, score_col=C.SENTIMENT_SCORE, list_id="list_id", items_col="items", item_col=C.ARTICLE_ID, name="sentiment", **join_options) -> DataFrame:
    """Mean attribute per list."""
    return _mean_over(lists, items, F.col(score_col), list_id, items_col, item_col, name, **join_options)


def self_information(popularity_col):
    """``-log2(p)``; infinite at 0, where Spark's log2 is null."""
    p = F.col(popularity_col).cast("double")
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log2(p))


def novelty(lists, items, popularity_col, list_id="list_id", items_col="items", item_col=C.ARTICLE_ID, name="novelty", **join_options) -> DataFrame:
    """Mean self-information of the popularity scores per list."""
    return _mean_over(lists, items, self_information(popularity_col), list_id, items_col, item_col, name, **join_options)


def distribution(lists, items, attribute, items_col="items", item_col=C.ARTICLE_ID, group=(), **join_options) -> DataFrame:
    """Share of each attribute value over all listed items (list attributes flattened).

    With ``group`` columns of ``lists`` (a list name, say) shares are taken per group.
    """
    groups = list(group)
    table = items.select(item_col, F.col(attribute).alias("__a"))
    rows = lists.select(*groups, F.explode(items_col).alias(item_col))
    # count ids before the join: far fewer rows than listed items
    counted = rows.groupBy(*groups, item_col).agg(F.count("*").alias("__n"))
    joined = lookup_join(counted, table, item_col, "inner", spread=groups or None, **join_options)
    if isinstance(items.schema[attribute].dataType, T.ArrayType):
        joined = joined.select(*groups, "__n", F.explode("__a").alias("__a"))
    counts = joined.groupBy(*groups, F.col("__a").alias("value")).agg(F.sum("__n").alias("n"))
    if not groups:
        return counts.select("value", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("total"))
    return counts.join(totals, groups).select(*groups, "value", (F.col("n") / F.col("total")).alias("share"))


def distribution_table(shares, name_col, values=None) -> DataFrame:
    """One row per name and one column per value; a value missing from a name is null."""
    return shares.groupBy(name_col).pivot("value", values).agg(F.first("share"))


def coverage(lists, candidates=None, items_col="items", item_col=C.ARTICLE_ID) -> DataFrame:
    """Distinct listed items, alone and as a share of the distinct candidates (-inf without any)."""
    out = lists.select(F.explode(items_col).alias("i")).agg(F.count_distinct("i").alias("coverage_count"))
    if candidates is None:
        return out.withColumn("coverage_fraction", F.lit(float("-inf")))
    n = candidates.agg(F.count_distinct(item_col)).scalar()
    share = F.when(n > 0, F.try_divide(F.col("coverage_count").cast("double"), n)).otherwise(F.lit(float("-inf")))
    return out.withColumn("coverage_fraction", share)


def item_popularity(lists, items_col="items", item_col="item") -> DataFrame:
    """Occurrences of each item divided by the number of lists."""
    counts = lists.select(F.explode(items_col).alias(item_col)).groupBy(item_col).count()
    return counts.select(item_col, (F.col("count") / lists.agg(F.count("*")).scalar()).alias("popularity"))


def normalized_distribution(df, value_col, weight_col=None, prior=None) -> DataFrame:
    """Sum of weights per value (1/n by default), added to a ``(value, share)`` prior when given."""
    if weight_col:
        out = df.groupBy(F.col(value_col).alias("value")).agg(F.sum(weight_col).alias("share"))
    else:
        counts = df.groupBy(F.col(value_col).alias("value")).count()
        out = counts.select("value", (F.col("count") / counts.agg(F.sum("count")).scalar()).alias("share"))
    if prior is None:
        return out
    return out.unionByName(prior.select("value", "share")).groupBy("value").agg(F.sum("share").alias("share"))


def index_of_dispersion(df, column, group=()) -> DataFrame:
    """``k (N^2 - sum f^2) / (N^2 (k - 1))`` over category counts; one category: NaN if N is 1, else 0."""
    groups = list(group)
    counts = df.groupBy(*groups, column).agg(F.count("*").cast("double").alias("f"))
    stats = counts.groupBy(*groups).agg(
        F.count("*").alias("k"), F.sum("f").alias("N"), F.sum(F.col("f") * F.col("f")).alias("ff")
    )
    k, n, ff = F.col("k"), F.col("N"), F.col("ff")
    value = (
        F.when(k > 1, F.try_divide(k * (n * n - ff), n * n * (k - 1)))
        .when(n == 1, F.lit(NAN))
        .otherwise(F.lit(0.0))
    )
    return stats.select(*groups, value.alias("dispersion"))


# --- bounds over a candidate list ----------------------------------------------------------


def candidate_diversity(
    candidates, items, vector_col, n, item_col=C.ARTICLE_ID, distance="cosine", method="exact", n_samples=20000, seed=None, **join_options
) -> DataFrame:
    """Lowest and highest diversity of ``n`` candidates; candidates without a vector take no part.

    ``exact`` gives the bounds over all combinations by branch and bound (``operators.extremes``); ``sampled`` draws
    ``n_samples`` random subsets and gives bounds over those. Which one runs never depends on the size of
    the input. Below two candidates a list has no diversity, and the bounds are NaN.
    """
    if method not in ("exact", "sampled"):
        raise ValueError(f"method is exact or sampled, not {method}")
    known = candidates.select(item_col).join(items.filter(F.col(vector_col).isNotNull()).select(item_col, vector_col), item_col)
    total = known.count()
    if n > total:
        raise ValueError(f"cannot recommend {n} of {total} candidates")
    spark = candidates.sparkSession
    if method == "exact":
        low, high = diversity_bounds(known, vector_col, n, [item_col], distance) if n > 1 else (NAN, NAN)
        return spark.range(1).select(F.lit(low).alias("min_diversity"), F.lit(high).alias("max_diversity"))
    indexed = row_index(known.select(item_col), [item_col], "__nr")
    picks = spark.range(n_samples).select(F.col("id").alias("list_id"), distinct_draws(total, n, seed, "id").alias("picks"))
    rows = picks.select("list_id", F.posexplode("picks").alias("pos", "__nr")).withColumn("__nr", F.col("__nr").cast("bigint"))
    named = lookup_join(rows, indexed, "__nr", "inner", spread=["list_id"])
    lists = named.groupBy("list_id").agg(F.collect_list(item_col).alias("items"))
    scores = intralist_diversity(lists, items, vector_col, item_col=item_col, distance=distance, **join_options)
    nan = F.max(F.isnan("diversity"))
    return scores.agg(
        F.when(nan, F.lit(NAN)).otherwise(F.min("diversity")).alias("min_diversity"),
        F.when(nan, F.lit(NAN)).otherwise(F.max("diversity")).alias("max_diversity"),
    )


def _extremes(candidates, items, value, n, item_col, names):
    rows = candidates.select(item_col).join(items.select(item_col, value.alias("__x")), item_col)
    low = rows.orderBy(F.col("__x").asc(), item_col).limit(n).agg(F.avg("__x").alias(names[1]))
    high = rows.orderBy(F.col("__x").desc(), item_col).limit(n).agg(F.avg("__x").alias(names[0]))
    return high.withColumn(names[1], low.scalar())


def candidate_sentiment(candidates, items, n, score_col=C.SENTIMENT_SCORE, item_col=C.ARTICLE_ID) -> DataFrame:
    """Mean attribute of the ``n`` highest and of the ``n`` lowest candidates."""
    return _extremes(candidates, items, F.col(score_col), n, item_col, ("mean_n_highest", "mean_n_lowest"))


def candidate_novelty(candidates, items, n, popularity_col, item_col=C.ARTICLE_ID) -> DataFrame:
    """Novelty of the ``n`` most popular candidates (the minimum) and of the ``n`` least popular."""
    table = items.select(item_col, self_information(popularity_col).alias("__i"))
    return _extremes(candidates, table, F.col("__i"), n, item_col, ("max_novelty", "min_novelty"))


# --- tables --------------------------------------------------------------------------------


def mean_std(df, value, group=()) -> DataFrame:
    """Mean and population standard deviation; NaN values propagate."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


METRICS = ("diversity", "sentiment", "novelty", "serendipity")


def _attribute_values(items, attributes):
    """All (attribute, value) pairs of an item as one array; the values of list attributes side by side."""

    def pairs(name):
        def pair(v):
            return F.struct(F.lit(name).alias("attribute"), v.cast("string").alias("value"))

        if isinstance(items.schema[name].dataType, T.ArrayType):
            return F.coalesce(F.transform(name, pair), F.array().cast("array<struct<attribute:string,value:string>>"))
        return F.array(pair(F.col(name)))

    parts = [pairs(name) for name in attributes]
    return F.concat(*parts) if parts else F.array().cast("array<struct<attribute:string,value:string>>")


def scored_lists(
    lists, items, vector_col, sentiment_col, popularity_col, keys, items_col="items", item_col=C.ARTICLE_ID, **join_options
) -> DataFrame:
    """Every list with all that its items tell: ``keys``, ``diversity``, ``sentiment``, ``novelty``, ``n``, ``s``.

    The lists are exploded and joined to the items once, and one fold gives every metric side by side. ``n`` and ``s`` are
    the number and the sum of the unit vectors.
    """
    require_columns(items, [vector_col, sentiment_col, popularity_col])
    extra = [F.col(sentiment_col).alias("__feeling"), self_information(popularity_col).alias("__i")]
    table = _unit_items(items, vector_col, item_col, *extra)
    rows = _unit_rows(lists, table, ["__v", "__len", "__sq", "__feeling", "__i"], keys, items_col, item_col, **join_options)
    sums, total = _vector_sums(items, vector_col)
    folded = rows.groupBy(*keys).agg(
        F.count("__sq").alias("n"),
        F.coalesce(F.sum("__sq"), F.lit(0.0)).alias("sq"),
        *sums,
        _or_nan(F.avg("__feeling")).alias("sentiment"),
        _or_nan(F.avg("__i")).alias("novelty"),
    )
    summed = folded.withColumn("s", total)
    return summed.select(*keys, _mean_of_pairs(_cosine_total()).alias("diversity"), "sentiment", "novelty", "n", "s")


def _with_serendipity(scored, past, name_col, user_col, shared_col) -> DataFrame:
    """A row per list and user: a list of its own meets its user's history, a shared one every history.

    Shared lists are few and short: they ride along with every history as one array.
    """
    known = past.select(F.col(user_col).alias("__user"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    own = scored.filter(~F.col(shared_col)).join(known, F.col(user_col) == F.col("__user"), "left").drop("__user")
    columns = [name_col, "diversity", "sentiment", "novelty", "n", "s"]
    together = scored.filter(shared_col).agg(F.collect_list(F.struct(*columns))).scalar()
    shared = past.select(user_col, F.col("n").alias("hn"), F.col("s").alias("hs"), F.explode(together).alias("__r"))
    both = own.select(user_col, *columns, "hn", "hs").unionByName(shared.select(user_col, "__r.*", "hn", "hs"))
    score = 1 - F.try_divide(dot("s", "hs"), F.col("n") * F.col("hn"))
    return both.select(name_col, user_col, "diversity", "sentiment", "novelty", _or_nan(score).alias("serendipity"))


def _by_groups(df, segments, keys, aggregates) -> DataFrame:
    """``aggregates`` over all rows and by each segment, in one pass: ``keys, segment, segment_value``, results."""
    sets = [[*keys], *[[*keys, s] for s in segments]]
    out = df.groupingSets(sets, *keys, *segments).agg(*[F.grouping(s).alias(f"__g_{s}") for s in segments], *aggregates)
    segment, value = F.lit("all"), F.lit(None).cast("string")
    for s in segments:
        segment = F.when(F.col(f"__g_{s}") == 0, F.lit(s)).otherwise(segment)
        value = F.when(F.col(f"__g_{s}") == 0, F.col(s).cast("string")).otherwise(value)
    names = [c for c in out.columns if c not in {*keys, *segments} and not c.startswith("__g_")]
    return out.select(*keys, segment.alias("segment"), value.alias("segment_value"), *names)


def _shares(shown, items, attributes, segments, name_col, user_col, shared_col, item_col, **join_options) -> DataFrame:
    """The share of each attribute value among the listed items, whole and by segment.

    Attribute values are few, so listed items meet theirs before anything is counted: counts then combine on the map
    side, which counts of ids by all segments hardly do.
    """
    told = items.select(item_col, _attribute_values(items, attributes).alias("__values")).join(_copies(items, item_col), item_col)
    valued = lookup_join(shown, told, item_col, "inner", spread=[name_col, user_col, *segments], **join_options)
    counted = valued.select(name_col, shared_col, *segments, "__copies", F.inline("__values"))
    counted = counted.groupBy(name_col, shared_col, *segments, "attribute", "value").agg(F.sum("__copies").alias("n"))
    grouped = _by_groups(counted, segments, [name_col, shared_col, "attribute", "value"], [F.sum("n").alias("n")])
    grouped = grouped.filter(~F.col(shared_col) | (F.col("segment") == "all")).drop(shared_col)
    place = [name_col, "segment", "segment_value", "attribute"]
    totals = grouped.groupBy(*place).agg(F.sum("n").alias("total"))
    here = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place]
    shares = grouped.alias("a").join(totals.alias("b"), here)
    return shares.select(*[f"a.{c}" for c in place], "value", (F.col("n") / F.col("total")).alias("share"))


def _copies(items, item_col) -> DataFrame:
    """How often the item table repeats an id: a repeated item counts that often wherever it meets the table."""
    return items.groupBy(item_col).agg(F.count("*").alias("__copies"))


def _covered(shown, items, segments, name_col, shared_col, item_col) -> DataFrame:
    """Distinct listed items ``n_items`` and listed items ``total``, whole and by segment.

    Ids are counted by all segments first, so an id has few rows however often it is listed, and these meet in one task.
    """
    counted = shown.groupBy(name_col, shared_col, *segments, item_col).agg(F.count("*").alias("n"))
    counted = counted.repartition(item_col).join(_copies(items, item_col), item_col, "left")
    # listed items meet the table twice, for what they tell and for their attributes
    copies = F.coalesce("__copies", F.lit(1))
    whole = F.struct(F.lit("all").alias("segment"), F.lit(None).cast("string").alias("segment_value"))
    by_segment = [F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("segment_value")) for s in segments]
    places = F.when(~F.col(shared_col), F.array(whole, *by_segment)).otherwise(F.array(whole))
    spread = counted.select(name_col, shared_col, item_col, (F.col("n") * copies * copies).alias("n"), F.inline(places))
    each = spread.groupBy(item_col, name_col, shared_col, "segment", "segment_value").agg(F.sum("n").alias("n"))
    return each.groupBy(name_col, "segment", "segment_value").agg(F.count("*").alias("n_items"), F.sum("n").alias("total"))


def beyond_accuracy_report(
    lists, items, histories, vector_col, sentiment_col, popularity_col, attributes=(), users=None, segments=(), user_col=C.USER,
    name_col="list_name", list_id="list_id", items_col="items", history_col="history", item_col=C.ARTICLE_ID, shared_col="is_shared",
    candidates=None, **join_options,
) -> tuple[DataFrame, DataFrame]:
    """All beyond-accuracy metrics and distributions of named sets of lists, whole and by user segment.

    ``lists`` rows are ``(list_name, list_id, user, items, is_shared)``, ``histories`` rows ``(user, history)`` and ``users`` one
    row per user with the ``segments`` columns. Returns two tables:

    * ``list_name, segment, segment_value, metric, mean, std, n`` for diversity, sentiment, novelty, serendipity, and the
      coverage as a count and, given ``candidates``, as a fraction of these. Means leave out undefined values; ``n``
      counts the others. A shared list is set against every history, so it counts once per user with one.
    * ``list_name, segment, segment_value, attribute, value, share`` for each of ``attributes``. A shared list
      is the same in all segments and given as a whole only, here and for coverage.

    ``segment`` is ``all`` for the whole. The lists are stored once as they are, and every table reads these: the metrics
    fold them by list, the others count ids by segment, so a table that is not used costs nothing.
    """
    keys = list(dict.fromkeys([name_col, list_id, user_col, shared_col]))
    segments = list(segments)
    lists = materialise(lists.select(*keys, items_col))
    scored = scored_lists(lists, items, vector_col, sentiment_col, popularity_col, keys, items_col, item_col, **join_options)
    past = _folded_units(histories, items, vector_col, user_col, history_col, item_col, **join_options)
    scores = _with_serendipity(scored, past, name_col, user_col, shared_col)
    listed = lists.select(name_col, user_col, shared_col, items_col)
    if segments:
        known = users.select(user_col, *segments)
        scores = lookup_join(scores, known, user_col, "left", spread=[name_col], count_on=lists)
        listed = lookup_join(listed, known, user_col, "left", spread=[name_col])

    defined = {m: F.nanvl(m, F.lit(None)) for m in METRICS}
    cells = [F.struct(F.lit(m).alias("metric"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n")) for m, x in defined.items()]
    metrics = _by_groups(scores, segments, [name_col], [F.array(*cells).alias("__m")])
    metrics = metrics.select(name_col, "segment", "segment_value", F.inline("__m"))

    shown = listed.select(name_col, user_col, shared_col, *segments, F.explode(items_col).alias(item_col)).filter(F.col(item_col).isNotNull())
    shares = _shares(shown, items, attributes, segments, name_col, user_col, shared_col, item_col, **join_options)
    totals = _covered(shown, items, segments, name_col, shared_col, item_col)

    none, count = F.lit(None).cast("double"), F.col("n_items").cast("double")
    covered = [F.struct(F.lit("coverage_count").alias("metric"), count.alias("mean"), none.alias("std"), F.col("total").alias("n"))]
    if candidates is not None:
        fraction = F.try_divide(count, candidates.agg(F.count_distinct(item_col)).scalar())
        covered.append(F.struct(F.lit("coverage_fraction").alias("metric"), fraction.alias("mean"), none.alias("std"), F.col("total").alias("n")))
    coverage_rows = totals.select(name_col, "segment", "segment_value", F.inline(F.array(*covered)))
    return metrics.unionByName(coverage_rows), shares


def beyond_accuracy_table(
    lists, items, histories, vector_col, sentiment_col, popularity_col, name_col="list_name", list_id="list_id", items_col="items", item_col=C.ARTICLE_ID, candidates=None
) -> DataFrame:
    """Long ``(list_name, metric, mean, std)`` table for named sets of lists, without segments.

    ``lists`` rows are ``(list_name, list_id, items, is_shared)`` and ``histories`` rows
    ``(list_id, history)``. A shared list is set against every history for serendipity, any
    other one against the history of its own ``list_id``.
    """
    metrics, _ = beyond_accuracy_report(
        lists, materialise(items), histories, vector_col, sentiment_col, popularity_col, user_col=list_id, name_col=name_col,
        list_id=list_id, items_col=items_col, item_col=item_col, candidates=candidates,
    )
    return metrics.select(name_col, "metric", "mean", "std")


def item_table(articles, histories, candidates, vectors, pageviews_col=C.TOTAL_PAGEVIEWS, item_col=C.ARTICLE_ID, history_col=C.HISTORY_IDS) -> DataFrame:
    """Catalogue rows needed for evaluation: candidates and history items, counters filled with 1,
    popularity normalised two ways, vectors joined."""
    needed = candidates.select(item_col).unionByName(histories.select(F.explode(history_col).alias(item_col))).distinct()
    kept = articles.join(needed, item_col, "left_semi").fillna(
        1, subset=[c for c in (C.TOTAL_INVIEWS, C.TOTAL_PAGEVIEWS) if c in articles.columns]
    )
    x = F.col(pageviews_col)
    bounds = kept.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    low, high = bounds["lo"], bounds["hi"]
    # fixed values: the min-max form maps to [0.0001, 1], so its logarithm is finite
    small, large = 1e-4, 1.0
    scaled = F.coalesce(F.try_divide((x - low).cast("double"), high - low), F.lit(0.0)) * (large - small) + small
    normalised = kept.withColumns(
        {
            f"{pageviews_col}_normalized_max": F.try_divide(x.cast("double"), high),
            f"{pageviews_col}_normalized_min_max": scaled,
        }
    )
    return normalised.join(vectors, item_col, "left")


def by_segment(scores, segments, value, segment_col, on) -> DataFrame:
    """Mean of a per-list value per user segment."""
    joined = lookup_join(scores, segments.select(on, segment_col), on, "inner")
    return joined.groupBy(segment_col).agg(F.avg(value).alias(value), F.count("*").alias("n"))
