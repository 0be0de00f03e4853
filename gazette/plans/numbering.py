"""Dense row numbers and running totals without a single-task window."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from gazette.plans.lookup import HOT_ROWS
from gazette.plans.store import materialise

_LOCAL_BITS = 33  # layout of monotonically_increasing_id: partition number above, row number below


def _sorted_parts(df: DataFrame, order: list) -> DataFrame:
    """Range-sort ``df`` and store it with its partition number and place in it.

    The source position closes ties, so that equal keys can still be split over
    partitions. Storing fixes the partitioning for the two passes that follow.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.withColumn("__tie", F.monotonically_increasing_id())
        .orderBy(*keys, "__tie")
        .drop("__tie")
        .withColumn("__tag", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftrightunsigned("__tag", _LOCAL_BITS).cast("int"))
        .withColumn("__local", F.col("__tag").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("__tag")
    )
    return materialise(placed)


def _starts(per_part: DataFrame, value: str) -> DataFrame:
    """Exclusive running sum over one row per partition: never more rows than partitions."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("__part", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("__start"))


def row_index(df: DataFrame, order: list, name: str = "row_nr", offset: int = 0) -> DataFrame:
    """Add the 0-based (plus ``offset``) position of each row in ``order``.

    ``order`` should be total; rows that tie on it are numbered arbitrarily.
    """
    stored = _sorted_parts(df, order)
    starts = _starts(stored.groupBy("__part").agg(F.count("*").alias("__n")), "__n")
    return (
        stored.join(F.broadcast(starts), "__part")
        .withColumn(name, (F.col("__start") + F.col("__local") + offset).cast("bigint"))
        .drop("__part", "__local", "__start")
    )


def running_total(df: DataFrame, order: list, value: str, name: str, inclusive: bool = True) -> DataFrame:
    """Add the running sum of ``value`` in ``order``; exclusive leaves the current row out."""
    stored = _sorted_parts(df, order)
    starts = _starts(stored.groupBy("__part").agg(F.sum(value).alias("__n")), "__n")
    inside = Window.partitionBy("__part").orderBy("__local").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(inside)
    here = total if inclusive else total - F.col(value)
    return (
        stored.withColumn("__here", here)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__here"))
        .drop("__part", "__local", "__start", "__here")
    )


def row_position(df: DataFrame, name: str = "row_nr") -> DataFrame:
    """Add the 0-based position of each row in the order that ``df`` already has; it is stored once for that."""
    tag = F.monotonically_increasing_id()
    stored = materialise(
        df.withColumn("__tag", tag)
        .withColumn("__part", F.shiftrightunsigned("__tag", _LOCAL_BITS).cast("int"))
        .withColumn("__local", F.col("__tag").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("__tag")
    )
    starts = _starts(stored.groupBy("__part").agg(F.count("*").alias("__n")), "__n")
    placed = stored.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__local"))
    return placed.drop("__part", "__local", "__start")


def first_rows(df: DataFrame, n: int, group: list[str], order: list, hot_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, which should be total.

    A ranked window does it, and up to the session's ``windowGroupLimitThreshold`` Spark limits it on the
    map side. Beyond that, groups with more than ``hot_rows`` rows are numbered along (group, order) by
    a range sort instead, so that no task sorts such a group.
    """

    def windowed(rows):
        ranked = Window.partitionBy(*group).orderBy(*order)
        return rows.withColumn("__nr", F.row_number().over(ranked)).filter(F.col("__nr") <= n).drop("__nr")

    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return windowed(df)
    names = [f"__group_{i}" for i in range(len(group))]
    keys = [F.col(c).alias(k) for c, k in zip(group, names, strict=True)]
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, names, strict=True)])
    large = df.groupBy(*keys).count().filter(F.col("count") > (HOT_ROWS if hot_rows is None else hot_rows)).drop("count")
    if large.isEmpty():
        return windowed(df)
    hot = F.broadcast(large)  # at most rows / hot_rows groups
    numbered = row_index(df.join(hot, same, "left_semi"), [*group, *order], "__nr")
    starts = F.broadcast(numbered.groupBy(*keys).agg(F.min("__nr").alias("__first")))
    picked = numbered.join(starts, same).filter(F.col("__nr") - F.col("__first") < n).select(*df.columns)
    return windowed(df.join(hot, same, "left_anti")).unionByName(picked)


# Digests are uniform, so their leading hex digits cut the rows into even buckets.
_BUCKET_DIGITS = 4


def _bucket(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, _BUCKET_DIGITS), 16, 10).cast("int")


def digest_index(df: DataFrame, digest: Column, name: str = "row_nr", offset: int = 0) -> DataFrame:
    """Position of each row in digest order: one shuffle, nothing stored.

    Rows are numbered inside 65,536 even buckets and shifted by the bucket's start;
    the start table has at most one row per bucket. The digest must be unique per row.
    """
    marked = df.withColumn("__digest", digest).withColumn("__part", _bucket(F.col("__digest")))
    sizes = df.select(_bucket(digest).alias("__part")).groupBy("__part").agg(F.count("*").alias("__n"))
    inside = Window.partitionBy("__part").orderBy("__digest")
    return (
        marked.withColumn("__local", F.row_number().over(inside) - 1)
        .join(F.broadcast(_starts(sizes, "__n")), "__part")
        .withColumn(name, (F.col("__start") + F.col("__local") + offset).cast("bigint"))
        .drop("__digest", "__part", "__local", "__start")
    )


def digest_cut(df: DataFrame, digest: Column, n: Column) -> Column:
    """The digest of the ``n``-th row in digest order, as a scalar; null when ``n`` is 0.

    ``n`` is an expression over ``total`` (the row count). Only the bucket in which the
    cut falls is counted by digest (combined on the map side) and sorted, so an exact split or sample
    shuffles 1/65,536 of the rows. The job fails where the cut would fall between copies of one digest,
    since no digest then separates exactly ``n`` rows.
    """
    digests = df.select(digest.alias("__digest")).withColumn("__part", _bucket(F.col("__digest")))
    sizes = digests.groupBy("__part").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = (
        sizes.select(
            "__part",
            (F.sum("__n").over(upto) - F.col("__n")).alias("__before"),
            F.col("__n"),
            F.sum("__n").over(every).alias("total"),
        )
        .withColumn("__rank", n.cast("bigint") - F.col("__before"))
        .filter((F.col("__rank") >= 1) & (F.col("__rank") <= F.col("__n")))
        .select("__part", "__rank")
    )
    counted = digests.join(F.broadcast(edge), "__part").groupBy("__part", "__rank", "__digest").agg(F.count("*").alias("__n"))
    inside = Window.partitionBy("__part").orderBy("__digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    torn = F.raise_error(F.lit("the key does not identify a row: copies of one key lie on both sides of the cut"))
    return (
        counted.withColumn("__upto", F.sum("__n").over(inside))
        .filter((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__n") < F.col("__rank")))
        .agg(F.max(F.when(F.col("__upto") == F.col("__rank"), F.col("__digest")).otherwise(torn)))
        .scalar()
    )
