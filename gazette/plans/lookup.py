"""Joining id rows to a lookup table whatever the size of the table and the skew of the ids."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A lookup table is broadcast only when its measured size is below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more rows than this is spread over several tasks.
HOT_ROWS = 2_000_000


# Types of at most 8 bytes, and those of at most 16; any other is never taken to be small.
_EIGHT_BYTES = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_FIXED = (*_EIGHT_BYTES, T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType)


def _measurable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _measurable(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _measurable(dtype.keyType) and _measurable(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return all(_measurable(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (*_FIXED, T.StringType, T.BinaryType))


def _value_bytes(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if not isinstance(inner, _EIGHT_BYTES):
            each = F.transform(value, lambda x: _value_bytes(x, inner).cast("bigint"))
            return F.coalesce(F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)) + 16
        return F.greatest(F.size(value), F.lit(0)) * 8 + 16
    if isinstance(dtype, T.MapType):
        sides = _value_bytes(F.map_keys(value), T.ArrayType(dtype.keyType)) + _value_bytes(F.map_values(value), T.ArrayType(dtype.valueType))
        return F.coalesce(sides, F.lit(0)) + 16
    if isinstance(dtype, T.StructType):
        return reduce(add, [_value_bytes(value[f.name], f.dataType) for f in dtype.fields], F.lit(16))
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Exact payload size of ``df`` in bytes: one map-side aggregate over its columns."""
    row = reduce(add, [_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    return df.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def fits_broadcast(df: DataFrame, limit: int) -> bool:
    """Whether the payload of ``df`` is at most ``limit`` bytes.

    A table with a type whose size is unknown never fits. Rows are counted first, which a stored table answers from its footers, so that a table with
    too many rows is never read to be measured.
    """
    if not _measurable(df.schema):
        return False
    return df.count() * 16 * len(df.columns) <= limit and measured_bytes(df) <= limit


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "left",
    spread: list[str] | None = None,
    broadcast_bytes: int | None = None,
    hot_rows: int | None = None,
    count_on: DataFrame | None = None,
) -> DataFrame:
    """Equi-join many rows to a table with one row per ``key``.

    * The table is measured. Below ``broadcast_bytes`` it is broadcast and the rows
      stay where they are.
    * Otherwise both sides are shuffled. Keys with more than ``hot_rows`` rows are
      counted first (map-side combined), their rows are spread over ``ceil(n / hot_rows)``
      salts taken from the ``spread`` columns, and only their lookup rows are repeated.
      Null keys match nothing and are always spread.

    Measuring costs a count and, for a small table, one pass, so give a stored or cheap one. Where it
    is itself the result of heavy work, ``broadcast_bytes=0`` skips the measurement: the join is
    planned as a shuffle, which adaptive execution still turns into a broadcast if the finished
    stage proves small. ``count_on`` names a cheaper frame with the same keys to count hot keys
    on. ``how`` is ``left``, ``inner`` or ``left_semi``.
    """
    if is_small(lookup, broadcast_bytes):
        return df.join(F.broadcast(lookup), key, how)
    return shuffled_join(df, lookup, key, how, spread, hot_rows, count_on)


def is_small(lookup: DataFrame, broadcast_bytes: int | None = None) -> bool:
    """Whether ``lookup_join`` broadcasts a table."""
    broadcast_bytes = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    return bool(broadcast_bytes and fits_broadcast(lookup, broadcast_bytes))


def shuffled_join(df, lookup, key, how="left", spread=None, hot_rows=None, count_on=None) -> DataFrame:
    """``lookup_join`` for a table that is not broadcast."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    spread = spread or [c for c in plain if c != key]
    # at most (rows / hot_rows) keys can be hot, which bounds this broadcast
    hot = (
        (df if count_on is None else count_on)
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .filter(F.col("count") > hot_rows)
        .select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("__salts"))
    )
    dice = F.xxhash64(*spread) if spread else F.lit(0).cast("bigint")
    salted = (
        df.join(F.broadcast(hot), key, "left")
        .withColumn(
            "__salt",
            F.when(F.col(key).isNull(), F.pmod(dice, F.lit(4096)))
            .when(F.col("__salts").isNotNull(), F.pmod(dice, F.col("__salts")))
            .otherwise(F.lit(0))
            .cast("int"),
        )
        .drop("__salts")
    )
    repeated = (
        lookup.join(F.broadcast(hot), key, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))))
        .drop("__salts")
    )
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")
