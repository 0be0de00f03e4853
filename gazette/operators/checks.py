"""Schema and data checks, renaming, flattening."""

from pyspark.sql import Column, DataFrame, functions as F, types as T


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def equal_list_lengths(column1: str, column2: str) -> Column:
    """True where both lists have the same length (two nulls count as equal)."""
    return F.size(column1).eqNullSafe(F.size(column2))


def validate_equal_list_column_lengths(df: DataFrame, column1: str, column2: str) -> None:
    """Raise when any row holds lists of different length."""
    if not df.filter(~equal_list_lengths(column1, column2)).isEmpty():
        raise ValueError(f"lists in {column1!r} and {column2!r} differ in length")


def rename_columns(df: DataFrame, map_dict: dict[str, str]) -> DataFrame:
    """Rename the columns that exist; other entries are ignored."""
    return df.withColumnsRenamed(map_dict)


def missing_attributes(items: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per attribute with the number of items that lack it."""
    counts = items.agg(
        F.map_from_arrays(
            F.array(*[F.lit(a) for a in attributes]), F.array(*[F.count_if(F.col(a).isNull()) for a in attributes])
        ).alias("m")
    )
    return counts.select(F.explode("m").alias("attribute", "n_missing"))


def require_attribute(items: DataFrame, attribute: str, item_col: str) -> None:
    """Raise naming an item that lacks ``attribute``."""
    require_columns(items, [attribute])
    lacking = items.filter(F.col(attribute).isNull()).select(item_col).first()
    if lacking:
        raise ValueError(f"item {lacking[0]!r} has no {attribute!r}")


def flatten_struct(df: DataFrame, separator: str = "-") -> DataFrame:
    """Flatten nested structs to top-level columns named ``child-parent``."""

    def leaves(fields, path, suffix):
        for f in fields:
            name = f"{f.name}{separator}{suffix}" if suffix else f.name
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, here, name)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(name)

    return df.select(*leaves(df.schema.fields, [], ""))
