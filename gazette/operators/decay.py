"""Weighting history vectors by their age."""

from pyspark.sql import DataFrame, functions as F

from gazette.functions.arrays import exponential_decay_weights, linear_decay_weights, weighted_vectors


def add_decay_weights(df, column, decay_func=linear_decay_weights, ascending=True, **kwargs) -> DataFrame:
    """Add ``<column>_weights``, one weight per list element; a null list gives an empty list.

    ``decay_func`` takes a length column and ``ascending`` and returns a column of weights.
    """
    n = F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0))
    return df.withColumn(f"{column}_weights", decay_func(n, ascending=ascending, **kwargs))


def decay_weighting_nested_lists(df, column_history, column_history_weights) -> DataFrame:
    """Multiply each inner vector by its weight; a null vector becomes ``[null]``, a null list stays null."""
    return df.withColumn(column_history, weighted_vectors(column_history, column_history_weights))


__all__ = ["add_decay_weights", "decay_weighting_nested_lists", "exponential_decay_weights", "linear_decay_weights"]
