"""Reproducible randomness: digests of (seed, row key, place) stand in for a generator.

A digest depends on data alone, so a draw is the same for any partitioning and when a task
is run again.
"""

from pyspark.sql import Column, functions as F

from gazette.functions.arrays import col, field, named, with_each


def digest(seed, *parts) -> Column:
    """md5 over ``seed:part:part...``; a null part counts as an empty word."""
    words = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *words))


def as_integer(d: Column, digits: int = 15) -> Column:
    """The leading hex digits of a digest as a bigint: 60 bits, enough for an even draw below any count of rows."""
    return F.conv(F.substring(d, 1, digits), 16, 10).cast("bigint")


def uniform_below(bound, seed, *parts) -> Column:
    """An integer in ``[0, bound)``; null when ``bound`` is 0."""
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    return F.try_mod(as_integer(digest(seed, *parts)), bound.cast("bigint"))


def shuffled(c, seed, *key) -> Column:
    """Permute a list by the digest of its places."""
    cells = F.transform(col(c), lambda x, i: named(d=digest(seed, *key, i), x=x))
    return field(F.array_sort(cells), "x")


def sample_without_replacement(c, n: int, seed, *key) -> Column:
    """``n`` elements of a list; raises for a list with fewer."""
    c = col(c)
    fits = F.size(c) >= n
    return F.when(c.isNull(), c).otherwise(
        F.when(fits, F.slice(shuffled(c, seed, *key), 1, n)).otherwise(
            F.raise_error(F.lit(f"cannot draw {n} elements without replacement from a shorter list"))
        )
    )


def sample_with_replacement(c, n: int, seed, *key) -> Column:
    """``n`` draws from a list; an empty list gives ``n`` nulls."""
    c = col(c)
    if n < 1:
        return F.slice(c, 1, 0)
    return F.when(
        c.isNotNull(),
        with_each(
            F.sequence(F.lit(0), F.lit(n - 1)), c, lambda i, all_: F.get(all_, uniform_below(F.size(all_), seed, *key, i))
        ),
    )


def distinct_draws(total, n: int, seed, *key) -> Column:
    """``n`` different integers below ``total``, every subset equally likely.

    Takes one draw per element and never builds the whole range: the j-th draw is below
    ``total - n + j + 1``, and a value already taken is replaced by the largest allowed one.
    Null when ``n`` exceeds ``total``.
    """
    total = (total if isinstance(total, Column) else F.lit(total)).cast("bigint")

    def take(chosen, j):
        top = total - n + j
        x = uniform_below(top + 1, seed, *key, j)
        return F.array_append(chosen, F.when(F.array_contains(chosen, x), top).otherwise(x))

    return F.when(
        total >= n,
        F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<bigint>"), take),
    )
