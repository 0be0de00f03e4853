"""Row-local list expressions: ``Column -> Column``, no shuffle."""

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def field(c, name: str) -> Column:
    """One field of a list of structs, as a list."""
    return col(c).getField(name)


def named(**fields) -> Column:
    """A struct whose field names do not depend on aliases."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def with_each(c, value, fn) -> Column:
    """``fn(element, value)`` for every element, ``value`` being worked out once per row.

    An expression used inside a lambda is evaluated again for every element, and the optimizer
    moves columns of an earlier select into lambdas. Handing the value over as a second list
    keeps it outside.
    """
    c = col(c)
    return F.zip_with(c, F.array_repeat(value, F.size(c)), fn)


def tail(c, n) -> Column:
    """The last ``n`` elements; shorter lists stay whole, null stays null."""
    c, n = col(c), n if isinstance(n, Column) else F.lit(n)
    return F.slice(c, F.greatest(F.size(c) - n, F.lit(0)) + 1, n)


def tail_padded(c, n: int, padding) -> Column:
    """The last ``n`` elements, filled up on the left to exactly ``n``; null stays null."""
    c = col(c)
    missing = F.greatest(F.lit(n) - F.size(c), F.lit(0))
    return F.when(c.isNotNull(), F.concat(F.array_repeat(F.lit(padding), missing), tail(c, n)))


def head_padded(c, n: int, padding) -> Column:
    """The first ``n`` elements, filled up on the right to exactly ``n``; null stays null."""
    c = col(c)
    missing = F.greatest(F.lit(n) - F.size(c), F.lit(0))
    return F.when(c.isNotNull(), F.concat(F.slice(c, 1, n), F.array_repeat(F.lit(padding), missing)))


def without(c, removed) -> Column:
    """Elements of ``c`` not in ``removed``; order and repeats are kept."""
    marked = with_each(
        c, col(removed), lambda x, r: named(x=x, gone=F.coalesce(F.array_contains(r, x), F.lit(False)))
    )
    return field(F.filter(marked, lambda m: ~m["gone"]), "x")


def binary_labels(inview, clicked) -> Column:
    """1 where the in-view id was clicked, else 0; a null click list gives zeros."""
    return with_each(
        inview, col(clicked), lambda x, c: F.coalesce(F.array_contains(c, x), F.lit(False)).cast("tinyint")
    )


def empty_to_null(c) -> Column:
    return F.when(F.size(c) > 0, c)


def chunked(c, size: int) -> Column:
    """Cut a list into consecutive sublists of ``size``; the last one may be shorter."""
    c = col(c)
    starts = F.sequence(F.lit(0), F.floor((F.size(c) - 1) / size).cast("int"))
    return F.when(F.size(c) > 0, with_each(starts, c, lambda i, all_: F.slice(all_, i * size + 1, F.lit(size)))).otherwise(
        F.when(c.isNotNull(), F.array())
    )


def array_sum(c) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda acc, x: acc + x)


# --- decay weights -------------------------------------------------------------------------


def _weights(n, ascending: bool, weight) -> Column:
    """``weight(distance, n)`` for every place, ``distance`` counted from the largest weight."""
    n = F.lit(n) if isinstance(n, int) else n
    distances = F.sequence(n - 1, F.lit(0), F.lit(-1)) if ascending else F.sequence(F.lit(0), n - 1)
    return F.when(n > 0, with_each(distances, n, weight)).otherwise(F.array().cast("array<double>"))


def linear_decay_weights(n, ascending: bool = True) -> Column:
    """Weights falling in even steps from 1 to 1/n; ascending puts the largest last."""
    return _weights(n, ascending, lambda d, size: (size - d) / size.cast("double"))


def exponential_decay_weights(n, lambda_factor: float, ascending: bool = True) -> Column:
    """Weights ``lambda_factor ** distance``; ascending puts the largest last."""
    return _weights(n, ascending, lambda d, size: F.pow(F.lit(float(lambda_factor)), d))


def weighted_vectors(vectors, weights) -> Column:
    """Scale each inner vector by its weight; a null vector becomes ``[null]``."""
    return F.zip_with(
        col(vectors),
        col(weights),
        lambda v, w: F.coalesce(F.transform(v, lambda x: x * w), F.array(F.lit(None).cast("double"))),
    )


# --- vectors -------------------------------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def unit(v) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    v = col(v)
    return with_each(v, norm(v), lambda x, length: F.when(length == 0, x).otherwise(x / length))


def cosine_distance(a, b) -> Column:
    """``1 - cos``; a zero vector has cosine 0 with everything."""
    length = norm(a) * norm(b)
    return 1 - F.coalesce(F.try_divide(dot(a, b), length), F.lit(0.0))


def euclidean_distance(a, b) -> Column:
    return F.sqrt(array_sum(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def manhattan_distance(a, b) -> Column:
    return array_sum(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean_distance, "manhattan": manhattan_distance}


def is_udf(function) -> bool:
    """Whether a function is a Python UDF, which Spark cannot call inside a lambda."""
    return hasattr(function, "evalType")


def resolve_distance(distance):
    """A named distance, or any ``(Column, Column) -> Column``, a UDF of two array columns among them."""
    if callable(distance):
        return distance
    if distance not in DISTANCES:
        raise ValueError(f"unknown distance {distance!r}; use one of {sorted(DISTANCES)} or a function of two columns")
    return DISTANCES[distance]


def softmax(c) -> Column:
    """Softmax over a list, shifted by its maximum."""
    weights = with_each(c, F.array_max(col(c)), lambda x, top: F.exp(x - top))
    return with_each(weights, array_sum(weights), lambda w, total: w / total)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))
