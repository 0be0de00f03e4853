"""Ranks and accuracy metrics of one impression, computed inside its row.

Labels and scores are parallel lists, so ranking is a sort of one small array and every
metric is an expression over it: no explode, no window, no shuffle. Ties go to the later
position; NaN ranks first.
"""

from pyspark.sql import Column, functions as F

from gazette.functions.arrays import array_sum, col, field, named


def ordered(scores, labels=None) -> Column:
    """``(score, pos, y)`` structs from best to worst."""
    scores = col(scores)
    labels = scores if labels is None else col(labels)
    pairs = F.zip_with(scores, labels, lambda s, y: named(s=s, y=y.cast("double")))
    cells = F.transform(pairs, lambda c, i: named(score=c["s"], pos=i, y=c["y"]))
    return F.sort_array(cells, asc=False)


def ranks(scores) -> Column:
    """Rank of each position, 1 for the highest score."""
    placed = F.transform(ordered(scores), lambda s, i: named(pos=s["pos"], rank=i + 1))
    return field(F.array_sort(placed), "rank")


def n_positive(labels) -> Column:
    return F.aggregate(col(labels), F.lit(0.0), lambda acc, y: acc + y.cast("double"))


def _wins(labels, scores) -> Column:
    """Count (positive, negative) pairs in the right order in one pass over the sorted list.

    Sorting by (score, label) puts positives before negatives of the same score, so at a
    negative all positives at or above it have been seen.
    """
    labels, scores = col(labels), col(scores)
    cells = F.sort_array(
        F.zip_with(scores, labels, lambda s, y: named(s=s.cast("double"), y=y.cast("double"))),
        asc=False,
    )
    zero = F.lit(0.0)
    start = named(at=F.lit(None).cast("double"), above=zero, tied=zero, wins=zero, strict=zero)

    def step(acc, c):
        same = F.coalesce(acc["at"] == c["s"], F.lit(False))
        above = F.when(same, acc["above"]).otherwise(acc["above"] + acc["tied"])
        tied = F.when(same, acc["tied"]).otherwise(F.lit(0.0)) + c["y"]
        return named(
            at=c["s"],
            above=above,
            tied=tied,
            wins=acc["wins"] + (1 - c["y"]) * (above + tied / 2),
            strict=acc["strict"] + (1 - c["y"]) * above,
        )

    return F.aggregate(cells, start, step)


def _pairs(labels) -> Column:
    p = n_positive(labels)
    return p * (F.size(col(labels)) - p)


def auc(labels, scores) -> Column:
    """Area under the ROC curve, ties count one half; null when only one class is present."""
    pairs = _pairs(labels)
    return F.when(pairs > 0, _wins(labels, scores)["wins"] / pairs)


def auc_strict(labels, scores) -> Column:
    """As :func:`auc` with ties counting nothing."""
    pairs = _pairs(labels)
    return F.when(pairs > 0, _wins(labels, scores)["strict"] / pairs)


# The metrics of a ranking look only at the labels in rank order, so several of them can share
# one sort: see ``MetricEvaluator``.


def ranked_labels(labels, scores) -> Column:
    """The labels as doubles, from the best ranked to the worst."""
    return field(ordered(scores, labels), "y")


def mrr_of(ranked) -> Column:
    """Mean of 1/rank over the positives; NaN without a positive."""
    total = array_sum(F.transform(col(ranked), lambda y, i: y / (i + 1)))
    p = array_sum(ranked)
    return F.when(p > 0, total / p).otherwise(F.lit(float("nan")))


def reciprocal_rank_of(ranked) -> Column:
    """1/rank of the best ranked positive; 1 without a positive."""
    first = F.array_position(col(ranked), 1.0)
    return F.when(first > 0, 1 / first).otherwise(F.lit(1.0))


def dcg_of(ranked, k: int = 10) -> Column:
    """Discounted cumulative gain of the top ``k``."""
    top = F.slice(col(ranked), 1, k)
    return array_sum(F.transform(top, lambda y, i: (F.pow(F.lit(2.0), y) - 1) / F.log2(i + 2.0)))


def ndcg_of(ranked, k: int = 10) -> Column:
    """DCG divided by the best possible DCG; NaN without a positive."""
    ideal = dcg_of(F.sort_array(col(ranked), asc=False), k)
    return F.when(ideal > 0, dcg_of(ranked, k) / ideal).otherwise(F.lit(float("nan")))


def mrr(labels, scores) -> Column:
    return mrr_of(ranked_labels(labels, scores))


def reciprocal_rank(labels, scores) -> Column:
    return reciprocal_rank_of(ranked_labels(labels, scores))


def dcg(labels, scores, k: int = 10) -> Column:
    return dcg_of(ranked_labels(labels, scores), k)


def ndcg(labels, scores, k: int = 10) -> Column:
    return ndcg_of(ranked_labels(labels, scores), k)


# Fixed value: scores are clipped this far from 0 and 1 before taking logarithms.
LOGLOSS_CLIP = 1e-11


def _row_mean(labels, scores, term) -> Column:
    """Mean of ``term(y, p)`` over the list; null for an empty list."""
    labels, scores = col(labels), col(scores)
    each = F.zip_with(labels, scores, lambda y, p: term(y.cast("double"), p.cast("double")))
    return F.try_divide(array_sum(each), F.size(labels).cast("double"))


def logloss(labels, scores) -> Column:
    """Binary log loss; null when only one class is present."""

    def term(y, p):
        p = F.least(F.greatest(p, F.lit(LOGLOSS_CLIP)), F.lit(1 - LOGLOSS_CLIP))
        return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))

    return F.when(_pairs(labels) > 0, _row_mean(labels, scores, term))


def rmse(labels, scores) -> Column:
    return F.sqrt(_row_mean(labels, scores, lambda y, p: (y - p) * (y - p)))


def binarise(score, threshold: float) -> Column:
    return (col(score) >= threshold).cast("int")


def accuracy(labels, scores, threshold: float = 0.5) -> Column:
    return _row_mean(labels, scores, lambda y, p: ((p >= threshold) == (y == 1)).cast("double"))


def f1(labels, scores, threshold: float = 0.5) -> Column:
    """F1 of the thresholded scores; 0 when nothing is positive on either side."""
    labels, scores = col(labels), col(scores)
    hits = array_sum(
        F.zip_with(labels, scores, lambda y, p: ((p >= threshold) & (y == 1)).cast("double"))
    )
    chosen = array_sum(F.transform(scores, lambda p: (p >= threshold).cast("double")))
    return F.coalesce(F.try_divide(2 * hits, chosen + n_positive(labels)), F.lit(0.0))
