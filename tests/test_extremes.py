"""Exact diversity bounds against every combination."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gazette.operators import beyond as B, extremes
from gazette.operators.extremes import _measures, _with_found, least_total


def cosine(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
    return 1 - (sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0)


def bounds(vectors, k, distance):
    means = [sum(distance(a, b) for a, b in itertools.combinations(c, 2)) / math.comb(k, 2) for c in itertools.combinations(vectors, k)]
    return min(means), max(means)


@pytest.mark.parametrize(("k", "distance"), [(2, "cosine"), (3, "cosine"), (5, "cosine"), (4, "euclidean")])
def test_bounds_over_all_combinations(spark, k, distance):
    rng = random.Random(k)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(13)] + [[0.0, 0.0, 0.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(50, None)]
    items = spark.createDataFrame(rows, "article_id long, v array<double>")
    ids = items.select("article_id").unionByName(spark.createDataFrame([(99,)], "article_id long"))
    got = tuple(B.candidate_diversity(ids, items, "v", k, distance=distance).first())
    assert got == pytest.approx(bounds(vectors, k, cosine if distance == "cosine" else math.dist))


def test_prefixes_are_dropped(spark, monkeypatch):
    """In clusters nearly all prefixes go, over several blocks of items."""
    monkeypatch.setattr("gazette.operators.extremes.BLOCK", 16)
    rng = random.Random(0)
    vectors = []
    for i in range(90):
        angle = (i % 6) + rng.gauss(0, 0.01)
        vectors.append((i, [math.cos(angle), math.sin(angle)]))
    items = spark.createDataFrame(vectors, "nr long, v array<double>")
    found = _with_found(items, 3, _measures("cosine")[0])
    low, kept = least_total(found, 3)
    high, kept_high = least_total(found, 3, sign=-1)
    want = bounds([v for _, v in vectors], 3, cosine)
    assert (low / 3, -high / 3) == pytest.approx(want)
    assert kept[0] < math.comb(90, 2) / 20 and kept_high[0] < math.comb(90, 2)


@pytest.mark.parametrize("dense", [True, False])
def test_prefixes_above_the_best_mean_are_dropped(spark, monkeypatch, dense):
    """Where vectors lie all around, few pairs are as far apart as the best selection on average; several blocks either way."""
    monkeypatch.setattr("gazette.operators.extremes.BLOCK", 1 if dense else 16)
    rng = random.Random(3)
    rows = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    vectors = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in rows]
    items = spark.createDataFrame(list(enumerate(vectors)), "nr long, v array<double>")
    apart = [[cosine(a, b) for b in vectors] for a in vectors]
    for k in (3, 4):
        found = _with_found(items, k, _measures("cosine")[0], dense)
        low, kept = least_total(found, k, dense=dense)
        high, kept_high = least_total(found, k, sign=-1, dense=dense)
        totals = [sum(apart[a][b] for a, b in itertools.combinations(c, 2)) for c in itertools.combinations(range(40), k)]
        assert (low, -high) == pytest.approx((min(totals), max(totals)))
        assert max(kept[0], kept_high[0]) < math.comb(40, 2) / 3


def test_pairs_never_become_rows(spark, monkeypatch):
    """Vectors all around a circle leave many pairs to follow, but no stored table has more rows than items; several cells of items."""
    monkeypatch.setattr("gazette.operators.extremes.BLOCK", 1)
    monkeypatch.setattr("gazette.operators.extremes._HELD", 16, raising=False)
    rows, inner = [], extremes.materialise

    def counted(df):
        stored = inner(df)
        rows.append(stored.count())
        return stored

    rng = random.Random(7)
    vectors = [[math.cos(x), math.sin(x)] for x in (rng.uniform(0, 2 * math.pi) for _ in range(40))]
    items = spark.createDataFrame(list(enumerate(vectors)), "nr long, v array<double>")
    apart = [[cosine(a, b) for b in vectors] for a in vectors]
    monkeypatch.setattr(extremes, "materialise", counted)
    for k in (2, 3, 4):
        found = _with_found(items, k, _measures("cosine")[0], True)
        low, high = least_total(found, k, dense=True)[0], -least_total(found, k, sign=-1, dense=True)[0]
        totals = [sum(apart[a][b] for a, b in itertools.combinations(c, 2)) for c in itertools.combinations(range(40), k)]
        assert (low, high) == pytest.approx((min(totals), max(totals)))
        assert k > 3 or max(rows) == 40


def test_copies_beyond_a_selection_take_no_part(spark, monkeypatch):
    """However many copies a vector has, a selection holds at most its own number of them."""
    seen, inner = [], extremes._with_found

    def counted(items, *args):
        seen.append(items.count())
        return inner(items, *args)

    monkeypatch.setattr(extremes, "_with_found", counted)
    distinct = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.5]]
    rows = [(i, distinct[i % 3] if i else [2.0, 2.0]) for i in range(60)]
    items = spark.createDataFrame(rows, "article_id long, v array<double>")
    got = tuple(B.candidate_diversity(items, items, "v", 3).first())
    assert got == pytest.approx(bounds([*distinct * 3, [2.0, 2.0]], 3, cosine)) and seen == [10]


def test_arguments(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "article_id long, v array<double>")
    assert all(math.isnan(x) for x in B.candidate_diversity(items, items, "v", 1).first())
    with pytest.raises(ValueError):
        B.candidate_diversity(items, items, "v", 5)
    with pytest.raises(ValueError):
        B.candidate_diversity(items, items, "v", 2, distance=F.udf(lambda a, b: 1.0, "double"))
