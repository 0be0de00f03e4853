"""Product codes against brute force in Python integers, and the tree against looking at every entry."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.llm.codes import Gnat, codebooks_sha256, product_codes, whole_numbers


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def reference(rows, parts=4, entries=256, rounds=4):
    """``(id, label, vector)`` rows -> sorted (id, code, error, label error) and the codebooks."""
    kept = [r for r in rows if r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(order[0][2])
    kept, order = ([r for r in part if len(r[2]) == width] for part in (kept, order))

    def cut(v):
        whole = [1024 * n // d for n, d in map(float.as_integer_ratio, v)]
        return [whole[p * width // parts : (p + 1) * width // parts] for p in range(parts)]

    pieces = [cut(r[2]) for r in kept]
    books = [[cut(r[2])[p] for r in order[:entries]] for p in range(parts)]

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (distance(v[p], books[p][e]), e)) for p in range(parts)] for v in pieces]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(pieces, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(distance(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(pieces, codes, strict=True)]
    held = [e if e < 2**63 else None for e in errors]
    out = []
    for r, c, e in zip(kept, codes, held, strict=True):
        same = [x for q, x in zip(kept, held, strict=True) if q[1] == r[1]]
        total = None if None in same or sum(same) >= 2**63 else sum(same)
        out.append((r[0], "".join(f"{i:02x}" for i in c), e, total))
    return sorted(out, key=str), books


def rows_of(df):
    return sorted((tuple(r) for r in df.select("id", "code", "error", "label_error").collect()), key=str)


@pytest.mark.parametrize("spread", [1, 30, 1000, 10**25])
def test_tree_finds_the_nearest(spread):
    """Ties, equal entries and components beyond float64."""
    rng = random.Random(spread)
    entries = [[rng.randrange(-spread, spread + 1) for _ in range(3)] for _ in range(200)]
    queries = [[rng.randrange(-spread, spread + 1) for _ in range(3)] for _ in range(150)] + entries[:20]
    kind = object if spread > 10**9 else np.float64
    index, squared = Gnat(np.array(entries, kind)).nearest(np.array(queries, kind))
    want = [min((distance(q, e), i) for i, e in enumerate(entries)) for q in queries]
    assert [(int(s), int(i)) for s, i in zip(squared, index, strict=True)] == want


def test_tree_rules_out_subtrees():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (16, 8))
    entries = (centres.repeat(16, axis=0) + rng.integers(-40, 40, (256, 8))).astype(float)
    queries = entries[rng.integers(0, 256, 500)] + rng.integers(-20, 20, (500, 8))
    tree = Gnat(entries)
    index, squared = tree.nearest(queries)
    every = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (squared == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()
    assert tree.looked < 0.3 * every.size


def test_equal_entries():
    tree = Gnat(np.ones((256, 2)))
    index, squared = tree.nearest(np.zeros((3, 2)))
    assert index.tolist() == [0, 0, 0] and squared.tolist() == [2.0] * 3


def test_whole_numbers_of_any_size():
    values = np.array([[0.5, -0.0001, 1e300, -3.7e18, 5e-324, -5e-324]])
    assert [int(x) for x in whole_numbers(values)[0]] == [1024 * n // d for n, d in map(float.as_integer_ratio, values[0].tolist())]


def test_against_brute_force(spark):
    """Ties on a coarse grid, repeated vectors and ids, null ids and labels, rows that take no part."""
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, None]), [rng.randrange(-6, 7) / 256 + rng.choice([0, 1e-5]) for _ in range(8)]) for i in range(420)]
    rows += [(500 + i, 2, rows[7][2]) for i in range(60)] + [(3, 1, rows[9][2]), (None, 1, rows[11][2])]
    rows += [
        (-1, 0, None), (-2, 0, []), (-3, 0, [0.1] * 7 + [None]), (-4, 0, [0.1] * 7 + [float("nan")]),
        (-5, 0, [0.1] * 7 + [float("inf")]), (700, 0, [0.1] * 4),
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, id long, code string")
    found, books = product_codes(df)
    want, want_books = reference(rows)
    assert rows_of(found) == want
    assert codebooks_sha256(books) == codebooks_sha256([np.array(b, object) for b in want_books])


def test_large_components(spark):
    rng = random.Random(8)
    rows = [(i, i % 2, [rng.choice([1, 1e3, 1e9, 1e20, 1e200]) * rng.random() for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, 7, [rng.random() for _ in range(4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found, _ = product_codes(df, entries=16)
    assert rows_of(found) == reference(rows, entries=16)[0]


def test_few_or_no_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    few = [(1, None, [0.5, 0.25, 0.125, 0.0]), (2, None, [0.5, 0.25, 0.5, -1.0])]
    assert rows_of(product_codes(spark.createDataFrame(few, schema))[0]) == reference(few)[0]
    none, books = product_codes(spark.createDataFrame(few, schema).filter(F.lit(False)))
    assert none.collect() == [] and books == []
    with pytest.raises(ValueError):
        product_codes(spark.createDataFrame([(1, 1, [1.0, 2.0])], schema))
