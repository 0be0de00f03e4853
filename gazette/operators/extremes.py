"""The most and the least diverse selection from a candidate list, exactly, by branch and bound.

A selection grows item by item in the order of item numbers. A prefix holds the sum of its unit vectors (for cosine; else its
vectors), the total distance within it, and how near its items have their nearest other items at best. Whatever is added, ``r``
more items are at least as far from each item of the prefix as its ``r`` nearest ones, and from one another as the nearest
pair of all; a prefix whose total cannot come below that of a known selection is dropped. Leaving out the item farthest from
the others never raises the mean distance, so every selection grows from a pair through prefixes whose mean is at most its
own: prefixes above the mean of the best selection are dropped too. They are sets then, and any other item may be added.
The first known selections are each item with its own nearest ones. The greatest total is the least total of negated distances.

Prefixes are rows spread over tasks; each meets the items in blocks, so a candidate that the bounds rule out never becomes a
row. For cosine over whole vectors the distances of two blocks are one matrix product in an Arrow task; other
distances are column functions over blocks that are arrays.

There the last two items ``b`` and ``c`` are added to a prefix in one task, so no row is made of a prefix with ``b``. Of the two let ``c``
be the farther from the prefix; then what ``b`` has left bounds how far ``c`` may be. In a selection of three, the two shortest
distances meet in one item: seen from there the third is no shorter than that of ``c``, so ``c`` is among the items
within half of what the nearest one leaves, which are few.
"""

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.functions.arrays import array_sum, dot, is_udf, resolve_distance, unit
from gazette.plans.numbering import first_rows, row_index
from gazette.plans.store import materialise

BLOCK = 256  # items of a block
_DENSE = 16  # times as many rows of a block that meets the items in matrix products, at least
_HELD = 512  # times as many items that a task holds in a block
_TASKS = 32  # blocks of rows times cells of items grow no further; the rows of a block do
_STRIP = 1 << 22  # distances held at a time
_CHUNK = 64  # next to last items met with last ones at a time
_FEW = 8  # least distances found one by one
_SLACK = 1e-9  # totals this close to the best one are followed further, so that rounding drops none


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """``block, xs``: all items ``(nr, v, near)`` in arrays of at most ``BLOCK``."""
    n = -(-items.count() // BLOCK)
    placed = items.withColumn("block", F.floor(F.col("nr") / BLOCK).cast("int"))
    return placed.groupBy("block").agg(F.collect_list(F.struct("nr", "v", "near")).alias("xs")), n


def _meeting(rows: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Every row with every block."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")


def _is_dense(items: DataFrame, distance) -> bool:
    """Whether distances are products of matrices: cosine, and vectors of one width without gaps."""
    if distance != "cosine":
        return False
    gaps = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    low, high, gap = items.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(gaps)).first()
    return bool(low and low > 0 and low == high and not gap)


def _met_in_arrow(rows: DataFrame, n_rows: int, key, items: DataFrame, n_items: int, fn, schema: str, pairs: bool = False) -> DataFrame:
    """``fn(rows, items)`` for every block of rows, dealt by the hash of ``key``, with every block of items, or every pair of them."""
    held = BLOCK * _HELD
    m = max(1, -(-n_items // held))
    whole = pairs and m > 1
    cells = [(p, q) for p in range(m) for q in range(p + 1, m)] if whole else [(p,) for p in range(m)]
    n = max(1, -(-n_rows // min(held, max(BLOCK * _DENSE, -(-n_rows * len(cells) // _TASKS)))))
    left = rows.withColumn("a", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1))))
    own = F.floor(F.col("nr") / held).cast("int")
    if whole:
        places = [F.array(*[F.lit(i) for i, cell in enumerate(cells) if p in cell]) for p in range(m)]
        right = items.withColumn("b", F.explode(F.get(F.array(*places), own)))
    else:
        right = items.withColumn("b", own)
    right = right.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(fn, schema)


def _strips(left: np.ndarray, right: np.ndarray):
    """Slices of ``left`` and their products with all of ``right``, which the next ones are written over."""
    step = max(1, min(len(left), _STRIP // len(right)))
    held = np.empty((step, len(right)))
    for at in range(0, len(left), step):
        part = slice(at, min(at + step, len(left)))
        yield part, np.matmul(left[part], right.T, out=held[: part.stop - at])


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    col = table.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _places(nr: np.ndarray):
    """``find(wanted)``: which of the wanted numbers are in ``nr``, and where."""
    order = np.argsort(nr)

    def find(wanted):
        at = order[np.minimum(np.searchsorted(nr, wanted, sorter=order), len(nr) - 1)]
        there = np.flatnonzero(nr[at] == wanted)
        return there, at[there]

    return find


def _least(e: np.ndarray, n: int):
    """The ``n`` least of each row and their places."""
    if n > _FEW:
        at = np.argpartition(e, n - 1, axis=1)[:, :n]
        return np.take_along_axis(e, at, 1), at
    each, found, places = np.arange(len(e)), [], []
    for _ in range(n):
        at = e.argmin(axis=1)
        found.append(e[each, at])
        places.append(at)
        e[each, at] = np.inf
    found, places = np.column_stack(found), np.column_stack(places)
    e[each[:, None], places[:, ::-1]] = found[:, ::-1]  # the first of a place is its own, where none was left
    return found, places


def _ends(k: int):
    """The ``k - 1`` nearest (side 1) and farthest (side -1) items of a block for each row of another: ``nr, side, e, other``."""

    def run(rows: pa.Table, items: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0), np.empty(0, np.int64))]
        if rows.num_rows and items.num_rows:
            a, b, left, right = rows.column("nr").to_numpy(), items.column("nr").to_numpy(), _matrix(rows, "v"), _matrix(items, "v")
            n, find = min(k - 1, len(b)), _places(b)
            for part, apart in _strips(-left, right):
                own = a[part]
                itself = find(own)
                apart += 1
                for side in (1, -1):
                    if side < 0:
                        np.negative(apart, out=apart)
                    apart[itself] = np.inf
                    e, near = (x.ravel() for x in _least(apart, n))
                    kept = e < np.inf
                    out.append((np.repeat(own, n)[kept], np.full(int(kept.sum()), side, np.int32), e[kept], b[near][kept]))
        return pa.table(dict(zip(("nr", "side", "e", "other"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _found_dense(items: DataFrame, k: int) -> DataFrame:
    """``nr, low, high`` of ``(e, nr)``, as the column functions find them."""
    n = items.count()
    few = _met_in_arrow(items.select("nr", "v"), n, "nr", items.select("nr", "v"), n, _ends(k), "nr long, side int, e double, other long")
    ends = [
        F.slice(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("e", F.col("other").alias("nr"))))), 1, k - 1).alias(c)
        for c, side in (("low", 1), ("high", -1))
    ]
    return materialise(few.groupBy("nr").agg(*ends))


def _with_found(items: DataFrame, k: int, between, dense: bool = False) -> DataFrame:
    """``nr, v, low, high``: the ``k - 1`` nearest and farthest other items of each item.

    Both are ``(e, nr, v)`` in order, ``e`` being the distance in ``low`` and its negation in ``high``. The distances of an
    item to all others are worked out once, and only the ends of their order leave a block.
    """
    found = _found_dense(items, k) if dense else _found_by_columns(items, k, between)
    vectors = items.select(F.col("nr").alias("other"), F.col("v").alias("own"))
    out = found.join(items.select("nr", "v"), "nr")
    for c in ("low", "high"):
        rows = found.select("nr", F.inline(F.transform(c, lambda x: F.struct(x["e"].alias("e"), x["nr"].alias("other")))))
        whole = F.array_sort(F.collect_list(F.struct("e", F.col("other").alias("nr"), F.col("own").alias("v")))).alias(c)
        out = out.drop(c).join(rows.join(vectors, "other").groupBy("nr").agg(whole), "nr")
    return materialise(out)


def _found_by_columns(items: DataFrame, k: int, between) -> DataFrame:
    """``nr, low, high`` of ``(e, nr)``."""
    blocks, n_blocks = _blocks(items.withColumn("near", F.array().cast("array<double>")))
    met = _meeting(items.select("nr", "v"), materialise(blocks), n_blocks)
    others = F.filter("xs", lambda x: x["nr"] != F.col("nr"))
    order = F.array_sort(F.transform(others, lambda x: F.struct(between(F.col("v"), x["v"]).alias("e"), x["nr"].alias("nr"))))
    farther = F.transform(F.reverse("order"), lambda x: F.struct((-x["e"]).alias("e"), x["nr"].alias("nr")))
    few = met.select("nr", order.alias("order")).select("nr", F.slice("order", 1, k - 1).alias("low"), F.slice(farther, 1, k - 1).alias("high"))
    ends = [F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k - 1).alias(c) for c in ("low", "high")]
    return materialise(few.groupBy("nr").agg(*ends))


def _measures(distance):
    """The distance of two vectors, that of a prefix of ``m`` to a vector, and a prefix with one more vector."""
    if is_udf(distance):
        raise ValueError("exact bounds need a distance made of column functions")
    measure = resolve_distance(distance)
    if distance != "cosine":
        return measure, lambda vs, v, m: array_sum(F.transform(vs, lambda a: measure(a, v))), F.array_append
    # the prefix is one vector, the sum of its own, and the distances to a new one come from one product
    grown = lambda vs, v: F.array(F.zip_with(vs[0], v, lambda a, b: a + b))
    return lambda a, b: 1 - dot(a, b), lambda vs, v, m: F.lit(float(m)) - dot(vs[0], v), grown


def _totals(prefixes: pa.Table, items: pa.Table, size: int, sign: int):
    """Strips of prefixes, and their totals with every item, which the next ones are written over; infinite for items of the prefix."""
    if not prefixes.num_rows or not items.num_rows:
        return
    sums, right, w = _matrix(prefixes, "s"), _matrix(items, "v"), prefixes.column("w").to_numpy()
    own, find = _matrix(prefixes, "nrs"), _places(items.column("nr").to_numpy())
    for part, e in _strips(-sign * sums, right):
        e += (w[part] + sign * size)[:, None]
        for c in range(size):
            e[find(own[part, c])] = np.inf
        yield part, e


def _last_two(size: int, sign: int, best: float, closest: float):
    """The least total of a block of prefixes with two more items, or ``best``, and how many prefixes with one more were followed: ``w, n``."""

    def run(prefixes: pa.Table, items: pa.Table) -> pa.Table:
        least, n = best, 0
        if prefixes.num_rows and items.num_rows:
            # promising prefixes first, since a lower total rules out more of the others
            prefixes = prefixes.take(np.argsort(prefixes.column("w").to_numpy() + _matrix(prefixes, "near")[:, 0]))
            right, nr, more = _matrix(items, "v"), items.column("nr").to_numpy(), _matrix(items, "near")[:, 0]
            own, near, ws = _matrix(prefixes, "nrs"), _matrix(prefixes, "near")[:, 0], prefixes.column("w").to_numpy()
            share = comb(size + 1, 2) / comb(size + 2, 2)
        for part, strip in _totals(prefixes, items, size, sign):
            for row in np.flatnonzero(strip.min(axis=1) <= least * share + _SLACK):
                i, e = part.start + row, strip[row]
                w, low = ws[i], e.min()

                def most(b):  # the greatest total of the prefix with the last item, if that with the other is b
                    return ((least - b) / 2 if size == 1 else least + w - b - closest) + _SLACK  # noqa: B023

                last = np.flatnonzero(e <= most(low))
                last = last[e[last] + low - w + more[last] <= least + _SLACK]
                last = last[np.argsort(e[last])]
                one = last[(e[last] <= least * share + _SLACK) & (e[last] + near[i] + more[last] <= least + _SLACK)]
                n += int((nr[one] > own[i, 0]).sum()) if size == 1 else len(one)  # pairs once
                step = max(1, min(_CHUNK, _STRIP // max(1, len(last))))
                for at in range(0, len(one), step):
                    some = one[at : at + step]
                    rest = last[: np.searchsorted(e[last], most(e[some[0]]), "right")]
                    if not len(rest):
                        break
                    total = (-sign * right[some]) @ right[rest].T
                    total += (e[some] - w + sign)[:, None]
                    total += e[rest]
                    total[some[:, None] == rest] = np.inf
                    least = min(least, float(total.min()))
        return pa.table({"w": pa.array([least], pa.float64()), "n": pa.array([n], pa.int64())})

    return run


def _grown(size: int, sign: int, left: int, reach: float, best: float, mean: float):
    """Prefixes of a block with one more item of a block, as far as the bounds let them: ``nrs, s, w, near``."""

    def run(prefixes: pa.Table, items: pa.Table) -> pa.Table:
        out = {"nrs": [], "s": [], "w": [], "near": []}
        if prefixes.num_rows and items.num_rows:
            nrs, sums, near = (_matrix(prefixes, c) for c in ("nrs", "s", "near"))
            nr, right, more = items.column("nr").to_numpy(), _matrix(items, "v"), _matrix(items, "near")
        for part, e in _totals(prefixes, items, size, sign):
            i, j = np.nonzero(e <= mean + _SLACK)
            w = e[i, j]
            i += part.start
            hopeful = w + near[i, left - 1] + more[j, left - 1] + reach <= best + _SLACK
            if size == 1:  # pairs once
                hopeful &= nr[j] > nrs[i, 0]
            i, j, w = i[hopeful], j[hopeful], w[hopeful]
            if len(i):
                out["nrs"].append(np.sort(np.column_stack([nrs[i], nr[j]]), axis=1))
                out["s"].append(sums[i] + right[j])
                out["w"].append(w)
                out["near"].append(near[i] + more[j])
        if not out["w"]:
            return pa.table({"nrs": pa.array([], pa.list_(pa.int64())), "s": pa.array([], pa.list_(pa.float64())), "w": pa.array([], pa.float64()), "near": pa.array([], pa.list_(pa.float64()))})

        def lists(parts):
            whole = np.concatenate(parts)
            offsets = np.arange(0, whole.size + 1, whole.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.ravel()))

        return pa.table({c: np.concatenate(x) if c == "w" else lists(x) for c, x in out.items()})

    return run


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """Stored prefixes, each set of items once; pairs are formed once anyway."""
    return materialise(rows if size == 1 else rows.dropDuplicates(["nrs"]))


def least_total(found: DataFrame, k: int, distance="cosine", sign: int = 1, dense: bool = False) -> tuple[float, list[int]]:
    """The least sum of ``sign`` times the distances over all pairs within ``k`` items, and the prefixes kept or followed by size.

    ``found`` comes from ``_with_found``; its numbers ``nr`` are dense from 0.
    """
    between, to_prefix, joined = _measures(distance)
    found = found.select("nr", "v", F.col("low" if sign > 0 else "high").alias("found"))
    # near[r - 1] bounds what r more items add to this item's distances from below
    near = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda r: array_sum(F.transform(F.slice("found", F.lit(1), r), lambda x: x["e"])))
    ready = materialise(found.select("nr", "v", near.alias("near")))
    chosen = F.concat(F.array("v"), F.transform("found", lambda x: x["v"]))
    every = F.transform(chosen, lambda a: array_sum(F.transform(chosen, lambda b: sign * between(a, b))))
    itself = F.transform(chosen, lambda a: sign * between(a, a))
    first = found.select(((array_sum(every) - array_sum(itself)) / 2).alias("w"), F.get(F.transform("found", lambda x: x["e"]), F.lit(0)).alias("e"))
    best, closest = first.agg(F.min("w"), F.min("e")).first()

    kept = []
    if dense:
        n = ready.count()
        prefixes = ready.select(F.array("nr").alias("nrs"), F.col("v").alias("s"), F.lit(0.0).alias("w"), "near")
        for size in range(1, k - 1):  # the pairs are all in the first selections
            left, rows = k - size - 1, kept[-1] if kept else n
            if not rows:
                break
            if left == 1:
                run = _last_two(size, sign, best, closest)
                last, grown = _met_in_arrow(prefixes, rows, "nrs", ready, n, run, "w double, n long", pairs=True).agg(F.min("w"), F.sum("n")).first()
                best = best if last is None else min(best, last)
                kept.append(grown or 0)
                break
            run = _grown(size, sign, left, comb(left, 2) * closest, best, best * comb(size + 1, 2) / comb(k, 2))
            prefixes = _sets(_met_in_arrow(prefixes, rows, "nrs", ready, n, run, "nrs array<long>, s array<double>, w double, near array<double>"), size)
            kept.append(prefixes.count())
        return best, kept

    blocks, n_blocks = _blocks(ready)
    blocks = materialise(blocks)
    prefixes = ready.select(F.array("nr").alias("nrs"), F.array("v").alias("vs"), F.lit(0.0).alias("w"), "near")
    for size in range(1, k):
        left = k - size - 1
        met = _meeting(prefixes, blocks, n_blocks)
        total = lambda x: F.col("w") + sign * to_prefix(F.col("vs"), x["v"], size)  # noqa: E731, B023
        # pairs once; a larger prefix takes any other item
        others = F.filter("xs", lambda x: x["nr"] > F.col("nrs")[0] if size == 1 else ~F.array_contains("nrs", x["nr"]))  # noqa: B023
        if not left:
            last = met.select(F.array_min(F.transform(others, total)).alias("w")).agg(F.min("w")).first()[0]
            best = best if last is None else min(best, last)
            break
        reach, mean = F.lit(comb(left, 2) * closest), F.lit(best * comb(size + 1, 2) / comb(k, 2) + _SLACK)
        grown = F.transform(
            others,
            lambda x: F.struct(
                x["nr"].alias("last"), total(x).alias("w"), x["v"].alias("v"), F.zip_with("near", x["near"], lambda a, b: a + b).alias("near")
            ),
        )
        hopeful = F.filter(grown, lambda g: (g["w"] <= mean) & (g["w"] + F.element_at(g["near"], left) + reach <= F.lit(best + _SLACK)))
        rows = met.select("nrs", "vs", F.inline(hopeful))
        prefixes = _sets(rows.select(F.array_sort(F.array_append("nrs", F.col("last"))).alias("nrs"), joined(F.col("vs"), F.col("v")).alias("vs"), "w", "near"), size)
        kept.append(prefixes.count())
    return best, kept


def diversity_bounds(known: DataFrame, vector_col: str, n: int, order: list, distance="cosine") -> tuple[float, float]:
    """Lowest and highest mean distance within ``n`` rows of ``known``, each with a vector."""
    vector = F.col(vector_col).cast("array<double>")
    vectors = known.select(*order, (unit(vector) if distance == "cosine" else vector).alias("v"))
    # a selection never has more than n copies of one vector
    numbered = row_index(first_rows(vectors, n, ["v"], order), order, "nr").select("nr", "v")
    items = materialise(numbered)
    dense = _is_dense(items, distance)
    found = _with_found(items, n, _measures(distance)[0], dense)
    low, _ = least_total(found, n, distance, 1, dense)
    high, _ = least_total(found, n, distance, -1, dense)
    return low / comb(n, 2), -high / comb(n, 2)
