"""Product codes of vectors, with a GNAT over each codebook's entries.

A vector is cut into equal consecutive parts; each part position has a codebook, learned by Lloyd rounds in whole
numbers, and a vector's code is the nearest entry of each of its parts. Nearest entries are found in a geometric
near-neighbour access tree: a node holds split points, every other entry below the nearest of
them, and for each pair of split point and child the range of distances from the one to the entries below the other. The
distance from a query to a split point, less or plus the distance to its best entry so far, rules out every child whose
range it misses, with the whole subtree.

Elimination is strict and roots are rounded outwards (down where a distance should be large to rule out, up where it
should be small), so an entry at the very distance of the best one is always looked at; ties are then settled on
integer squared distances by the smaller index. Distances are whole numbers held in float64 while they stay
below 2**53, so that arithmetic on them is exact; larger components take Python integers through the same tree.

Queries go through the tree in blocks inside Arrow tasks. A round brings one (count, sum) per entry to the driver,
added up per task and then per entry, and sends the codebooks out again: parts x entries x places numbers, whatever the
number of vectors.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from gazette.llm.registry import query, table
from gazette.plans.lookup import lookup_join
from gazette.plans.store import materialise

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
_FANOUT = 16  # split points of a node
_LEAF = 16  # entries that are not split further
_BLOCK = 4096  # vectors of a task at a time
_EXACT = 2.0**53


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` as float64 where that is exact, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**52:
        return scaled
    exact = [scale * n // d for n, d in map(float.as_integer_ratio, values.ravel().tolist())]
    return np.array(exact, object).reshape(values.shape)


def _safe(points: np.ndarray, dims: int) -> bool:
    """Whether squared distances among such points stay exact in float64."""
    return points.dtype != object and (not points.size or dims * (2 * float(np.abs(points).max())) ** 2 < _EXACT)


def _squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of every query to every point; all terms are whole numbers, so any order of adding is exact."""
    if queries.dtype == object:
        return np.stack([((queries - p) ** 2).sum(axis=1) for p in points], axis=1)
    return (queries * queries).sum(axis=1)[:, None] - 2 * (queries @ points.T) + (points * points).sum(axis=1)


def _roots(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of square roots."""
    if squared.dtype == object:
        low = np.array([math.isqrt(int(s)) for s in squared.ravel()], object).reshape(squared.shape)
        return low, low + 1
    near = np.sqrt(squared)
    return np.nextafter(near, -np.inf), np.nextafter(near, np.inf)


class Gnat:
    """Nearest entry of a codebook (integers, row by row), exactly, ties to the smaller index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.looked = 0  # distances worked out so far
        self.root = self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray):
        """A leaf is its members; a node is (split points, ranges low, ranges high, children)."""
        if len(members) <= _LEAF:
            return members
        own = self.entries[members]
        # split points far from one another: each is the farthest from those before it
        picks, least = [0], _squared(own, own[:1])[:, 0]
        while len(picks) < _FANOUT and least.max() > 0:
            picks.append(int(np.argmax(least)))
            least = np.minimum(least, _squared(own, own[picks[-1:]])[:, 0])
        if len(picks) == 1:  # all entries are equal
            return members
        picks.sort()
        apart = _squared(own, own[picks]).T
        below = np.argmin(apart, axis=0)
        below[picks] = np.arange(len(picks))
        low, high, children = [], [], []
        for j in range(len(picks)):
            inside = below == j
            low.append(_roots(apart[:, inside].min(axis=1))[0])
            high.append(_roots(apart[:, inside].max(axis=1))[1])
            inside[picks[j]] = False
            children.append(self._grow(members[inside]) if inside.any() else None)
        return members[picks], np.stack(low, axis=1), np.stack(high, axis=1), children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each query."""
        best = _squared(queries, self.entries[:1])[:, 0]
        index = np.zeros(len(queries), np.int64)
        self._search(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _look(self, entries: np.ndarray, queries, who, best, index) -> np.ndarray:
        """Distances of the queries ``who`` to ``entries`` (ascending); the best ones so far are kept."""
        squared = _squared(queries[who], self.entries[entries])
        self.looked += squared.size
        near = np.argmin(squared, axis=1)
        least, entry = squared[np.arange(len(who)), near], entries[near]
        better = ((least < best[who]) | ((least == best[who]) & (entry < index[who]))).astype(bool)
        best[who[better]] = least[better]
        index[who[better]] = entry[better]
        return squared

    def _search(self, node, queries, who, best, index):
        if isinstance(node, np.ndarray):
            self._look(node, queries, who, best, index)
            return
        splits, low, high, children = node
        near, far = _roots(self._look(splits, queries, who, best, index))
        for j, child in enumerate(children):
            if child is None:
                continue
            # what children before this one gave counts
            reach = _roots(best[who])[1][:, None]
            misses = ((near - reach > high[:, j]) | (far + reach < low[:, j])).any(axis=1).astype(bool)
            if not misses.all():
                self._search(child, queries, who[~misses], best, index)


# --- jobs ------------------------------------------------------------------------------------


def _usable(rows: DataFrame) -> DataFrame:
    """Rows with a vector of finite components only."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & ~bad)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _as_integers(points: np.ndarray) -> np.ndarray:
    return points if points.dtype == object else np.array([[int(x) for x in row] for row in points.tolist()], object).reshape(points.shape)


class _Coder:
    """Codes blocks of vectors; trees are built once per task, those of Python integers only when needed."""

    def __init__(self, codebooks: list[np.ndarray], scale: int):
        self.codebooks, self.scale = codebooks, scale
        self.dims = codebooks[0].shape[1]
        self.fast = [Gnat(c) if _safe(c, self.dims) else None for c in codebooks]
        self.slow: list[Gnat | None] = [None] * len(codebooks)

    def parts(self, column: pa.Array):
        """For each part position: the integer parts, their entries and squared distances."""
        vectors = whole_numbers(_matrix(column), self.scale)
        for p, tree in enumerate(self.fast):
            own = vectors[:, p * self.dims : (p + 1) * self.dims]
            if own.dtype == object and max(map(abs, own.ravel().tolist()), default=0) < 2**52:
                own = own.astype(np.float64)
            if tree is not None and _safe(own, self.dims):
                yield own, *tree.nearest(own)
                continue
            if self.slow[p] is None:
                self.slow[p] = Gnat(_as_integers(self.codebooks[p]))
            own = _as_integers(own)
            yield own, *self.slow[p].nearest(own)


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            yield batch.slice(at, _BLOCK)


def _moved(vectors: DataFrame, codebooks: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """The codebooks after one round: every used entry at the rounded-down mean of its parts."""
    dims, shape = codebooks[0].shape[1], [len(c) for c in codebooks]

    def add(batches):
        coder = _Coder(codebooks, scale)
        counts = [np.zeros(n, np.int64) for n in shape]
        sums = [np.zeros((n, dims), object) for n in shape]
        for part in _blocks(batches):
            for p, (own, index, _) in enumerate(coder.parts(part.column(0))):
                counts[p] += np.bincount(index, minlength=shape[p])
                if own.dtype == object:
                    np.add.at(sums[p], index, own)
                else:
                    # such components are below 2**26, so the sums of a block are exact in float64
                    total = np.stack([np.bincount(index, own[:, d], shape[p]) for d in range(dims)], axis=1)
                    sums[p] += _as_integers(total)
        rows = [(p, e) for p in range(len(shape)) for e in np.flatnonzero(counts[p]).tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in rows], pa.int32()),
                pa.array([e for _, e in rows], pa.int32()),
                pa.array([int(counts[p][e]) for p, e in rows], pa.int64()),
                pa.array([[str(x) for x in sums[p][e]] for p, e in rows], pa.list_(pa.string())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    def total(group: pa.Table) -> pa.Table:
        """One entry's sums over all tasks; Python integers, so that none can overflow."""
        sums = [str(sum(map(int, place))) for place in zip(*group.column("sums").to_pylist(), strict=True)]
        n = pc.sum(group.column("n")).as_py()
        return pa.table({"part": group.column("part")[:1], "entry": group.column("entry")[:1], "n": pa.array([n]), "sums": pa.array([sums])})

    schema = "part int, entry int, n long, sums array<string>"
    out = [_as_integers(c).copy() for c in codebooks]
    # one row per entry: 4 x 256 at most
    for r in vectors.select("vector").mapInArrow(add, schema).groupBy("part", "entry").applyInArrow(total, schema).collect():
        out[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return [_narrow(c) for c in out]


def _narrow(points: np.ndarray) -> np.ndarray:
    """Python integers as float64 where that is exact."""
    return points.astype(np.float64) if max(map(abs, points.ravel().tolist()), default=0) < 2**52 else points


def learn_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """One codebook per part position over ``vectors`` (``id, vector``, stored); [] without any vector.

    They start as the parts of the ``entries`` smallest ids (nulls last, ties by vector) and move ``rounds`` times.
    """
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return []
    whole = _narrow(_as_integers(whole_numbers(np.array([r["vector"] for r in first], np.float64), scale)))
    codebooks = np.split(whole, parts, axis=1)
    for _ in range(rounds):
        codebooks = _moved(vectors, codebooks, scale)
    return codebooks


def encode(vectors: DataFrame, codebooks: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``id, label, code, error`` of every row of ``vectors``. An error beyond 64 bits is null."""

    def run(batches):
        coder = _Coder(codebooks, scale)
        for part in _blocks(batches):
            indexes, errors = [], []
            for _, index, squared in coder.parts(part.column(2)):
                indexes.append(index)
                errors.append(squared)
            code = np.stack(indexes, axis=1)
            error = [sum(map(int, e)) for e in zip(*errors, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(["".join(f"{i:02x}" for i in row) for row in code.tolist()], pa.string()),
                    pa.array([e if e < 2**63 else None for e in error], pa.int64()),
                ],
                names=["id", "label", "code", "error"],
            )

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("id", "label")]
    return vectors.select("id", "label", "vector").mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code string, error long")


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    """Digest of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def product_codes(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``id, code, error, label_error`` of every usable row, and the codebooks.

    Rows whose vector is null, empty, holds null or non-finite components, or has another length than
    the row of the smallest id are left out; that length must be a multiple of ``parts``, else the call fails. Rows with a
    null or repeated id are coded like any other. ``label_error`` adds up the errors of equal labels, nulls together; it
    is null if an error or the sum is beyond 64 bits. With fewer rows than ``entries`` the codebooks are as
    short. Other columns of ``rows`` are not read. An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: give 1 to 256 entries")
    plain = rows.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("vector")
    )
    kept = materialise(_usable(plain).filter(F.size("vector") > 0))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    if first:
        width = len(first[0]["vector"])
        if width % parts:
            raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
        kept = kept.filter(F.size("vector") == width)
    codebooks = learn_codebooks(kept, parts, entries, rounds, scale)
    if not codebooks:
        return kept.select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    coded = materialise(encode(kept, codebooks, scale)).withColumn("key", F.struct("label"))
    spread = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    totals = coded.groupBy("key").agg(spread.try_cast("long").alias("label_error"))
    joined = lookup_join(coded, materialise(totals), "key", "left", spread=["id"])
    return joined.select("id", "code", "error", "label_error"), codebooks


def _sql(rounds: int = ROUNDS) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
        SELECT v.vec_id, v.p, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.e}}) AS best
        FROM cut v JOIN book{r} c ON c.p = v.p GROUP BY v.vec_id, v.p
    )"""
        )
        if r < rounds:
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (
        SELECT c.p, c.e, coalesce(m.x, c.x) AS x
        FROM book{r} c LEFT JOIN (
            SELECT p, e, list(x ORDER BY i) AS x
            FROM (SELECT n.p, n.best.e AS e, i, CAST(floor(sum(v.x[i]) / count(*)) AS BIGINT) AS x
                  FROM near{r} n JOIN cut v ON v.vec_id = n.vec_id AND v.p = n.p, range(1, len(v.x) + 1) places(i) GROUP BY n.p, n.best.e, i)
            GROUP BY p, e
        ) m ON m.p = c.p AND m.e = c.e
    )"""
            )
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), cut AS MATERIALIZED (
        SELECT vec_id, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS x FROM kept, range({PARTS}) parts(p)
    ), book0 AS MATERIALIZED (
        SELECT p, e, x FROM (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x FROM cut) WHERE e < {ENTRIES}
    ), {", ".join(steps)}, coded AS (
        SELECT n.vec_id, k.label, string_agg(printf('%02x', best.e::INT), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
        FROM near{rounds} n JOIN kept k ON k.vec_id = n.vec_id GROUP BY n.vec_id, k.label
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
    FROM coded
    """


@query(sql=_sql())
def op11_codes(spark, sf_dir):
    """Codes of all ``embeddings`` by codebooks learned on all of them."""
    coded, codebooks = product_codes(table(spark, sf_dir, "embeddings"))
    return coded.withColumnRenamed("id", "vec_id").withColumn("codebooks_sha256", F.lit(codebooks_sha256(codebooks)))
