"""Exact top-k inner products: candidates by descending length, partial sums in a rotated basis.

Components become integers, so scores are exact. The right singular vectors of all candidates
(from their Gram matrix, one partial sum per task) give a rotation that moves most of a product
into its first coordinates. A candidate's score for a query is at most

    ``partial sum + |rest of the query| * |rest of the candidate|``        (Cauchy-Schwarz)

and every later candidate is at most ``|query| * |candidate|``, since lengths only fall. Vectors are
packed into blocks; a task streams the blocks of one stripe of candidates by descending length
past one block of queries, holding two blocks and the best rows so far, so neither side needs to
fit anywhere. Queries lie in blocks of their own size, however many partitions the session names: a
query block travels once to each stripe, and a candidate once for each query block.

Vectors that are null, or hold a null or non-finite component, take no part. Vectors shorter than the
longest count as padded with zeros. Repeated vectors are candidates on their own; equal scores go to
the smaller id. Components of any finite size count whole: products beyond the exact range of doubles are
taken in 64-bit integers, and beyond those in Python's. Scores outside the range of a long are held at its
ends and tie there.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gazette.llm.registry import query, table
from gazette.plans.store import materialise

_QUERIES = 8  # times as many rows of a block of queries, up to ...
_QUERY_BYTES = 1 << 22
_STRIPES = 64  # of candidates, at most
_EXACT = 2.0**53  # doubles from here on are whole numbers themselves
_LONG = 2**63 - 1


def _integers(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    times = F.transform(F.col(vec_col), lambda x: x.cast("double") * scale)
    scaled = F.transform(times, lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x))
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.filter(F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if len(flat) == len(column) * width:
        out[:] = flat.reshape(-1, width)
    else:
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of outer products; one flat row per (row, column) cell after map-side sums."""

    def partial(batches):
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(1), width)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": np.arange(width * width), "x": total.ravel()})

    cells = vectors.mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for i, x in cells:  # width**2 cells, whatever the number of vectors
        out[i] = x
    return out.reshape(width, width) if np.isfinite(out).all() else np.eye(width)  # any rotation gives right results


def _packed(vectors: DataFrame, width: int, rows: int, parts: int, spread) -> DataFrame:
    """Blocks of at most ``rows`` vectors: ``block long, top double, ids binary, data binary``.

    A range partitioning by descending length keeps vectors of like length together; ``spread``
    makes the number that a block is dealt by.
    """
    ordered = vectors.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")

    def pack(batches):
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                m = _matrix(part.column(1), width)
                norms = part.column(2).to_numpy()
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([spread(task, count)], pa.int64()),
                        "top": pa.array([norms.max()], pa.float64()),
                        "ids": pa.array([part.column(0).to_numpy().tobytes()], pa.binary()),
                        "data": pa.array([m.tobytes()], pa.binary()),
                    }
                )
                count += 1

    return ordered.mapInArrow(pack, "block long, top double, ids binary, data binary")


def _best(ids, scores, k):
    """The k best of one query: highest score, then smallest id."""
    order = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, and has no overflow
    return ids[order], scores[order]


def _scores(raw: np.ndarray, query_row: np.ndarray, most: float) -> np.ndarray:
    """Whole inner products of all rows with one; no partial sum is above ``most``."""
    if most < _EXACT:
        return (raw @ query_row).astype(np.int64)
    if most < _LONG / 2:
        return raw.astype(np.int64) @ query_row.astype(np.int64)
    one = [int(x) for x in query_row]
    found = [sum(a * int(b) for a, b in zip(one, row, strict=True)) for row in raw]
    return np.array([min(max(x, -_LONG - 1), _LONG) for x in found], np.int64)


def _search(batches, rotation, head, width, k, strip):
    """Streams (query block, candidate blocks by descending length) of every stripe; yields each query's best."""
    state = None

    def started(key, ids, raw):
        turned = raw @ rotation
        return {
            "key": key,
            "ids": ids,
            "raw": raw,
            "head": turned[:, :head],
            "rest": np.linalg.norm(turned[:, head:], axis=1),
            "norm": np.linalg.norm(raw, axis=1),
            "most": float(np.abs(raw).max(initial=0)),
            "best_ids": [np.empty(0, np.int64)] * len(ids),
            "best": [np.empty(0, np.int64)] * len(ids),
            "floor": np.full(len(ids), -np.inf),
        }

    def done():
        ids, best_ids, best_scores = state["ids"], state["best_ids"], state["best"]
        q = np.repeat(ids, [len(x) for x in best_ids])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(q, pa.int64()),
                pa.array(np.concatenate(best_ids) if len(q) else [], pa.int64()),
                pa.array(np.concatenate(best_scores) if len(q) else [], pa.int64()),
            ],
            names=["query_id", "vec_id", "score"],
        )

    def compare(ids, raw, top):
        s = state
        slack = 1e-6 * (1 + s["norm"] * top)  # far above rounding, far below what would cost work
        # said so that an undefined bound rules out nothing
        every = np.flatnonzero(~(s["norm"] * top + slack < s["floor"]))
        if not len(every):
            return
        turned = raw @ rotation
        rest = np.linalg.norm(turned[:, head:], axis=1)
        most = s["most"] * float(np.abs(raw).max(initial=0)) * width
        for open_ in (every[at : at + strip] for at in range(0, len(every), strip)):
            bound = s["head"][open_] @ turned[:, :head].T
            bound += np.outer(s["rest"][open_], rest)
            bound += slack[open_, None]
            passed = ~(bound < s["floor"][open_, None])
            passed &= s["ids"][open_, None] != ids
            exact = None
            if most < _EXACT and passed.any():  # the products of whole rows at once
                exact = s["raw"][open_] @ raw.T
                passed &= exact >= s["floor"][open_, None]
            for row in np.flatnonzero(passed.any(axis=1)):
                i, hit = open_[row], np.flatnonzero(passed[row])
                scores = _scores(raw[hit], s["raw"][i], most) if exact is None else exact[row, hit].astype(np.int64)
                s["best_ids"][i], s["best"][i] = _best(
                    np.concatenate([s["best_ids"][i], ids[hit]]), np.concatenate([s["best"][i], scores]), k
                )
                if len(s["best"][i]) == k:
                    s["floor"][i] = float(s["best"][i][-1])

    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)
        for at, (qb, stripe, is_candidate, top) in enumerate(keys):
            ids = np.frombuffer(b.column(4)[at].as_buffer(), np.int64)
            raw = np.frombuffer(b.column(5)[at].as_buffer()).reshape(-1, width)
            if is_candidate:
                compare(ids, raw, top)
                continue
            if state is not None:
                yield done()
            state = started((qb, stripe), ids, raw)
    if state is not None:
        yield done()


def topk_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    block_rows: int = 1024,
    head_share: float = 0.25,
    stripes: int | None = None,
) -> DataFrame:
    """The ``k`` best other vectors of each query: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on ``vectors``; every other row is a candidate, and queries are
    candidates of each other. Candidate blocks are dealt to ``stripes`` in turn along falling
    lengths, so each stripe starts with long vectors and prunes the rest. The shuffle carries the
    query blocks once per stripe and the candidates once per query block.
    """
    spark = vectors.sparkSession
    ints = _integers(vectors.filter(F.col(id_col).isNotNull()), id_col, vec_col, scale)
    asked = _integers(vectors.filter(F.col(id_col).isNotNull() & is_query), id_col, vec_col, scale)
    width, n_rows = ints.agg(F.max(F.size("v")), F.count("*")).first()
    width, n_asked = width or 1, asked.count()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")
    ints, asked = ints.select("id", "v", norm), asked.select("id", "v", norm)
    _, basis = np.linalg.eigh(_gram(ints.select("id", "v"), width))
    rotation = np.ascontiguousarray(basis[:, ::-1])
    head = max(1, round(width * head_share))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = stripes or max(1, min(_STRIPES, -(-n_rows // block_rows)))

    def ranges(n, rows):  # as many as there are blocks, so that blocks are full
        return max(1, min(parts, -(-n // rows)))

    # consecutive blocks along the falling lengths go to different stripes
    candidates = _packed(ints, width, block_rows, ranges(n_rows, block_rows), lambda task, i: task + i)
    q_rows = max(block_rows, min(block_rows * _QUERIES, _QUERY_BYTES // (8 * width)))
    # stored, since a block's number depends on how its rows were partitioned, and both sides need it
    asked_blocks = materialise(_packed(asked, width, q_rows, ranges(n_asked, q_rows), lambda task, i: (task << 32) + i))
    numbers = asked_blocks.select(F.col("block").alias("qb"))
    queries = asked_blocks.select(
        F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(False).alias("is_candidate"), "top", "ids", "data"
    )
    met = candidates.crossJoin(F.broadcast(numbers)).select(
        "qb", F.pmod("block", F.lit(stripes)).cast("int").alias("stripe"), F.lit(True).alias("is_candidate"), "top", "ids", "data"
    )
    cells = (
        queries.unionByName(met)
        .repartition(parts, "qb", "stripe")
        .sortWithinPartitions("qb", "stripe", "is_candidate", F.desc("top"))
    )
    found = cells.mapInArrow(
        lambda batches: _search(batches, rotation, head, width, k, block_rows), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


@query(
    sql="""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 100 = 0
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """
)
def op2_topk_search(spark, sf_dir):
    """The 10 best of every 100th vector against all rows of ``embeddings``."""
    return topk_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
