"""Language-model scores by deleted interpolation.

``p(w | v) = a * c(v, w) / c(v) + b * c(w) / N + c / (V + 1)``, with one set of mixture weights ``(a, b, c)`` per
bucket of context frequency ``c(v)``. The weights are learned by expectation-maximisation on deleted
counts: every training token is predicted from counts without that occurrence. The context of a
text's first word is the end token.

Counts are exchanged as packed arrays. Documents are dealt to blocks; a block sends the sorted
distinct keys (words and word pairs, as 64-bit hashes) of its documents with its training counts, cut
by hash range; a range adds up all blocks and answers each with the totals of its keys in the same
order. So a key crosses the network once per block, however frequent it is, and no task holds more than
one block or one range.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gazette.llm.hashing import Words, crc32_remainder, lower_words, mix
from gazette.llm.registry import query, table
from gazette.plans.store import materialise

BLOCK_BYTES = 1 << 23
_SLICE_BYTES = 1 << 18  # text hashed at a time
LEAST_BLOCKS = 8
_RANGE_BYTES = 1 << 23  # text per hash range
_BUCKETS = 32
_STEPS = 8  # steps of probability per power of two, for learning the weights
_END = np.uint64(0x2545F4914F6CDD1D)
_WORD, _PAIR = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _token_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of every token and of its pair with the token before, and the token counts of the texts."""
    sizes = np.cumsum([len(t or b"") for t in texts])
    cuts = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1], _SLICE_BYTES), side="left")) if len(sizes) else []
    # a slice starts at a text, before which an end stands, so slices do not depend on one another
    held = [_slice_keys(texts[a:b]) for a, b in itertools.pairwise([*cuts, len(texts)]) if b > a]
    return tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else _slice_keys(texts)


def _slice_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words([lower_words(t) for t in texts])
    counts = np.diff(words.first) + 1
    ends = np.cumsum(counts) - 1
    hashes = np.empty(int(counts.sum()), np.uint64)
    inner = np.ones(len(hashes), bool)
    inner[ends] = False
    hashes[inner] = words.hashes() if words.n else []
    hashes[ends] = _END
    before = np.concatenate([[_END], hashes[:-1]])  # an end stands before every first word
    return mix(hashes ^ _WORD), mix(before * _PAIR + hashes), counts


def _block_keys(group: pa.Table):
    """Distinct keys of a block in order, where each token's word and pair are among them, and training counts."""
    texts = group.column("text").cast(pa.binary()).to_pylist()
    word, pair, counts = _token_keys(texts)
    taught = np.repeat(~np.array(group.column("held_out").to_pylist(), bool), counts)
    # words and pairs one after the other: sorting both at once took twice the memory
    found = [_distinct(x, taught) for x in (word, pair)]
    del word, pair
    keys = np.concatenate([f[0] for f in found])
    order = np.argsort(keys)
    spot = np.empty(len(keys), np.int32)
    spot[order] = np.arange(len(keys), dtype=np.int32)
    cut = len(found[0][0])
    place = np.concatenate([spot[:cut][found[0][1]], spot[cut:][found[1][1]]])
    return keys[order], place, np.concatenate([f[2] for f in found])[order], counts


def _distinct(keys: np.ndarray, taught: np.ndarray):
    """Distinct keys in order, the place of every key among them, and how many of them are training tokens."""
    distinct, place = np.unique(keys, return_inverse=True)
    place = place.astype(np.int32)
    return distinct, place, np.bincount(place[taught], minlength=len(distinct))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: high bytes are mostly zero, which the shuffle's compression then finds."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _send(bits: int):
    def run(group: pa.Table) -> pa.Table:
        keys, _, own, _ = _block_keys(group)
        block = group.column("block")[0].as_py()
        cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(keys)])
        parts = np.flatnonzero(np.diff(cuts)).tolist()
        return pa.table(
            {
                "part": pa.array(parts, pa.int32()),
                "block": pa.array([block] * len(parts), pa.int64()),
                "keys": pa.array([_planes(np.diff(keys[cuts[p] : cuts[p + 1]], prepend=np.uint64(0))) for p in parts], pa.binary()),
                "counts": pa.array([_planes(own[cuts[p] : cuts[p + 1]].astype(np.int32)) for p in parts], pa.binary()),
            }
        )

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Totals over all blocks of the keys of one hash range, for each block in its own order."""
    blocks = group.column("block").to_pylist()
    # the keys of a block are sorted and sent as differences
    keys = [np.cumsum(_from_planes(x, np.uint64), dtype=np.uint64) for x in group.column("keys").to_pylist()]
    counts = np.concatenate([_from_planes(x, np.int32) for x in group.column("counts").to_pylist()])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, counts).astype(np.int64)[place]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    part = group.column("part")[0].as_py()
    return pa.table(
        {
            "block": pa.array(blocks, pa.int64()),
            "part": pa.array([part] * len(blocks), pa.int32()),
            "totals": pa.array([_planes(t) for t in np.split(totals, cuts)], pa.binary()),
        }
    )


def _resolve(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """``id, held_out, words, pairs``: training counts of every token's word and pair."""
    _, place, _, counts = _block_keys(docs)
    answers = answers.sort_by("part")
    totals = np.concatenate([_from_planes(x, np.int64) for x in answers.column("totals").to_pylist()])[place]
    n = len(totals) // 2
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    del place
    pa.default_memory_pool().release_unused()
    return pa.table(
        {
            "id": docs.column("id"),
            "held_out": docs.column("held_out"),
            "words": pa.ListArray.from_arrays(offsets, pa.array(totals[:n])),
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(totals[n:])),
        }
    )


def token_counts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bytes: int = _RANGE_BYTES) -> DataFrame:
    """Per row of ``docs`` (``id, text, held_out``): training counts of its tokens and pairs, in turn.

    The last token is the end token. Rows are dealt to blocks by a hash of the row.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = max(LEAST_BLOCKS, -(-size // block_bytes))
    bits = int(size // range_bytes).bit_length()
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(n_blocks)))
    answers = (
        dealt.groupBy("block")
        .applyInArrow(_send(bits), "part int, block long, keys binary, counts binary")
        .groupBy("part")
        .applyInArrow(_answer, "block long, part int, totals binary")
    )
    kind = docs.schema["id"].dataType.simpleString()
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_resolve, f"id {kind}, held_out boolean, words array<long>, pairs array<long>")
    )


def _few(batches, rows: int = 512):
    """The batches in pieces of a few rows, since work on their flat counts takes many times their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def _columns(batch, start):
    """Flat counts of a batch of ``token_counts`` rows, and the count of the token before each."""
    words, pairs = batch.column(start), batch.column(start + 1)
    sizes = np.diff(words.offsets.to_numpy())
    return words.flatten().to_numpy(), pairs.flatten().to_numpy(), sizes


def _contexts(words: np.ndarray, sizes: np.ndarray, n_ends: int) -> np.ndarray:
    before = np.concatenate([[n_ends], words[:-1]])
    before[np.cumsum(sizes)[:-1]] = n_ends
    return before


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else its number of binary digits."""
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), _BUCKETS - 1)


def _step(p: np.ndarray) -> np.ndarray:
    """Probability in steps of its logarithm; 0 for none."""
    return np.where(p > 0, 1 + np.round(-np.log2(np.maximum(p, 1e-300)) * _STEPS), 0).astype(np.int64)


def learn_weights(cells: list[tuple[int, int, int, int]], vocabulary: int, rounds: int = 50) -> np.ndarray:
    """Mixture weights (pair, word, uniform) per bucket from (bucket, pair step, word step, tokens) cells."""
    weights = np.tile([0.3, 0.6, 0.1], (_BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    if not cells:
        return weights
    bucket, pair, word, n = np.array(cells, np.int64).T
    chance = np.stack(
        [
            np.where(pair > 0, 2.0 ** (-(pair - 1) / _STEPS), 0),
            np.where(word > 0, 2.0 ** (-(word - 1) / _STEPS), 0),
            np.full(len(n), 1 / (vocabulary + 1)),
        ],
        axis=1,
    )
    for _ in range(rounds):
        share = weights[bucket] * chance
        share *= (n / share.sum(axis=1))[:, None]
        mass = np.stack([np.bincount(bucket, share[:, k], _BUCKETS) for k in range(3)], axis=1)
        seen = mass.sum(axis=1) > 0
        # a little of every part stays, so that no token gets probability 0
        mass[seen] += 1e-3 * mass[seen].sum(axis=1, keepdims=True) / 3
        weights[seen] = mass[seen] / mass[seen].sum(axis=1, keepdims=True)
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def interpolated_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Rows for which ``held_out`` is not true teach the model. Null texts are empty; an empty text is
    the end token alone. Scores are log10. ``base_score`` is an add-half unigram model on the same counts.
    Without any training row all tokens share the uniform probability.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counted = materialise(token_counts(rows))
    n_ends = counted.filter("NOT held_out").count()

    def words_seen(batches):
        for b in _few(batches):
            values, n = np.unique(_columns(b, 0)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["c", "n"])

    taught = counted.filter("NOT held_out").select("words", "pairs")
    # a word with count c occurs c times, so n tokens of that count are n / c words
    total, vocabulary = (
        taught.mapInArrow(words_seen, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.sum(F.expr("n div c"))).first()
    )
    total, vocabulary = total or 0, vocabulary or 0

    def deleted(batches):
        for b in _few(batches):
            words, pairs, sizes = _columns(b, 0)
            context = _contexts(words, sizes, n_ends) - 1
            by_pair = np.where(context > 0, (pairs - 1) / np.maximum(context, 1), 0)
            by_word = (words - 1) / max(total - 1, 1)
            cell, n = np.unique(_bucket(context) << 40 | _step(by_pair) << 20 | _step(by_word), return_counts=True)
            parts = cell >> 40, cell >> 20 & 0xFFFFF, cell & 0xFFFFF
            yield pa.RecordBatch.from_arrays([*map(pa.array, parts), pa.array(n)], names=["b", "p", "w", "n"])

    # buckets and steps are few, so there are at most some ten thousand cells at any size
    cells = taught.mapInArrow(deleted, "b long, p long, w long, n long").groupBy("b", "p", "w").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([tuple(c) for c in cells], vocabulary)

    def score(batches):
        for b in _few(batches):
            words, pairs, sizes = _columns(b, 2)
            context = _contexts(words, sizes, n_ends)
            w = weights[_bucket(context)]
            p = w[:, 0] * pairs / np.maximum(context, 1) + w[:, 1] * words / max(total, 1) + w[:, 2] / (vocabulary + 1)
            if not total:
                p = np.ones(len(words))
            base = np.log10((words + 0.5) / (total + 0.5 * (vocabulary + 1)))
            starts = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(np.add.reduceat((words > 0).astype(np.int64), starts) if len(sizes) else sizes.astype(np.int64)),
                    pa.array(np.full(len(sizes), total, np.int64)),
                    pa.array(np.add.reduceat(base, starts) if len(sizes) else np.empty(0)),
                    pa.array(np.add.reduceat(np.log10(p), starts) if len(sizes) else np.empty(0)),
                ],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return counted.select("id", "held_out", "words", "pairs").mapInArrow(
        score,
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


@query()
def op5_lm_score(spark, sf_dir):
    """Scores of all ``documents``; a fifth of them is held out of the counts."""
    docs = table(spark, sf_dir, "documents")
    return interpolated_scores(docs, crc32_remainder(F.col("doc_id"), 5) == 1).withColumnRenamed("id", "doc_id")
