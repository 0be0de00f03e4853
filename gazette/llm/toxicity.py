"""Toxicity scores from a factorization machine over hashed terms.

``logit = b + sum w_i + 1/2 * sum_f ((sum_i v_if)**2 - sum_i v_if**2)`` over the distinct terms ``i`` of a
text. The second part weighs every pair of terms, so a pair such as an insult and a group can count
for more than its terms do alone. Terms are hashed into ``2**bits`` places; all places that two training
texts share are fitted, whatever their own link with the label, since a pair may count where neither
term does.

The machine is fitted on at most ``max_rows`` labelled rows, those with the smallest hash of their
id; that bound is what makes it safe to fit in one place. All texts are scored, whole, in the tasks.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.llm.blocks import with_columns
from gazette.llm.hashing import crc32_remainder, plain_words
from gazette.llm.registry import query, table

MAX_ROWS = 20_000
BITS = 20
RANK = 4


STEMS = (5, 7)


def terms(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed terms of a whole text; none for null or empty texts.

    Terms are the words and the beginnings of longer words (``STEMS`` bytes), which inflected and
    compound forms share.
    """
    mask = (1 << bits) - 1
    words = set(plain_words(text))
    found = {zlib.crc32(w) & mask for w in words}
    for n in STEMS:
        found.update(zlib.crc32(w, n) & mask for w in {w[:n] for w in words if len(w) > n})
    return np.array(sorted(found), np.int32)


class FactorizationMachine:
    """Weights by place; only places seen in training are held, in ascending order."""

    def __init__(self, places, weights, factors, bias):
        self.places, self.weights, self.factors, self.bias = places, weights, factors, bias

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for i, row in enumerate(rows):
            at = np.searchsorted(self.places, row)
            at, row = at[at < len(self.places)], row[at < len(self.places)]
            at = at[self.places[at] == row]
            v = self.factors[at]
            s = v.sum(axis=0)
            out[i] += self.weights[at].sum() + 0.5 * float(s @ s - (v * v).sum())
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    rank: int = RANK,
    epochs: int = 12,
    rate: float = 0.3,
    decay: float = 1e-4,
    min_docs: int = 2,
    start: float = 1.0,
    seed: int = 11,
) -> FactorizationMachine:
    """Logistic loss, mini-batches with one adaptive step length per weight (AdaGrad).

    ``start`` is what a weight's squared gradients begin with: a term seen a few times moves by its gradient
    alone, instead of a whole step each time, which is what keeps the many rare terms from learning the
    training texts by heart.
    """
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int32)
    places, counts = np.unique(flat, return_counts=True)
    places = places[counts >= min_docs]
    share = float(labels.mean()) if len(labels) else 0.0
    share = min(max(share, 1e-3), 1 - 1e-3)
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(places)), rng.normal(0, 0.01, (len(places), rank)), float(np.log(share / (1 - share)))
    if not len(places) or len(set(labels.tolist())) < 2:
        return FactorizationMachine(places, w, np.zeros_like(v), bias)
    # all rows as one array of weight numbers, cut by ``ends``
    held = np.isin(flat, places)
    row_of = np.repeat(np.arange(len(rows)), lengths)[held]
    known = np.searchsorted(places, flat[held]).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row_of, minlength=len(rows)))])
    place = np.zeros(len(places), np.int64)  # a batch's own numbers of the weights it uses, 0 in between
    v = np.ascontiguousarray(v.T)  # factor by factor, so that every step runs along memory
    gw, gv, gb = np.full(len(places), start), np.full(v.shape, start), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), 64):
            batch = order[first : first + 64]
            sizes = ends[batch + 1] - ends[batch]
            at = np.concatenate([known[ends[i] : ends[i + 1]] for i in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            va = np.take(v, at, axis=1)
            s = _sums(va, row, len(batch))
            linear = np.bincount(row, w[at], len(batch))
            squares = np.bincount(row, np.einsum("fi,fi->i", va, va), len(batch))
            z = bias + linear + 0.5 * ((s * s).sum(axis=0) - squares)
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]
            place[at] = 1
            used = np.flatnonzero(place)
            place[used] = np.arange(len(used))
            inverse = place[at]
            place[used] = 0
            each = np.repeat(d, sizes)
            grad = np.bincount(inverse, each, len(used)) / len(batch) + decay * w[used]
            gw[used] += grad * grad
            w[used] -= rate * grad / np.sqrt(gw[used])
            pull = (np.repeat(s, sizes, axis=1) - va) * each
            grad_v = _sums(pull, inverse, len(used)) / len(batch) + decay * v[:, used]
            gv[:, used] += grad_v * grad_v
            v[:, used] -= 0.2 * rate * grad_v / np.sqrt(gv[:, used])
            g = float(d.mean())
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
    return FactorizationMachine(places, w, np.ascontiguousarray(v.T), bias)


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the columns of ``values`` by group number, for each of its rows."""
    return np.stack([np.bincount(group, row, n) for row in values])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
    bits: int = BITS,
    **options,
) -> FactorizationMachine:
    """Fit on at most ``max_rows`` labelled ids.

    Null ids and labels are left out; an id labelled more than once is positive if any label is.
    Of the texts of a repeated id the least counts, so ``max_rows`` bounds the texts too; an id with null texts
    alone counts as an empty text. Without positives or without negatives the score is constant.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .dropna()
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)  # the bound that lets the sample be broadcast and fitted in one place
    )
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id", "y").agg(F.min("text").alias("text"))

    def featurise(batch):
        rows = [terms(t, bits).tolist() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return [pa.array(rows, pa.list_(pa.int32()))]

    found = with_columns(sample.select("id", "text", "y"), "terms array<int>", featurise)
    got = found.select("id", "y", "terms").toArrow().sort_by("id")
    lists = got.column("terms").combine_chunks()
    cuts = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    rows = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return fit(rows, got.column("y").to_numpy().astype(float), **options)


def score(
    docs: DataFrame, model: FactorizationMachine, text_col: str = "text", bits: int = BITS, threshold: float = 0.5
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``); empty texts have the bias's score."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits places

    def predict(batch):
        col = batch.column(at).cast(pa.binary())
        found = shared.value.scores([terms(t, bits) for t in col.to_pylist()])
        return [pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())]

    return with_columns(docs, "score double, predicted int", predict)


@query()
def op8_toxicity(spark, sf_dir):
    """Toxicity of all ``documents``; a fifth of the labelled ones is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    held_out = crc32_remainder(F.col("doc_id"), 5) == 0
    model = learn(docs, labels.filter(~held_out))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", "predicted"
    )
