"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +-1, drawn from its code point. A letter n-gram is bound by multiplying
its letters' vectors, each rotated by its place; a text is the bundle (sum) of its n-grams, and a
language the bundle of its training texts. A text is of the language whose prototype has the highest
cosine to it.

Letters are lower-cased Unicode letters; runs of anything else count as one blank, which is a symbol
too. Only distinct n-grams of a text are bound, times their counts, which gives the same sum.
"""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.llm.blocks import column, slices, with_columns
from gazette.llm.hashing import crc32_remainder
from gazette.llm.registry import query, table

UNDETERMINED = "und"
_KNOWN_GRAMS = 32_768  # rows of n-gram vectors that a worker keeps; others are bound again when met


class Encoder:
    """Binds the letter n-grams of texts into vectors of ``dims`` numbers."""

    def __init__(self, dims: int, n: int, seed: int):
        self.dims, self.n, self.seed = dims, n, seed
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[int, int] = {}
        self.rows = np.zeros((1024, dims), np.int8)
        self.kind = np.full(0x110000, -1, np.int32)  # code point -> lower-case letter, 0 for others

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def _bind(self, gram: int) -> np.ndarray:
        out = np.ones(self.dims, np.int8)
        for place in range(self.n):
            out = out * np.roll(self._letter((gram >> (21 * place)) & 0x1FFFFF), place)
        return out

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        if len(self.grams) + len(grams) > _KNOWN_GRAMS:
            self.grams.clear()
        at = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            row = self.grams.get(g)
            if row is None:
                row = self.grams[g] = len(self.grams)
                if row == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[row] = self._bind(g)
            at[i] = row
        return self.rows[at].astype(np.float32)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, as packed code points, and how often each occurs; none without a letter."""
        codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        kind = self.kind[codes]
        if (kind < 0).any():
            for c in np.unique(codes[kind < 0]).tolist():
                low = chr(c).lower()
                self.kind[c] = ord(low[0]) if unicodedata.category(low[0])[0] == "L" else 0
            kind = self.kind[codes]
        if not kind.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keep = (kind > 0) | (np.concatenate([[1], kind[:-1]]) > 0)
        symbols = np.concatenate([[0], kind[keep], [0] * self.n]).astype(np.int64)
        size = len(symbols) - self.n + 1
        grams = sum(symbols[p : p + size] << (21 * p) for p in range(self.n))
        return np.unique(grams, return_counts=True)

    def bundle(self, text: str | None) -> np.ndarray | None:
        grams, counts = self.counts(text)
        if not len(grams):
            return None
        out = np.zeros(self.dims)
        for at in range(0, len(grams), 2048):
            out += counts[at : at + 2048].astype(np.float32) @ self._vectors(grams[at : at + 2048])
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(dims: int, n: int, seed: int) -> Encoder:
    """One encoder per worker process, so that n-grams are bound once."""
    if (dims, n, seed) not in _encoders:
        _encoders[dims, n, seed] = Encoder(dims, n, seed)
    return _encoders[dims, n, seed]


def learn_prototypes(
    texts: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, n: int = 3, seed: int = 7
) -> dict[str, np.ndarray]:
    """The bundle of every language's texts. Null texts and languages teach nothing.

    Tasks add up their texts per language; Spark adds the parts per (language, dimension), combined
    on the map side. What reaches the driver is one vector per language.
    """

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for text, lang in zip(column(b, "text"), column(b, "lang"), strict=True):
                v = encoder(dims, n, seed).bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dims, "dim": np.arange(dims, dtype=np.int32), "x": v})

    taught = texts.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    sums = taught.mapInArrow(partial, "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    per_lang = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("cells"))
    out = {}
    for lang, cells in per_lang.collect():
        v = np.zeros(dims)
        for d, x in cells:
            v[d] = x
        out[lang] = v
    return out


def identify(
    docs: DataFrame,
    prototypes: dict[str, np.ndarray],
    text_col: str = "text",
    n: int = 3,
    seed: int = 7,
    lang_name: str = "lang_pred",
    score_name: str = "score",
) -> DataFrame:
    """``docs`` with the nearest language and its cosine, from 0 to 1.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was
    learnt. Ties go to the first language in alphabetical order. Columns of those names are replaced;
    all others stay.
    """
    langs = sorted(prototypes)
    dims = len(prototypes[langs[0]]) if langs else 1
    unit = np.array([prototypes[k] / (np.linalg.norm(prototypes[k]) or 1) for k in langs]).reshape(len(langs), dims)
    at = docs.columns.index(text_col)

    def predict(batch):
        lang, score = [], []
        for text in batch.column(at).to_pylist():
            v = encoder(dims, n, seed).bundle(text) if langs else None
            norm = 0 if v is None else np.linalg.norm(v)
            if not norm:
                lang.append(UNDETERMINED)
                score.append(0.0)
                continue
            cosine = unit @ v / norm
            best = int(np.argmax(cosine))
            lang.append(langs[best])
            score.append(float(min(1.0, max(0.0, cosine[best]))))
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return with_columns(docs, f"{lang_name} string, {score_name} double", predict)


@query()
def op6_language_id(spark, sf_dir):
    """Languages of all ``documents``; a third of them is held out of the prototypes."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_remainder(F.col("doc_id"), 3) == 1
    prototypes = learn_prototypes(docs.filter(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), prototypes).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
