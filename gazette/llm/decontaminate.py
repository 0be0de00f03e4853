"""Benchmark decontamination with one FM-index per shard of training text.

A shard is a run of documents of bounded size inside a task. Its words that no benchmark phrase has
become breaks, and runs between breaks that are shorter than the shortest phrase cannot hold one and
are left out; the rest, as numbers, is indexed:

* suffixes are sorted by doubling, breaks being all different and smaller than words;
* the Burrows-Wheeler transform is kept in a wavelet tree, whose level bits answer rank queries;
* all phrases are searched backwards at once, one word of each per step;
* hits are located by walking back to sampled suffix positions.

Located phrases become word spans, which are merged per document and may be cut out of its text.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gazette.llm.blocks import shards, texts
from gazette.llm.hashing import Words, plain_words
from gazette.llm.registry import query, table

PHRASE_WORDS = 10
SHARD_BYTES = 1 << 23
BLOCK_BYTES = 1 << 25
_SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order, by doubling; only unsettled ones are re-sorted."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    rank = rank.astype(np.int64)
    # rank of a suffix = start of its group in the order
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = start
    step = 1
    while True:
        groups = np.flatnonzero(~(first & np.append(first[1:], True)))  # places in groups of two or more
        if not len(groups):
            return order
        at = order[groups]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        again = np.lexsort((after, rank[at]))
        at, after, lead = at[again], after[again], rank[at][again]
        order[groups] = at
        first[groups] = np.concatenate([[True], (lead[1:] != lead[:-1]) | (after[1:] != after[:-1])])
        rank[at] = np.maximum.accumulate(np.where(first[groups], groups, 0))
        step *= 2


class WaveletTree:
    """Rank queries on a sequence of small numbers: one bit vector per binary digit, high to low."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each value occurs before each place."""
        low, high = np.zeros_like(place), place
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = ((value >> level) & 1).astype(bool)
            ones_low, ones_high = self.ones[i][low], self.ones[i][high]
            low = np.where(bit, self.zeros[i] + ones_low, low - ones_low)
            high = np.where(bit, self.zeros[i] + ones_high, high - ones_high)
        return high - low

    def access(self, place: np.ndarray) -> np.ndarray:
        value = np.zeros_like(place)
        for i in range(self.bits):
            ones = self.ones[i]
            bit = ones[place + 1] - ones[place]
            value = 2 * value + bit
            place = np.where(bit == 1, self.zeros[i] + ones[place], place - ones[place])
        return value


class FMIndex:
    """Index over word numbers from 1; 0 is a break, which no phrase can span."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        breaks = symbols == 0
        top = int(symbols.max(initial=0))
        unique = np.where(breaks, np.cumsum(breaks) - 1, symbols + int(breaks.sum()))
        order = suffix_order(unique)
        self.bwt = WaveletTree(symbols[order - 1].astype(np.int32), max(1, top.bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        # positions are sampled evenly and behind every break, so a walk back never crosses one
        kept = (order % _SAMPLE == 0) | breaks[order - 1]
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.sample = order[kept]
        self.top = top

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length; ``phrases`` is a matrix of word numbers."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.bwt.n)
        for step in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[:, step]
            inside = word <= self.top
            word = np.where(inside, word, 0)
            start = self.before[word]
            low, high = start + self.bwt.rank(word, low), start + self.bwt.rank(word, high)
            high = np.where(inside, high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the index."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            sampled = self.kept[rows + 1] > self.kept[rows]
            out[todo[sampled]] = self.sample[self.kept[rows[sampled]]] + steps
            todo, rows = todo[~sampled], rows[~sampled]
            word = self.bwt.access(rows)
            rows = self.before[word] + self.bwt.rank(word, rows)
            steps += 1
        return out


class Phrases:
    """Distinct phrases of a block of benchmark items, as word numbers, by length."""

    def __init__(self, items: list[tuple[object, bytes | None]], length: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        self.items = []
        for item, text in items:
            words = [self.words.setdefault(w, len(self.words) + 1) for w in plain_words(text)]
            self.items.append(item)
            for i in range(max(1, len(words) - length + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + length]), set()).add(len(self.items) - 1)
        by_length: dict[int, list] = {}
        for phrase in owners:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.groups = [(np.array(p, np.int64), [sorted(owners[x]) for x in p]) for _, p in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def _indexable(numbers: np.ndarray, text: np.ndarray, shortest: int) -> np.ndarray:
    """Places of words in runs, within a text, of at least ``shortest`` words that phrases have."""
    known = numbers > 0
    edge = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (text[1:] != text[:-1])]))
    size = np.diff(np.append(edge, len(numbers)))
    return np.flatnonzero(np.repeat(known[edge] & (size >= shortest), size))


def find_phrases(tokens: list[list[bytes]], phrases: Phrases) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: first word, end word (exclusive) and item of every occurrence."""
    none = (np.empty(0, np.int64),) * 3
    out = [none] * len(tokens)
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    number = phrases.words.get
    flat = np.fromiter((number(w, 0) for t in tokens for w in t), np.int64, int(counts.sum()))
    if not len(flat) or not phrases.groups:
        return out
    text = np.repeat(np.arange(len(tokens)), counts)
    place = _indexable(flat, text, phrases.shortest)
    if not len(place):
        return out
    split = np.flatnonzero((np.diff(place) != 1) | (np.diff(text[place]) != 0)) + 1
    origin = np.concatenate([np.insert(place, split, -1), [-1]])
    symbols = np.where(origin >= 0, flat[origin], 0)
    index = FMIndex(np.concatenate([[0], symbols]))
    found = []
    for matrix, owners in phrases.groups:
        low, high = index.search(matrix)
        n = high - low
        which = np.repeat(np.arange(len(matrix)), n)
        if len(which):
            rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            found.append((origin[index.locate(rows) - 1], np.full(len(which), matrix.shape[1]), [owners[i] for i in which]))
    if not found:
        return out
    start = np.concatenate([f[0] for f in found])
    size = np.concatenate([f[1] for f in found])
    owner = [o for f in found for o in f[2]]
    repeat = np.fromiter(map(len, owner), np.int64, len(owner))
    item = np.fromiter((i for o in owner for i in o), np.int64, int(repeat.sum()))
    start, size = np.repeat(start, repeat), np.repeat(size, repeat)
    doc = text[start]
    order = np.argsort(doc, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)])
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    for part in np.split(order, cuts):
        d = doc[part[0]]
        begin = start[part] - first[d]
        out[d] = (begin, begin + size[part], item[part])
    return out


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans that the given ones cover; spans that touch are joined."""
    out: list[list[int]] = []
    for s, e in sorted(zip(np.asarray(start).tolist(), np.asarray(end).tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """Lists of (item, text) with at most ``limit`` bytes each, read one after the other.

    Items without an id are left out. One block at a time is on the driver and in the tasks, so a
    benchmark of any size takes more passes, not more memory.
    """
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    block, size = [], 0
    for item, text in rows.orderBy("item", "text").toLocalIterator():
        block.append((item, text.encode()))
        size += len(block[-1][1])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    phrase_words: int = PHRASE_WORDS,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``id, n_words, spans, items``.

    ``spans`` are the merged word spans covered by phrases and ``items`` the sorted distinct ids, as
    strings, of items with a phrase in the document. A phrase is ``phrase_words`` words of an item in a
    row; an item with fewer words, but not none, is one phrase. A null text has no words. Rows are
    kept as they are, repeated ids too, as long as one benchmark block is enough; with more blocks,
    rows of the same id are merged.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    if docs.schema[id_col].dataType.typeName() != "long":
        schema = schema.replace("id long", f"id {docs.schema[id_col].dataType.simpleString()}", 1)

    def one_pass(block):
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(block, phrase_words))  # at most block_bytes of text

        def search(batches):
            names = shared.value.items
            for group in shards(batches, "text", shard_bytes):
                tokens = [plain_words(t) for part in group for t in texts(part)]
                hits = find_phrases(tokens, shared.value)
                at = 0
                for part in group:
                    own = hits[at : at + part.num_rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            pa.array([len(t) for t in tokens[at : at + part.num_rows]], pa.int64()),
                            pa.array(
                                [[{"start": s, "end": e} for s, e in merged(h[0], h[1])] for h in own],
                                pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                            ),
                            pa.array([sorted({str(names[i]) for i in set(h[2].tolist())}) for h in own], pa.list_(pa.string())),
                        ],
                        names=["id", "n_words", "spans", "items"],
                    )
                    at += part.num_rows

        return rows.mapInArrow(search, schema)

    passes = [one_pass(b) for b in benchmark_blocks(benchmark, item_col, "text", block_bytes)] or [one_pass([])]
    if len(passes) == 1:
        return passes[0]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    # overlapping spans of different blocks are joined in order of their start
    folded = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return every.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        folded.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_words(text: str, spans: list[dict]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in _ANY_CASE.finditer(text)]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return "".join(out) + text[last:]


def cut_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``found`` (rows of ``contamination``) cut out of their texts.

    All columns stay. Rows without spans stay as they are; rows left without any word go. Rows of a
    repeated id that do not have the same words are cut by their own spans only if their number of
    words agrees; give unique ids where texts differ.
    """
    from gazette.llm.blocks import with_columns

    spans = found.filter(F.size("spans") > 0).select(
        F.col("id").alias("__id"), F.col("n_words").alias("__n"), F.col("spans").alias("__spans")
    ).dropDuplicates(["__id", "__n"])
    joined = docs.join(spans, F.col(id_col) == F.col("__id"), "left").drop("__id")
    text_at, n_at, spans_at = (joined.columns.index(c) for c in (text_col, "__n", "__spans"))

    def cut(batch):
        out, gone = [], []
        for text, n, own in zip(*(batch.column(i).to_pylist() for i in (text_at, n_at, spans_at)), strict=True):
            hit = bool(own) and text is not None and len(plain_words(text.encode())) == n
            new = cut_words(text, own) if hit else text
            out.append(new)
            gone.append(hit and not plain_words(new.encode()))
        return [pa.array(out, pa.string()), pa.array(gone, pa.bool_())]

    done = with_columns(joined, "__text string, __gone boolean", cut).filter("NOT __gone")
    return done.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


@query(
    sql=r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
        SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), phrase AS (
        SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS p, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ), sizes AS (
        SELECT DISTINCT n FROM phrase
    ), gram AS (
        SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
    ), hit AS (
        SELECT doc_id, g.n, i, item_id FROM gram g JOIN phrase USING (p) WHERE g.n = phrase.n
    ), covered AS (
        SELECT doc_id, count(DISTINCT pos) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id
    ), found AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
    )
    SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
    """
)
def op7_decontaminate(spark, sf_dir):
    """Benchmark phrases in all ``documents``."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
