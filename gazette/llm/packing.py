"""Packing tokenised documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths, what
attention within documents costs). A piece's demand follows from its length alone, so pieces of one
length are alike, and the fit is worked out on the histogram of lengths: classes in falling length
order, and sequences with equal contents as one kind with a count. Each class goes to the kind that
has room under every capacity and fits best, by the norm of what would be left or by the weighted
dot product of demand and room. That plan has at most a few kinds per length, whatever the number of
documents; pieces find their place in it from their rank among pieces of their length.
"""

import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gazette.llm.blocks import slices
from gazette.llm.registry import query, table
from gazette.plans.store import materialise

MAX_TOKENS = 1024
END_ID = 2
_SLICE_BYTES = 1 << 22  # text tokenised at a time
_KNOWN = 200_000  # chunks whose ids a worker keeps
_LONGEST = 64  # longer chunks are not kept, which bounds the bytes too
_ROW = 256  # chunks encoded in a row
_LINE_FEED = "\u010a"  # the token of a line feed in a byte-level vocabulary, where a blank is the letter below
_BLANK = "\u0120"


class ChunkTokenizer:
    """A byte-level BPE tokenizer that encodes each distinct chunk between blanks once and remembers it.

    Its pre-tokenizer always starts anew at a blank before a non-blank character, so the ids of a
    text are those of its chunks in turn. The usual byte-level one also does so around a line feed
    between non-blanks. Splitting, finding distinct chunks and putting ids together are done on
    columns; chunks are encoded many in a row, set apart by the tokens that begin with a blank or are
    line feeds. Texts with a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        bytewise = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.fine = bytewise and pre.get("use_regex", True)
        self.opens = np.zeros(self.model.get_vocab_size(with_added_tokens=True), bool)
        self.feeds = self.opens.copy()
        if bytewise:
            self.opens[[i for token, i in self.model.get_vocab().items() if token.startswith(_BLANK)]] = True
        if self.fine and _LINE_FEED in self.model.get_vocab():
            self.feeds[self.model.token_to_id(_LINE_FEED)] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.cuts = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and where each chunk's begin and end."""
        opened = pc.match_substring_regex(chunks, _OPENED).to_numpy(zero_copy_only=False) & self.opens.any()
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False) & self.feeds.any()
        order, found, sizes = [], [], []
        for chosen, glue, marks in ((opened, "", self.opens), (plain, "\n", self.feeds)):
            at = np.flatnonzero(chosen)
            names = chunks.take(pa.array(at)).to_pylist()
            groups = [slice(i, i + _ROW) for i in range(0, len(at), _ROW)]
            for group, ids in zip(groups, self._encode([glue.join(names[g]) for g in groups]), strict=True):
                n = len(at[group])
                edges = np.flatnonzero(marks[ids])
                if len(edges) == n - bool(glue):
                    if glue:  # the line feeds go
                        size = np.diff(np.concatenate([[-1], edges, [len(ids)]])) - 1
                        ids = np.delete(ids, edges)
                    else:
                        size = np.diff(np.append(edges, len(ids)))
                    order.append(at[group])
                    found.append(ids)
                    sizes.append(size)
                else:
                    chosen[at[group]] = False
        alone = np.flatnonzero(~(opened | plain))
        each = self._encode(chunks.take(pa.array(alone)).to_pylist())
        order = np.concatenate([*order, alone]).astype(np.int64)
        sizes = np.concatenate([*sizes, [len(x) for x in each]]).astype(np.int64)
        ends = np.cumsum(sizes)
        place = np.empty(len(chunks), np.int64)
        place[order] = np.arange(len(chunks))
        return _gathered(np.concatenate([*found, *each, self.ids[:0]]), (ends - sizes)[place], sizes[place])

    def _distinct_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_chunk_ids``, with the help of what earlier texts had."""
        at = pc.index_in(chunks, self.known)
        new = chunks.filter(pc.is_null(at))
        ids, cuts = self._chunk_ids(new)
        pool = np.concatenate([self.ids, ids])
        starts = np.concatenate([self.cuts[:-1], cuts[:-1] + len(self.ids)])
        sizes = np.concatenate([np.diff(self.cuts), np.diff(cuts)])
        spot = np.empty(len(chunks), np.int64)
        missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        spot[missing] = len(self.known) + np.arange(len(new))
        spot[~missing] = at.drop_null().to_numpy()
        ids, cuts = _gathered(pool, starts[spot], sizes[spot])
        # beyond the bound only the last texts' chunks are kept
        kept, numbers = (pa.concat_arrays([self.known, new]), None) if len(self.known) + len(new) <= _KNOWN else (chunks, spot)
        short = pc.less_equal(pc.binary_length(kept), _LONGEST).to_numpy(zero_copy_only=False)
        numbers = (np.arange(len(kept)) if numbers is None else numbers)[short]
        self.known = kept.filter(pa.array(short))
        self.ids, self.cuts = _gathered(pool, starts[numbers], sizes[numbers])
        if len(self.known) > _KNOWN:
            self._forget()
        return ids, cuts

    def _of_lists(self, lists: pa.Array) -> list[bytes]:
        """Ids of texts given as lists of their chunks."""
        coded = lists.flatten().dictionary_encode()
        ids, cuts = self._distinct_ids(coded.dictionary)
        code = coded.indices.to_numpy()
        ids, cuts = _gathered(ids, cuts[:-1][code], np.diff(cuts)[code])
        edges = (4 * cuts[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)]).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in itertools.pairwise(edges)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; a null text is empty."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        names = texts.to_pylist()
        whole = np.array([any(s in t for s in self.special) for t in names], bool)
        wide = np.array([bool(_WIDE.search(t)) or "\0" in t for t in names], bool) & ~whole
        narrow = ~(whole | wide)
        out: list[bytes] = [b""] * len(names)
        cut = pc.replace_substring(texts.filter(pa.array(narrow)), " ", "\0 ")
        if self.fine:
            cut = pc.replace_substring(cut, "\n", "\0\n\0")
        pattern = _FINE_CUT if self.fine else _CUT
        widely = pa.array([pattern.split(names[i]) for i in np.flatnonzero(wide)], pa.large_list(pa.large_string()))
        singly = [x.tobytes() for x in self._encode([names[i] for i in np.flatnonzero(whole)])]
        for chosen, found in ((narrow, self._of_lists(pc.split_pattern(cut, "\0"))), (wide, self._of_lists(widely)), (whole, singly)):
            for i, ids in zip(np.flatnonzero(chosen).tolist(), found, strict=True):
                out[i] = ids
        return out


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after the other, and where each begins and ends in the result."""
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return values[np.repeat(starts - cuts[:-1], sizes) + np.arange(cuts[-1])], cuts


_NO_BLANK = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_OPENED = f"^ {_NO_BLANK}$"
_PLAIN = f"^{_NO_BLANK}$"
_WIDE = re.compile(r"\s\s")
_CUT = re.compile(r"(?= \S)")
_FINE_CUT = re.compile(r"(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def tokenised_pieces(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of every piece of every document.

    A document's tokens end with ``end_id``; null texts are empty. More than ``max_tokens`` are cut into
    full pieces, with a shorter one first if there is a rest.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for part in slices(batches, limit=_SLICE_BYTES):
            encoded = tokenizer(path).encode(part.column(part.schema.get_field_index("text")))
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(encoded):
                raw += end
                n = len(raw) // 4
                begin = 0
                for nr in range(-(-n // max_tokens)):
                    size = (n % max_tokens or max_tokens) if nr == 0 else max_tokens
                    own = raw[4 * begin : 4 * (begin + size)]
                    at.append(i)
                    piece.append(nr)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(own))
                    if keep_ids:
                        ids.append(own)
                    begin += size
            columns = {
                "id": part.column(0).take(pa.array(at, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return rows.mapInArrow(cut, schema)


def plan_sequences(
    histogram: dict[int, int],
    max_tokens: int = MAX_TOKENS,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights=(1.0, 1.0, 1.0),
    select: str = "norm",
) -> list[tuple[int, list[int]]]:
    """Kinds of sequences as (how many, lengths in it). ``histogram`` maps a length to its number of pieces.

    ``max_docs`` and ``max_attention`` default to what ``max_tokens`` already implies. ``select`` is
    ``norm`` (least weighted norm of the room left) or ``dot`` (greatest weighted dot product).
    """
    limit = np.array([max_tokens, max_docs or max_tokens, max_attention or max_tokens**2], float)
    weights = np.asarray(weights, float)
    room, count, contents = np.empty((0, 3)), np.empty(0, np.int64), []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        demand = np.array([length, 1, length * length], float)
        if (demand > limit).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity on its own")
        while left:
            fits = np.flatnonzero((count > 0) & (room >= demand).all(axis=1))
            if len(fits):
                scaled = room[fits] / limit
                if select == "dot":
                    best = fits[np.argmax((scaled * (demand / limit) * weights).sum(axis=1))]
                else:
                    best = fits[np.argmin((weights * (scaled - demand / limit) ** 2).sum(axis=1))]
                n = min(left, int(count[best]))
                count[best] -= n
                rest, held, copies = room[best] - demand, [*contents[best], length], 1
            else:
                # a new sequence takes pieces of this length until one does not fit
                copies = min(left, int((limit // demand).min()))
                n = left // copies
                rest, held = limit - copies * demand, [length] * copies
            left -= n * copies
            same = np.flatnonzero((count == 0) if len(count) else [])
            if len(same):  # reuse the place of a used-up kind
                spot = same[0]
                room[spot], count[spot], contents[spot] = rest, n, held
            else:
                room, count = np.vstack([room, rest]), np.append(count, n)
                contents.append(held)
    return [(int(c), held) for c, held in zip(count, contents, strict=True) if c]


def _places(kinds: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks up to which a place is filled, its first sequence, its offset."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for count, held in kinds:
        offset = 0
        for length in held:
            slots.setdefault(length, []).append((count, base, offset))
            offset += length
        base += count
    out = {}
    for length, rows in slots.items():
        counts, first, offset = np.array(rows, np.int64).T
        out[length] = (np.cumsum(counts), first, offset)
    return out


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, from 0, among the pieces of the same length.

    Ordered by (length, hash of the id) over range partitions, so that a length with very many pieces
    is spread; a partition's pieces of a length are numbered in it and shifted by those before.
    """
    session = pieces.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn("__h", F.xxhash64("id", "piece"))
    ordered = keyed.repartitionByRange(parts, "length", "__h").sortWithinPartitions("length", "__h")
    names = pieces.columns
    at = names.index("length")

    def number(batches):
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            length = b.column(at).to_numpy()
            if not len(length):
                continue
            starts = np.flatnonzero(np.concatenate([[length[0] != last], length[1:] != length[:-1]]))
            here = np.arange(len(length)) + seen
            if len(starts):
                group = np.searchsorted(starts, np.arange(len(length)), side="right") - 1
                here = np.where(group >= 0, np.arange(len(length)) - starts[np.maximum(group, 0)], here)
            last, seen = length[-1], int(here[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(names)], pa.array(here), pa.array(np.full(len(length), part))], names=[*names, "__local", "__part"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    numbered = materialise(ordered.mapInArrow(number, f"{schema}, __local long, __part long"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        numbered.groupBy("length", "__part")
        .agg(F.count("*").alias("__n"))
        .select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    # range partitions overlap in a length at their edges only: at most partitions + lengths rows
    return (
        numbered.join(F.broadcast(shifts), ["length", "__part"])
        .withColumn("rank", F.col("__local") + F.col("__shift"))
        .select(*names, "rank")
    )


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights=(1.0, 1.0, 1.0),
    select: str = "norm",
    keep_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its place: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    Rows with equal ids are packed on their own; a null id is kept as it is. An empty table gives no
    rows. With ``keep_ids`` the ids of a piece come along as 32-bit numbers.
    """
    pieces = materialise(tokenised_pieces(docs, path, id_col, text_col, max_tokens, end_id, keep_ids))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    places = _places(plan_sequences(histogram, max_tokens, max_docs, max_attention, weights, select))
    ranked = _ranked(pieces)
    names = ranked.columns
    length_at, rank_at = names.index("length"), names.index("rank")

    def assign(batches):
        for b in batches:
            length, rank = b.column(length_at).to_numpy(), b.column(rank_at).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                ends, first, at = places[size]
                slot = np.searchsorted(ends, rank[own], side="right")
                sequence[own] = first[slot] + rank[own] - np.where(slot > 0, ends[slot - 1], 0)
                offset[own] = at[slot]
            kept = [c for i, c in enumerate(b.columns) if i != rank_at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*[n for n in names if n != "rank"], "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: ``sequence_id, ids`` (binary, 32-bit), and its pieces in order.

    ``packed`` is what ``pack(keep_ids=True)`` returns. A sequence has at most ``max_tokens`` ids.
    """
    piece = F.struct("offset", "id", "piece", "start", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), F.transform("pieces", lambda p: p.dropFields("ids")).alias("pieces"))


@query()
def op3_pack(spark, sf_dir):
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
