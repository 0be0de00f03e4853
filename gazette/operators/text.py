"""Text columns: concatenation, vocabularies, token ids and vectors."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from gazette import columns as C
from gazette.functions.arrays import field, head_padded, named
from gazette.functions.draws import as_integer, digest
from gazette.functions.text import joined_text, list_text, spaced_words, words
from gazette.plans.lists import as_keys
from gazette.plans.lookup import lookup_join
from gazette.plans.numbering import row_index
from gazette.plans.store import materialise

_BLOCK_TOKENS = 1 << 20  # tokens of the texts that share a dictionary in a task
_VECTORS = 1 << 14  # rows of sums made dense at a time


def concat_str_columns(df, columns) -> tuple[DataFrame, str]:
    """Join text columns by a space into a column named by joining their names with ``-``."""
    name = "-".join(columns)
    return df.withColumn(name, joined_text(*columns)), name


def concat_list_str(df, column) -> DataFrame:
    return df.withColumn(column, list_text(column))


def _token_counts(limit: int):
    def run(batches):
        for block in _token_blocks(batches, limit):
            counts = block.column(-1).combine_chunks().flatten().value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["token", "n"])

    return run


def vocabulary(df, column, order_offset=1) -> DataFrame:
    """``(token, n, id)``: tokens numbered from the most frequent down (ties by token). Blocks of texts count their own first."""
    texts = df.select(spaced_words(column).alias("__w"))
    counts = texts.mapInArrow(_token_counts(_BLOCK_TOKENS), "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return row_index(counts, [F.col("n").desc(), "token"], "id", offset=order_offset)


def _coded(limit: int):
    """Blocks of texts as places in the dictionary of their block, and a row with the dictionary; the last column holds the tokens."""

    def run(batches):
        task = TaskContext.get().partitionId() << 33
        for i, block in enumerate(_token_blocks(batches, limit)):
            block = block.combine_chunks()
            lists, keys = block.column(-1).combine_chunks(), block.columns[:-1]
            coded = lists.flatten().dictionary_encode()
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.indices)
            tokens = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
            names = ["__block", "__places", "__tokens", *block.schema.names[:-1]]
            number = pa.array([task + i], pa.int64())
            yield pa.RecordBatch.from_arrays([number, pa.nulls(1, places.type), tokens, *[pa.nulls(1, k.type) for k in keys]], names=names)
            number = pa.repeat(number[0], len(lists))
            yield pa.RecordBatch.from_arrays([number, places, pa.nulls(len(lists), tokens.type), *[k.combine_chunks() for k in keys]], names=names)

    return run


def _decoded(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Ids of the texts of a block from the ids of its dictionary."""
    found = found.sort_by([("__place", "ascending"), ("__id", "ascending")])
    lists = texts.column("__places").combine_chunks()
    place = lists.flatten().to_numpy()
    first = np.searchsorted(found.column("__place").to_numpy(), np.arange(place.max() + 2))
    n = np.diff(first)[place]  # above one where the vocabulary repeats a token
    ends = np.append(0, np.cumsum(n))
    at = np.repeat(first[place] - ends[:-1], n) + np.arange(ends[-1])
    cuts = ends[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]
    ids = found.column("__id").combine_chunks().take(pa.array(at))
    return texts.drop_columns(["__of", "__places"]).append_column("__ids", pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids))


def convert_text2encoding(df, vocab, column, name="vocab", max_length=None, key=C.ARTICLE_ID, unknown=0, **join_options) -> tuple[DataFrame, str]:
    """Token ids of each text in order, from a ``(token, id)`` table.

    With ``max_length`` lists are cut, before anything is joined, and filled with 0 on the right.
    Unknown tokens get ``unknown``, a null text null. The new column is ``<column>_encode_<name>``;
    ``key`` must identify a row. Blocks of texts share a dictionary, and a token is joined once for each block.
    """
    keys = as_keys(key)
    out = f"{column}_encode_{name}"
    tokens = F.substring_index(spaced_words(column), " ", max_length) if max_length else spaced_words(column)
    # keys travel under names of their own, which the tasks pass on
    held = [f"__k{i}" for i in range(len(keys))]
    types = ", ".join(f"{h} {df.schema[k].dataType.simpleString()}" for h, k in zip(held, keys, strict=True))
    rows = df.select(*[F.col(k).alias(h) for k, h in zip(keys, held, strict=True)], tokens.alias("__w"))
    # stored, so that texts and dictionaries of a block are the same ones for both readers
    coded = materialise(rows.mapInArrow(_coded(_BLOCK_TOKENS), f"__block bigint, __places array<int>, __tokens array<string>, {types}"))
    entries = coded.filter("__tokens IS NOT NULL").select("__block", F.posexplode("__tokens").alias("__place", "token"))
    table = vocab.select("token", F.col("id").cast("bigint").alias("__id"))
    found = lookup_join(entries, table, "token", "left", spread=["__block", "__place"], **join_options)
    found = found.select("__block", "__place", F.coalesce("__id", F.lit(unknown).cast("bigint")).alias("__id"))
    texts = coded.filter("__places IS NOT NULL").select(F.col("__block").alias("__of"), "__places", *held)
    encoded = texts.groupBy("__of").cogroup(found.groupBy("__block")).applyInArrow(_decoded, f"{types}, __ids array<bigint>")
    encoded = encoded.select(*[F.col(h).alias(k) for k, h in zip(keys, held, strict=True)], "__ids")
    # rows with one key share their ids, in the order of places
    placed = F.flatten(F.transform("__l", lambda ids: F.transform(ids, lambda x, i: named(pos=i, id=x))))
    ids = F.when(F.size("__l") == 1, F.col("__l")[0]).otherwise(field(F.array_sort(placed), "id"))
    lists = encoded.groupBy(*keys).agg(F.collect_list("__ids").alias("__l"))
    ids = F.coalesce(ids, F.array().cast("array<bigint>"))
    if max_length:
        ids = head_padded(ids, max_length, 0)
    # the text itself is not needed behind the join and drops out where the caller does not select it
    marked = df.withColumn("__known", F.col(column).isNotNull())
    joined = marked.join(lists, keys, "left").withColumn(out, F.when(F.col("__known"), ids))
    return joined.select(*df.columns, out), out


def _token_blocks(batches, limit: int):
    """Rows with words, as tables, with the words of the last column (``spaced_words``) as lists: up to ``limit`` words together, or a single row."""
    held, size = [], 0
    for batch in batches:
        # texts without words are left out here: a filter before the task would make the words twice
        batch = batch.filter(pc.not_equal(batch.column(batch.num_columns - 1), ""))
        lists = pc.split_pattern(batch.column(batch.num_columns - 1), " ")
        batch = pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=batch.schema.names)
        start = 0
        for i, n in enumerate(lists.value_lengths().to_pylist()):
            if size and size + n > limit:
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, start, size = [], i, 0
            size += n
        held.append(batch.slice(start))
    if size:
        yield pa.Table.from_batches(held)


def hashed_embeddings(df, column, dim=256, out="embedding", key=C.ARTICLE_ID, seed=0, dtype="float32") -> DataFrame:
    """A unit-length hashed bag of words per text, computed where the text lies.

    A word adds one to the coordinate that its digest names.
    """
    place = F.transform(words(F.coalesce(column, F.lit(""))), lambda t: F.pmod(as_integer(digest(seed, t), 8), F.lit(dim)).cast("string"))
    rows = df.select(*as_keys(key), place.alias("__w"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="__w", outputCol="__tf")
    scaled = Normalizer(p=2.0, inputCol="__tf", outputCol="__v").transform(counter.transform(rows))
    return scaled.select(*as_keys(key), vector_to_array("__v", dtype).alias(out))


def encode_with(df, column, encoder, out="embedding", key=C.ARTICLE_ID) -> DataFrame:
    """Embed texts with ``encoder(list of str) -> 2-d array`` in Arrow batches.

    ``encoder`` is shipped to the tasks; load large models lazily inside it.
    """
    keys = as_keys(key)
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"`{out}` array<float>"])

    def run(batches):
        for batch in batches:
            vectors = encoder(batch[column].fillna("").tolist())
            yield batch[keys].assign(**{out: [[float(x) for x in v] for v in vectors]})

    return df.select(*keys, column).mapInPandas(run, schema)


def _neighbour_sums(dim: int, window: int, seed, limit: int):
    """Per block of texts and token: coordinates of the neighbours and their sums, from one sort of numbers."""
    prefix = f"{seed}:".encode()

    def coordinates(tokens):
        # as ``digest`` and ``as_integer`` read it: 8 hex digits for the place, the ninth for the sign
        digests = b"".join(hashlib.md5(prefix + t).digest() for t in tokens.cast(pa.binary()).to_pylist())
        table = np.frombuffer(digests, np.uint8).reshape(-1, 16)
        place = np.ascontiguousarray(table[:, :4]).view(">u4").ravel().astype(np.int64) % dim
        return 2 * place + (table[:, 4] >> 7)

    def run(batches):
        for block in _token_blocks(batches, limit):
            lists = block.column(-1).combine_chunks()
            coded = lists.flatten().dictionary_encode()
            tokens, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            here, lead = coordinates(tokens)[code], code * (2 * dim)
            keys = [np.empty(0, np.int64)]
            for k in range(1, window + 1):
                same = text[k:] == text[:-k]
                keys += [(lead[:-k] + here[k:])[same], (lead[k:] + here[:-k])[same]]
            keys = np.sort(np.concatenate(keys))
            if not len(keys):
                continue
            edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n = np.diff(np.append(edge, len(keys)))
            cell, n = keys[edge] >> 1, np.where(keys[edge] & 1, -n, n)
            edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            cell, total = cell[edge], np.add.reduceat(n, edge)
            owner = cell // dim
            edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            ends = pa.array(np.append(edge, len(owner)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    tokens.take(pa.array(owner[edge])),
                    pa.ListArray.from_arrays(ends, pa.array(cell % dim, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(total, pa.int64())),
                ],
                names=["token", "dims", "sums"],
            )

    return run


def _unit_vectors(dim: int):
    """Adds up the rows of each token, which follow one another, and scales the sums to length one."""

    def emit(tokens, total):
        length = np.sqrt((total * total).sum(axis=1))
        vectors = total / np.where(length == 0, 1.0, length)[:, None]
        ends = pa.array(np.arange(len(total) + 1) * dim, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names=["token", "vector"])

    def run(batches):
        last, held = None, None
        for batch in (whole.slice(at, _VECTORS) for whole in batches for at in range(0, whole.num_rows, _VECTORS)):
            tokens, dims = batch.column(0), batch.column(1)
            new = np.append(True, pc.not_equal(tokens.slice(1), tokens.slice(0, len(tokens) - 1)).to_numpy(zero_copy_only=False))
            cell = np.repeat(np.cumsum(new) - 1, dims.value_lengths().to_numpy()) * dim + dims.flatten().to_numpy()
            total = np.bincount(cell, batch.column(2).flatten().to_numpy(), int(new.sum()) * dim).reshape(-1, dim)
            tokens = tokens.take(pa.array(np.flatnonzero(new))).to_pylist()
            if last == tokens[0]:
                total[0] += held
            elif last is not None:
                yield emit([last], held[None])
            yield emit(tokens[:-1], total[:-1])
            last, held = tokens[-1], total[-1].copy()
        if last is not None:
            yield emit([last], held[None])

    return run


def token_vectors(df, column, dim=64, window=2, seed=0, out="vector") -> DataFrame:
    """A ``(token, vector)`` table learnt from the corpus by random indexing.

    Every token owns one signed coordinate (from its digest). A token's vector is the sum of
    the coordinates of its neighbours within ``window`` places, scaled to length one. Blocks of texts
    add up their own sums, so one row per block and token is shuffled; the vocabulary is never on the
    driver, nor whole in a task.
    """
    sums = df.select(spaced_words(column).alias("__w")).mapInArrow(_neighbour_sums(dim, window, seed, _BLOCK_TOKENS), "token string, dims array<int>, sums array<bigint>")
    together = sums.repartition("token").sortWithinPartitions("token")
    return together.mapInArrow(_unit_vectors(dim), "token string, vector array<double>").select("token", F.col("vector").alias(out))
