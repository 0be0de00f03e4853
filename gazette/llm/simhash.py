"""SimHash near duplicates by tiled exact comparison.

A document's fingerprint has a bit set where over half of the hashes of its word shingles have it.
Documents with equal fingerprints are one node from the start. The distinct fingerprints are laid out in
cells by the population counts of their four 16-bit quarters: the counts of two fingerprints differ, summed
over the quarters, by at most the number of bits in which these differ. So only tiles of cells within
the radius of each other are compared; all other tile pairs are skipped, and none of the kept ones is
sampled or capped.

A cell is cut into tiles of bounded size by a hash, and tile pairs are spread over tasks. A task compares
a pair with exclusive-or and bit counts in numpy, exactly, and returns links that span the components
within the pair instead of all of its links, so a ball of many close fingerprints stays small.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gazette.llm.blocks import slices, texts
from gazette.llm.components import connected_components
from gazette.llm.hashing import lower_words
from gazette.llm.registry import query, table
from gazette.plans.lookup import lookup_join
from gazette.plans.store import materialise

WORDS = 3
RADIUS = 2
SEED = 42
TILE = 1024  # a task takes up to 10,000 pairs of tiles in one Arrow batch
_AT_ONCE = 1 << 15  # hashes whose bits are counted together
_QUARTER = 0xFFFF


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned; 0 for a text without words."""
    tokens = lower_words(text)
    if not tokens:
        return 0
    data = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        cuts = zip(starts[at : min(at + _AT_ONCE, n)].tolist(), last[at : at + _AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(data[a:b], seed) for a, b in cuts], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(rows: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``id, fp`` of rows ``id, text``; the 64 bits of ``fp`` are held in a signed long."""

    def run(batches):
        for part in slices(batches):
            found = np.array([fingerprint(t, words, seed) for t in texts(part)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def close_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles that join what is connected by pairs at ``radius`` bits or fewer.

    Every pair is compared; what is returned spans each component within the pair of tiles.
    """
    apart = np.bitwise_count(left[:, None] ^ right[None, :])
    i, j = np.nonzero(apart <= radius)
    j = j + len(left)
    label = np.arange(len(left) + len(right))
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    both = np.concatenate([left, right])
    moved = np.flatnonzero(label != np.arange(len(label)))
    a, b = both[moved], both[label[moved]]
    differ = a != b
    return a[differ], b[differ]


def _offsets(radius: int) -> list[tuple[int, int, int, int]]:
    """Steps to the cells within the radius, one of each step and its opposite."""
    steps = itertools.product(range(-radius, radius + 1), repeat=4)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]


def _tiles(distinct: DataFrame, tile: int) -> DataFrame:
    """``c0 .. c3, tile, n_tiles, fps``: the fingerprints of each cell in tiles of about ``tile``."""
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(_QUARTER))).alias(f"c{q}") for q in range(4)]
    cell = [f"c{q}" for q in range(4)]
    placed = distinct.select("fp", *quarters)
    # 17 ** 4 cells at most, which bounds this broadcast
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n")).select(*cell, F.ceil(F.col("n") / tile).cast("int").alias("n_tiles"))
    return (
        placed.join(F.broadcast(sizes), cell)
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n_tiles")).cast("int"))
        .groupBy(*cell, "n_tiles", "tile")
        .agg(F.collect_list("fp").alias("fps"))
    )


def _tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """Every pair of tiles whose population counts allow a link, once: ``fps, others``."""
    cell = [f"c{q}" for q in range(4)]
    sizes = tiles.select(*cell, "n_tiles").distinct()
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"s{q}") for q, x in enumerate(s)]) for s in _offsets(radius)])
    near = tiles.select(*cell, F.col("tile").alias("own"), F.col("fps").alias("others"), F.explode(steps).alias("step"))
    same = F.col("step") == F.struct(*[F.lit(0).alias(f"s{q}") for q in range(4)])
    reached = near.select(
        *[(F.col(c) + F.col(f"step.s{q}")).alias(c) for q, c in enumerate(cell)], "own", "others", same.alias("same")
    )
    # within a cell each pair of tiles once, between cells all
    wanted = reached.join(F.broadcast(sizes), cell).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    wanted = wanted.filter(~F.col("same") | (F.col("own") <= F.col("tile"))).drop("n_tiles", "same", "own")
    return wanted.join(tiles.select(*cell, "tile", "fps"), [*cell, "tile"]).select("fps", "others")


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` between fingerprints that span the components of all pairs within ``radius`` bits."""
    tiles = materialise(_tiles(distinct, tile))

    def compare(batches):
        for batch in batches:
            for one, other in zip(batch.column(0), batch.column(1), strict=True):
                left, right = (x.values.to_numpy().view(np.uint64) for x in (one, other))
                a, b = close_links(left, right, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return _tile_pairs(tiles, radius).mapInArrow(compare, "a long, b long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """``id, fp, component_id`` for every row of ``docs``.

    ``fp`` is the fingerprint of all ``words``-word shingles, repeats included (a text with fewer words is
    one shingle; null, empty and blank texts have fingerprint 0). Rows link when their fingerprints differ
    in ``radius`` bits or fewer; ``component_id`` is the smallest id reachable. Rows with a null id or a
    repeated one are linked like any other; a component of null ids alone has a null ``component_id``. Other
    columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = materialise(fingerprints(rows, words))
    distinct = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")))
    labels = connected_components(materialise(linked_fingerprints(distinct.select("fp"), radius, tile)))
    grouped = distinct.join(labels.toDF("fp", "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialise(grouped.join(least, "label").select("fp", "component_id"))
    # a fingerprint that very many documents share is spread over tasks by the join
    return lookup_join(marked, named, "fp", "left", spread=["id"]).select("id", "fp", "component_id")


@query()
def op12_simhash(spark, sf_dir):
    """Fingerprints and near-duplicate components of all ``documents``."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
