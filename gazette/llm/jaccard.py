"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct word n-grams, as 64-bit hashes; documents with equal sets are one
node from the start. Tokens are ordered by document frequency, rarest first. If two sets overlap in at
least ``a`` tokens, the first ``|r| - a + l`` tokens of both share at least ``l``: a longer prefix costs more
shared tokens to look at, but asks for more of them before a pair is verified. Each node picks the
``l`` with the least estimated cost from the frequencies of its own tokens; a pair must share
``m = min(l_r, l_s)`` tokens of its ``m``-prefixes.

How the work is kept linear:

* Frequencies come from one exchange of packed hashes by hash range. Tokens of a single node can be in
  no overlap; they only use up prefix, and a node with too few others is done.
* In each token's list, nodes are first compared with one node of the list only. Links of these
  stars are joined into components, and only pairs of different components that still share a list
  are then matched in full, so a group of near copies never becomes all of its pairs.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gazette.llm.blocks import slices, texts
from gazette.llm.components import connected_components
from gazette.llm.hashing import Words, lower_words, mix
from gazette.llm.registry import query, table
from gazette.plans.store import materialise

WORDS = 5
PERCENT = 80
MOST_MATCHES = 4
_RANGE_TOKENS = 2_000_000  # tokens of one hash range, on average
_BLOCK_TOKENS = 500_000  # tokens that a task packs at a time


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes text by text, the number of each text, and a hash of each whole set (0: empty)."""
    n_texts = len(words.first) - 1
    if not words.n:
        return np.empty(0, np.uint64), np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    grams, at = words.grams(k)
    owner = words.text[at]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
    grams, owner = grams[new], owner[new]
    sizes = np.bincount(owner, minlength=n_texts)
    full = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])[full]
    node = np.zeros(n_texts, np.uint64)
    node[full] = mix(np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), starts) + sizes[full].astype(np.uint64))
    return grams, sizes, node.view(np.int64)


def _sets(part: pa.RecordBatch, k: int):
    return shingle_sets(Words([lower_words(t) for t in texts(part)]), k)


def document_nodes(rows: DataFrame, k: int) -> DataFrame:
    """``id, n, node``: the size and the hash of each document's set."""

    def run(batches):
        for part in slices(batches):
            _, sizes, node = _sets(part, k)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(node)], names=["id", "n", "node"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, node long")


def _packed_tokens(rows: DataFrame, k: int, bits: int) -> DataFrame:
    """Blocks of tokens by hash range: ``range, nodes, counts, tokens`` (binary), nodes in turn."""

    def emit(held):
        tokens, sizes, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
        owner = np.repeat(np.arange(len(nodes)), sizes)
        _, first = np.unique(nodes, return_index=True)  # copies within the block once
        keep = np.isin(owner, first)
        tokens, owner = tokens[keep], owner[keep]
        part = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
        order = np.argsort(part, kind="stable")
        tokens, owner, part = tokens[order], owner[order], part[order]
        cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
        out = {"range": [], "nodes": [], "counts": [], "tokens": []}
        for r in np.flatnonzero(np.diff(cuts)):
            own = owner[cuts[r] : cuts[r + 1]]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out["range"].append(int(r))
            out["nodes"].append(nodes[own[start]].tobytes())
            out["counts"].append(np.diff(np.append(start, len(own))).astype(np.int32).tobytes())
            out["tokens"].append(tokens[cuts[r] : cuts[r + 1]].tobytes())
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches):
        held, size = [], 0
        for part in slices(batches):
            held.append(_sets(part, k))
            size += len(held[-1][0])
            if size >= _BLOCK_TOKENS:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    return rows.mapInArrow(run, "range int, nodes binary, counts binary, tokens binary")


def _shared(group: pa.Table) -> pa.Table:
    """Tokens of one hash range that two nodes or more have: ``node, token, df``."""
    columns = group.select(["nodes", "counts", "tokens"]).to_pydict()
    nodes = np.concatenate([np.frombuffer(x, np.int64) for x in columns["nodes"]])
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in columns["counts"]])
    tokens = np.concatenate([np.frombuffer(x, np.int64) for x in columns["tokens"]])
    owner = np.repeat(nodes, counts)
    order = np.argsort(tokens, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(tokens[order]) != 0]))
    size = np.diff(np.append(edge, len(order)))
    order = order[np.repeat(size > 1, size)]  # most tokens occur once
    tokens, owner = tokens[order], owner[order]
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])[: len(tokens)]
    tokens, owner = tokens[new], owner[new]
    edge = np.flatnonzero(np.concatenate([[True], np.diff(tokens) != 0])[: len(tokens)])
    size = np.diff(np.append(edge, len(tokens)))
    df = np.repeat(size, size)
    keep = df > 1
    return pa.table({"node": owner[keep], "token": tokens[keep], "df": df[keep].astype(np.int32)})


def _least_overlap(n, percent):
    """Tokens that a set of ``n`` must share with any set linked to it."""
    return -(-n * percent // 100)


def choose_matches(n: int, df: np.ndarray, percent: int, most: int = MOST_MATCHES) -> tuple[int, list[int]]:
    """The number of shared prefix tokens to ask for, and how many shared-token places each number takes.

    ``df`` are the frequencies of the set's tokens that others have, ascending; the ``n - len(df)`` tokens
    of its own come before them. Looking at a posting costs 1, verifying a pair as much as its tokens;
    the candidates with ``l`` matches are estimated as postings / l**2.
    """
    alone = n - len(df)
    base = n - _least_overlap(n, percent)
    places = [min(len(df), max(0, base + m - alone)) for m in range(1, most + 1)]
    total = np.concatenate([[0], np.cumsum(df - 1)])
    costs = [total[p] * (1 + n / (16 * m * m)) for m, p in enumerate(places, 1) if m <= _least_overlap(n, percent)]
    return int(np.argmin(costs)) + 1, places


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, own, rest, level, matches`` of every prefix token that others have.

    A token is in the prefix for ``m`` matches from ``m = level`` on; ``own`` counts the tokens of the node
    alone and ``rest`` those from this token to the end of the set.
    """

    def rows(part):
        nodes, sizes, lists = (part.column(i) for i in range(3))
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        flat = lists.flatten()
        tokens, dfs = (flat.field(name).to_numpy() for name in ("token", "df"))
        for i, (node, n) in enumerate(zip(nodes.to_pylist(), sizes.to_pylist(), strict=True)):
            df = dfs[cuts[i] : cuts[i + 1]].astype(np.int64)
            m, places = choose_matches(n, df, percent)
            used = places[m - 1]
            level = np.searchsorted(np.array(places[:m]), np.arange(used), side="right") + 1
            same = [np.full(used, x, np.int64) for x in (node, n, n - len(df), m)]
            rest = np.arange(len(df), len(df) - used, -1)
            yield tokens[cuts[i] : cuts[i] + used], same[0], same[1], same[2], rest, level, same[3]

    def run(batches):
        names = ["token", "node", "n", "own", "rest", "level", "matches"]
        # token lists stay in Arrow: as Python objects those of one batch took hundreds of MB
        for part in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            out = [np.concatenate(x) for x in zip(*rows(part), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=names)

    schema = "token long, node long, n long, own long, rest long, level long, matches long"
    return sets.select("node", "n", "tokens").mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough: exact, on all shared tokens."""
    own = sets.select("node", "n", F.transform("tokens", lambda t: t["token"]).alias("tokens"))
    left = own.toDF("a", "n_a", "t_a")
    right = own.toDF("b", "n_b", "t_b")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return both.filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def _similar_size(a, b, percent):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _open_lists(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the label of their node, in lists that hold two labels or more."""
    if labels is None:
        named = postings.withColumn("label", F.col("node"))
    else:
        named = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return named.join(mixed, "token")


def similar_links(sets: DataFrame, percent: int = PERCENT, stars: int = 2) -> tuple[DataFrame | None, DataFrame]:
    """Components of the similarity graph over ``sets`` as ``node, label``, and links that span them."""
    postings = materialise(_postings(sets, percent))
    links, labels = None, None
    for turn in range(stars):
        lists = _open_lists(postings, labels)
        # the least edited copy has the most links; then one from another component
        hub = F.min(F.struct("own", "label", "node", "n")) if turn % 2 == 0 else F.max(F.struct("label", "own", "node", "n"))
        centres = lists.groupBy("token").agg(hub.alias("hub")).select(
            "token", F.col("hub.label").alias("hub_label"), F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a")
        )
        pairs = (
            lists.join(centres, "token")
            .filter((F.col("label") != F.col("hub_label")) & _similar_size("n", "n_a", percent))
            .select("a", F.col("node").alias("b"))
            .distinct()
        )
        found = materialise(_verified(pairs, sets, percent))
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)
    lists = materialise(_open_lists(postings, labels).select("token", "node", "n", "own", "rest", "level", "matches", "label"))
    left = lists.toDF("token", "a", "n_a", "own_a", "rest_a", "level_a", "m_a", "label_a")
    right = lists.toDF("token", "b", "n_b", "own_b", "rest_b", "level_b", "m_b", "label_b")
    need = F.least("m_a", "m_b")
    # of the first ``need`` shared tokens of a linked pair, each has less than ``need`` shared ones before it
    before = F.least(need - 1, F.expr("n_a - own_a - rest_a"), F.expr("n_b - own_b - rest_b"))
    reach = (100 + percent) * (F.least("rest_a", "rest_b") + before) >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = (
        left.join(right, "token")
        .filter((F.col("label_a") < F.col("label_b")) & _similar_size("n_a", "n_b", percent))
        .filter((F.col("level_a") <= need) & (F.col("level_b") <= need) & reach)
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"), F.first(need).alias("need"))
        .filter("shared >= need")
        .select("a", "b")
    )
    found = materialise(_verified(pairs, sets, percent))
    links = links.unionByName(found)
    return links, connected_components(links)


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``.

    Two documents link when ``100 * shared >= percent * union`` of their sets of ``words``-word shingles;
    a text with fewer words is one shingle. A document without words links with nothing and is its own
    component, as is every row with a null id. Rows of a repeated id are documents on their own.
    Identity of sets and shingles is that of their 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    documents = materialise(document_nodes(rows, words))
    filled = documents.filter("n > 0")
    nodes = materialise(filled.groupBy("node").agg(F.max("n").alias("n"), F.min("id").alias("least")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(total // _RANGE_TOKENS).bit_length())
    shared = (
        _packed_tokens(rows, words, bits).groupBy("range").applyInArrow(_shared, "node long, token long, df int")
    )
    sets = materialise(
        shared.groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
        .join(nodes, "node")
        .filter(F.size("tokens") * 100 >= F.col("n") * percent)
        .select("node", "n", "tokens")
    )
    _, labels = similar_links(sets, percent)
    # the smallest id of a component, from the smallest of each of its nodes
    grouped = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component"))
    named = grouped.join(least, "label").select("node", "component")
    linked = filled.filter("id IS NOT NULL").join(named, "node").select("id", "n", F.col("component").alias("component_id"))
    alone = documents.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select("id", F.col("n").alias("n_shingles"), "component_id")


@query()
def op1_jaccard_join(spark, sf_dir):
    """Near-duplicate components of all ``documents``."""
    return near_duplicate_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
