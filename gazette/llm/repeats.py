"""Removing repeated byte strings with suffix arrays of shards.

Every byte covered by a string of ``length`` bytes that also starts earlier, in a document with a smaller
id or further ahead in the same one, is removed. Three steps bring all starts of a string together
without sorting the whole corpus in one place:

* In every string one place is chosen by its content alone: the ``_GRAM``-byte gram with the least hash
  (winnowing). Equal strings choose the same gram, so a string can only repeat if its gram does.
* Neighbouring starts with the same chosen gram make a segment. Segments whose gram occurs once
  are done; the others go to the shard of their gram, by a second hash, since the chosen ones crowd at small values of the first. Equal segments are combined before,
  so a passage in very many documents arrives once. A gram whose segments exceed a shard (a short
  passage with ever other neighbours) goes to none: each string of its segments is told by its
  digest, which spreads over all tasks.
* A shard leaves out segments that are alone with their gram (strings with one gram at different offsets differ)
  and starts whose surroundings of the gram no other segment has,
  and sorts the suffixes of the others by external induced sorting (``induced``). Suffixes whose
  common prefixes reach ``length`` are equal strings, and all but the first start are repeats.

Whole copies of a text are told by their digest and only the first is looked at.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gazette.llm.blocks import column, give_back, slices, texts, with_columns
from gazette.llm.decontaminate import merged
from gazette.llm.hashing import Spans, mix
from gazette.llm.induced import suffixes_with_common
from gazette.llm.registry import query, table
from gazette.plans.lookup import lookup_join
from gazette.plans.store import materialise

LENGTH = 100
_GRAM = 32
_RANGE_BYTES = 1 << 25  # text per range of gram hashes
_SHARD_BYTES = 1 << 21  # distinct segments per suffix-sorted shard
_SORT_BYTES = 1 << 20  # of a shard, sorted at a time
_CLASSES = 4  # of starts, by their distance to the gram
_BLOCK_TEXT = 1 << 24
_SLICE_BYTES = 1 << 18  # text hashed at a time: a few arrays of 8 bytes for each of its own


def _segments(parts: list[bytes], length: int):
    """Runs of starts with one chosen gram: text number, first start, starts, gram place, gram hash.

    Places are relative to the text. Texts shorter than ``length`` have no starts.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n = int(sizes.sum())
    if n < length:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    base = np.cumsum(sizes) - sizes
    hashes = Spans(b"".join(parts)).every(_GRAM)
    key = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    window, span = length - _GRAM + 1, 1
    while 2 * span <= window:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < window:
        key = np.minimum(key[: len(key) - (window - span)], key[window - span :])
    new = np.concatenate([[True], key[1:] != key[:-1]])
    # a text's starts begin at its first byte and end ``length`` bytes before its last
    fits = sizes >= length
    new[base[fits]] = True
    past = (base + sizes)[fits] - length + 1
    new[past[past < len(new)]] = True
    edge = np.flatnonzero(new)
    count = np.diff(np.append(edge, len(new)))
    text = np.searchsorted(base, edge, side="right") - 1
    valid = edge + length <= (base + sizes)[text]
    edge, count, text = edge[valid], count[valid], text[valid]
    place = (key[edge] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return text, edge - base[text], count, place - base[text], hashes[place]


def _digest(text: bytes | None) -> int:
    return int.from_bytes(hashlib.md5(text or b"").digest()[:8], "big", signed=True)


def _packed_grams(rows: DataFrame, length: int, bits: int) -> DataFrame:
    """Blocks of chosen grams by hash range: ``part, nodes, counts, grams, places`` (binary)."""

    def emit(held):
        nodes, counts, grams, places = (np.concatenate(x) for x in zip(*held, strict=True))
        owner = np.repeat(np.arange(len(nodes)), counts)
        _, first = np.unique(nodes, return_index=True)  # copies within the block once
        keep = np.isin(owner, first)
        owner, grams, places = owner[keep], grams[keep], places[keep]
        # chosen grams have the least hashes of their strings: their leading bits are nearly all zero until mixed again
        part = (mix(grams) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
        order = np.argsort(part, kind="stable")
        owner, grams, places = owner[order], grams[order], places[order]
        cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1))
        out = {"part": [], "nodes": [], "counts": [], "grams": [], "places": []}
        for p in np.flatnonzero(np.diff(cuts)):
            own = owner[cuts[p] : cuts[p + 1]]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out["part"].append(int(p))
            out["nodes"].append(nodes[own[start]].tobytes())
            out["counts"].append(np.diff(np.append(start, len(own))).astype(np.int32).tobytes())
            out["grams"].append(grams[cuts[p] : cuts[p + 1]].tobytes())
            out["places"].append(places[cuts[p] : cuts[p + 1]].tobytes())
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches):
        held, size = [], 0
        for part in slices(batches, limit=_SLICE_BYTES):
            own = [t or b"" for t in texts(part)]
            text, _, _, place, grams = _segments(own, length)
            nodes = np.array([_digest(t) for t in own], np.int64)
            held.append((nodes, np.bincount(text, minlength=len(own)), grams, place.astype(np.int32)))
            size += sum(map(len, own))
            if size >= _BLOCK_TEXT:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return rows.mapInArrow(run, "part int, nodes binary, counts binary, grams binary, places binary")


def _repeated_grams(group: pa.Table) -> pa.Table:
    """Places of grams of one hash range that occur at two places or more: ``node, place``."""
    read = {c: group.column(c).to_pylist() for c in ("nodes", "counts", "grams", "places")}
    nodes = np.concatenate([np.frombuffer(x, np.int64) for x in read["nodes"]])
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in read["counts"]])
    grams = np.concatenate([np.frombuffer(x, np.uint64) for x in read["grams"]])
    places = np.concatenate([np.frombuffer(x, np.int32) for x in read["places"]]).astype(np.int64)
    owner = np.repeat(nodes, counts)

    def in_groups(*columns):
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return new

    order = np.argsort(grams, kind="stable")
    edge = np.flatnonzero(in_groups(grams[order]))
    size = np.diff(np.append(edge, len(order)))
    order = order[np.repeat(size > 1, size)]
    grams, owner, places = grams[order], owner[order], places[order]
    order = np.lexsort((places, owner, grams))
    grams, owner, places = grams[order], owner[order], places[order]
    new = in_groups(grams, owner, places)
    grams, owner, places = grams[new], owner[new], places[new]
    edge = np.flatnonzero(in_groups(grams))
    size = np.diff(np.append(edge, len(grams)))
    keep = np.repeat(size > 1, size)
    return pa.table({"node": owner[keep], "place": places[keep]})


def _cut_segments(candidates: DataFrame, length: int) -> DataFrame:
    """``gram, key, content, id, start, size, ahead`` of the segments at the given places (``id, text, places``).

    ``ahead`` is the place of the gram in the content.
    """

    def run(batches):
        for part in slices(batches, limit=_SLICE_BYTES):
            own = [t or b"" for t in texts(part)]
            text, start, count, place, grams = _segments(own, length)
            wanted = [np.array(p, np.int64) for p in column(part, "places")]
            # places of all texts on one axis, so that one look-up answers all
            shift = np.cumsum([0, *map(len, own)])
            every = np.concatenate([w + shift[i] for i, w in enumerate(wanted)])
            keep = np.isin(place + shift[text], every)
            text, start, count, place, grams = text[keep], start[keep], count[keep], place[keep], grams[keep]
            content = [own[t][s : s + c + length - 1] for t, s, c in zip(text.tolist(), start.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams.view(np.int64)),
                    pa.array([hashlib.blake2b(c, digest_size=16).digest() for c in content], pa.binary()),
                    pa.array(content, pa.binary()),
                    part.column(0).take(pa.array(text)),
                    pa.array(start),
                    pa.array(count + length - 1),
                    pa.array((place - start).astype(np.int32)),
                ],
                names=["gram", "key", "content", "id", "start", "size", "ahead"],
            )

    return candidates.select("id", "text", "places").mapInArrow(run, "gram long, key binary, content binary, id long, start long, size long, ahead int")


def _with_partners(group: pa.Table, length: int) -> pa.Table:
    """Segments of a shard cut to the starts that may occur in another one: ``gram, content, id, start``.

    Starts are put in classes by their distance to the gram. The strings of a class have a middle part in common,
    and equal strings are in one class, so a class whose middle no other segment of the gram has holds no repeat.
    """
    content = group.column("content").to_pylist()
    gram, ahead = group.column("gram").to_numpy(), group.column("ahead").to_numpy().astype(np.int64)
    sizes = np.fromiter(map(len, content), np.int64, len(content))
    low, high, salt = sizes.copy(), np.full(len(content), -1), mix(gram.view(np.uint64))
    cuts = np.linspace(0, length - _GRAM + 1, _CLASSES + 1).astype(np.int64)
    classes = []  # first and last start of a class, segments with any, hashes of their middles
    for near, far in zip(cuts[:-1].tolist(), (cuts[1:] - 1).tolist(), strict=True):
        first, last = np.maximum(ahead - far, 0), np.minimum(ahead - near, sizes - length)
        own = np.flatnonzero(first <= last)
        classes.append((first, last, own, ahead - near, ahead - far + length, np.zeros(len(content), np.uint64)))
    pieces = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // _SLICE_BYTES, prepend=-1, append=-1))
    for begin, end in zip(pieces[:-1].tolist(), pieces[1:].tolist(), strict=True):
        base = np.cumsum(sizes[begin:end]) - sizes[begin:end]
        spans = Spans(b"".join(content[begin:end]))
        for _, _, own, left, right, middle in classes:
            i = own[np.searchsorted(own, begin) : np.searchsorted(own, end)]
            middle[i] = spans.hash(base[i - begin] + left[i], base[i - begin] + right[i]) ^ salt[i]
    for first, last, own, _, _, middle in classes:
        _, alike, count = np.unique(middle[own], return_inverse=True, return_counts=True)
        own = own[count[alike] > 1]
        low[own], high[own] = np.minimum(low[own], first[own]), np.maximum(high[own], last[own])
    kept = np.flatnonzero(high >= 0)
    parts = [content[i][s : e + length] for i, s, e in zip(kept.tolist(), low[kept].tolist(), high[kept].tolist(), strict=True)]
    start = group.column("start").to_numpy()[kept] + low[kept]
    return pa.table({"gram": gram[kept], "content": pa.array(parts, pa.binary()), "id": group.column("id").to_numpy()[kept], "start": start})


def _sorted_repeats(length: int):
    def run(group: pa.Table) -> pa.Table:
        # strings of one segment hold the gram at different offsets, so they differ: a segment alone with its gram has no repeats
        _, gram, size = np.unique(group.column("gram").to_numpy(), return_inverse=True, return_counts=True)
        group = group.filter(pa.array(size[gram] > 1, pa.bool_()))
        if not group.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
        content = group.column("content").to_pylist()
        ids, starts = group.column("id").to_numpy(), group.column("start").to_numpy()
        sizes = np.fromiter(map(len, content), np.int64, len(content))
        base = np.cumsum(sizes + 1) - sizes - 1
        text = np.frombuffer(b"\0".join(content) + b"\0", np.uint8).astype(np.int32) + 1
        text[base + sizes] = 0
        order, common = suffixes_with_common(text, length)
        same = common >= length
        group_of = np.cumsum(~same)
        keep = same | np.append(same[1:], False)  # in a group of two or more
        order, group_of = order[keep], group_of[keep]
        owner = np.searchsorted(base, order, side="right") - 1
        at = starts[owner] + order - base[owner]
        by = np.lexsort((at, ids[owner], group_of))
        repeat = np.concatenate([[False], group_of[by][1:] == group_of[by][:-1]])[: len(by)]
        owner, at = owner[by][repeat], at[by][repeat]
        by = np.lexsort((at, owner))
        owner, at = owner[by], at[by]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)])
        last = np.append(first[1:], len(at))[: len(first)] - 1
        return pa.table({"id": ids[owner[first]], "start": at[first], "end": at[last] + length})

    return run


def _shard_repeats(length: int):
    """Repeats of a shard, found in pieces of whole grams, which share no strings."""
    sort = _sorted_repeats(length)

    def run(group: pa.Table) -> pa.Table:
        kept = _with_partners(group, length)
        _, gram = np.unique(kept.column("gram").to_numpy(), return_inverse=True)
        size = np.bincount(gram, weights=pc.binary_length(kept.column("content")).to_numpy())
        piece = ((np.cumsum(size) - size) // _SORT_BYTES)[gram]
        found = [sort(kept.filter(pa.array(piece == p, pa.bool_()))) for p in np.unique(piece)]
        give_back()
        return pa.concat_tables(found) if found else sort(kept)

    return run


def _strings(segments: DataFrame, length: int) -> DataFrame:
    """``digest, id, start`` of every string of ``length`` bytes in segments (``content, id, start``)."""

    def run(batches):
        for part in slices(batches, "content", _SLICE_BYTES):
            content = column(part, "content")
            counts = np.fromiter((len(c) - length + 1 for c in content), np.int64, len(content))
            owner = pa.array(np.repeat(np.arange(len(content)), counts))
            ahead = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            digests = [hashlib.blake2b(c[i : i + length], digest_size=16).digest() for c in content for i in range(len(c) - length + 1)]
            starts = part.column("start").to_numpy(zero_copy_only=False)[owner.to_numpy()] + ahead
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), part.column("id").take(owner), pa.array(starts, pa.int64())], names=["digest", "id", "start"]
            )

    return segments.select("content", "id", "start").mapInArrow(run, "digest binary, id long, start long")


def _repeats_by_digest(segments: DataFrame, length: int) -> DataFrame:
    """What the shards find, ``id, start, end``, without bringing the segments of a gram together."""
    strings = materialise(_strings(segments, length))
    firsts = strings.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("at"), F.count("*").alias("n"))
    firsts = materialise(firsts.filter("n > 1").select("digest", F.col("at.id").alias("first_id"), F.col("at.start").alias("first_start")))
    found = lookup_join(strings, firsts, "digest", how="inner")
    later = (F.col("id") != F.col("first_id")) | (F.col("start") != F.col("first_start"))
    return found.filter(later).select("id", "start", (F.col("start") + length).alias("end"))


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Of ``id, md5, text``: the first row of every text (``id, md5, first``) and spans ``id, start, end`` to remove.

    Spans are given for first rows only and may overlap.
    """
    facts = materialise(rows.select("id", "md5", F.octet_length("text").cast("long").alias("size")))
    size = facts.agg(F.sum("size")).first()[0] or 0
    firsts = facts.groupBy("md5").agg(F.min("id").alias("id"))
    grams = _packed_grams(rows.select("id", "text"), length, int(size // _RANGE_BYTES).bit_length())
    found = grams.groupBy("part").applyInArrow(_repeated_grams, "node long, place long")
    places = found.groupBy("node").agg(F.collect_list("place").alias("places"))
    node = F.conv(F.substring("md5", 1, 16), 16, -10).cast("long")  # as the tasks read it: 8 bytes, signed
    wanted = firsts.select("id", "md5", node.alias("node")).join(places, "node").select("id", "md5", "places")
    cut = _cut_segments(rows.join(wanted, ["id", "md5"]).dropDuplicates(["id", "md5"]), length)
    segments = materialise(cut, compression="zstd")  # neighbouring segments overlap
    alike = segments.groupBy("gram", "key")
    distinct = alike.agg(F.min(F.struct("id", "start")).alias("at"), F.min("content").alias("content"), F.min("size").alias("size"), F.min("ahead").alias("ahead"))
    distinct = materialise(distinct, compression="zstd")
    # a sort has a fixed cost, so shards are as few as the distinct segments allow
    bits = int((distinct.agg(F.sum("size")).first()[0] or 0) // _SHARD_BYTES).bit_length()
    first_of = distinct.select("gram", "key", "at")
    sizes = distinct.groupBy("gram").agg(F.sum("size").alias("size"))
    # at most two for each _SHARD_BYTES of segments
    hot = materialise(sizes.filter(F.col("size") > _SHARD_BYTES // 2).select("gram"))
    spread = None
    if not hot.isEmpty():
        large = distinct.join(F.broadcast(hot), "gram", "left_semi").select("content", "at.id", "at.start")
        spread = _repeats_by_digest(large, length)
        distinct = distinct.join(F.broadcast(hot), "gram", "left_anti")
    # hashed again for the same reason as the ranges: by the leading bits of the gram most segments would meet in a few shards
    part = F.shiftrightunsigned(F.xxhash64("gram"), 64 - bits) if bits else F.lit(0).cast("long")
    shards = distinct.select(part.alias("part"), "gram", "content", "ahead", "at.id", "at.start")
    # as many tasks as shards: small shuffle partitions put together would sort them one after the other
    dealt = shards.repartition(1 << bits, "part")
    inside = dealt.groupBy("part").applyInArrow(_shard_repeats(length), "id long, start long, end long")
    later = (
        segments.select("gram", "key", "id", "start", "size")
        .join(first_of, ["gram", "key"])
        .filter(F.struct("id", "start") != F.col("at"))
        .select("id", "start", (F.col("start") + F.col("size")).alias("end"))
    )
    spans = inside.unionByName(later)
    return firsts, spans if spread is None else spans.unionByName(spread)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, n_bytes, spans, kept`` (binary) for every row; spans are maximal removed runs of bytes.

    Null texts are empty. Texts shorter than ``length`` stay whole. Rows of a repeated id must have one text
    and get one result; rows with a null id stay whole and are no earlier place for others. Ids are
    whole numbers, which give the order of documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    keyed = rows.withColumn("md5", F.md5("text"))
    firsts, spans = repeated_spans(keyed.filter("id IS NOT NULL"), length)
    per_doc = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    info = firsts.withColumnRenamed("id", "first").join(per_doc.withColumnRenamed("id", "first"), "first", "left")
    owners = keyed.filter("id IS NOT NULL").select("id", "md5").distinct().join(info, "md5").filter("id > first OR found IS NOT NULL")
    own = owners.select(F.col("id").alias("__id"), (F.col("id") > F.col("first")).alias("copy"), F.when(F.col("id") == F.col("first"), F.col("found")).alias("found"))
    joined = rows.join(own, F.col("id") == F.col("__id"), "left").select("id", "text", "copy", "found")

    def cut(batch):
        n_bytes, spans, kept = [], [], []
        for text, copy, found in zip(texts(batch.rename_columns(["id", "text", "copy", "found"])), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n = len(text)
            if copy:
                own = [(0, n)] if n >= length else []
            else:
                own = merged([s["start"] for s in found], [s["end"] for s in found]) if found else []
            out, last = [], 0
            for s, e in own:
                out.append(text[last:s])
                last = e
            n_bytes.append(n)
            spans.append([{"start": s, "end": e} for s, e in own])
            kept.append(b"".join(out) + text[last:])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(n_bytes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]

    done = with_columns(joined, "n_bytes long, spans array<struct<start: long, end: long>>, kept binary", cut)
    return done.select("id", "n_bytes", "spans", "kept")


@query()
def op9_suffix_dedup(spark, sf_dir):
    """Repeated 100-byte strings removed from all ``documents``."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
