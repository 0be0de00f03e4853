"""SimHash fingerprints and components against comparing all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gazette.llm.simhash import close_links, linked_fingerprints, simhash_groups


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """The smallest key reachable over all pairs of ``key -> fingerprint``."""
    parent = {k: k for k in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    rows = simhash_groups(docs).collect()
    assert {r["id"]: r["fp"] for r in rows} == {k: signed(v) for k, v in prints.items()}
    assert {r["id"]: r["component_id"] for r in rows} == components(prints)


def planted(rng, n):
    """Fingerprints in chains and balls, some with very few or very many bits."""
    base = [rng.getrandbits(64) for _ in range(n)] + [0, (1 << 64) - 1]
    out = set(base)
    for b in base:
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(1, 5)):
                b ^= 1 << rng.randrange(64)
            out.add(b)
    return sorted(out)


def test_planted_links_over_small_tiles(spark):
    """Cells of several tiles each: every link is found whatever the tile size."""
    rng = random.Random(1)
    ball = rng.getrandbits(64)
    prints = sorted({*planted(rng, 150), *(ball ^ 1 << i for i in range(64)), *(ball ^ 1 << i ^ 1 << j for i in range(20) for j in range(i))})
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    want = components({p: p for p in prints})
    for tile in (4, 1024):
        links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in linked_fingerprints(df, tile=tile).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in links)
        group = {p: p for p in prints}
        changed = True
        while changed:
            changed = False
            for a, b in links:
                low = min(group[a], group[b])
                if group[a] != low or group[b] != low:
                    group[a] = group[b] = low
                    changed = True
        assert group == want


def test_a_dense_pair_of_tiles_gives_a_spanning_set():
    ball = np.array([1 << i for i in range(60)], np.uint64)
    a, b = close_links(ball, ball, 2)
    assert len(a) < 2 * len(ball)


def test_hostile_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "a b c"), (6, "a b c"), (7, long), (8, long),
        (None, "one two"), (None, "alone here now"), (9, "é ß 漢字"),
    ]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp long, least string")
    got = sorted(((r["id"], r["fp"], r["component_id"]) for r in simhash_groups(df).collect()), key=str)
    prints = {k: plain_fingerprint(t) for k, (_, t) in enumerate(rows)}
    place = components(prints)
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in place if place[j] == place[k] and rows[j][0] is not None]
        want.append((i, signed(prints[k]), min(ids, default=None)))
    assert got == sorted(want, key=str)
    assert simhash_groups(df.filter(F.lit(False))).collect() == []
