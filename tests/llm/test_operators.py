"""The operators against brute force on the smallest tables and on hostile rows."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazette.llm import chat, decontaminate, induced, jaccard, language, lines, lm, packing, repeats, topk, toxicity
from gazette.llm.queries import QUERIES, SQL
from tests.test_queries import TABLES, normal

LONG = " ".join(f"word{i % 977}x" for i in range(60_000))
# (id, text): nulls, empty, blank, repeats of a row and of a text, ties, a very long text, control strings
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (6, "a b c d e f g"), (6, "a b c d e f g"),
    (7, LONG), (8, LONG + " end"), (9, "x" * 250), (10, "x" * 250 + "y"), (None, "a b c d e f g"), (None, None),
    (11, "é ß 漢字 <|endoftext|> </s>"), (12, "12 34 !!"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if t else None, "s", None) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def texts(small):
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    answer = con.execute(SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(answer.fetchall(), names)


def components(sets, percent=80):
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_jaccard(spark, small, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_jaccard_join"](spark, small).collect()}
    assert got == components({d: shingles(t) for d, t in texts.items()})


def test_jaccard_near_threshold(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"z{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    got = jaccard.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: (r.n_shingles, r.component_id) for r in got.collect()} == components({i: shingles(t) for i, t in rows})


def test_jaccard_odd(spark, odd):
    got = sorted(map(tuple, jaccard.near_duplicate_groups(odd).collect()), key=str)
    assert len(got) == len(ODD)
    found = {r[0]: r[2] for r in got if r[0] is not None}
    assert found[1] == 1 and found[2] == 2 and found[3] == 3 and found[5] == 4 and found[8] == 7 and found[6] == 6
    assert jaccard.near_duplicate_groups(odd.limit(0)).count() == 0


def test_topk_odd(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [-1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.topk_inner_products(df, F.col("vec_id") == 0, k=2).collect()]
    assert got == [(0, 1, 4, 5 * 1024 * 1024), (0, 2, 5, 5 * 1024 * 1024)]
    assert topk.topk_inner_products(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_pack(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op3_pack"](spark, small).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, text in texts.items():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces]])[:-1]) and sum(p.length for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
        assert all(p.length == 1024 for p in pieces[1:])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= math.ceil(sum(r.length for r in rows) / 1024) + 3


def test_pack_capacities_and_ids(spark, odd):
    import public_tokenizers

    plan = packing.plan_sequences({10: 50, 3: 100, 40: 7}, 64, max_docs=3, max_attention=2500, select="dot")
    held = collections.Counter()
    for n, lengths in plan:
        assert sum(lengths) <= 64 and len(lengths) <= 3 and sum(x * x for x in lengths) <= 2500
        held.update({x: n * c for x, c in collections.Counter(lengths).items()})
    assert held == {10: 50, 3: 100, 40: 7}
    whole = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)
    for s in packing.sequences(whole).collect():
        assert len(s.ids) == 4 * sum(p.length for p in s.pieces) <= 4096
    assert packing.pack(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_tokenizer_chunks():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "it's", "é", "漢", "1", "!", " ", "　", "\x1c", "\x85", "<|endoftext|>", "don't"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    model, own = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    want = [np.array(model.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in cases]
    assert own.encode(cases) == want


def test_tokenizer_forgets(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, own = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    monkeypatch.setattr(packing, "_KNOWN", 40)
    monkeypatch.setattr(packing, "_ROW", 3)
    signs = [" ", "  ", "\n", "\t", "\r", "a", "Bc", "9", "'s", "'", "\u00e9", "\u00a0", "\u3000", "\0", "\x1c", ",", "...", "\x85", "_", "\u4e2d", "\u0301", "<|endoftext|>", "\U0001f600"]
    rng = np.random.default_rng(3)
    for _ in range(400):
        some = ["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(10)] + ["x" * 100, ""]
        want = [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        assert own.encode(some) == want
        assert len(own.known) <= 40 and len(own.cuts) == len(own.known) + 1
        assert max((len(x.encode()) for x in own.known.to_pylist()), default=0) <= 64


def test_line_dedup_odd(spark, odd):
    got = lines.drop_recurring_lines(odd).collect()
    assert len(got) == len(ODD) and all(r.n_dropped == 0 for r in got)
    rows = [(i, " ".join(c * k for k in range(1, 9) for c in "abcdefghijklmno"[i : i + 3]) + f"\nAll rights reserved {i} by us.\n") for i in range(12)]
    done = lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_constant=50).collect()
    assert all(r.n_dropped == 1 and "rights" not in r.text for r in done)
    assert lines.drop_recurring_lines(odd.limit(0)).count() == 0
    clash = spark.createDataFrame([(*r, 7, "x", None) for r in rows], "doc_id long, text string, at long, h string, chars string")
    done = lines.drop_recurring_lines(clash, min_constant=50).collect()
    assert all(r.n_dropped == 1 and r.at == 7 and r.h == "x" and r.chars is None for r in done)


def test_lines_across_copies(spark):
    def words(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))

    short = [f"{w} to the list of our {w}s today" for w in ("home", "sign", "mail")]  # in 12 different documents
    rows = [(i, "\n".join([words(i, 60), short[i % 3], short[(i + 1) % 3]])) for i in range(40)]
    rows += [(100, "\n".join(short))]  # made up of recurring lines, and a copy of nothing
    own = [words(1000 + k, 12) for k in range(30)]
    rows += [(200 + k, "\n".join([*own, short[0]]) + f"\nnumber {words(5000 + k, 1)}") for k in range(15)]  # near copies
    got = {r.doc_id: r.text for r in lines.drop_lines_across_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "" and all(not any(x in t for x in short) for t in got.values())
    assert all(all(x in got[200 + k] for x in own) for k in range(15)) and all(words(i, 60) in got[i] for i in range(40))


def test_lines_of_one_document_and_long_passages(spark):
    def words(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))

    verse = "\n".join(f"the river runs to {words(k, 1)} and on to the sea" for k in range(12))
    passage, figures = words(7, 60), " ".join(["total of the year", *["and of the next 1"] * 20])
    rows = [(i, words(100 + i, 80) + "\n" + words(200 + i, 90)) for i in range(8)]
    rows = [(i, t + f"\n{passage}" * (i in (2, 5, 6)) + (f"\n{figures}{i}" if i in (3, 4) else "")) for i, t in rows]
    rows += [(50, words(300, 80) + "\n" + verse), (60, f"{words(400, 80)}\nsome words of a line that nine have")]
    got = {r.doc_id: r.text for r in lines.drop_lines_across_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in got if passage in got[i]] == [2]
    assert all(got[i] == t.replace(f"\n{passage}", "" if i != 2 else f"\n{passage}") for i, t in rows)


def test_lm(spark, small, texts):
    def tokens(t):
        return [*(t or "").encode().lower().split(), None]

    taught = {d: t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1}
    c, pairs = collections.Counter(), collections.Counter()
    for t in taught.values():
        w = tokens(t)
        c.update(w)
        pairs.update(zip([None, *w], w))
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op5_lm_score"](spark, small).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.held_out == (r.doc_id not in taught) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd(spark, odd):
    got = lm.interpolated_scores(odd, F.col("doc_id") == 7).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    nothing = lm.interpolated_scores(odd, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
    assert lm.interpolated_scores(odd.limit(0), F.lit(False)).count() == 0


def test_weights_are_learnt():
    cells = [(3, 1 + 8, 1 + 80, 900), (3, 0, 1 + 80, 100), (1, 0, 1 + 40, 500)]
    w = lm.learn_weights(cells, 1000)
    assert w[3][0] > 0.5 > w[1][0] and np.allclose(w.sum(axis=1), 1)


def test_language(spark, small):
    truth = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{small}/documents.parquet'").fetchall())
    rows = QUERIES["op6_language_id"](spark, small).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in rows} == set(truth) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_odd(spark, odd):
    taught = odd.withColumn("lang_pred", F.lit(9))
    got = language.identify(taught, language.learn_prototypes(taught)).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3, 12)] == ["und"] * 4 and len(got) == len(ODD)
    assert language.learn_prototypes(odd.limit(0)) == {}
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}


def test_binding_is_that_of_single_letters():
    enc = language.Encoder(64, 3, 7)
    text = "Ab, éa b"
    symbols = [0, *map(ord, "ab"), 0, *map(ord, "éa"), 0, ord("b"), 0, 0, 0]
    want = sum(
        np.roll(enc._letter(symbols[i]), 0).astype(int) * np.roll(enc._letter(symbols[i + 1]), 1) * np.roll(enc._letter(symbols[i + 2]), 2)
        for i in range(len(symbols) - 2)
    )
    assert (enc.bundle(text) == want).all()


def test_contamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "One!"), (None, "a b"), (4, "c d e"), (4, "c d e"), (5, LONG[:5000])], "item_id long, text string")
    for block in (1 << 20, 10):
        got = {r.id: r for r in decontaminate.contamination(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), bench, block_bytes=block).collect()}
        assert [tuple(s) for s in got[4].spans] == [(0, 1)] and got[4]["items"] == ["3"]
        assert [tuple(s) for s in got[6].spans] == [(2, 5)] and got[6]["items"] == ["4"]
        assert got[1].n_words == 0 and got[7]["items"] == ["5"]
    assert decontaminate.contamination(odd, bench.limit(0)).filter(F.size("spans") > 0).count() == 0
    found = decontaminate.contamination(odd, bench)
    left = {r.doc_id: r.text for r in decontaminate.cut_spans(odd, found).collect()}
    assert left[6] == "a b  f g" and left[4] == " two" and left[1] is None


def test_toxicity(spark, small, odd):
    rows = QUERIES["op8_toxicity"](spark, small).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.learn(odd, labels)).collect()
    assert len(got) == len(ODD)
    empty = toxicity.learn(odd, labels.limit(0))
    assert len({r.score for r in toxicity.score(odd, empty).collect()}) == 1


def test_factorization_machine_finds_pairs():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({*rng.choice(200, 5), *([500] * a), *([501] * b)}), np.int32))
        y.append(float(a and b))
    model = toxicity.fit(rows, np.array(y))
    s = model.scores([np.array([500]), np.array([501]), np.array([500, 501]), np.array([], np.int32)])
    assert s[2] > 0.5 > max(s[0], s[1], s[3])


@pytest.mark.parametrize("size", [3e6, 3e9, 1e12, 1e200])
def test_topk_of_large_components(spark, size):
    """Components far above 2**31 after scaling keep their order; scores beyond a long are held at its ends."""
    vectors = [(0, [1.0, 1.0]), (1, [size, 0.0]), (2, [size * 4 / 3, 0.0]), (3, [-size, 0.5]), (4, [0.0, 0.0]), (5, [size, -size]), (6, [size / 7, 0.3])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.topk_inner_products(df, F.col("vec_id") % 2 == 0, k=3, block_rows=2, stripes=2).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors}
    want = set()
    for q in (0, 2, 4, 6):
        score = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))) for i, v in whole.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:3]
        want |= {(q, r + 1, i, score[i]) for r, i in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_topk_moves_blocks_once(spark, monkeypatch):
    """Query blocks reach each stripe once and candidates each query block once, however many partitions the session names."""
    frames, frame = [], type(spark.range(0))
    inner = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *args, **named: frames.append(df) or inner(df, *args, **named))
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = topk.topk_inner_products(df, F.col("vec_id") % 10 == 0, k=3, block_rows=50, stripes=4).collect()
        moved = frames[-1].select([F.length(c).alias(c) for c, kind in frames[-1].dtypes if kind == "binary"])
        total = moved.select(F.sum(sum(F.col(c) for c in moved.columns))).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    # an id and four components each: 40 queries to 4 stripes, 400 candidates to one block of queries
    assert total == (4 * 40 + 400) * 5 * 8
    whole = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    want = set()
    for q in range(0, 400, 10):
        scores = whole @ whole[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[i], i))[:3]
        want |= {(q, r + 1, i, scores[i]) for r, i in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_a_pair_counts_though_one_term_alone_says_nothing():
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(20_000):
        insult, group = rng.random() < 0.1, rng.random() < 0.1
        rows.append(np.array(sorted({*rng.integers(0, 3000, 20).tolist(), *([5000] * insult), *([5001] * group)}), np.int32))
        y.append(float(rng.random() < (0.9 if insult and group else 0.25 if insult else 0.02)))
    model = toxicity.fit(rows, np.array(y))
    insult, group, both = model.scores([np.array([5000]), np.array([5001]), np.array([5000, 5001])])
    assert {5000, 5001} <= set(model.places.tolist()) and both > 0.5 > max(insult, group)


def test_toxicity_held_out_ranking(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op8_toxicity"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet").dropna(subset=["toxic"]), "doc_id")
    got = rows.select("score", "toxic").toPandas()
    ranks, n = got.score.rank(), int(got.toxic.sum())
    auc = (ranks[got.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(got) - n))
    assert len(got) > 500 and auc >= 0.96


def test_toxicity_of_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "you fool", 5, "a"), (1, None, 6, "b"), (2, "hello", 7, "c"), (2, "hello", 7, "c"), (3, None, 1, "d")], "doc_id long, text string, y int, id string")
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, 0, "y"), (3, 0, "z")], "doc_id long, toxic int, text string")
    got = toxicity.score(docs, toxicity.learn(docs, labels, min_docs=1))
    assert got.columns == [*docs.columns, "score", "predicted"] and got.count() == 5


def removed(docs, n=100):
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                hit[i : i + n] = b"\1" * n
            seen.add(b[i : i + n])
        runs = sum(hit[i] and (i == 0 or not hit[i - 1]) for i in range(len(b)))
        out[d] = (len(b), sum(hit), runs, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest())
    return out


def test_repeats(spark, small, texts):
    rows = QUERIES["op9_suffix_dedup"](spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == removed(texts)


def test_repeats_odd(spark, odd):
    got = repeats.remove_repeats(odd)
    assert got.count() == len(ODD)
    want = removed({i: t for i, t in ODD if i is not None})
    for r in got.filter("id IS NOT NULL").collect():
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans)) == want[r.id][:3]
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


def test_repeats_of_a_hot_gram(spark, monkeypatch):
    limit, inner = 1 << 14, repeats._sorted_repeats

    def bounded(length):
        run = inner(length)

        def checked(group):
            assert sum(map(len, group.column("content").to_pylist())) <= 4 * limit
            return run(group)

        return checked

    monkeypatch.setattr(repeats, "_SHARD_BYTES", limit)
    monkeypatch.setattr(repeats, "_sorted_repeats", bounded)
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    short, long = noise(70), noise(108)  # the second has nine strings that repeat
    docs = {i: noise(90) + (short if i % 3 else long) + noise(90) for i in range(900)}
    docs |= {900 + i: docs[i] + noise(3) for i in range(0, 60, 7)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(df).collect()}
    assert got == removed(docs)


def test_repeats_are_spread(spark, monkeypatch):
    """Chosen grams have small hashes, yet no range and no shard takes most of them."""
    limit, inner, ranged = 1 << 14, repeats._sorted_repeats, repeats._repeated_grams

    def bounded(length):
        run = inner(length)

        def checked(group):
            assert sum(map(len, group.column("content").to_pylist())) <= 4 * limit
            return run(group)

        return checked

    def checked_range(group):
        assert sum(map(len, group.column("grams").to_pylist())) <= 4 * limit
        return ranged(group)

    monkeypatch.setattr(repeats, "_SHARD_BYTES", limit)
    monkeypatch.setattr(repeats, "_RANGE_BYTES", limit * 4)
    monkeypatch.setattr(repeats, "_sorted_repeats", bounded)
    monkeypatch.setattr(repeats, "_repeated_grams", checked_range)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passages = [noise(300) for _ in range(1000)]
    docs = {i: noise(9) + passages[i % 1000] + noise(20 + i % 5) for i in range(2000)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(df).collect()}
    assert got == removed(docs)


def test_segments_alone_with_their_gram_are_not_sorted(monkeypatch):
    inner, sorted_bytes = repeats.suffixes_with_common, []

    def counted(text, cap):
        sorted_bytes.append(len(text))
        return inner(text, cap)

    monkeypatch.setattr(repeats, "suffixes_with_common", counted)
    rng = random.Random(8)
    noise = lambda n: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=n))
    shared = noise(104)
    content = [noise(150), shared + noise(9), noise(7) + shared, noise(150), noise(140)]
    group = pa.table({"part": [0] * 5, "gram": [5, 6, 6, 7, 8], "content": content, "id": [1, 2, 3, 4, 5], "start": [0, 10, 20, 0, 0]})
    assert repeats._sorted_repeats(100)(group).to_pylist() == [{"id": 3, "start": 27, "end": 131}]
    assert sorted_bytes == [len(content[1]) + len(content[2]) + 2]
    assert repeats._sorted_repeats(100)(group.slice(0, 1)).num_rows == 0
    assert len(sorted_bytes) == 1


def test_starts_without_a_partner_are_not_sorted(monkeypatch):
    inner, sorted_bytes = repeats.suffixes_with_common, []

    def counted(text, cap):
        sorted_bytes.append(len(text))
        return inner(text, cap)

    monkeypatch.setattr(repeats, "suffixes_with_common", counted)
    rng = random.Random(9)
    noise = lambda n: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=n))
    phrase, passage = noise(32), noise(110)
    content = [noise(60) + phrase + noise(60), noise(60) + phrase + noise(60), noise(9) + passage + noise(5), noise(3) + passage + noise(20)]
    columns = {"part": [0] * 4, "gram": [5, 5, 6, 6], "content": content, "ahead": pa.array([60, 60, 49, 43], pa.int32()), "id": [1, 2, 3, 4], "start": [0, 10, 20, 30]}
    group = pa.table(columns)
    assert repeats._shard_repeats(100)(group).to_pylist() == [{"id": 4, "start": 33, "end": 143}]
    assert len(sorted_bytes) == 1 and sorted_bytes[0] < sum(map(len, content[2:])) + 2
    assert repeats._shard_repeats(100)(group.slice(0, 2)).num_rows == 0
    assert repeats._shard_repeats(100)(group.slice(0, 0)).num_rows == 0
    assert len(sorted_bytes) == 1


@pytest.mark.parametrize("limit", [1 << 8, 1 << 20])
def test_shards_find_every_repeat(monkeypatch, limit):
    monkeypatch.setattr(repeats, "_SORT_BYTES", limit)
    monkeypatch.setattr(repeats, "_SLICE_BYTES", 4 * limit)
    rng = random.Random(limit)
    found = 0
    for letters in ("abcdefghij ", "ab", "a"):
        noise = lambda n, letters=letters: bytes(rng.choices(letters.encode(), k=n))
        passages = [noise(rng.randint(60, 300)) for _ in range(6)]
        docs = [b"".join(rng.choice([noise(rng.randint(0, 60)), rng.choice(passages)]) for _ in range(6)) for _ in range(25)]
        text, start, count, place, grams = repeats._segments(docs, 100)
        segments = {}
        for t, s, c, p, g in zip(text.tolist(), start.tolist(), count.tolist(), place.tolist(), grams.view(np.int64).tolist(), strict=True):
            segments.setdefault((g, docs[t][s : s + c + 99]), (p - s, t, s))
        rows = [{"gram": g, "content": c, "ahead": a, "id": t, "start": s} for (g, c), (a, t, s) in segments.items()]
        schema = pa.schema({"gram": pa.int64(), "content": pa.binary(), "ahead": pa.int32(), "id": pa.int64(), "start": pa.int64()})
        got = repeats._shard_repeats(100)(pa.Table.from_pylist(rows, schema)).to_pylist()
        strings = sorted((r["content"][i : i + 100], r["id"], r["start"] + i) for r in rows for i in range(len(r["content"]) - 99))
        want = {(d, s) for (x, d, s), (y, _, _) in zip(strings[1:], strings[:-1], strict=True) if x == y}
        assert {(r["id"], i) for r in got for i in range(r["start"], r["end"] - 99)} == want
        found += len(want)
    assert found > 1000


def test_queue_chunks_leave_together():
    chunks = [(np.arange(i, dtype=np.int64), np.full(i, i, np.uint8)) for i in (3, 1, 4)]
    for budget, groups in ((1 << 20, [[0, 1, 2]]), (1, [[0], [1], [2]])):
        queues = induced.DiskQueues(2, budget)
        for position, common in chunks:
            queues.push(1, position, common)
        got = list(queues.pop(1))
        assert len(got) == len(groups)
        for (position, common), own in zip(got, groups, strict=True):
            assert position.tolist() == [x for i in own for x in chunks[i][0].tolist()]
            assert common.tolist() == [x for i in own for x in chunks[i][1].tolist()]
        assert queues.held == 0
        queues.close()


def test_induced_sorting():
    rng = random.Random(1)
    for _ in range(300):
        parts = [[rng.randint(1, rng.choice([1, 2, 3, 250])) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 5))]
        text = [x for p in [*parts, parts[0]] for x in [*p, 0]]
        zeros = iter(range(len(text)))
        key = [(0, next(zeros)) if x == 0 else (1, x) for x in text]
        want = sorted(range(len(text)), key=lambda i: key[i:])
        order, common = induced.suffixes_with_common(np.array(text), cap=20, budget=rng.choice([10, 1 << 20]))
        assert order.tolist() == want
        for i in range(1, len(want)):
            a, b, n = want[i - 1], want[i], 0
            while n < 20 and max(a, b) + n < len(key) and key[a + n] == key[b + n]:
                n += 1
            assert common[i] == n


def test_chat_trees(spark):
    rows = [
        ("r", None, 1.0, "user", "hi <|end|> \\ </s>[INST] x [/INST]"), ("a", "r", 2.0, "assistant", "<|user|>\n"),
        ("b", "r", 5.0, "assistant", "[b]"), ("c", "a", 9.0, "user", None), ("d", "gone", None, "us|>er", ""),
        ("e", "f", 1.0, "user", "x"), ("f", "e", 1.0, "user", "y"), (None, "r", 1.0, "user", "z"), ("b", "r", 5.0, "assistant", "[b]"),
    ]
    df = spark.createDataFrame(rows, "id string, parent string, score double, role string, text string")
    got = {(r.root, r.leaf): r for r in chat.format_trees(df, branches=None).collect()}
    assert set(got) == {("r", "c"), ("r", "b"), ("d", "d")} and got["r", "c"].branch == 1
    assert chat.parse(got["r", "c"].formatted) == [("user", rows[0][4]), ("assistant", "<|user|>\n"), ("user", "")]
    assert chat.parse(got["d", "d"].formatted) == [("us|>er", "")]
    assert {r.leaf for r in chat.format_trees(df).collect()} == {"c", "d"}
    assert chat.format_trees(df.limit(0)).count() == 0
