"""Golden values of the row-local operators."""

import pytest
from pyspark.sql import functions as F

from gazette import columns as C
from gazette.functions import arrays, text as X
from gazette.operators import checks, filters, history, labels, mapping, sampling, scoring, text as T
from gazette.sources import files
from gazette.operators.decay import add_decay_weights, decay_weighting_nested_lists


def values(df, column, key="k"):
    return [r[0] for r in df.orderBy(key).select(column).collect()]


def frame(spark, schema, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"k int, {schema}")


def test_labels(spark):
    df = frame(spark, "i array<int>, c array<int>", ([1, 2, 3], [2, 3, 4]), ([4, 5, 6], [3, 5]), ([7, 8], None), ([1, None], [None]), ([], [1]))
    out = labels.create_binary_labels_column(df, clicked_col="c", inview_col="i")
    assert values(out, "labels") == [[0, 1, 1], [0, 1, 0], [0, 0], [0, 0], []]
    assert out.schema["labels"].dataType.simpleString() == "array<tinyint>"


def test_shuffled_labels_follow_their_ids(spark):
    df = frame(spark, "i array<int>, c array<int>", ([1, 2, 3, 4, 5], [2, 4]), ([6, 7, 8], [8]))
    out = labels.create_binary_labels_column(df, True, 3, "c", "i", key="k")
    for r in out.collect():
        assert {x for x, y in zip(r["i"], r["labels"]) if y} == set(r["c"])


def test_minimum_negatives(spark):
    df = frame(spark, "i array<int>, c array<int>", ([1, 2, 3], [1]), ([1], [1]), ([1, 2, 3], [1, 2]), ([1, 2], None))
    keep = lambda n: values(filters.filter_minimum_negative_samples(df, n, "i", "c"), "k")
    assert keep(1) == [0, 2] and keep(2) == [0] and keep(None) == keep(0) == [0, 1, 2, 3]


def test_length_filters(spark):
    df = frame(spark, "l array<int>", ([1, 2, 3],), ([1],), (None,))
    assert values(filters.filter_minimum_lengths_from_list(df, 2, "l"), "k") == [0]
    assert values(filters.filter_maximum_lengths_from_list(df, 2, "l"), "k") == [1]
    assert filters.filter_minimum_lengths_from_list(df, 2, "absent") is df


@pytest.mark.parametrize("as_frame", [False, True])
def test_list_and_element_filters(spark, as_frame):
    ids = [1, 3, 5, 7]
    wanted = spark.createDataFrame([(i,) for i in ids + [None]], "id int") if as_frame else ids
    df = frame(spark, "l array<int>", ([1, 2, 3],), ([3, 4],), (None,), ([7, 8],), ([9, 10],))
    assert values(filters.filter_list_elements(df, "l", wanted, key="k"), "l") == [[1, 3], [3], None, [7], None]
    one = frame(spark, "x int", (1,), (2,), (3,), (4,), (5,), (None,))
    assert values(filters.filter_elements(one, "x", wanted), "x") == [1, None, 3, None, 5, None]
    users = frame(spark, "user_id int", (1,), (2,), (3,), (4,))
    known = spark.createDataFrame([(2,), (4,)], "u int") if as_frame else [2, 4]
    assert values(filters.add_known_user_column(users, known), C.KNOWN_USER) == [False, True, False, True]


def test_remove_positives_keeps_order_and_repeats(spark):
    df = frame(spark, "i array<int>, c array<int>", ([1, 2, 3], [1, 2]), ([3, 1, 3], [1]), ([1, 2], None))
    assert values(sampling.remove_positives_from_inview(df, "i", "c"), "i") == [[3], [3, 3], [1, 2]]


def test_history_tail_and_padding(spark):
    df = frame(spark, "h array<string>", (list("abc"),), (list("defg"),), (list("hi"),), (None,), ([],))
    cut = history.truncate_history(df, "h", 3, enable_warning=False)
    assert values(cut, "h") == [list("abc"), list("efg"), list("hi"), None, []]
    padded = history.truncate_history(df, "h", 3, "-", enable_warning=False)
    assert values(padded, "h") == [list("abc"), list("efg"), list("-hi"), None, list("---")]
    with pytest.warns(UserWarning):
        history.truncate_history(df, "h", 3)


def test_small_list_helpers(spark):
    df = frame(spark, "l array<int>", ([1, None, 3],), (None,), ([4, 5],))
    assert values(history.drop_nulls_from_list(df, "l"), "l") == [[1, 3], None, [4, 5]]
    df = frame(spark, "l array<int>", ([1, 2, 3, 3],), ([3, 4, 3, 5],))
    assert values(sampling.keep_unique_values_in_list(df, "l"), "l") == [[1, 2, 3], [3, 4, 5]]
    df = frame(spark, "l array<int>", ([0, 0, 1, 1, 0, 0],), ([1, 2, 3, 4],), ([],), (None,))
    assert values(df.select("k", arrays.chunked("l", 3).alias("l")), "l") == [[[0, 0, 1], [1, 0, 0]], [[1, 2, 3], [4]], [], None]


def test_equal_lengths(spark):
    df = frame(spark, "a array<int>, b array<int>", ([1], [2]), ([1, 2], [3, 4]))
    checks.validate_equal_list_column_lengths(df, "a", "b")
    with pytest.raises(ValueError):
        checks.validate_equal_list_column_lengths(df.unionByName(frame(spark, "a array<int>, b array<int>", ([1], []))), "a", "b")


def test_decay(spark):
    one = spark.range(1)
    w = lambda c: one.select(c).first()[0]
    assert w(arrays.linear_decay_weights(5)) == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0])
    assert w(arrays.linear_decay_weights(5, False)) == pytest.approx([1.0, 0.8, 0.6, 0.4, 0.2])
    assert w(arrays.exponential_decay_weights(5, 0.5)) == pytest.approx([0.0625, 0.125, 0.25, 0.5, 1.0])
    assert w(arrays.linear_decay_weights(0)) == []
    df = frame(spark, "h array<array<double>>", ([[1.0]] * 4,), ([[1.0, 1.0]] * 2,), ([[1.0], None],), (None,))
    weighted = add_decay_weights(df, "h", arrays.linear_decay_weights)
    assert values(weighted, "h_weights")[1:] == [[0.5, 1.0], [0.5, 1.0], []]
    scaled = decay_weighting_nested_lists(weighted, "h", "h_weights")
    assert values(scaled, "h") == [[[0.25], [0.5], [0.75], [1.0]], [[0.5, 0.5], [1.0, 1.0]], [[0.5], [None]], None]


def test_text(spark):
    df = frame(spark, "a string, b string, l array<string>", ("John", "Doe", ["ab", "cd"]), ("Jane", None, ["x", None]))
    out, name = T.concat_str_columns(df, ["a", "b"])
    assert name == "a-b" and values(out, F.col("`a-b`")) == ["John Doe", None]
    assert values(T.concat_list_str(df, "l"), "l") == ["ab cd", "x"]
    counts = frame(spark, "t string", ("a b",), ("a  b",), ("",), (None,))
    assert values(counts.select("k", X.word_count("t").alias("n")), "n") == [2, 3, 0, 0]
    assert spark.range(1).select(X.format_delta(F.lit(86400 + 3 * 3600 + 42 * 60 + 54))).first()[0] == "1 days 3:42:54"


def test_encoding_and_hashed_vectors(spark):
    df = frame(spark, "t string", ("b a b",), ("c!",), ("",), (None,))
    vocab = T.vocabulary(df, "t")
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"b": 1, "a": 2, "c": 3}
    out, name = T.convert_text2encoding(df, vocab.filter("token <> 'c'"), "t", max_length=2, key="k")
    assert name == "t_encode_vocab" and values(out, name) == [[1, 2], [0, 0], [0, 0], None]
    vectors = values(T.hashed_embeddings(df, "t", 16, key="k"), "embedding")
    assert sorted(x for x in vectors[0] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and sum(vectors[1]) == pytest.approx(1)
    assert not any(vectors[2])
    own = T.encode_with(df, "t", lambda texts: [[len(t), 1.0] for t in texts], key="k")
    assert values(own, "embedding") == [[5.0, 1.0], [2.0, 1.0], [0.0, 1.0], [0.0, 1.0]]


def test_encoding_by_block_dictionaries(spark, monkeypatch):
    """A block joins a distinct token once; results don't depend on how rows fall into blocks."""
    texts = ["b a b", "c b!", "", None, "x a a a", "b b b b b b b b", "a"]
    df = frame(spark, "t string", *[(t,) for t in texts]).coalesce(1)
    vocab = T.vocabulary(df, "t")
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert ids == {"b": 1, "a": 2, "c": 3, "x": 4}
    inner, joined = T.lookup_join, []
    monkeypatch.setattr(T, "lookup_join", lambda rows, *a, **o: joined.append(rows.count()) or inner(rows, *a, **o))
    want = [None if t is None else [ids[w] for w in t.replace("!", "").split()] for t in texts]
    for limit, distinct in ((1 << 20, 4), (5, 2 + 2 + 2 + 1 + 1), (1, 2 + 2 + 2 + 1 + 1)):
        monkeypatch.setattr(T, "_BLOCK_TOKENS", limit)
        out, name = T.convert_text2encoding(df, vocab, "t", key="k")
        assert values(out, name) == want
        assert joined.pop() <= distinct + (limit == 5)
    keys = "a int, b string, t string"
    repeated = spark.createDataFrame([(1, "x", "b a"), (1, "x", "c"), (1, None, "a b"), (2, "x", "zz b"), (2, "x", "zz b")], keys)
    twice = vocab.unionByName(vocab.filter("token = 'c'").withColumn("id", F.col("id") + 6))
    out, name = T.convert_text2encoding(repeated.filter("a = 1"), vocab, "t", key=["a", "b"])
    assert sorted((r["t"], r[name]) for r in out.collect()) == [("a b", []), ("b a", [1, 3, 2]), ("c", [1, 3, 2])]
    out, name = T.convert_text2encoding(repeated.filter("a = 2"), vocab, "t", key=["a", "b"], unknown=-1)
    assert [r[name] for r in out.collect()] == [[-1, -1, 1, 1]] * 2
    out, name = T.convert_text2encoding(df, twice, "t", key="k")
    assert values(out, name)[:2] == [[1, 2, 1], [3, 9, 1]]


def test_token_sums_of_a_block_are_one_row_per_token():
    import pyarrow as pa

    own = [" ".join(["a", "b"] * 50), "b c a", None, "", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(own)], names=["w"])
    whole = [r for b in T._neighbour_sums(16, 2, 0, 1 << 20)([batch]) for r in b.to_pylist()]
    assert sorted(r["token"] for r in whole) == ["a", "b", "c"]
    cut = [r for b in T._neighbour_sums(16, 2, 0, 3)([batch]) for r in b.to_pylist()]
    assert sorted(r["token"] for r in cut) == ["a", "a", "b", "b", "c"]

    def total(rows):
        sums = {}
        for r in rows:
            for d, x in zip(r["dims"], r["sums"], strict=True):
                sums[r["token"], d] = sums.get((r["token"], d), 0) + x
        return sums

    assert total(whole) == total(cut)
    rows = pa.RecordBatch.from_pylist(sorted(cut, key=lambda r: r["token"]), schema=pa.schema([("token", pa.string()), ("dims", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))]))
    apart = [r for b in T._unit_vectors(16)([rows.slice(i, 1) for i in range(5)]) for r in b.to_pylist()]
    assert [r["token"] for r in apart] == ["a", "b", "c"]
    for r in apart:
        plain = [total(whole).get((r["token"], d), 0) for d in range(16)]
        length = sum(x * x for x in plain) ** 0.5
        assert r["vector"] == pytest.approx([x / length if length else 0.0 for x in plain])


def test_token_vectors_match_brute_force(spark):
    import hashlib

    texts = ["a b c a", "b c", "d", "e f e f g a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {r["token"]: r["vector"] for r in T.token_vectors(df, "t", dim=8, window=2).collect()}
    want = {}
    for t in texts:
        w = t.split()
        for i, token in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    h = hashlib.md5(f"0:{w[j]}".encode()).hexdigest()
                    v = want.setdefault(token, [0.0] * 8)
                    v[int(h[:8], 16) % 8] += 1 if h[8] < "8" else -1
    assert set(got) == set(want)
    for token, v in want.items():
        length = sum(x * x for x in v) ** 0.5
        assert got[token] == pytest.approx([x / length if length else 0.0 for x in v])


def test_map_list_modes(spark):
    df = frame(spark, "ids array<string>", (["A1", "A2"],), (["A2", "A3"],), (["A1", "A4"],), (["A4", "A4"],), (None,))
    table = spark.createDataFrame([("A1", "News"), ("A2", "Sports"), ("A3", "Ent")], "id string, v string")
    run = lambda **o: values(mapping.map_list_article_id_to_value(df, "ids", table, key="k", **o), "ids")
    assert run(fill_nulls="?") == [["News", "Sports"], ["Sports", "Ent"], ["News", "?"], ["?", "?"], ["?"]]
    assert run(drop_nulls=True, fill_nulls="?") == [["News", "Sports"], ["Sports", "Ent"], ["News"], None, None]
    assert run() == [["News", "Sports"], ["Sports", "Ent"], ["News", None], [None, None], [None]]


def test_score_lookup_unknown_ids(spark):
    df = frame(spark, "i array<int>", ([1, 2, 9],))
    table = spark.createDataFrame([(1, 5.0), (2, None)], "id int, s double")
    assert values(mapping.score_lists(df, table, "i", key="k"), "s") == [[5.0, 0.0, 0.0]]
    assert values(mapping.score_lists(df, table, "i", unknown="keep", key="k"), "s") == [[5.0, 0.0, 9.0]]


def test_lookup_objects_and_gather(spark):
    v = spark.createDataFrame([(10, [0.1, 0.2]), (20, [0.4, 0.5]), (30, [0.7, 0.8])], "id int, vec array<double>")
    index, matrix = labels.create_lookup_objects(v, "zeros")
    assert sorted(map(tuple, index.collect())) == [(10, 1), (20, 2), (30, 3)]
    assert [r[1] for r in matrix.orderBy("idx").collect()] == [[0.0, 0.0], [0.1, 0.2], [0.4, 0.5], [0.7, 0.8]]
    assert labels.create_lookup_objects(v, "mean")[1].orderBy("idx").first()[1] == pytest.approx([0.4, 0.5])
    with pytest.raises(ValueError):
        labels.create_lookup_objects(v, "median")
    df = frame(spark, "i array<int>", ([30, 99],))
    assert values(mapping.gather_vectors(df, "i", v, key="k"), "i") == [[[0.7, 0.8], [0.0, 0.0]]]
    got = values(mapping.gather_vectors(df, "i", v, "mean", key="k"), "i")[0]
    assert got[0] == [0.7, 0.8] and got[1] == pytest.approx([0.4, 0.5])


def test_ranks_and_submission(spark, tmp_path):
    df = frame(spark, "s array<double>", ([0.2, 0.1, 0.3],), ([0.1, 0.2],), ([0.4, 0.2, 0.1, 0.3],), ([0.5, 0.5],), ([],))
    ranked = scoring.rank_predictions_by_score(df, "s")
    assert values(ranked, "s") == [[2, 3, 1], [2, 1], [1, 3, 4, 2], [2, 1], []]
    files.write_submission_file(ranked, "s", str(tmp_path / "out"), key="k")
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines[0] == "0 [2,3,1]" and lines[4] == "4 []"
    back = files.read_submission_file(spark, str(tmp_path / "out"))
    assert {r[0]: r[1] for r in back.collect()}["2"] == [1.0, 3.0, 4.0, 2.0]


def test_attach_scores(spark):
    df = frame(spark, "i array<int>", ([1, 2, 3],), ([4, 5],), ([],))
    flat = spark.createDataFrame([(n, s) for n, s in enumerate([0.3, 0.4, 0.5, 0.6, 0.7])], "nr long, s double")
    out = scoring.add_flat_prediction_scores(df, flat, inview_col="i", key="k")
    assert values(out, C.SCORES) == [[0.3, 0.4, 0.5], [0.6, 0.7], None]


def test_sort_score(spark):
    df = spark.createDataFrame([(1, 100), (2, 150), (3, 200), (4, 50), (5, 300), (6, None)], "article_id int, views int")
    out = scoring.create_sort_based_prediction_score(df, "views", True)
    assert {r[0]: r[2] for r in out.collect()} == {6: 1.0, 5: 1 / 2, 3: 1 / 3, 2: 1 / 4, 1: 1 / 5, 4: 1 / 6}


def test_flatten(spark):
    df = spark.sql("select 'v1' key1, named_struct('n1', 'a', 'n2', named_struct('d', 'b')) key2")
    out = checks.flatten_struct(df)
    assert out.columns == ["key1", "n1-key2", "d-n2-key2"] and tuple(out.first()) == ("v1", "a", "b")


def test_join_history_from_files(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 8)], "impression_id int, user_id int").write.parquet(str(tmp_path / "behaviors.parquet"))
    spark.createDataFrame([(7, [1, 2, 3])], "user_id int, article_id_fixed array<int>").write.parquet(str(tmp_path / "history.parquet"))
    out = files.impressions_from_path(spark, str(tmp_path), history_size=5)
    assert values(out, C.HISTORY_IDS, C.IMPRESSION_ID) == [[0, 0, 1, 2, 3], None]


def test_example_tables(spark):
    log = spark.createDataFrame([(1, 7, [10, 99], [0, 1]), (2, 8, [20], [1])], "impression_id int, user_id int, article_ids_inview array<int>, labels array<int>")
    past = spark.createDataFrame([(7, [20, 98])], "user_id int, article_id_fixed array<int>")
    index = spark.createDataFrame([(10, 1), (20, 2)], "id int, idx long")
    for rows in (
        labels.evaluation_examples(log, index, histories=past),
        labels.evaluation_examples(log.join(past, "user_id", "left"), index),
    ):
        got = sorted((r["impression_id"], r["pos"], r[C.INVIEW], r["labels"], r[C.HISTORY_IDS]) for r in rows.collect())
        assert got == [(1, 0, 1, 0, [2, 0]), (1, 1, 0, 1, [2, 0]), (2, 0, 2, 1, [0])]
    table = spark.createDataFrame([(10, "t10", 1), (20, "t20", 2)], "id int, title string, cat int")
    wide = labels.attribute_examples(log, table, unknown={"title": "?", "cat": 0}, histories=past, eval_mode=True)
    got = sorted((r["impression_id"], r["pos"], r["title_inview"], r["cat_inview"], r["title_history"], r["labels"]) for r in wide.collect())
    assert got == [(1, 0, "t10", 1, ["t20", "?"], 0), (1, 1, "?", 0, ["t20", "?"], 1), (2, 0, "t20", 2, ["?"], 1)]
    users = labels.with_user_index(log, known_users=log.filter("user_id = 7"))
    assert values(users, "user_index", C.IMPRESSION_ID) == [1, 0]
