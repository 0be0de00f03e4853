"""Histories, splits, numbering and reproducible sampling."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gazette.operators import history, sampling
from gazette.plans.numbering import digest_index, row_index, running_total
from gazette.functions.draws import digest, distinct_draws

DAY = lambda n: dt.datetime(2023, 2, n)
ROWS = [
    (0, 9604210, DAY(18), 0),
    (0, 9634540, DAY(18), 2),
    (0, 9640420, DAY(25), 8),
    (1, 9647983, DAY(22), 13),
    (1, 9647984, DAY(21), 1),
    (1, 9647981, DAY(23), 1),
    (0, None, DAY(19), 6),
    (2, None, DAY(26), 1),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(ROWS)],
        "nr int, user_id long, article_id long, impression_time timestamp_ntz, read_time int",
    )


@pytest.mark.parametrize("hot_rows", [None, 3, 1])
def test_dynamic_history(log, hot_rows):
    out = history.create_dynamic_history(log, 3, tie_cols=["nr"], hot_rows=hot_rows)
    got = {r["nr"]: r["history_dynamic"] for r in out.collect()}
    assert got == {
        0: [],
        1: [9604210],
        6: [9604210, 9634540],
        2: [9604210, 9634540],
        4: [],
        3: [9647984],
        5: [9647984, 9647983],
        7: [],
    }
    assert out.columns == [*log.columns, "history_dynamic"]


@pytest.mark.parametrize("size, tails", [(None, [[9604210, 9634540], [9647984, 9647983, 9647981]]), (1, [[9634540], [9647981]])])
def test_fixed_history(log, size, tails):
    out = history.create_fixed_history(log, DAY(24), size, tie_cols=["nr"])
    for r in out.collect():
        assert r["history_fixed"] == [*tails, None][r["user_id"]]


def test_fixed_history_keeps_lists_parallel(spark, log):
    holed = log.withColumn("read_time", F.when(F.col("nr") != 3, F.col("read_time")))
    out = history.create_fixed_history_aggr_columns(holed, DAY(24), columns=["impression_time", "read_time"], tie_cols=["nr"])
    row = out.filter("nr = 5").first()
    assert row["article_id_fixed"] == [9647984, 9647983, 9647981]
    assert row["read_time_fixed"] == [1, None, 1]
    assert row["impression_time_fixed"] == [DAY(21), DAY(22), DAY(23)]
    assert out.filter("nr = 7").first()["read_time_fixed"] is None


def test_dynamic_history_of_a_hot_user_equals_the_window(spark):
    log = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("user_id"),
        F.when(F.col("id") % 7 != 0, F.col("id")).alias("article_id"),
        (F.col("id") * 7919 % 500).alias("impression_time"),
        F.col("id").alias("nr"),
    )
    run = lambda h: sorted((r["nr"], r["history_dynamic"]) for r in history.create_dynamic_history(log, 8, tie_cols=["nr"], hot_rows=h).collect())
    assert run(50) == run(10**9)


def test_down_sampling(log):
    got = [r["user_id"] for r in history.down_sample_on_users(log, 2, seed=1, key="nr").collect()]
    assert sorted(got) == [0, 0, 1, 1, 2]


def test_time_splits(log):
    train, rest = history.split_last_period(log, "INTERVAL 1 DAY")
    assert {r["nr"] for r in rest.collect()} == {2, 7} and train.count() == 6
    train, rest = history.split_by_date(log, 1)
    assert {r["nr"] for r in rest.collect()} == {2, 7} and train.count() == 6


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_numbering_does_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id"), (F.col("id") % 7).alias("v")).repartition(parts)
    got = {r["id"]: r["row_nr"] for r in row_index(df, ["id"]).collect()}
    assert got == {i: i for i in range(1000)}
    total = 0
    want = {}
    for i, v in sorted((r["id"], r["v"]) for r in df.collect()):
        want[i] = total
        total += v
    assert {r["id"]: r["t"] for r in running_total(df, ["id"], "v", "t", inclusive=False).collect()} == want
    order = sorted(r["id"] for r in df.collect())
    nr = {r["id"]: r["row_nr"] for r in digest_index(df, digest(5, "id")).collect()}
    assert sorted(nr.values()) == order
    first, second = sampling.split_df_fraction(df, 0.3, seed=5, key="id")
    assert {r["id"] for r in first.collect()} == {i for i, n in nr.items() if n < 300} and second.count() == 700


def test_copies_are_numbered_and_shuffled(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("t"))
    assert sorted(r["row_nr"] for r in row_index(df, ["t"]).collect()) == list(range(300))
    shuffled = [r[0] for r in sampling.shuffle_rows(df, 1).collect()]
    assert sorted(shuffled) == sorted(r[0] for r in df.collect())


def test_chunks_and_splits(spark):
    sizes = lambda parts: [p.count() for p in parts]
    df = spark.range(7)
    assert sizes(sampling.split_df_chunks(df, 3, key="id")) == [2, 2, 3]
    assert sizes(sampling.split_df_in_n(df, 3, key="id")) == [3, 3, 1]
    assert sizes(sampling.split_df_chunks(spark.range(3), 2, key="id")) == [1, 2]
    assert sizes(sampling.split_df_chunks(spark.range(2), 3, key="id")) == [0, 0, 2]
    with pytest.raises(ValueError):
        sampling.split_df_fraction(df, 1.0)
    a, b = sampling.split_df_fraction(df, 0.5, shuffle=False, key="id")
    assert [r[0] for r in a.orderBy("id").collect()] == [0, 1, 2] and b.count() == 4
    assert sampling.sample_rows(df, n=4, seed=1, key="id").count() == 4
    assert sampling.sample_rows(df, fraction=0.5, seed=1, key="id").count() == 3


def test_wu_sampling(spark):
    rows = [(0, [1, 2, 3], [1, 2]), (1, [1, 2, 3, 4], [1, 3]), (2, [1, 2, 3], [1]), (3, [1], [1]), (4, [1, 2], None)]
    df = spark.createDataFrame(rows, "impression_id int, article_ids_inview array<int>, article_ids_clicked array<int>")
    out = sampling.sampling_strategy_wu2019(df, 2, seed=123).collect()
    assert len(out) == 6
    source = {r[0]: r for r in rows}
    for i, shown, clicked in out:
        assert len(shown) == 3 and clicked == shown[-1:]
        negatives = set(source[i][1]) - set(source[i][2])
        assert set(shown[:-1]) <= (negatives or {None})
    mixed = sampling.sampling_strategy_wu2019(df, 2, shuffle=True, seed=123).collect()
    key = lambda r: (r[0], r[2])
    assert [sorted(r[1], key=str) for r in sorted(mixed, key=key)] == [sorted(r[1], key=str) for r in sorted(out, key=key)]
    enough = df.filter(F.size("article_ids_inview") > 3)
    for _, shown, _ in sampling.sampling_strategy_wu2019(enough, 2, False, False, 1).collect():
        assert sorted(shown[:2]) == [2, 4]
    with pytest.raises(Exception, match="without replacement"):
        sampling.sampling_strategy_wu2019(df, 2, False, False, 1).collect()
    assert sampling.sampling_strategy_wu2019(df, 2, seed=1, keep_empty=True).count() == 7


@pytest.mark.parametrize("parts", [1, 5])
def test_list_shuffles_and_samples(spark, parts):
    df = spark.createDataFrame([(i, list(range(i))) for i in range(40)], "impression_id int, article_ids_inview array<int>")
    df = df.repartition(parts)
    mixed = {r[0]: r[1] for r in sampling.shuffle_list_column(df, "article_ids_inview", 9).collect()}
    assert all(sorted(v) == list(range(k)) for k, v in mixed.items()) and mixed[39] != list(range(39))
    drawn = sampling.sample_article_ids(df.filter("impression_id >= 3"), 3, False, 9).collect()
    assert all(len(set(r[1])) == 3 and max(r[1]) < r[0] for r in drawn)
    again = {r[0]: r[1] for r in sampling.sample_article_ids(df, 3, True, 9).collect()}
    assert again[0] == [None, None, None] and all(len(v) == 3 for v in again.values())


def test_random_candidates_are_distinct_and_even(spark):
    items = spark.createDataFrame([(i * 10,) for i in range(8)], "article_id int")
    lists = sampling.random_candidates(items, 3, 800, seed=4).groupBy("list_id").agg(F.collect_set("article_id").alias("s")).collect()
    assert len(lists) == 800 and all(len(r["s"]) == 3 for r in lists)
    counts = [sum(i * 10 in r["s"] for r in lists) for i in range(8)]
    assert all(240 < c < 360 for c in counts)
    with pytest.raises(ValueError):
        sampling.random_candidates(items, 9, 1, seed=4)


def test_draws_reach_beyond_32_bits(spark):
    total = 1 << 40
    row = spark.range(200).select(distinct_draws(total, 3, 1, "id").alias("d")).collect()
    drawn = [x for r in row for x in r["d"]]
    assert all(0 <= x < total for x in drawn) and len(set(drawn)) == 600
    assert 0.4 < sum(x >= total // 2 for x in drawn) / 600 < 0.6


def test_exact_splits_need_keys_that_identify_rows(spark):
    copies = spark.range(100).select((F.col("id") % 5).alias("k"))
    whole, none = sampling.split_df_fraction(copies, 0.4, 1, key="k")
    assert (whole.count(), none.count()) == (40, 60)
    with pytest.raises(Exception, match="both sides of the cut"):
        sampling.sample_rows(copies, n=10, seed=1, key="k").count()


@pytest.mark.parametrize("parts", [1, 5])
def test_row_order_does_not_depend_on_partitions(spark, parts):
    df = spark.range(200).select((F.col("id") % 9).alias("k"), F.col("id").alias("v"))
    once, again = (sampling.shuffle_rows(x, 3, "k").collect() for x in (df, df.repartition(parts)))
    assert once == again and [r["v"] for r in once] != sorted(r["v"] for r in once)


def test_user_mapping(spark):
    df = spark.createDataFrame([(5,), (3,), (5,), (None,)], "user_id int")
    assert sorted(map(tuple, sampling.create_user_id_to_int_mapping(df).collect())) == [(3, 0), (5, 1)]
