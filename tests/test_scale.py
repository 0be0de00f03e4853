"""Plans and skew: what is broadcast, what is spread, what is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from gazette import columns as C
from gazette.functions.arrays import linear_decay_weights
from gazette.operators import history, mapping, sampling, scoring
from gazette.operators.mapping import create_article_id_to_value_mapping, create_lookup
from gazette.plans import lookup
from gazette.plans.numbering import first_rows, row_position
from gazette.plans.store import materialise, scratch_folder
from gazette.workload import QUERIES, views as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skewed(spark):
    """A third of the rows share one id, another share has none."""
    return spark.range(9000).select(
        F.col("id").alias("nr"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 != 1, F.col("id") % 500).alias("key"),
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    table = spark.range(400).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    expected = sorted(map(str, skewed.join(table, "key", how).collect()))
    small = lookup.lookup_join(skewed, table, "key", how, spread=["nr"])
    salted = lookup.lookup_join(skewed, table, "key", how, spread=["nr"], broadcast_bytes=0, hot_rows=100)
    order = skewed.join(table, "key", how).columns
    for out in (small, salted):
        assert sorted(str(r) for r in out.select(*order).collect()) == expected
    assert "__salt" in plan(salted) and "__salt" not in plan(small)


def test_hot_key_is_spread(spark, skewed):
    table = spark.range(400).select(F.col("id").alias("key"), F.lit("x").alias("v"))
    hot = skewed.groupBy("key").count().filter("count > 100 AND key IS NOT NULL").count()
    assert hot == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup.lookup_join(skewed, table, "key", "left", spread=["nr"], broadcast_bytes=0, hot_rows=100)
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in sizes) < 9000 / 4


def test_measured_bytes_grow_with_content(spark):
    short = spark.createDataFrame([(1, [1.0] * 10, "a")], "k int, v array<double>, s string")
    long = spark.createDataFrame([(1, [1.0] * 1000, "a" * 500)], "k int, v array<double>, s string")
    assert lookup.measured_bytes(long) - lookup.measured_bytes(short) == 990 * 8 + 499
    nested = spark.createDataFrame([(1, [["a"], ["bb", "c"]])], "k int, v array<array<string>>")
    assert lookup.measured_bytes(nested) > 0


def test_mapping_is_the_same_without_broadcast(spark):
    rows = [(i, [j % 7 for j in range(i % 9)]) for i in range(200)]
    df = spark.createDataFrame(rows, "impression_id int, ids array<int>")
    table = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "id int, v string")
    run = lambda **o: sorted(map(str, mapping.map_list_article_id_to_value(df, "ids", table, fill_nulls="?", **o).collect()))
    assert run() == run(broadcast_bytes=0, hot_rows=20)


def test_row_local_operators_do_not_shuffle(spark, small):
    log = spark.createDataFrame([(1, [1, 2], [2])], f"{C.IMPRESSION_ID} int, {C.INVIEW} array<int>, {C.CLICKED} array<int>")
    assert "Exchange" not in plan(sampling.sampling_strategy_wu2019(log, 4, seed=1))
    assert "Exchange" not in plan(sampling.shuffle_list_column(log, C.INVIEW, 1))


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(V.clicks(spark, small).filter(F.col(C.READ_TIME) > 60).select("event_id"))
    assert "GreaterThan(value,60" in text and re.search(r"ReadSchema: struct<event_id:bigint,value:double>", text)
    text = plan(V.inview(spark, small))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_returnflag:string>" in text


def test_down_sampling_is_limited_before_the_shuffle(spark, small):
    text = plan(history.down_sample_on_users(V.clicks(spark, small), 5, seed=1, key="event_id"))
    assert "Partial" in text and text.count("WindowGroupLimit") == 2


def test_materialise_has_no_lineage(spark):
    out = materialise(spark.range(10).withColumn("x", F.rand()))
    assert "FileScan parquet" in plan(out) and sorted(map(str, out.collect())) == sorted(map(str, out.collect()))


class _Session:
    """Just enough of a session to ask for its scratch folder."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_folder_comes_from_the_session(tmp_path):
    assert scratch_folder(_Session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert scratch_folder(_Session("local[2]")) == scratch_folder(_Session("local[2]"))
    with pytest.raises(RuntimeError):
        scratch_folder(_Session("yarn"))


def test_embedding_scores_are_the_same_without_broadcast(spark):
    log = spark.createDataFrame([(i, i % 4 if i % 3 else 0, [i % 5, 9]) for i in range(60)], "impression_id int, user_id int, article_ids_inview array<int>")
    past = spark.createDataFrame([(0, [1, 2, 9]), (1, [3]), (2, [])], "user_id int, article_id_fixed array<int>")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "article_id int, vector array<double>")

    def run(**options):
        out = scoring.embedding_scores(log, past, vectors, linear_decay_weights, **options)
        return {r[C.IMPRESSION_ID]: r["scores"] for r in out.collect()}

    plain, salted = run(), run(broadcast_bytes=0, hot_rows=10)
    # user 0: weights 1/3, 2/3 over items 1 and 2; item 9 has no vector and drops out with its weight
    assert plain[3] == pytest.approx([3 * (1 / 3 + 4 / 3) + 1, 0.0]) and plain[2] == [0.0, 0.0]
    assert plain.keys() == salted.keys() and all(plain[k] == pytest.approx(salted[k]) for k in plain)


def test_repeated_keys_and_ids_fail(spark):
    from gazette.plans.lists import gathered

    lookup = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    rows = spark.createDataFrame([(1, [1, 2]), (2, [2])], "k int, ids array<int>")
    repeated = spark.createDataFrame([(1, [1]), (1, [2]), (None, [1]), (None, [2])], "k int, ids array<int>")
    for limit in (None, 0):
        assert gathered(rows, ["ids"], lookup, "id", ["v"], key="k", broadcast_bytes=limit).count() == 2
        for df, table in ((repeated, lookup), (rows, twice)):
            with pytest.raises(Exception, match="does not identify a row"):
                gathered(df, ["ids"], table, "id", ["v"], key="k", broadcast_bytes=limit).collect()


def test_wide_maps_are_measured(spark):
    from gazette.plans.lookup import fits_broadcast

    wide = spark.range(10).selectExpr("id", "map_from_arrays(sequence(1, 100000), sequence(1, 100000)) AS m")
    assert not fits_broadcast(wide, 1 << 20)
    assert fits_broadcast(spark.range(10).selectExpr("id", "map(1, 2) AS m"), 1 << 20)


def test_histories_are_whole(spark, small):
    from gazette.workload import views as V

    read = V.clicks(spark, small).filter("article_id IS NOT NULL").count()
    assert V.histories(spark, small).selectExpr("sum(size(article_id_fixed))").first()[0] == read


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_first_rows_beyond_the_window_limit(spark, hot_rows):
    heavy = spark.range(3000).select(F.lit("a").alias("user"), F.col("id").alias("t"))
    light = spark.range(60).select(F.lit("b").alias("user"), F.col("id").alias("t"))
    null = spark.range(5).select(F.lit(None).cast("string").alias("user"), F.col("id").alias("t"))
    rows = heavy.unionByName(light).unionByName(null).repartition(7)
    got = first_rows(rows, 1500, ["user"], [F.col("t").desc()], hot_rows)
    found = {r.user: (r.n, r.low, r.high) for r in got.groupBy("user").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).collect()}
    assert found == {"a": (1500, 1500, 2999), "b": (60, 0, 59), None: (5, 0, 4)}
    # only groups at or below hot_rows meet in a window
    plan = got._jdf.queryExecution().toString()
    assert ("LeftAnti" in plan) == (hot_rows is not None)


def test_positions_and_last_wins(spark):
    df = spark.range(1000).repartition(5).orderBy(F.col("id").desc())
    assert row_position(df).filter("row_nr <> 999 - id").count() == 0
    pairs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 5), (2, "c", 4), (3, "d", 1), (3, "e", 1)], "k int, v string, t int")
    last = {r.k: r.v for r in create_lookup(pairs, "k", "v", "t").collect()}
    assert last == {1: "b", 2: None, 3: "e"}
    assert {r.k: r.v for r in create_article_id_to_value_mapping(pairs, "v", "k").collect()} == {1: "b", 2: "c", 3: "e"}


@pytest.mark.parametrize("name", ["gather_vectors", "decay_apply"])
def test_vectors_are_widened_behind_the_shuffles(spark, small, name, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    out = QUERIES[name](spark, small)
    assert "cast(embedding" not in plan(out) and dict(out.dtypes)["v0"] == "double"
    assert out.filter("v0 <> 0 AND v0 <> cast(cast(v0 AS float) AS double)").count() > 0


@pytest.mark.parametrize("broadcast_bytes", [0, lookup.BROADCAST_BYTES])
@pytest.mark.parametrize("name", ["diversity", "serendipity"])
def test_sums_of_vectors_are_not_shuffled_before_they_combine(spark, small, name, broadcast_bytes, monkeypatch):
    """Partial sums, as wide as a vector for every line, lie under the whole sums without an exchange between."""
    want = {r[0]: r[1] for r in QUERIES[name](spark, small).collect()}
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", broadcast_bytes)
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = QUERIES[name](own, small)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [above for above, line in zip(lines, lines[1:]) if "functions=[partial_count(__sq" in line]
    assert below and not any("Exchange" in x for x in below)
    got = {r[0]: r[1] for r in out.collect()}
    assert len(got) == len(want) and all(got[k] == pytest.approx(want[k], abs=2e-6, nan_ok=True) for k in want)
