"""Golden values of the accuracy and beyond-accuracy metrics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gazette.functions import ranking
from gazette.functions.arrays import dot
from gazette.operators import accuracy as A, beyond as B, describe as D
from gazette.workload import QUERIES, views

NAN = float("nan")


@pytest.fixture(scope="module")
def three(spark):
    rows = [([1, 0, 0], [0.2, 0.3, 0.5]), ([1, 1, 0], [0.18, 0.7, 0.1]), ([1, 0, 0, 0], [0.18, 0.2, 0.1, 0.1])]
    return spark.createDataFrame(rows, "labels array<int>, prediction_scores array<double>")


def test_evaluator(three):
    metrics = [A.AucScore(), A.MrrScore(), A.NdcgScore(5), A.NdcgScore(10), A.LogLossScore(), A.RootMeanSquaredError(), A.AccuracyScore(), A.F1Score()]
    evaluator = A.MetricEvaluator(three, metrics)
    want = {
        "auc": 0.5555555555555556,
        "mrr": 0.5277777777777778,
        "ndcg@5": 0.7103099178571526,
        "ndcg@10": 0.7103099178571526,
        "logloss": 0.716399020295845,
        "rmse": 0.5022870658128165,
        "accuracy": 0.5833333333333334,
        "f1": 0.2222222222222222,
    }
    assert {r["metric"]: r["value"] for r in evaluator.evaluate_long().collect()} == pytest.approx(want)
    assert len(evaluator.per_impression().columns) == 10
    with pytest.raises(TypeError):
        A.MetricEvaluator(three, ["auc"])


def test_one_class_rows(spark, three):
    one = spark.createDataFrame([([1, 1], [0.1, 0.9])], "labels array<int>, prediction_scores array<double>")
    row = A.MetricEvaluator(three.unionByName(one), [A.AucScore()]).evaluate().first()
    assert row["auc"] == pytest.approx(0.5555555555555556) and (row["n_rows"], row["n_skipped"]) == (4, 1)
    with pytest.raises(Exception, match="one-class"):
        A.MetricEvaluator(one, [A.AucScore()], strict=True).evaluate().collect()


def test_single_list_metrics(spark):
    def value(metric, y, p):
        return spark.createDataFrame([(y, p)], "y array<int>, p array<double>").select(metric(F.col("y"), F.col("p"))).first()[0]

    assert value(ranking.mrr, [1, 0, 0, 1], [0.5, 0.2, 0.1, 0.4]) == pytest.approx(0.75)
    assert value(ranking.reciprocal_rank, [0, 0, 1], [0.3, 0.2, 0.1]) == pytest.approx(1 / 3)
    assert value(ranking.reciprocal_rank, [0, 0], [0.3, 0.2]) == 1.0
    assert math.isnan(value(ranking.mrr, [0, 0], [0.3, 0.2])) and math.isnan(value(ranking.ndcg, [0, 0], [0.3, 0.2]))
    assert value(ranking.dcg, [1, 0, 1], [0.9, 0.5, 0.3]) == pytest.approx(1.5)
    # ties count one half, strictly nothing
    assert value(ranking.auc, [1, 0, 1, 0], [0.5, 0.5, 0.9, 0.1]) == pytest.approx(3.5 / 4)
    assert value(ranking.auc_strict, [1, 0, 1, 0], [0.5, 0.5, 0.9, 0.1]) == pytest.approx(3 / 4)
    assert value(ranking.f1, [0, 0], [0.1, 0.2]) == 0.0
    # on a tie the later position ranks first
    assert value(ranking.mrr, [1, 0], [0.5, 0.5]) == 0.5 and value(ranking.mrr, [0, 1], [0.5, 0.5]) == 1.0


def test_auc_against_all_pairs(spark):
    import random

    rng = random.Random(0)
    rows = [([rng.randint(0, 1) for _ in range(n)], [rng.randint(0, 5) / 5 for _ in range(n)]) for n in range(2, 40)]
    out = spark.createDataFrame(rows, "y array<int>, p array<double>").select("y", "p", ranking.auc("y", "p").alias("a"), ranking.auc_strict("y", "p").alias("s"))
    for r in out.collect():
        pairs = [(p, q) for y, p in zip(r["y"], r["p"]) if y for z, q in zip(r["y"], r["p"]) if not z]
        if not pairs:
            assert r["a"] is None and r["s"] is None
            continue
        assert r["a"] == pytest.approx(sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs))
        assert r["s"] == pytest.approx(sum(p > q for p, q in pairs) / len(pairs))


ITEMS = [
    ("101", [1.0, 0.0, 0.0], 1, [1], 0.50),
    ("102", [0.0, 1.0, 0.0], 2, [1], 0.25),
    ("103", [1.0, 1.0, 1.0], 3, [1], 0.75),
    ("104", [1.0, 1.0, 1.0], 4, [1], 0.50),
    ("105", [-1.0, 0.0, 0.0], 5, [1], 0.94),
    ("106", [-1.0, 0.0, 0.0], 6, [1, 2], 0.95),
    ("107", [-1.0, 0.0, 0.0], 7, [1, 2], 0.96),
    ("108", [0.0, 0.0, 1.0], 8, [1, 2], 0.50),
    ("400", [0.0, 0.0, 1.0], 9, [4], 0.20),
    ("401", [0.0, 0.0, 1.0], 9, [4, 5], 0.20),
]
R = ["101 102 400", "101 103 400", "101 102 103", "101 104 400", "101 106 404", "404 404 404"]
H = ["101 102", "105 106 400", "102 103 104", "101 400", "400", "400"]
CANDIDATES = "1 2 101 102 103 104 105 106 107 108 400 401".split()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "article_id string, vec array<double>, v int, sv array<int>, pop double")


@pytest.fixture(scope="module")
def lists(spark):
    rows = [(i, r.split(), h.split()) for i, (r, h) in enumerate(zip(R, H))]
    return spark.createDataFrame(rows, "list_id int, items array<string>, history array<string>")


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.createDataFrame([(c,) for c in CANDIDATES], "article_id string")


def column(df, name):
    return [r[0] for r in df.orderBy("list_id").select(name).collect()]


def test_list_metrics(lists, items):
    close = lambda got, want: got == pytest.approx(want, abs=1e-6, nan_ok=True)
    third = (2 * (1 - 1 / math.sqrt(3)) * 2 + 2) / 6
    assert close(column(B.intralist_diversity(lists, items, "vec"), "diversity"), [1.0, third, third, third, 2.0, NAN])
    want = [0.666667, 1.175261, 0.345917, 0.474217, 1.0, NAN]
    assert close(column(B.serendipity(lists, lists, items, "vec"), "serendipity"), want)
    want = [1.773976, 1.245655, 1.138346, 1.440643, 0.537, NAN]
    assert column(B.novelty(lists, items, "pop"), "novelty") == pytest.approx(want, abs=1e-5, nan_ok=True)
    assert math.isinf(column(B.novelty(lists, items.withColumn("pop", F.lit(0.0)), "pop"), "novelty")[0])
    with pytest.raises(ValueError):
        B.intralist_diversity(lists, items, "q")


@pytest.mark.parametrize("distance", ["cosine", "euclidean", "manhattan"])
def test_distances_against_all_pairs(lists, items, distance):
    from gazette.functions.arrays import DISTANCES

    vec = {i: v for i, v, *_ in ITEMS}

    def dist(a, b):
        if distance == "euclidean":
            return math.dist(a, b)
        if distance == "manhattan":
            return sum(abs(x - y) for x, y in zip(a, b))
        return 1 - sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))

    def mean(pairs):
        pairs = list(pairs)
        return sum(dist(vec[a], vec[b]) for a, b in pairs) / len(pairs) if pairs else NAN

    known = [[x for x in r.split() if x in vec] for r in R]
    past = [[x for x in h.split() if x in vec] for h in H]
    inside = [mean((a, b) for i, a in enumerate(k) for j, b in enumerate(k) if i != j) for k in known]
    across = [mean((a, b) for a in k for b in p) for k, p in zip(known, past)]
    for choice in (distance, DISTANCES[distance]):
        got = column(B.intralist_diversity(lists, items, "vec", distance=choice), "diversity")
        assert got == pytest.approx(inside, nan_ok=True, abs=1e-9)
        got = column(B.serendipity(lists, lists, items, "vec", distance=choice), "serendipity")
        assert got == pytest.approx(across, nan_ok=True, abs=1e-9)


def test_python_distance(spark):
    @F.udf("double")
    def furthest(a, b):
        return max(abs(x - y) for x, y in zip(a, b))

    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 1.0]), (3, [0.0, 5.0])], "article_id long, v array<double>")
    lists = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 9]), (3, None)], "list_id long, items array<long>")
    got = {r[0]: r[1] for r in B.intralist_diversity(lists, items, "v", distance=furthest).collect()}
    assert got[1] == pytest.approx((3 + 5 + 4) / 3) and math.isnan(got[2]) and math.isnan(got[3])
    past = spark.createDataFrame([(1, [2]), (2, [3, 1])], "list_id long, history array<long>")
    got = {r[0]: r[1] for r in B.serendipity(lists, past, items, "v", distance=furthest).collect()}
    assert got[1] == pytest.approx((3 + 0 + 4) / 3) and got[2] == pytest.approx(2.5) and math.isnan(got[3])


@pytest.mark.parametrize("distance", ["cosine", "manhattan"])
def test_shared_histories(spark, distance):
    items = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0]), (3, [2.0, 5.0])], "article_id long, v array<double>")
    lists = spark.createDataFrame([(1, 7, [1, 2]), (2, 7, [3]), (3, 8, [1]), (4, None, [2])], "list_id long, user_id long, items array<long>")
    past = spark.createDataFrame([(7, [3, 2, 99])], "user_id long, history array<long>")
    shared = B.serendipity(lists, past, items, "v", distance=distance, history_key="user_id").collect()
    each = lists.join(past, "user_id", "left").select("list_id", "history")
    copied = {r[0]: r[1] for r in B.serendipity(lists, each, items, "v", distance=distance).collect()}
    got = {r[0]: r[1] for r in shared}
    assert [got[i] for i in (1, 2)] == pytest.approx([copied[i] for i in (1, 2)])
    assert len(shared) == 4 and math.isnan(got[3]) and math.isnan(got[4])


def test_list_metrics_scan_the_lists_once(spark, small):
    for name in ("sentiment", "diversity", "novelty"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines()) == 1, name


def _report_tables(spark):
    items = spark.createDataFrame(
        [(1, [0.0, 1.0], 0.5, 0.5, "a", ["x", "y"]), (2, [3.0, 1.0], 0.1, 1.0, "b", ["x"]), (3, None, 0.3, 0.25, "a", None), (4, [1.0, 0.0], None, None, None, [])],
        "article_id long, v array<double>, mood double, pop double, kind string, topics array<string>",
    )
    lists = spark.createDataFrame(
        [("own", 10, 7, [1, 2], False), ("own", 11, 8, [3, 99], False), ("own", 12, None, [], False), ("own", 13, 7, [4], False), ("top", -1, None, [1, 4], True)],
        "list_name string, list_id long, user_id long, items array<long>, is_shared boolean",
    )
    past = spark.createDataFrame([(7, [2]), (8, [1, 3]), (9, [99])], "user_id long, history array<long>")
    users = spark.createDataFrame([(7, "m", 1), (8, "f", 1), (9, None, 2)], "user_id long, sex string, area int")
    return lists, items, past, users


def test_report_by_segment(spark):
    lists, items, past, users = _report_tables(spark)
    metrics, shares = B.beyond_accuracy_report(lists, items, past, "v", "mood", "pop", ["kind", "topics"], users, ["sex", "area"], candidates=items)
    got = {(r["list_name"], r["segment"], r["segment_value"], r["metric"]): (r["mean"], r["n"]) for r in metrics.collect()}
    cosine = 1 - 1 / math.sqrt(10)
    assert got["own", "all", None, "diversity"] == pytest.approx((cosine, 1))
    assert got["own", "all", None, "sentiment"] == pytest.approx(((0.3 + 0.3) / 2, 2))
    assert got["own", "sex", "f", "novelty"] == pytest.approx((2.0, 1))
    assert got["own", "sex", None, "diversity"] == (None, 0)
    # list 13 holds (1, 0) against a history of (3, 1); list 11 knows no vector
    r = math.sqrt(10)
    assert got["own", "area", "1", "serendipity"] == pytest.approx((((1 - 1 / r) / 2 + 1 - 3 / r) / 2, 2))
    assert got["top", "all", None, "diversity"] == pytest.approx((1.0, 3))
    assert got["top", "area", "1", "sentiment"] == pytest.approx((0.5, 2))
    assert got["own", "all", None, "coverage_count"] == (5, 5) and got["own", "sex", "m", "coverage_count"] == (3, 3)
    assert got["own", "all", None, "coverage_fraction"] == (1.25, 5) and ("top", "sex", "m", "coverage_count") not in got
    told = {(r["list_name"], r["segment"], r["segment_value"], r["attribute"], r["value"]): r["share"] for r in shares.collect()}
    assert told["own", "all", None, "kind", "a"] == 0.5 and told["own", "all", None, "kind", None] == 0.25
    assert told["own", "sex", "m", "topics", "x"] == pytest.approx(2 / 3) and told["top", "all", None, "topics", "y"] == 0.5
    none, empty = B.beyond_accuracy_report(lists.limit(0), items, past, "v", "mood", "pop", ["kind"], users, ["sex"])
    assert none.count() == 0 and empty.count() == 0


def test_report_reads_and_explodes_the_lists_once(spark, small):
    lists = views.impressions(spark, small).select(
        F.lit("inview").alias("list_name"), F.col("impression_id").alias("list_id"), "user_id", F.col("article_ids_inview").alias("items")
    )
    items = views.articles(spark, small).join(views.vectors(spark, small), "article_id", "left").withColumn("pop", F.lit(0.5))
    keys = ["list_name", "list_id", "user_id"]
    plan = B.scored_lists(lists, items, "vector", "sentiment_score", "pop", keys)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation" in x and "l_orderkey" in x for x in plan) == 1
    assert sum("Generate" in x for x in plan) == 1


def test_wide_vectors(spark):
    """Sums beyond the width of generated code give the same numbers."""
    rows = [(i, [math.sin(i * k + 1) for k in range(100)]) for i in range(6)]
    items = spark.createDataFrame(rows, "article_id long, v array<double>")
    lists = spark.createDataFrame([(1, [0, 1, 2]), (2, [3, 99, 4]), (3, [99, 5]), (4, [99]), (5, [])], "list_id long, items array<long>")
    got = {r[0]: r[1] for r in B.intralist_diversity(lists, items, "v").collect()}
    pairs = B.intralist_diversity(lists, items, "v", distance=lambda a, b: 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))
    want = {r[0]: r[1] for r in pairs.collect()}
    assert [got[i] for i in (1, 2)] == pytest.approx([want[i] for i in (1, 2)])
    assert all(math.isnan(got[i]) for i in (3, 4, 5))


def test_candidate_bounds(candidates, items):
    assert tuple(B.candidate_diversity(candidates, items, "vec", 2).first()) == pytest.approx((0.0, 2.0))
    low, high = B.candidate_diversity(candidates, items, "vec", 2, method="sampled", n_samples=20, seed=1).first()
    assert 0 <= low <= high <= 2
    with pytest.raises(ValueError):
        B.candidate_diversity(candidates, items, "vec", 11)
    row = B.candidate_novelty(candidates, items, 2, "pop").first()
    assert (row["min_novelty"], row["max_novelty"]) == pytest.approx((0.066447, 2.321928), abs=1e-6)
    row = B.candidate_sentiment(candidates, items, 1, "pop").first()
    assert (row["mean_n_highest"], row["mean_n_lowest"]) == (0.96, 0.2)


def test_coverage_and_distribution(lists, items, candidates):
    row = B.coverage(lists, candidates).first()
    assert (row[0], row[1]) == (7, pytest.approx(0.583333, abs=1e-6))
    assert B.coverage(lists).first()[1] == float("-inf")
    got = {r["value"]: r["share"] for r in B.distribution(lists.filter("list_id < 2"), items, "v").collect()}
    assert got == pytest.approx({1: 1 / 3, 2: 1 / 6, 3: 1 / 6, 9: 1 / 3})
    got = {r["value"]: r["share"] for r in B.distribution(lists, items, "sv").collect()}
    assert got == pytest.approx({1: 11 / 15, 2: 1 / 15, 4: 0.2})


def test_docstring_vectors(spark):
    items = spark.createDataFrame([(f"item{i}", [i / 10, (i + 1) / 10]) for i in range(1, 9)], "article_id string, v array<double>")
    lists = spark.createDataFrame([(0, ["item1", "item2"]), (1, ["item2", "item3"]), (2, ["item3", "item4"])], "list_id int, items array<string>")
    got = column(B.intralist_diversity(lists, items, "v"), "diversity")
    assert got == pytest.approx([0.00772212, 0.00153965, 0.00048792], abs=1e-8)
    four = spark.createDataFrame([(f"item{i}",) for i in range(1, 5)], "article_id string")
    assert tuple(B.candidate_diversity(four, items, "v", 2).first()) == pytest.approx((0.0004879239129211843, 0.02219758592259058))
    both = spark.createDataFrame(
        [(0, ["item1", "item2"], ["item5", "item6"]), (1, ["item3", "item4"], ["item7", "item8"])], "list_id int, items array<string>, history array<string>"
    )
    assert column(B.serendipity(both, both, items, "v"), "serendipity") == pytest.approx([0.01734935, 0.00215212], abs=1e-8)


def test_popularity_and_dispersion(spark):
    lists = spark.createDataFrame([(["i1", "i2", "i3"],), (["i1", "i3"],), (["i1", "i4"],)], "items array<string>")
    assert {r[0]: r[1] for r in B.item_popularity(lists).collect()} == pytest.approx({"i1": 1.0, "i2": 1 / 3, "i3": 2 / 3, "i4": 1 / 3})
    abc = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "x string")
    got = {r["value"]: r["share"] for r in B.normalized_distribution(abc, "x").collect()}
    assert got == {"a": 0.25, "b": 0.25, "c": 0.5}
    cats = [c for c, n in zip("abcde", (25, 42, 13, 8, 13)) for _ in range(n)]
    value = lambda xs: B.index_of_dispersion(spark.createDataFrame([(x,) for x in xs], "x string"), "x").first()[0]
    assert value(cats) == pytest.approx(0.9079992157631604)
    assert math.isnan(value(["a"])) and value(["a", "a"]) == 0


def test_candidate_list_check(spark):
    same = spark.createDataFrame([([1, 2],), ([1, 2],)], "article_ids_inview array<int>")
    assert sorted(r[0] for r in D.shared_candidates(same).collect()) == [1, 2]
    other = same.unionByName(spark.createDataFrame([([2, 1],)], "article_ids_inview array<int>"))
    with pytest.raises(Exception, match="different candidate lists"):
        D.shared_candidates(other).collect()


def test_auc_of_rows(spark):
    from gazette.operators.accuracy import auc_of_rows

    rng = random.Random(5)
    nan = float("nan")
    rows = [(rng.choice(["a", "b", None]), int(rng.random() < 0.3), float(rng.choice([0.0, -0.0, 1.0, 2.5, 7.0, nan]))) for _ in range(3000)]
    rows += [("one class", 1, 0.5), ("a", None, 1.0), ("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, label int, score double")

    def brute(of):
        key = lambda x: math.inf if x != x else x
        p, n = ([key(s) for _, y, s in of if y == c and s is not None] for c in (1, 0))
        if not p or not n:
            return None, None, len(p), len(n)
        wins, ties = sum(a > b for a in p for b in n), sum(a == b for a in p for b in n)
        return (wins + ties / 2) / len(p) / len(n), wins / len(p) / len(n), len(p), len(n)

    got = {r.g: tuple(r)[1:] for r in auc_of_rows(df, "g").collect()}
    want = {g: brute([r for r in rows if r[0] == g]) for g in {r[0] for r in rows}}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    whole = auc_of_rows(df)
    assert tuple(whole.first()) == pytest.approx(brute(rows))
    assert tuple(auc_of_rows(df.limit(0)).first()) == (None, None, 0, 0)
    text = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text


def test_shares_do_not_wait_for_the_metrics(spark):
    """Each table of the report is made when it is used, and sums of vectors are never stored."""
    lists, items, past, users = _report_tables(spark)
    twice = items.unionByName(items.filter("article_id = 1"))
    metrics, shares = B.beyond_accuracy_report(lists, twice, past, "v", "mood", "pop", ["kind", "topics"], users, ["sex", "area"], candidates=items)
    told = shares._jdf.queryExecution().optimizedPlan().toString()
    assert "__s0" not in told and "history" not in told
    plan = metrics._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(article_id" not in plan and "sum(" in plan and "hn" in plan
    got = {(r["list_name"], r["segment"], r["segment_value"], r["metric"]): (r["mean"], r["n"]) for r in metrics.collect()}
    assert got["own", "all", None, "coverage_count"] == (5, 8) and got["own", "sex", "m", "coverage_count"] == (3, 6)
    assert got["own", "sex", "f", "novelty"] == pytest.approx((2.0, 1))
    shared = {(r["list_name"], r["segment"], r["attribute"], r["value"]): r["share"] for r in shares.collect() if r["segment"] == "all"}
    assert shared["own", "all", "kind", "a"] == pytest.approx(5 / 7) and shared["own", "all", "topics", "y"] == pytest.approx(4 / 9)
