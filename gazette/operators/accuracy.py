"""Accuracy metrics per impression and their means."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gazette import columns as C
from gazette.functions import ranking
from gazette.functions.arrays import field
from gazette.plans.lists import as_keys
from gazette.plans.numbering import row_index, running_total


@dataclass(frozen=True)
class Metric:
    """A named expression over parallel label and score lists.

    ``of_ranked``, where given, computes the same from the labels in rank order.
    """

    name: str
    expr: Callable[[Column, Column], Column]
    of_ranked: Callable[[Column], Column] | None = None

    def __call__(self, labels, scores) -> Column:
        return self.expr(labels, scores)


def _ranking_metric(name, of_ranked):
    return Metric(name, lambda y, p: of_ranked(ranking.ranked_labels(y, p)), of_ranked)


def AucScore():
    return Metric("auc", ranking.auc)


def StrictAucScore():
    return Metric("auc_strict", ranking.auc_strict)


def MrrScore():
    return _ranking_metric("mrr", ranking.mrr_of)


def ReciprocalRankScore():
    return _ranking_metric("reciprocal_rank", ranking.reciprocal_rank_of)


def DcgScore(k=10):
    return _ranking_metric(f"dcg@{k}", lambda ranked: ranking.dcg_of(ranked, k))


def NdcgScore(k=10):
    return _ranking_metric(f"ndcg@{k}", lambda ranked: ranking.ndcg_of(ranked, k))


def LogLossScore():
    return Metric("logloss", ranking.logloss)


def RootMeanSquaredError():
    return Metric("rmse", ranking.rmse)


def AccuracyScore(threshold=0.5):
    return Metric("accuracy", lambda y, p: ranking.accuracy(y, p, threshold))


def F1Score(threshold=0.5):
    return Metric("f1", lambda y, p: ranking.f1(y, p, threshold))


class MetricEvaluator:
    """Evaluate metrics on a frame with one impression per row.

    Each metric is an expression on the row's own lists, so the evaluation is one scan with a
    partial aggregate. A metric that is null or NaN for a row (one-class AUC or log loss, MRR and
    nDCG without a click) is left out of the mean; :meth:`evaluate` reports how many rows had such a metric as ``n_skipped``, and
    ``strict`` raises instead.
    """

    def __init__(self, df, metric_functions, labels_col=C.LABELS, scores_col=C.SCORES, strict=False):
        bad = [type(m) for m in metric_functions if not callable(m) or not hasattr(m, "name")]
        if bad or not metric_functions:
            raise TypeError(f"metrics must be callables with a name; got {bad}")
        self.df, self.metrics = df, list(metric_functions)
        self.labels_col, self.scores_col, self.strict = labels_col, scores_col, strict

    def per_impression(self) -> DataFrame:
        """One column per metric next to the input columns; the ranking is sorted once for all."""
        y, p = F.col(self.labels_col), F.col(self.scores_col)
        ranked = self.df.withColumn("__ranked", ranking.ranked_labels(y, p))

        def value(m):
            of_ranked = getattr(m, "of_ranked", None)
            return of_ranked(F.col("__ranked")) if of_ranked else m(y, p)

        return ranked.withColumns({m.name: value(m) for m in self.metrics}).drop("__ranked")

    def evaluate(self) -> DataFrame:
        """One row: the mean of each metric, ``n_rows`` and ``n_skipped``."""
        rows = self.per_impression().select(
            *[F.nanvl(F.col(f"`{m.name}`").cast("double"), F.lit(None).cast("double")).alias(m.name) for m in self.metrics]
        )
        undefined = F.lit(False)
        for m in self.metrics:
            undefined = undefined | F.col(f"`{m.name}`").isNull()
        skipped = F.count_if(undefined)
        if self.strict:
            skipped = F.when(skipped > 0, F.raise_error(F.lit("a metric is undefined for a one-class row"))).otherwise(skipped)
        return rows.agg(
            *[F.avg(f"`{m.name}`").alias(m.name) for m in self.metrics],
            F.count("*").alias("n_rows"),
            skipped.alias("n_skipped"),
        )

    def evaluate_long(self) -> DataFrame:
        """``(metric, value)`` rows."""
        wide = self.evaluate()
        pairs = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.col(f"`{m.name}`").alias("value")) for m in self.metrics])
        return wide.select(F.inline(pairs))


def metric_by_time(df, metric, window="1 day", time_col=C.IMPRESSION_TIME, labels_col=C.LABELS, scores_col=C.SCORES):
    """Mean of a per-impression metric per time window."""
    rows = df.select(F.window(time_col, window)["start"].alias("window_start"), metric(F.col(labels_col), F.col(scores_col)).alias("m"))
    return rows.groupBy("window_start").agg(F.avg("m").alias(metric.name), F.count("m").alias("n"))


def auc_from_fixed_groups(df, group_size, order, label_col="label", score_col="score") -> DataFrame:
    """Mean AUC of consecutive groups of ``group_size`` flat rows in the given order."""
    numbered = row_index(df.select(*[c for c in dict.fromkeys([*order, label_col, score_col])]), order, "__nr")
    groups = numbered.groupBy(F.floor(F.col("__nr") / group_size).alias("group")).agg(
        F.array_sort(F.collect_list(F.struct("__nr", F.col(label_col).alias("y"), F.col(score_col).alias("p")))).alias("g")
    )
    y, p = field("g", "y"), field("g", "p")
    return groups.select("group", ranking.auc(y, p).alias("auc")).agg(
        F.avg("auc").alias("auc"), F.count("auc").alias("n_groups")
    )


def auc_of_rows(df, group=(), label_col="label", score_col="score") -> DataFrame:
    """AUC over flat rows, whole or per ``group``, however many rows a group has.

    Returns the group, ``auc`` (ties count one half), ``auc_strict`` (ties count nothing), ``n_positive``
    and ``n_negative``; both areas are null where a class is missing. Rows with a null label or score
    are left out; NaN ranks first.

    Rows of one score are counted first, on the map side, so a frequent score is one row. The counts are
    range-sorted by group and score, and a running total of negatives then stands for the ranks: a positive beats
    the negatives before its score, less those of earlier groups. No group is one list or one task's sort.
    """
    keys = as_keys(group)
    names = [f"__group_{i}" for i in range(len(keys))]
    positive = F.col(label_col).cast("double") == 1
    rows = df.filter(F.col(label_col).isNotNull() & F.col(score_col).isNotNull())
    counts = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(score_col).cast("double").alias("__score")).agg(
        F.count_if(positive).alias("__pos"), F.count_if(~positive).alias("__neg")
    )
    before = running_total(counts, [*names, "__score"], "__neg", "__before", inclusive=False)
    # exact whole numbers: positives times rows outgrow a double
    p, n, earlier = (F.col(c).cast("decimal(18,0)") for c in ("__pos", "__neg", "__before"))
    sums = before.groupBy(*names).agg(
        F.sum("__pos").alias("n_positive"),
        F.sum("__neg").alias("n_negative"),
        F.min(earlier).alias("__start"),
        F.sum((p * earlier).cast("decimal(38,0)")).alias("__below"),
        F.sum((p * n).cast("decimal(38,0)")).alias("__tied"),
    )
    pairs = F.col("n_positive").cast("double") * F.col("n_negative")
    wins = (F.col("__below") - (F.col("n_positive").cast("decimal(18,0)") * F.col("__start")).cast("decimal(38,0)")).cast("double")
    return sums.select(
        *[F.col(x).alias(k) for x, k in zip(names, keys, strict=True)],
        F.try_divide(wins + F.col("__tied").cast("double") / 2, pairs).alias("auc"),
        F.try_divide(wins, pairs).alias("auc_strict"),
        F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
        F.coalesce("n_negative", F.lit(0)).alias("n_negative"),
    )
