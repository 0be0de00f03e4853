"""A training corpus from ``documents``: five stages, each on all that its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from gazette.llm.decontaminate import contamination, cut_spans
from gazette.llm.jaccard import near_duplicate_groups
from gazette.llm.language import UNDETERMINED, identify, learn_prototypes
from gazette.llm.lines import drop_lines_across_copies
from gazette.llm.packing import pack
from gazette.plans.store import materialise

# Unrelated texts have a likeness of 1/32 on average spread (profiles of 1,024 dimensions), so five times that
# is beyond chance. Cuttings of 60 letters from ordinary texts score above it, shorter ones often do not: too
# short to tell, they stay if they have a letter.
LEAST_LIKENESS = 5 / 32
ENOUGH_LETTERS = 60


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus labels; texts without letters and longer ones unlike all of them go."""
    found = identify(docs, learn_prototypes(docs), lang_name="__lang", score_name="__like")
    short = F.length(F.regexp_replace("text", r"[^\p{L}]+", "")) < ENOUGH_LETTERS
    return found.filter((F.col("__lang") != UNDETERMINED) & (short | (F.col("__like") >= LEAST_LIKENESS))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines, near copies counting as one document; ``n_chars`` follows the text."""
    return drop_lines_across_copies(docs).withColumn("n_chars", F.length("text").cast("long"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    groups = near_duplicate_groups(docs)
    kept = groups.filter(F.col("id").isNull() | (F.col("id") == F.col("component_id"))).select(F.col("id").alias("doc_id")).distinct()
    whole = docs.join(kept.filter("doc_id IS NOT NULL"), "doc_id", "left_semi")
    return whole.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that benchmark items share; a text that was nothing else goes."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("spans") > 0)
    clean = cut_spans(docs, found)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 1024 tokens."""
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

# Neither language identification nor packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus; every stage's rows are written out and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
