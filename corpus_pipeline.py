"""The training-data pipeline over ``documents``: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontamination, jaccard, langid, packing, toxicity
from shelfmark.llm.storage import free, written

TOXIC = 0.7  # documents that score this or more go
PLAIN = 0.3  # documents that give less evidence a character for their language than this share of what its texts give on average go
SLACK = 0.5  # standard errors of that share (for the four languages of the tables about 1.1 / sqrt(characters)) that a text is given


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't read as toxic; learnt from the labelled ones among them.

    Null and empty texts and texts without words have the lowest score and stay; very long texts are as toxic as their
    worst passage. Repeated rows and null ids are rows like any other; ties at the threshold go.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (score,) = free(docs, "_toxicity")
    return toxicity.classify(docs, labels, F.lit(True), score_col=score).where(F.col(score) < TOXIC).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read plainly as one of the languages of the corpus.

    Null and empty texts and texts without letters go, and so do letters without sense, texts in letters or words of a
    language that the corpus doesn't have and texts that are a mixture of languages, as their n-grams speak for no language
    by much. Numbers, addresses and runs with a digit are left out of account, and a text with nothing else goes. One rule
    holds at every length: its slack is that of the evidence, which varies more in a few characters. Repeated rows and null
    ids are rows like any other, texts of any length count whole, and a text at the threshold stays.
    """
    language, fit = free(docs, "_language", "_fit")
    found = langid.predict(docs, F.lit(True), pred_col=language, score_col=free(docs, "_likelihood")[0], fit_col=fit, slack=SLACK, mask=langid.NOT_PROSE)
    return found.where((F.col(language) != "und") & (F.col(fit) >= PLAIN)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    That of the smallest id stays, a null id last. Texts without words stay; of rows with equal id and text one stays.
    """
    return jaccard.one_of_each(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null, empty and short texts stay; a row that repeats stays or goes each time."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 1024: one row a piece. A null or empty text is one piece, the end id alone."""
    return packing.pack(docs, bpe.tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't say a trained classifier or the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Extra columns go through to the last stage but one, whatever their names; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
