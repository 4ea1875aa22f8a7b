"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each result to the
shared folder and reads it again for the next stage. All stages but the last return the
columns of ``documents`` (doc_id, text, lang, source, n_chars); n_chars follows the text.

Nulls: a null text has no language and goes in the first stage. Rows of equal key and text
are one document from the third stage on. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom import util
from askloom.llm import jaccard, langid, lines, packing, pii
from askloom.llm.queries import PSEUDONYM_KEY, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a document goes when its best language's calibrated probability is nearer to a guess (0) than this on
#: the way to certainty (1); measured on held-out rows, README.md
LEAST_CERTAINTY = 0.3
#: a repeated run of lines of so many words or more goes whole; shorter ones go where winnowing meets them
LEAST_WORDS = 50


def _columns(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and undecided ones go."""
    model = langid.train(docs.filter(~langid.held_out()))
    told = langid.predict(docs, model, keep=("text", "lang", "source"))
    return _columns(told.filter((F.col("lang_pred") != "und") & (F.col("score") >= langid.least_score(model, LEAST_CERTAINTY))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document of which no word is left goes."""
    left = lines.drop_repeats(docs.select("doc_id", "text", "lang", "source"), least_words=LEAST_WORDS)
    return _columns(left.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8, smallest key."""
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"), n=5, num=80, den=100)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_k")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_k")), "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source")
    return _columns(kept.withColumn("_r", F.row_number().over(same)).filter("_r = 1"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by pseudonyms."""
    return _columns(pii.pseudonymise(docs.select("doc_id", "text", "lang", "source"), PSEUDONYM_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens, with their ids."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary(), capacity=1024, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL cannot express a trained classifier or a tokenizer; tests/llm/test_pipeline.py has plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = util.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
