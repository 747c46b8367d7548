"""The corpus pipeline: five stages from raw documents to token ids.

Each stage works on all rows that the one before it kept. ``run`` writes every
stage's result to the shared folder and goes on from there, so that a lost
executor costs no more than its own stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, langid, minhash, pii, sentencepiece_viterbi
from marlstone.llm.common import drop, table, written
from marlstone.llm.queries import tokenizer_path

#: Shingles of the near-duplicate stage, in words.
SHINGLE = 5


def _own(docs: DataFrame) -> dict[str, str]:
    """Names for the columns of ``docs`` that clash with no result's."""
    return {c: f"__k{i}" for i, c in enumerate(docs.columns)}


def _col(name: str) -> Column:
    """A column by its name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; texts that are null or without letters go."""
    own = _own(docs)
    net = langid.train(*langid.training_sample(docs))
    named = langid.identify(docs.select(*[_col(c).alias(k) for c, k in own.items()], "text"), net, keep=tuple(own.values()))
    return named.where(F.col("lang_pred") != langid.UNKNOWN).select(*[F.col(k).alias(c) for c, k in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the least doc_id.

    Rows that repeat a doc_id are one document: the one with the least text
    stays. Rows without doc_id stay.
    """
    own = _own(docs)
    marked = minhash.near_duplicates(docs, size=SHINGLE).where("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    key = F.col("doc_id").cast("long")
    rows = docs.select(*[_col(c).alias(k) for c, k in own.items()], key.alias("__id"), F.col("text").alias("__text"))
    marked = marked.where("__id IS NOT NULL")
    alone = rows.where("__id IS NULL").unionByName(rows.join(marked.where("__n = 1"), "__id", "left_semi").select(*rows.columns))
    # Repeated ids are ordered by their texts; those that stand once need no order.
    repeated = rows.join(marked.where("__n > 1"), "__id", "left_semi")
    place = F.row_number().over(Window.partitionBy("__id").orderBy("__text"))
    first = repeated.withColumn("__place", place).where("__place = 1")
    return alone.select(*own.values()).unionByName(first.select(*own.values())).select(*[F.col(k).alias(c) for c, k in own.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated with benchmark items."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32, round_trip of every row."""
    return sentencepiece_viterbi.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", tokens),
]

#: Language identification and the segmentation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, path = written(docs)
            if read is not None:
                drop(spark, read)  # what the stage before wrote is read no more
            read = path
    return docs
