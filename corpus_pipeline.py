"""The corpus pipeline: from all documents to a mix of clean ones.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last have the columns of documents. Between
stages the rows are written to the cluster's shared folder and read again, so a lost executor costs a read.

1. ``quality``: documents that the quality classifier rejects go.
2. ``near_duplicates``: one document of each group that SimHash links (three-word shingles, two differing bits at most) stays, the one
   with the least id.
3. ``repeats``: passages that occur more than once are taken out of the texts.
4. ``decontamination``: documents that hold a passage of the benchmark go.
5. ``mix``: the documents of which the mix of the sources takes words, with the words taken in each turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm import decontaminate, mixing, quality, repeats, simhash
from reviewloom.llm.common import bounded, read, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return quality.keep(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return simhash.one_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return repeats.stripped(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return mixing.mixed(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("mix", mix),
]

#: Near copies, the classifier and the decontamination aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
