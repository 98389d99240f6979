"""Corpus pipeline: toxicity, exact duplicates, near-duplicates, decontamination, mixing.

Every stage is one operator over all that its predecessor kept. ``run`` writes each stage's
result to the folder that all executors share and reads it back for the next.

Defined cases, in every stage: a null text counts as empty; an empty text is not toxic and not
contaminated, and of all empty texts one stays; texts of any length are read whole; a null doc_id
loses to any other among equal texts, takes part in no near-duplicate link and is otherwise
judged by its text; of rows that repeat id and text one stays; ties between documents go to the
smaller doc_id; an empty table stays empty, and with empty labels or benchmark nothing is learnt
or contaminated; further columns are kept, whatever their names, but ``rate`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from lodestrata.llm.common import discard, materialize, table


#: Shares of tokens that the last stage aims at; what the first stage has left of toxic texts gets no weight.
MIXTURE = {"clean": 0.93, "poor": 0.07, "toxic": 0.0}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``rate``, how often a document is read in one pass; rate zero means never."""
    return mixing.with_rates(docs, table(spark, sf_dir, "labels"), MIXTURE)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]

#: A trained classifier and chained fingerprints are beyond SQL; tests hold the chain of stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
