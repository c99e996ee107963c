"""Corpus pipeline: five stages over ``documents``, each written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept.

* quality: a document that the classifier predicts as 0 goes.
* language: a document without a recognisable language goes: no letter in it, or a
  cosine with the nearest language that lies no further from 0 than chance would put
  it.  Between unrelated vectors it spreads by 1 / sqrt(places), whatever the length of
  the text; ``CHANCE`` such spreads are asked for, so a clean text of one or two words stays.
* near_dedup: of each class of near duplicates the document of the smallest id stays.
* decontamination: a document in which a benchmark item occurs goes.
* mixing: documents are taken as often as their source's target asks; one that is
  taken no time goes, ``taken`` counts the words of the others, repeats included.

Defined results: an empty table gives an empty result in every stage; a null text is
judged as the empty text by the classifier and goes for want of a letter if that keeps
it; rows without an id stay as long as their text earns it, one of each class; a null
source is a source of its own; repeated rows and ties leave one row, the least by a hash
of its columns; texts of any length are read whole; further columns, ``size``, ``target``
and ``taken`` among them, pass through the first four stages and are left out of the
last one's result, whose columns are fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.llm import decontaminate, language_id, mixing, near_dedup, quality
from marklake.llm._store import Workspace, table

CHANCE = 1.5


def _kept(docs: DataFrame, judge, test) -> DataFrame:
    """``docs`` as they came, without the rows that fail ``test``: columns that bear the names of the judge's own travel aside."""
    clash = [c for c in docs.columns if c in ("held_out", "score", "predicted", "lang_pred")]
    aside = docs.withColumnsRenamed({c: f"_aside_{c}" for c in clash})
    judged = judge(aside).where(test)
    return judged.select(*[F.col(f"_aside_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns])


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda df: quality.classify(spark, df, table(spark, sf_dir, "labels")), F.col("predicted") == 1)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = (F.col("lang_pred") != "und") & (F.col("score") >= CHANCE / language_id.DIM**0.5)
    return _kept(docs, lambda df: language_id.identify(spark, df), known)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(spark, docs).select(*docs.columns)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, docs).where("taken > 0").select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", stage_quality),
    ("language", stage_language),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("mixing", stage_mixing),
]

# SQL cannot express the classifier, the language profiles or the near-duplicate search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)  # the stage's own rows are written, its predecessor's are not needed any more
        before = name
    return docs
