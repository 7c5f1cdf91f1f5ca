"""A corpus pipeline over `documents`: STAGES in order, each on all that the stage before it kept.

1 language      documents whose language can't be told (no letter at all) go; without a labelled row all stay
2 lines         of a line that ten documents or more have, the first in order of document and position stays, the others go
3 near_dups     one document of each group of linked SimHash fingerprints stays, that of the smallest doc_id
4 mix           sources to target weights: documents are repeated, or left out, as the mix takes them
5 pack          token sequences of 2048

Stage 2 keeps the first occurrence, as otherwise ten copies of a clean document would all lose their text before stage 3
could keep one of them.  Stages 1 to 4 return the columns of `documents`, with n_chars of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tactus.llm import langid, line_dedup, mixing, packing, simhash
from tactus.llm.common import aside, remove, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = langid.training_sample(docs, ~langid.is_held_out(F.col("doc_id")))
    named, back = aside(docs, ("doc_id", "text"))
    if not sample:  # nothing to tell languages by, so nothing to reject
        return docs
    found = langid.predict_languages(named, sample, tuple(named.columns))
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(*named.columns).withColumnsRenamed(back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, back = aside(docs, ("doc_id", "text"))
    kept = line_dedup.dedup_lines(named, keep_first=True).select(*named.columns).withColumnsRenamed(back)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_dups", near_dups), ("mix", mix), ("pack", pack)]

#: SQL can't express the suffix automata, the fingerprints' components or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has returned is deleted when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(spark, before)
        before = docs
    return docs
