"""The queries opN_<name> of this subpackage, `pipeline`, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tactus.llm import bpe_count, chat, html_extract, langid, line_dedup, media, mixing, packing, simhash, topk
from tactus.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": _over("documents", langid.op1),
        "op2_simhash_near_dedup": _over("documents", simhash.op2),
        "op3_topk_search": _over("embeddings", topk.op3),
        "op4_html_extraction": _over("pages", html_extract.op4),
        "op5_line_dedup": _over("documents", line_dedup.op5),
        "op6_media_columns": _over("documents", media.op6),
        "op7_chat_formatting": chat.op7,
        "op8_token_counts": _over("documents", bpe_count.op8),
        "op9_source_mixing": _over("documents", mixing.op9),
        "op10_packing": _over("documents", packing.op10),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_search": topk.SQL, "op5_line_dedup": line_dedup.SQL, "op7_chat_formatting": chat.SQL, "op9_source_mixing": mixing.SQL}
