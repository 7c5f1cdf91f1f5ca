"""Token files: JSON lines of {ids, ids_encoded, programs}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.operators.split import subsequences

TOKENS = "score_id long, path string, stream int, ids array<int>, ids_encoded boolean, programs array<int>"


def write_tokens(sequences: DataFrame, path: str, overwrite: bool = True, encoded: bool = False, as_json: bool = True) -> None:
    """One row a sequence, by Spark's committer; without `overwrite`, files are added."""
    rows = sequences.withColumn("ids_encoded", F.lit(encoded))
    out = rows.write.mode("overwrite" if overwrite else "append")
    out.json(path) if as_json else out.parquet(path)


def read_tokens(spark: SparkSession, path: str, as_json: bool = True) -> DataFrame:
    return spark.read.schema(TOKENS).json(path) if as_json else spark.read.parquet(path)


def split_files(spark: SparkSession, path: str, out: str, max_len: int, min_len: int = 1) -> None:
    """Token files to token files of subsequences of max_len ids, with their `chunk`; a last one of min_len ids or fewer is left out."""
    subsequences(read_tokens(spark, path), "ids", max_len, min_len).write.mode("overwrite").json(out)
