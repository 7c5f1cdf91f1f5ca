"""Batches for model training: padding, attention masks, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED_LABEL = -100


def pad(ids: Column, length: Column, value: int, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value), (length - F.size(ids)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def collate(rows: DataFrame, ids: str, batch: list[str], pad_id: int, left: bool = False, copy_labels: bool = False, shift_labels: bool = False, label_pad: int = IGNORED_LABEL) -> DataFrame:
    """Rows padded to the longest of their batch, with attention_mask, and labels if asked for.

    Null and empty sequences are left out.  With shift_labels, inputs lose their last id and labels their first.
    """
    rows = rows.where(F.col(ids).isNotNull() & (F.size(ids) > 0))
    if copy_labels:
        rows = rows.withColumn("labels", F.col(ids))
    if copy_labels and shift_labels:
        rows = rows.withColumns({ids: F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), "labels": F.slice("labels", 2, F.greatest(F.size("labels") - 1, F.lit(0)))})
    longest = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    rows = rows.withColumn("__n", longest)
    made = {ids: pad(F.col(ids), F.col("__n"), pad_id, left)}
    if copy_labels:
        made["labels"] = pad(F.col("labels"), F.col("__n"), label_pad, left)
    rows = rows.withColumns(made)
    return rows.withColumn("attention_mask", F.transform(ids, lambda x: (x != pad_id).cast("int"))).drop("__n")
