"""Labelled training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled rows that a model is fitted on at most, about. This is the bound of what reaches the driver.
MAX_TRAIN = 8_000


def held_out(id_col: str, folds: int, fold: int):
    """Column: whether crc32 of the id as text falls in the fold that is never learnt from. A null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, *, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_text, _label of a bounded sample of the labelled documents outside the held-out fold, drawn by a hash of the id.

    Rows without a label or id are left out; of labels repeated for one id the largest counts, and of texts the last in
    order, so that repeated ids don't pass the bound.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    n = known.count()
    if n > max_train:
        known = known.filter((F.xxhash64("_id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < F.lit(max_train / n))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    found = rows.join(F.broadcast(known), "_id")  # about max_train rows of two numbers
    return found.groupBy("_id").agg(F.max("_text").alias("_text"), F.max("_label").alias("_label")).select("_text", "_label")
