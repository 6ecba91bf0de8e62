"""Bounded samples of labelled texts, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most `per_class` (text, label) of each of the labels 0 and 1, the first by a hash of the key.

    Of several labels of a key the larger counts. A key that several rows have
    gives one text, the first by a hash, however many they are.

    Args:
        learn: Condition on `k`, the key, under which a row may be learnt from.
    """
    named = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & learn)
    usable = named.groupBy("k").agg(F.max("y").alias("y"))
    order = [F.xxhash64("k", F.lit(11)), F.col("k")]
    # The feature is the bound: two short lists of keys, so the documents need no shuffle.
    chosen = usable.where("y = 0").orderBy(*order).limit(per_class).unionAll(usable.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").where(F.col("t").isNotNull())
    one = texts.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("first"))
    return sorted({(r.t, r.y) for r in one.select("first.t", "y").collect()}, key=lambda x: (len(x[0]), x))
