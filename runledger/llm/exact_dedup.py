"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over the leading part of the
text and its hash, each partition is sorted externally by the whole text, and
equals are found by comparing full neighbouring texts. Copies of a text that is
too frequent for one partition are spread over several runs, and the heads of
those runs are compared in full once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.plans.lineage import cut

#: Characters of the text that splitters compare; ties are split by a hash.
SPLITTER_CHARS = 24
#: A text is spread once its copies exceed this share of a partition's rows.
SPREAD_SHARE = 0.25


def content_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise=None, keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Args:
        normalise: Column -> Column applied to the text before it is compared;
            none by default, texts are equal when identical.
        keep: Which id of a group stays, `max` or `min`.

    A null text counts as empty; all empty texts are one group. Null ids lose
    to any other; a group of null ids only has a null keep_id and keeps all its
    rows, as do rows that repeat the id that stays. Other columns are not read.
    An empty table gives no rows.
    """
    assert keep in ("max", "min"), keep
    held = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (held if normalise is None else normalise(held)).alias("t")).withColumn("h", F.xxhash64("t")).withColumn("place", F.monotonically_increasing_id())
    spark = docs.sparkSession

    # Hashes that many rows share: at most partitions / SPREAD_SHARE of them.
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total, partitions = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    bound = max(1, int(total * SPREAD_SHARE / partitions))
    hot = cut(counts.where(F.col("n") > bound).select(F.col("h").alias("hh"), F.ceil(F.col("n") / bound).alias("runs")))
    # Rows that repeat an id, or have none, are told apart by where they were read.
    salt = F.pmod(F.xxhash64("doc_id", "place"), F.col("runs"))
    # h can be hot by collision too: then a run holds two texts, which the sort tells apart.
    spread = rows.join(F.broadcast(hot), F.col("h") == F.col("hh"), "left").select(
        "doc_id", "t", "h", F.when(F.col("runs").isNotNull(), salt).otherwise(0).alias("run"), F.col("runs").isNotNull().alias("hot")
    )
    ranged = spread.withColumn("lead", F.substring("t", 1, SPLITTER_CHARS)).repartitionByRange("lead", "h", "run")
    # The window's key contains the range key, so no other exchange is needed: rows
    # are sorted where they are and neighbours compared by their whole texts.
    run = Window.partitionBy("lead", "h", "run", "t")
    by_id = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    ordered = run.orderBy(by_id)
    whole = run.orderBy(by_id).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = cut(
        ranged.select(
            "doc_id",
            "hot",
            F.sha2("t", 256).alias("text_sha256"),
            F.first("doc_id").over(whole).alias("keep_id"),
            F.count(F.lit(1)).over(whole).alias("group_size"),
            F.row_number().over(ordered).alias("pos"),
            "t",
        ).withColumn("t", F.when(F.col("hot") & (F.col("pos") == 1), F.col("t")))
    )
    # Heads of the runs of spread texts: as few as there are runs, compared in full.
    heads = found.where("hot and pos = 1").groupBy("t", "text_sha256").agg((F.max if keep == "max" else F.min)("keep_id").alias("best"), F.sum("group_size").alias("n")).select("text_sha256", "best", "n", F.lit(True).alias("hot"))
    joined = found.drop("t", "pos").join(F.broadcast(heads), ["text_sha256", "hot"], "left")
    keep_id, size = F.when(F.col("hot"), F.col("best")).otherwise(F.col("keep_id")), F.when(F.col("hot"), F.col("n")).otherwise(F.col("group_size"))
    return joined.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
