"""Writing run documents and partitioned products."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.plans.lineage import cut

# Rows of one partition that a task sorts and a file holds, before they are compressed.
FILE_BYTES = 64 << 20


def nest_records(records: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Flat step records back as one JSON document per run: (run_id, text).

    A document is one value, and holds the steps of its run whole.

    Args:
        records: run_id, path, depth, idx and any fields, one root (depth 0) per run.
        max_depth: Depth of the deepest step where it is known; by default it is
            looked up. A step below it is an error, never left out.
    """
    deepest = records.agg(F.max("depth")).first()[0] or 0
    if max_depth is not None and deepest > max_depth:
        raise ValueError(f"a step has depth {deepest}, below {max_depth}")
    fields = [c for c in records.columns if c not in ("run_id", "path", "depth", "idx")]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    flat = records.select("run_id", "path", "depth", "idx", body.alias("body"), F.regexp_replace("path", r"\.[^.]*$", "").alias("parent"))
    children = None
    for depth in range(deepest, -1, -1):
        here = flat.where(F.col("depth") == depth)
        steps = F.lit("")
        if children is not None:
            here = here.join(children, ["run_id", "path"], "left")
            steps = F.coalesce("steps", F.lit(""))
        text = F.concat(F.regexp_replace("body", r"\}$", ""), F.lit(',"steps":['), steps, F.lit("]}"))
        if depth == 0:
            return here.select("run_id", text.alias("text"))
        ordered = F.array_sort(F.collect_list(F.struct("idx", text.alias("t"))))
        children = here.groupBy("run_id", F.col("parent").alias("path")).agg(F.array_join(F.transform(ordered, lambda c: c.t), ",").alias("steps"))
    raise AssertionError("depth 0 is always reached")


def write_runs(runs: DataFrame, path: str) -> None:
    """Append run documents, one per line, under `name=.../run_date=...`.

    Args:
        runs: (run_id, name, generated_at, text), `text` being the root record.
    """
    document = F.concat(
        F.regexp_replace(F.to_json(F.struct(F.col("run_id").cast("string").alias("run_id"), F.col("generated_at").cast("string").alias("generated_at"))), r"\}$", ""),
        F.lit(',"root":'),
        "text",
        F.lit("}"),
    )
    runs.select(document.alias("value"), "name", F.to_date("generated_at").alias("run_date")).write.mode("append").partitionBy("name", "run_date").text(path)


def drop_partitions(spark: SparkSession, path: str, values: DataFrame) -> None:
    """Delete the folders of the given partition values (columns in the order of the folders)."""
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in values.select(*[F.col(c).cast("string").alias(c) for c in values.columns]).distinct().toLocalIterator():
        parts = [f"{escape(c)}={'__HIVE_DEFAULT_PARTITION__' if row[c] is None else escape(row[c])}" for c in values.columns]
        folder = jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_outputs(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace the partitions that `df` has rows for, and only those.

    A partition is one file, or where its rows are large, one for each
    `FILE_BYTES` of them. Rows are measured first: what a shuffle writes is
    compressed and does not tell how much a task has to sort.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType for f in df.schema}
    nested = [c for c, kind in kinds.items() if isinstance(kind, T.ArrayType | T.MapType | T.StructType)]
    texts = [F.octet_length(c) for c, kind in kinds.items() if isinstance(kind, T.StringType | T.BinaryType)] + [F.octet_length(F.to_json(c)) for c in nested]
    width = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0)).cast("bigint") for t in texts], F.lit(16 + 8 * len(kinds)).cast("bigint"))
    sizes = cut(df.groupBy(*keys).agg(F.sum(width).alias("__bytes")))
    large = sizes.where(F.col("__bytes") > FILE_BYTES).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.ceil(F.col("__bytes") / FILE_BYTES).cast("int").alias("__files"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    # A place depends on what a row holds and on its task, not on the order of rows, so a repeated task deals alike.
    plain = [c for c, kind in kinds.items() if not isinstance(kind, T.MapType | T.VariantType)]
    dealt = df.withColumn("__hash", F.xxhash64(*plain, F.spark_partition_id())).join(F.broadcast(large), same, "left").withColumn("__place", F.coalesce(F.pmod("__hash", "__files"), F.lit(0)))
    tasks = int((sizes.agg(F.sum("__bytes")).first()[0] or 0) // FILE_BYTES) + 1
    rows = dealt.repartition(tasks, *keys, "__place").select(*df.columns)
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)
