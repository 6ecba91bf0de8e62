"""Extraction and step status over streams of lines and events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.operators.extract import Rule, extract_values
from runledger.operators.schema import latest_by
from runledger.sources.logs import explode_lines, split_lines
from runledger.sources.writers import drop_partitions

BATCH, SPAN = "batch_id", "span"


def stream_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """New text files under `path` as (file, line_no, text); the order is in the rows, not their arrival.

    A file is one value in one task; for large ones see `stream_split_lines`.
    """
    whole = spark.readStream.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return explode_lines(whole, "value", ["file"])


def stream_split_lines(spark: SparkSession, path: str) -> DataFrame:
    """New text files under `path`, read in splits: (file, block, place, text).

    (block, place) orders the lines of a file as line numbers would.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of the task, which is that of the file in each of its blocks."""
        seen = 0
        for batch in batches:
            yield batch.append_column("place", pa.array(range(seen, seen + len(batch)), pa.int64()))
            seen += len(batch)

    lines = split_lines(spark.readStream, path).select("file", "block", "text")
    return lines.mapInArrow(placed, "file string, block long, text string, place long").select("file", "block", "place", "text")


def _bounded(rows: DataFrame, watermark: tuple[str, str] | None, span: str | None, unique: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with the delay declared, repeats removed, and the column that ends state: the span of time a row is in."""
    if watermark is None:
        return rows, []
    rows = rows.withWatermark(*watermark)
    if unique:
        rows = rows.dropDuplicatesWithinWatermark(list(unique))
    if span is None:
        return rows, []
    return rows.withColumn(SPAN, F.window(F.col(watermark[0]), span)), [SPAN]


def extract_values_stream(lines: DataFrame, rules: Sequence[Rule], by: Sequence[str], order: Sequence[str], watermark: tuple[str, str] | None = None, unique: Sequence[str] = (), span: str | None = None) -> DataFrame:
    """The batch extraction over a stream: after each trigger the latest match per (by, field) so far.

    Args:
        watermark: (timestamp column, delay). Repeats of the `unique` columns
            within the delay are removed, lines later than it are dropped, and
            what is remembered of older lines goes. Without a watermark the
            result is that of the batch over the same lines.
        span: Length of time, such as `1 day`. Rows are then one per (by,
            field) and span, in column `span`, and the state of a span ends
            with the delay after it, so that no more is held than what a span
            and the delay see. `read_latest` with the span as order joins them.
    """
    lines, spans = _bounded(lines, watermark, span, unique)
    return extract_values(lines, rules, [*by, *spans], order)


def status_stream(events: DataFrame, step: str = "step", event: str = "event", order: Sequence[str] = ("ts",), watermark: tuple[str, str] | None = None, unique: Sequence[str] = (), span: str | None = None) -> DataFrame:
    """Latest lifecycle event of each step seen so far: (step[, span], event, order columns).

    Args:
        watermark, unique, span: As of `extract_values_stream`.
    """
    events, spans = _bounded(events, watermark, span, unique)
    return events.groupBy(step, *spans).agg(F.max_by(F.struct(event, *order), F.struct(*order)).alias("s")).select(step, *spans, "s.*")


def write_updates(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write each trigger's changed rows under its batch number.

    A batch that is repeated after a failure replaces its own folder, so it
    leaves its rows once.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(spark: SparkSession, out: str, by: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The state a stream of updates has reached: the last row written per key.

    Args:
        order: What makes a row later than one of another batch, such as the
            span, which a late row may have changed after a newer one.
    """
    return latest_by(spark.read.parquet(out), list(by), [*order, BATCH]).drop(BATCH)


def compact_updates(spark: SparkSession, out: str, by: Sequence[str], order: Sequence[str] = ()) -> None:
    """Replace the updates written so far by the last row per key.

    Call it between runs of the stream. The rows are written whole, under a
    number before all batches, and the others are dropped after, so one that
    dies in between leaves rows twice and none out.
    """
    updates = spark.read.parquet(out)
    numbers = sorted(r[0] for r in updates.select(BATCH).distinct().collect())
    if len(numbers) < 2:
        return
    latest_by(updates, list(by), [*order, BATCH]).drop(BATCH).write.parquet(f"{out}/{BATCH}={min(numbers[0], 0) - 1}")
    drop_partitions(spark, out, spark.createDataFrame([(n,) for n in numbers], f"{BATCH} int"))
