"""Console output and run logs as ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

# Line boundaries, the stream order, the log line layout and the
# level ranks.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
STREAMS = ("stdout", "stderr")
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[,.]\d{3}) ([A-Z]+) (.*)$"
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
STEP_EVENT = r"^step (\S+): (starting|finished|failed|cache hit|skipped)(.*)$"
STEP_OUTPUT = r"^\[([^\]]+)\] (.*)$"


def lines_of(text: Column) -> Column:
    """The lines of a text; a final line break does not open another line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(df: DataFrame, text_col: str, keys: Sequence[str]) -> DataFrame:
    """One row per line: keys, 0-based line_no, text."""
    return df.select(*keys, F.posexplode(lines_of(F.col(text_col))).alias("line_no", "text"))


def explode_streams(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of the `stdout` and `stderr` columns, all of stdout first: keys, stream, stream_rank, line_no, text."""
    both = F.array(
        *[F.struct(F.lit(i).alias("stream_rank"), F.lit(s).alias("stream"), lines_of(F.coalesce(F.col(s), F.lit(""))).alias("lines")) for i, s in enumerate(STREAMS)]
    )
    streams = df.select(*keys, F.explode(both).alias("s"))
    return streams.select(*keys, "s.stream", "s.stream_rank", F.posexplode("s.lines").alias("line_no", "text"))


def split_lines(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """Lines of text files where they are read, in splits and in order: (file, size, block, bytes, k, text).

    Splits end at line feeds. Of a stretch between two of them, `k` numbers the
    lines that other breaks make of it and `bytes` is its length, null but for
    the first.
    """
    stretches = reader.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # The carriage return before a line feed is part of the break.
    parts = F.split(F.regexp_replace("value", r"\r\z", ""), LINE_BREAK, -1)
    exploded = stretches.select("file", "size", "block", (F.octet_length("value") + 1).cast("bigint").alias("bytes"), F.posexplode(parts).alias("k", "text"))
    return exploded.select("file", "size", "block", F.when(F.col("k") == 0, F.col("bytes")).alias("bytes"), "k", "text")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (file, line_no, text); the number is the line's place in its own file, from 0.

    A file is read in splits, and no line is shuffled: one small row a split
    tells how many lines the splits before it hold. A final break opens no line.
    """
    lines = split_lines(spark.read, path).withColumn("place", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "size", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("place").alias("first"), F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block")
    whole = Window.partitionBy("file")
    starts = blocks.select(
        "file",
        "block",
        "first",
        (F.sum("lines").over(earlier) - F.col("lines")).alias("before"),
        # Without a final line feed the text is one byte shorter than its stretches; its last line is then left out if it is empty.
        F.when(F.sum("bytes").over(whole) > F.col("size"), F.sum("lines").over(whole) - 1).alias("open_end"),
    )
    numbered = lines.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("place") - F.col("first")).alias("line_no"), "k", "text", "open_end")
    after_a_break = (F.col("line_no") == F.col("open_end")) & (F.col("k") > 0) & (F.col("text") == "")
    return numbered.where(~F.coalesce(after_a_break, F.lit(False))).select("file", "line_no", "text")


def parse_run_log(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ts, level, step, event and message to run-log lines.

    `event` is a lifecycle event of the step, `output` for a forwarded line of
    its console, or null.
    """
    text = F.col(text_col)
    body = F.regexp_extract(text, LOG_LINE, 3)
    is_log = text.rlike(LOG_LINE)
    is_event, is_output = body.rlike(STEP_EVENT), body.rlike(STEP_OUTPUT)
    stamp = F.replace(F.regexp_extract(text, LOG_LINE, 1), F.lit(","), F.lit("."))
    return lines.withColumns(
        {
            "ts": F.when(is_log, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSS"))),
            "level": F.when(is_log, F.regexp_extract(text, LOG_LINE, 2)),
            "step": F.when(is_log & is_event, F.regexp_extract(body, STEP_EVENT, 1)).when(
                is_log & is_output, F.regexp_extract(body, STEP_OUTPUT, 1)
            ),
            "event": F.when(is_log & is_event, F.regexp_extract(body, STEP_EVENT, 2)).when(is_log & is_output, F.lit("output")),
            "message": F.when(is_log & is_output, F.regexp_extract(body, STEP_OUTPUT, 2)).when(is_log, body),
        }
    )


def level_rank(level: Column) -> Column:
    """Place of a log level in severity order, null where unknown."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.upper(level)).cast("int") - 1


def at_least(level: Column, threshold: str) -> Column:
    """Whether a level is the threshold or above it."""
    if threshold.upper() not in LEVELS:
        raise ValueError(f"unknown log level {threshold!r}")
    return level_rank(level) >= LEVELS.index(threshold.upper())
