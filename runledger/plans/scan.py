"""Ordered scans (row numbers, running sums, last/next value) over keys of any size.

A plain window over a key sorts the whole key in one task, which fails when one
key holds a third of the table. So keys are counted first. A key of a bounded
number of rows is scanned by a plain window, which moves and sorts the rows
once. Any other is cut into chunks that follow the order: each chunk is scanned
on its own, one small row per chunk carries what the chunks before (or after) it
contribute, and the carry is joined back on (key, chunk), the partitioning the
local scan already has.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.plans.lineage import cut

# A key with more rows is scanned in chunks.
WHOLE_ROWS = 1 << 14


@dataclass(frozen=True)
class RowNumber:
    """1-based position in the order."""


@dataclass(frozen=True)
class SumBefore:
    """Sum of `value` over strictly earlier rows (0 where there are none)."""

    value: Column


@dataclass(frozen=True)
class LastBefore:
    """Latest non-null `value` among strictly earlier rows."""

    value: Column


@dataclass(frozen=True)
class FirstAfter:
    """Earliest non-null `value` among strictly later rows."""

    value: Column


Spec = RowNumber | SumBefore | LastBefore | FirstAfter


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Sequence[Column],
    outputs: Mapping[str, Spec],
    coarse: Callable[[list[Column]], list[Column]] | None = None,
) -> DataFrame:
    """`df` with one column per entry of `outputs`.

    The rows of each key are counted at once; the scan itself is lazy.

    Args:
        by: Key columns, non-null; empty for one global order.
        order: Columns that order a key totally.
        chunk: Expressions that never decrease along `order`, such as the day
            of a timestamp or `floor(position / 100000)`. They bound how many
            rows of one key meet in one task.
        outputs: Output column name -> what to compute.
        coarse: Where a key may have very many chunks, a coarser chunk as a
            function of the chunk columns; the carry is then itself scanned in
            those.
    """
    by, order = list(by), list(order)
    if not by:
        return _scan_in_chunks(df, by, order, chunk, outputs, coarse)
    large = large_keys(df, by, WHOLE_ROWS)
    if large is None:
        return _scan_whole(df, by, order, outputs)
    small = _scan_whole(df.join(large, by, "left_anti"), by, order, outputs)
    in_chunks = _scan_in_chunks(df.join(large, by, "left_semi").select(*df.columns), by, order, chunk, outputs, coarse)
    return small.select(*df.columns, *outputs).unionByName(in_chunks)


def large_keys(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame | None:
    """The keys of more than `rows` rows, at most one in so many rows, if there are any."""
    large = cut(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows).select(*by).dropna())
    return None if large.isEmpty() else large


def _scan_whole(df: DataFrame, by: list[str], order: list[str], outputs: Mapping[str, Spec]) -> DataFrame:
    """The scan of keys that fit in a task: plain windows over one partitioning."""
    return _scan_plainly(df, by, order, outputs).select(*df.columns, *outputs)


def _scan_in_chunks(
    df: DataFrame,
    by: list[str],
    order: list[str],
    chunk: Sequence[Column],
    outputs: Mapping[str, Spec],
    coarse: Callable[[list[Column]], list[Column]] | None,
) -> DataFrame:
    """The scan of keys of any size."""
    # A nested scan must not reuse the chunk names of the one around it.
    level = 1 + max((int(c[3 : c.index("_", 3)]) for c in df.columns if c.startswith("__c")), default=-1)
    chunks = [f"__c{level}_{i}" for i in range(len(chunk))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(chunk, chunks)], *[_value(s).alias(f"__v_{n}") for n, s in outputs.items() if _value(s) is not None])

    forward = Window.partitionBy(*by, *chunks).orderBy(*order)
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    # "Later rows" as "earlier rows of the reversed order": Spark scans a frame
    # that starts unbounded once, and re-reads one that ends unbounded per row.
    after = Window.partitionBy(*by, *chunks).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)

    local, summary, carry = [], [], {}
    position = F.struct(*order)
    for name, spec in outputs.items():
        v, held = F.col(f"__v_{name}"), F.col(f"__s_{name}")
        match spec:
            case RowNumber():
                local.append(F.row_number().over(forward).cast("bigint").alias(f"__l_{name}"))
                summary.append(F.count(F.lit(1)).alias(f"__s_{name}"))
                carry[f"__b_{name}"] = SumBefore(held)
            case SumBefore():
                local.append(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__l_{name}"))
                summary.append(F.coalesce(F.sum(v), F.lit(0)).alias(f"__s_{name}"))
                carry[f"__b_{name}"] = SumBefore(held)
            case LastBefore():
                local.append(F.last(v, ignorenulls=True).over(before).alias(f"__l_{name}"))
                summary.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"__s_{name}"))
                carry[f"__b_{name}"] = LastBefore(held)
            case FirstAfter():
                local.append(F.last(v, ignorenulls=True).over(after).alias(f"__l_{name}"))
                summary.append(F.min_by(v, F.when(v.isNotNull(), position)).alias(f"__s_{name}"))
                carry[f"__b_{name}"] = FirstAfter(held)

    scanned = keyed.select("*", *local)
    summaries = keyed.groupBy(*by, *chunks).agg(*summary)
    if coarse is None:
        carried = _scan_plainly(summaries, by, chunks, carry)
    else:
        carried = ordered_scan(summaries, by, chunks, coarse([F.col(c) for c in chunks]), carry)
    carried = carried.select(*by, *chunks, *carry)
    joined = scanned.join(carried, [*by, *chunks], "left")
    results = []
    for name, spec in outputs.items():
        here, there = F.col(f"__l_{name}"), F.col(f"__b_{name}")
        additive = isinstance(spec, RowNumber | SumBefore)
        results.append((here + there if additive else F.coalesce(here, there)).alias(name))
    return joined.select(*df.columns, *results)


def _scan_plainly(df: DataFrame, by: list[str], order: list[str], outputs: Mapping[str, Spec]) -> DataFrame:
    """The scan where a key has few rows, such as over chunk summaries: plain windows."""
    keys = by or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    columns = {}
    for name, spec in outputs.items():
        match spec:
            case RowNumber():
                columns[name] = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
            case SumBefore(v):
                columns[name] = F.coalesce(F.sum(v).over(before), F.lit(0))
            case LastBefore(v):
                columns[name] = F.last(v, ignorenulls=True).over(before)
            case FirstAfter(v):
                columns[name] = F.last(v, ignorenulls=True).over(after)
    return df.withColumns(columns)


def _value(spec: Spec) -> Column | None:
    return None if isinstance(spec, RowNumber) else spec.value
