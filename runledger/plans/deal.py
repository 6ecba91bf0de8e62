"""Rows dealt by key over as many tasks as their number asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Rows a task is dealt, on average. Shuffled rows compress so well that partitions
#: put together by their bytes alone are many times as large in memory.
ROWS_OF_TASK = 1 << 20


def tasks_for(*tables: DataFrame, weight: int = 1) -> int | None:
    """Tasks that the rows of these tables ask for together; None if one would do.

    Args:
        weight: Narrow rows that one of these rows is worth.
    """
    tasks = -(-weight * sum(t.count() for t in tables) // ROWS_OF_TASK)
    return max(tasks, tables[0].sparkSession.sparkContext.defaultParallelism) if tasks > 1 else None


def dealt(df: DataFrame, tasks: int | None, keys: Sequence[str]) -> DataFrame:
    """`df` by key in `tasks` partitions, which are left as they are; without a number their sizes decide."""
    return df.repartition(*keys) if tasks is None else df.repartition(tasks, *keys)


def merged(df: DataFrame, tasks: int | None) -> DataFrame:
    """`df` as the side of a join that is not broadcast if rows are dealt; exploded and distinct rows count as small to the planner."""
    return df if tasks is None else df.hint("merge")
