"""Names for columns of an operator's own beside those of its input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def unused(name: str, columns: Iterable[str]) -> str:
    """`name`, with a mark before it for as long as a column has it in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns of some names, in any case of letters, under others; and the way back."""
    wanted = {n.lower() for n in names}
    aside, taken = {}, [*df.columns, *names]
    for column in df.columns:
        if column.lower() in wanted:
            aside[column] = unused(f"given_{column}", taken)
            taken.append(aside[column])
    return df.withColumnsRenamed(aside), {v: k for k, v in aside.items()}
