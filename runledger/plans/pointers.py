"""Following chains of pointers in a table by doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.plans.lineage import cut


def chase(pointers: DataFrame, key: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Where each key ends up when pointers are followed until there is none.

    Every round replaces a pointer by the pointer of what it points at, so a
    chain of n hops takes log2(n) rounds. A key on a ring, or leading into one,
    ends nowhere: its target columns come back null.

    Args:
        pointers: `key` (unique) and `target` columns, same order and types;
            null targets are no pointers.
    """
    key, target = list(key), list(target)
    hops = [f"__n{i}" for i in range(len(key))]
    table = cut(pointers.where(F.col(target[0]).isNotNull()).select(*key, *target))
    # A chain has no more hops than there are pointers; what still moves after
    # that many doublings goes round in a ring.
    for _ in range(table.count().bit_length() + 1):
        nxt = table.select(*[F.col(k).alias(t) for k, t in zip(key, target)], *[F.col(t).alias(h) for t, h in zip(target, hops)])
        joined = table.join(nxt, target, "left")
        moved = F.col(hops[0]).isNotNull()
        step = cut(joined.select(*key, *[F.coalesce(h, t).alias(t) for h, t in zip(hops, target)], moved.alias("__moved")))
        table = step.drop("__moved")
        if step.where("__moved").isEmpty():
            return table
    ring = table.select(*[F.col(k).alias(t) for k, t in zip(key, target)], F.lit(True).alias("__ring"))
    return table.join(ring, target, "left").select(*key, *[F.when(F.col("__ring").isNull(), F.col(t)).alias(t) for t in target])
