"""Sharding by Karmarkar-Karp differencing.

A partial partition is a tuple of k sums. Differencing takes the two with the
largest spread and adds them oppositely ordered, the largest sum of one to the
smallest of the other, until one is left. The order in which partial partitions
are combined is free, so each task first differences the groups it holds down
to one partial partition, and those (one row of k sums a task) are differenced
again. No task holds more than a stated number of groups on average.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.plans.lineage import cut
from runledger.plans.scan import RowNumber, ordered_scan

#: Groups a task differences at a time, on average.
GROUPS_PER_PART = 5_000
#: Groups above the total over HEAD are differenced together: there are fewer than
#: HEAD of them, and no other group can unbalance its part by more than that.
HEAD = 1 << 14
#: Partial partitions a task differences at a time.
FAN = 1024
#: Rows of one shard numbered in one task, on average.
ROWS_PER_CHUNK = 100_000


def difference(partials: Sequence[Sequence[int]], k: int) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions into one.

    Args:
        partials: Each of k sums, in any order of their own.

    Returns:
        The k final sums, descending, and for each partial partition where its
        j-th sum went: `place[i][j]`.
    """
    if not partials:
        return [0] * k, []
    nodes: list[tuple[int, int, list[int]] | list[int]] = []
    heap = []
    for sums in partials:
        order = sorted(range(k), key=lambda j: -sums[j])
        ranked = [sums[j] for j in order]
        heap.append((ranked[-1] - ranked[0], len(nodes), ranked))
        nodes.append(order)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        both = [x + y for x, y in zip(left, reversed(right))]
        order = sorted(range(k), key=lambda j: -both[j])
        ranked = [both[j] for j in order]
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes), ranked))
        nodes.append((a, b, order))
    # From the root down: where each rank of a node's own sums ends.
    ends: list[list[int] | None] = [None] * len(nodes)
    ends[-1] = list(range(k))
    for i in range(len(nodes) - 1, len(partials) - 1, -1):
        a, b, order = nodes[i]
        end = ends[i]
        ends[i] = None
        to = [0] * k
        for rank, j in enumerate(order):
            to[j] = end[rank]
        ends[a] = to
        ends[b] = to[::-1]
    places = []
    for i in range(len(partials)):
        place = [0] * k
        for rank, j in enumerate(nodes[i]):
            place[j] = ends[i][rank]
        places.append(place)
    return heap[0][2], places


def balance_groups(groups: DataFrame, key: str, weight: str, k: int, per_part: int = GROUPS_PER_PART) -> DataFrame:
    """(key, part, shard) of each row of `groups`, whose keys are distinct.

    `part` is the task that differenced the group, 0 that of the largest groups.
    An empty table gives none.
    """
    count, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    parts = max(1, -(-count // per_part)) + 1

    def shrink(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["w", "k"], ascending=[False, True])
        sums, places = difference([[int(w)] + [0] * (k - 1) for w in frame["w"]], k)
        return pd.DataFrame({"k": frame["k"].values, "part": frame["part"].values, "slot": [p[0] for p in places], "w": frame["w"].values})

    keyed = groups.select(F.col(key).alias("k"), F.col(weight).alias("w"), F.when(F.col(weight) * HEAD > total, 0).otherwise(1 + F.pmod(F.xxhash64(key), F.lit(parts - 1))).alias("part"))
    placed = cut(keyed.groupBy("part").applyInPandas(shrink, f"k {dict(groups.dtypes)[key]}, part long, slot int, w long"))
    # Partial partitions of k sums, FAN of them differenced in a task, until one is left.
    state = placed.groupBy("part", "slot").agg(F.sum("w").alias("w"))
    places = state.select("part", "slot", F.col("part").alias("p"), F.col("slot").alias("s"))
    left = parts
    while True:
        joined = cut(state.withColumn("above", F.floor(F.col("part") / FAN)).groupBy("above").applyInPandas(lambda f: _merge(f, k), "part long, slot int, above long, shard int, w long"))
        step = joined.select(F.col("part").alias("p"), F.col("slot").alias("s"), "above", "shard")
        places = places.join(step, ["p", "s"]).select("part", "slot", F.col("above").alias("p"), F.col("shard").alias("s"))
        left = -(-left // FAN)
        if left <= 1:
            break
        state = joined.groupBy(F.col("above").alias("part"), F.col("shard").alias("slot")).agg(F.sum("w").alias("w"))
    final = places.select("part", "slot", F.col("s").alias("shard"))
    return placed.join(final, ["part", "slot"]).select(F.col("k").alias(key), "part", "shard")


def _merge(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The partial partitions (part, slot, w) of one `above` differenced into one."""
    table = frame.pivot_table(index="part", columns="slot", values="w", aggfunc="sum", fill_value=0).reindex(columns=range(k), fill_value=0).sort_index()
    _, places = difference([[int(w) for w in row] for row in table.to_numpy()], k)
    above = int(frame["above"].iloc[0])
    rows = [(int(part), j, above, place[j], int(table.at[part, j])) for part, place in zip(table.index, places) for j in range(k)]
    return pd.DataFrame(rows, columns=["part", "slot", "above", "shard", "w"])


def shard_documents(docs: DataFrame, shards: int = 16, group: Column | None = None, key: str = "doc_id", text: str = "text", per_part: int = GROUPS_PER_PART, per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Documents dealt to shards of near equal bytes; rows of a group share one.

    Size is the UTF-8 bytes of the text plus 1. Returns one row per input row:
    key, size, text_crc32, law (`bytes`), shard, slot (0, 1, ... in each shard),
    grown_shard (null: this law does not promise where rows go with one more).

    A null text counts as empty, and all empty texts are one group. Null and
    repeated keys are rows as any other. Of equal sizes the group with the
    smaller digest goes first. Other columns are not read. An empty table gives
    no rows. A group is indivisible: one above a shard's share leaves that
    shard above the others.

    Args:
        group: What rows of one shard have in common; by default equal texts.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            (F.octet_length(held) + 1).cast("long").alias("size"),
            F.crc32(held.cast("binary")).alias("text_crc32"),
            (F.sha2(held, 256) if group is None else F.sha2(F.coalesce(group.cast("string"), F.lit("")), 256)).alias("g"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    groups = cut(rows.groupBy("g").agg(F.sum("size").alias("w")))
    dealt = rows.join(balance_groups(groups, "g", "w", shards, per_part), "g").select("doc_id", "size", "text_crc32", "place", "shard")
    chunks = max(1, -(-rows.count() // (shards * per_chunk)))
    # Rows that repeat id and text fill chunks of their own, dealt by their place in the
    # written table: which of them has which slot makes no difference. There are fewer such
    # ids and texts than rows / per_chunk.
    same = F.xxhash64("doc_id", "text_crc32").alias("same")
    repeated = rows.groupBy(same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_chunk).select("same", F.ceil(F.col("n") / per_chunk).alias("runs"))
    marked = dealt.withColumn("same", same).join(repeated, "same", "left")
    chunked = marked.select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        F.pmod("same", F.lit(chunks)).alias("chunk"),
        F.when(F.col("runs").isNotNull(), F.col("same")).alias("own"),
        F.coalesce(F.pmod(F.xxhash64("place"), F.col("runs")), F.lit(0)).alias("run"),
    ).withColumn("own", F.coalesce("own", F.lit(-(1 << 63))))
    numbered = ordered_scan(cut(chunked), ["shard"], ["chunk", "own", "run", "doc_id", "text_crc32"], [F.col("chunk"), F.col("own"), F.col("run")], {"n": RowNumber()})
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("n") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
