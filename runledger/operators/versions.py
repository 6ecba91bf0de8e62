"""Version chains: taint, restore, eviction, invalidation, health.

Tables: chains (chain, path, head, status, marker_run, tainted_through, alive),
generations (chain, pos, name, size, present), consumed (chain, step_path,
field, name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.plans.lineage import cut
from runledger.plans.scan import RowNumber, SumBefore, ordered_scan


def _positions(generations: DataFrame, name: str, pos: str) -> DataFrame:
    return generations.groupBy("chain", F.col("name").alias(name)).agg(F.min("pos").alias(pos))


def taint_blocks(generations: DataFrame, chains: DataFrame, targets: DataFrame) -> DataFrame:
    """Whether restoring each target would discard a write nothing can name.

    It would if the target is at or behind the taint; a name that is not in the
    chain, on either side, blocks as well.

    Args:
        targets: (chain, name).
    """
    known = (
        targets.select("chain", "name")
        .join(chains.select("chain", "tainted_through"), "chain")
        .join(_positions(generations, "name", "target_pos"), ["chain", "name"], "left")
        .join(_positions(generations, "tainted_through", "taint_pos"), ["chain", "tainted_through"], "left")
    )
    blocked = F.col("tainted_through").isNotNull() & F.coalesce(F.col("target_pos") <= F.col("taint_pos"), F.lit(True))
    return known.select("chain", "name", blocked.alias("blocked"))


def restore_plan(chains: DataFrame, generations: DataFrame, required: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What to do before a step touches a tracked path: (chain, name, action).

    Args:
        required: (chain, name), the state called for; null name = nothing.
        snapshots: (name), the snapshots on disk. Presence on disk decides, not
            what a generation recorded.
    """
    blocked = taint_blocks(generations, chains, required.where("name is not null")).distinct()
    on_disk = snapshots.select("name").distinct().withColumn("on_disk", F.lit(True))
    joined = (
        required.join(chains.select("chain", "head", "status", "marker_run", F.lit(True).alias("tracked")), "chain", "left")
        .join(blocked, ["chain", "name"], "left")
        .join(on_disk, "name", "left")
    )
    forced = F.col("marker_run").isNotNull() | (F.col("status") == "untrusted")
    action = (
        F.when(F.col("tracked").isNull() | F.col("name").isNull(), F.lit("noop"))
        .when(~forced & F.col("head").eqNullSafe(F.col("name")), F.lit("noop"))
        .when(~forced & F.col("blocked"), F.lit("refuse: tainted"))
        .when(F.col("on_disk").isNull(), F.lit("missing"))
        .when(forced & F.col("blocked"), F.lit("forced: discards work"))
        .when(forced, F.lit("forced"))
        .otherwise(F.lit("restore"))
    )
    return joined.select("chain", "name", action.alias("action"))


def protected_names(chains: DataFrame, consumed: DataFrame) -> DataFrame:
    """Names of generations eviction must not touch: heads, taints and consumed states of live chains."""
    live = chains.where("alive")
    held = live.select(F.explode(F.array("head", "tainted_through")).alias("name"))
    return held.unionByName(consumed.join(live.select("chain"), "chain", "left_semi").select("name")).where("name is not null").distinct()


def evict_plan(chains: DataFrame, generations: DataFrame, consumed: DataFrame, target: int, chain_span: int = 4096, pos_span: int = 65536) -> DataFrame:
    """Snapshots to delete, in order, to free `target` bytes: (rank columns, name, size, freed_before).

    First superseded generations of live chains, chain by chain, newest first;
    then those of dead chains, oldest first (`age`, a whole number). The
    running total is over all candidates, so it is scanned in chunks of the
    order and no task sees more than one: spans of chains and positions, and
    ranges between sampled rows, which split dead generations of one age
    wherever there are many, whatever their names.
    """
    candidates = generations.where("present").join(chains.select("chain", "alive"), "chain").join(protected_names(chains, consumed), "name", "left_anti")
    dead = ~F.col("alive")
    ranked = candidates.select(
        "name",
        "size",
        dead.cast("int").alias("phase"),
        F.when(dead, F.col("age")).otherwise(F.col("chain")).alias("major"),
        F.when(dead, F.lit(0)).otherwise(-F.col("pos")).alias("minor"),
    )
    first = ranked.groupBy("name").agg(F.min(F.struct("phase", "major", "minor", "size")).alias("r")).select("name", "r.*")
    order = ["phase", "major", "minor", "name", "size"]
    # Written, as the scan reads it twice and the ranges must be the same.
    ranges = cut(first.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    scanned = ordered_scan(
        ranges,
        [],
        order,
        [F.col("phase"), F.col("major"), F.floor(F.col("minor") / pos_span), F.col("__range")],
        {"freed_before": SumBefore(F.col("size"))},
        coarse=lambda c: [c[0], F.when(c[0] == 1, c[1]).otherwise(F.floor(c[1] / chain_span))],
    )
    return scanned.where(F.col("freed_before") < target).select("phase", "major", "minor", "name", "size", "freed_before")


def _produced(entries: DataFrame, generations: DataFrame) -> DataFrame:
    """Generations each invalidated step made; a state's name starts with its key."""
    keyed = generations.withColumn("cache_key", F.when(F.col("name").contains("__"), F.substring_index("name", "__", 1)))
    return entries.where("cache_key is not null").select(F.col("step_path").alias("invalidated"), "cache_key").join(keyed, "cache_key")


def invalidate_chains(entries: DataFrame, generations: DataFrame, chains: DataFrame, span: int = 65536) -> DataFrame:
    """How chains roll back when steps are invalidated: (invalidated, chain, n_dropped, new_head).

    A chain whose head goes gets the latest generation that stays, null if none
    does. Generations are numbered in their chain; those a step drops at the end
    are an unbroken run down from the last number, so its length tells which
    stays. Only what is dropped is looked at, however long a chain is.

    Args:
        entries: (step_path, cache_key) of the steps to invalidate, each on its own.
        span: How many positions of a chain a task numbers.
    """
    numbered = cut(ordered_scan(generations.select("chain", "pos", "name"), ["chain"], ["pos"], [F.floor(F.col("pos") / span)], {"number": RowNumber()}))
    # All places of a name have its key, so what a step made is what it drops.
    made = cut(_produced(entries, numbered).select("invalidated", "chain", "name", (-F.col("number")).alias("back")))
    down = ordered_scan(made, ["invalidated", "chain"], ["back", "name"], [F.floor(F.col("back") / span)], {"nth": RowNumber()})
    lengths = numbered.groupBy("chain").agg(F.max("number").alias("length"))
    at_the_end = F.col("length") + F.col("back") + 1 == F.col("nth")
    rolled = down.join(lengths, "chain").groupBy("invalidated", "chain").agg(F.count(F.lit(1)).alias("n_dropped"), (F.first("length") - F.count_if(at_the_end)).alias("number"))
    head = chains.select("chain", F.col("head").alias("name"))
    gone = made.select("invalidated", "chain", "name").distinct().withColumn("dropped", F.lit(True))
    return (
        rolled.join(numbered.select("chain", "number", F.col("name").alias("previous")), ["chain", "number"], "left")
        .join(head, "chain", "left")
        .join(gone, ["invalidated", "chain", "name"], "left")
        .select("invalidated", "chain", "n_dropped", F.when(F.col("dropped"), F.col("previous")).otherwise(F.col("name")).alias("new_head"))
    )


def invalidate_steps(entries: DataFrame, generations: DataFrame, consumed: DataFrame) -> DataFrame:
    """Steps whose entries go with an invalidated one: (invalidated, chain, step_path).

    A step is downstream if the state it consumed is not older than the first
    one the invalidated step made in that chain.
    """
    first = _produced(entries, generations).groupBy("invalidated", "chain").agg(F.min("pos").alias("first"))
    taken = consumed.select("chain", "step_path", "name").join(_positions(generations, "name", "pos"), ["chain", "name"])
    return first.join(taken, "chain").where("pos >= first").select("invalidated", "chain", "step_path").distinct()


def health_report(chains: DataFrame, generations: DataFrame, consumed: DataFrame, entries: DataFrame, snapshots: DataFrame, orphans: DataFrame) -> DataFrame:
    """Everything wrong with the chains, as (section, subject, detail).

    Args:
        entries: (step_path) in the cache. snapshots: (name) on disk. orphans: (trash).
    """
    head = chains.select("chain", "path", "head", "status", "marker_run", "tainted_through", "alive")
    named = generations.join(chains.select("chain", "path"), "chain")
    unrecorded = consumed.join(entries.select("step_path"), "step_path", "left_anti").join(chains.select("chain", "path"), "chain")

    def section(df: DataFrame, name: str, subject: str, detail: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.col(subject).cast("string").alias("subject"), F.col(detail).cast("string").alias("detail"))

    parts = [
        section(head.where("marker_run is not null"), "unreconciled", "path", "marker_run"),
        section(head.where("status = 'untrusted'"), "off tip", "path", "head"),
        section(head.where("tainted_through is not null"), "unprotected", "path", "tainted_through"),
        section(head.where("not alive").withColumn("d", F.lit("tracked but gone")), "disagreements", "path", "d"),
        section(named.where("not present"), "missing snapshots", "path", "name"),
        section(named.where("present").join(snapshots.select("name"), "name", "left_anti"), "disagreements", "path", "name"),
        section(unrecorded.withColumn("d", F.concat_ws(" ", "step_path", "name")), "disagreements", "path", "d"),
        section(orphans.withColumn("d", F.lit("no marker")), "orphan trash", "trash", "d"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
