"""Order-dependent rules: access order, convergence, batches, taint, bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.joins import containment_join
from runledger.operators.schema import latest_by
from runledger.plans import scan
from runledger.plans.digest import encode, group_digest
from runledger.plans.lineage import cut
from runledger.plans.paths import normalize
from runledger.plans.scan import FirstAfter, LastBefore, SumBefore, large_keys, ordered_scan


def access_order(accesses: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Sequence[Column], step: str = "step", mutates: str = "mutates") -> DataFrame:
    """The minimal edges that keep accesses to one path in a safe order: (by, step, dep).

    A writer follows every reader since the last write, or that write if there
    was no reader; a reader follows the last write. Seen from the reader, the
    first rule is an edge from the next write to it, so every edge comes from
    one row and its neighbours and nothing is joined with itself.

    Args:
        by: The path, and whatever separates unrelated pipelines.
        order: Columns that order the accesses of a path totally.
        chunk: See `ordered_scan`.
    """
    writes = F.col(mutates)
    scanned = ordered_scan(
        accesses.select(*dict.fromkeys([*by, *order, step, mutates])),
        by,
        order,
        chunk,
        {
            "__last": LastBefore(F.when(writes, F.col(step))),
            "__next": FirstAfter(F.when(writes, F.col(step))),
            "__after_write": LastBefore(writes),
        },
    )
    return _edges(scanned, by, step, ~writes | F.col("__after_write"), ~writes)


def access_order_within(accesses: DataFrame, by: Sequence[str], pos: str, chunk: Sequence[Column], path: str = "path", step: str = "step", mutates: str = "mutates") -> DataFrame:
    """The same where a path and what lies under it share their bytes: distinct (by, step, dep).

    Every path keeps a state from its first access on. A write touches the
    state of each path that overlaps it, and a read counts only for its own.

    Args:
        pos: Total order of the accesses of one `by`.
    """
    by = list(by)
    # Two spellings of a path are one.
    accesses = accesses.withColumn(path, normalize(F.col(path)))
    paths = accesses.select(*by, F.col(path).alias("path")).distinct()
    pairs = containment_join(paths, paths, by=by).select(*by, F.col("l.path").alias(path), F.col("r.path").alias("state"))
    since = accesses.groupBy(*by, F.col(path).alias("state")).agg(F.min(pos).alias("since"))
    touched = (
        accesses.select(*dict.fromkeys([*by, path, pos, step, mutates]))
        .join(pairs, [*by, path])
        .join(since, [*by, "state"])
        .where(F.col(pos) >= F.col("since"))
        .select(*dict.fromkeys([*by, "state", pos, step, mutates]), (F.col(path) == F.col("state")).alias("own"))
    )
    writes, own_read = F.col(mutates), F.col("own") & ~F.col(mutates)
    scanned = ordered_scan(
        cut(touched),
        [*by, "state"],
        [pos],
        chunk,
        {
            "__last": LastBefore(F.when(writes, F.col(step))),
            "__next": FirstAfter(F.when(writes, F.col(step))),
            "__after_write": LastBefore(F.when(writes, F.lit(True)).when(own_read, F.lit(False))),
        },
    )
    return _edges(scanned, by, step, ~writes | F.coalesce("__after_write", F.lit(False)), own_read).distinct()


def _edges(scanned: DataFrame, by: Sequence[str], step: str, follows_write: Column, read_before: Column) -> DataFrame:
    """Edges of a row: to the last write, and from the next write to it."""

    def edge(when: Column, later: str, earlier: str) -> Column:
        both = F.col(later).isNotNull() & F.col(earlier).isNotNull()
        return F.when(when & both, F.struct(F.col(later).alias("step"), F.col(earlier).alias("dep")))

    pairs = F.array_compact(F.array(edge(follows_write, step, "__last"), edge(read_before, "__next", step)))
    return scanned.select(*by, F.explode(pairs).alias("e")).select(*by, "e.step", "e.dep").where("step <> dep")


def converge(df: DataFrame, by: Sequence[str], order: Sequence[str], sentinel: str, cols: Sequence[str]) -> DataFrame:
    """Iterations after the first one whose sentinel appeared do nothing and repeat its outputs.

    Adds `skipped`, and puts the converged values in `cols` of skipped rows.
    The stopping point is one aggregate per loop, so a long loop needs no sort.
    """
    position = F.struct(*order)
    at = F.when(F.coalesce(F.col(sentinel), F.lit(False)), position)
    stops = df.groupBy(*by).agg(F.min(at).alias("__stop"), F.min_by(F.struct(*cols), at).alias("__out"))
    # A null key is a loop as any other.
    keyed = stops.withColumnsRenamed({b: f"__k_{b}" for b in by})
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__k_{b}")) for b in by])
    joined = df.join(keyed, same).drop(*[f"__k_{b}" for b in by]).withColumn("skipped", F.coalesce(position > F.col("__stop"), F.lit(False)))
    return joined.withColumns({c: F.when(F.col("skipped"), F.col(f"__out.{c}")).otherwise(F.col(c)) for c in cols}).drop("__stop", "__out")


def batches(steps: DataFrame, deps: DataFrame, by: Sequence[str], order: str, chunk: Sequence[Column]) -> DataFrame:
    """Number the runs of consecutive steps that depend on the same set: (by, order, batch).

    Keys of a bounded number of rows are numbered where they are, after one
    exchange; others by ordered scans.

    Args:
        deps: (by, order, dep).
    """
    by = list(by)
    large = large_keys(steps.select(*by).unionByName(deps.select(*by)), by, scan.WHOLE_ROWS)
    if large is None:
        return _batches_in_place(steps, deps, by, order)
    small = _batches_in_place(steps.join(large, by, "left_anti"), deps.join(large, by, "left_anti"), by, order)
    return small.unionByName(_batches_by_scans(steps.join(large, by, "left_semi"), deps.join(large, by, "left_semi"), by, order, chunk))


def _batches_in_place(steps: DataFrame, deps: DataFrame, by: list[str], order: str) -> DataFrame:
    """Batches of keys that fit in a task: all of it under one partitioning by key."""
    # A null names no step.
    named = deps.select(*by, order, "dep", F.lit(0).alias("__step")).dropna(subset=[*by, order])
    rows = steps.select(*by, order, F.lit(1).alias("__step")).unionByName(named, allowMissingColumns=True)
    once = rows.repartition(*by).groupBy(*by, order, "__step", "dep").agg(F.count(F.lit(1)))
    entry = F.when(F.col("__step") == 0, encode("dep"))
    sets = once.groupBy(*by, order).agg(group_digest(entry).alias("deps"), F.max("__step").alias("__step")).where("__step = 1")
    ahead = Window.partitionBy(*by).orderBy(order)
    signed = sets.withColumn("__prev", F.lag("deps").over(ahead))
    opened = F.when(F.col("__prev") == F.col("deps"), 0).otherwise(1)
    return signed.select(*by, order, F.sum(opened).over(ahead.rowsBetween(Window.unboundedPreceding, 0)).alias("batch"))


def _batches_by_scans(steps: DataFrame, deps: DataFrame, by: list[str], order: str, chunk: Sequence[Column]) -> DataFrame:
    """Batches of keys of any size."""
    sets = deps.select(*by, order, "dep").distinct().groupBy(*by, order).agg(group_digest(encode("dep")).alias("deps"))
    signed = steps.select(*by, order).join(sets, [*by, order], "left").withColumn("deps", F.coalesce("deps", F.lit("none")))
    # A scan reads its input twice: once for the rows, once for the chunk sums.
    lagged = ordered_scan(cut(signed), by, [order], chunk, {"__prev": LastBefore(F.col("deps"))})
    opened = F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col("deps")), 1).otherwise(0)
    counted = ordered_scan(cut(lagged.select(*by, order, opened.alias("__new"))), by, [order], chunk, {"__seen": SumBefore(F.col("__new"))})
    return counted.select(*by, order, (F.col("__seen") + F.col("__new")).alias("batch"))


def display_edges(steps: DataFrame, edges: DataFrame, by: Sequence[str], order: str, chunk: Sequence[Column]) -> DataFrame:
    """The edges to draw: real ones, and one to the previous step for a step without any.

    Args:
        edges: (by, order, dep).
    """
    lagged = ordered_scan(steps.select(*by, order), by, [order], chunk, {"dep": LastBefore(F.col(order))})
    free = lagged.where("dep is not null").join(edges.select(*by, order), [*by, order], "left_anti")
    return edges.select(*by, order, "dep", F.lit("real").alias("kind")).unionByName(free.select(*by, order, "dep", F.lit("display").alias("kind")))


def advance_taint(events: DataFrame, chain: str = "chain", seq: str = "seq", chunk: Sequence[Column] = ()) -> DataFrame:
    """How far each chain is tainted: the newest head that an unnamed write followed.

    Args:
        events: (chain, seq, produced), `produced` being the position of the
            generation a write made, null for an unnamed write.
    """
    heads = ordered_scan(events.select(chain, seq, "produced"), [chain], [seq], chunk, {"head": LastBefore(F.col("produced"))})
    return heads.where("produced is null").groupBy(chain).agg(F.max("head").alias("tainted_pos")).where("tainted_pos is not null")


def latest_entries(entries: DataFrame, key: str = "step_path", order: Sequence[str] = ("recorded_at",)) -> DataFrame:
    """The last recorded entry of each step."""
    return latest_by(entries, [key], order)


def last_consumed(events: DataFrame, by: Sequence[str] = ("step_path", "field"), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The state each step last took through each field."""
    return latest_by(events, by, order)
