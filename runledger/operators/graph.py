"""Dependency graphs of many pipelines at once.

Nodes are named by `by` columns (the recipe) and a node column; edges are
(by, src, dst) and never leave their recipe. Loops run on the driver, but each
round is one plan over all recipes whose result is written to shared storage.
Levels and keys of small recipes are settled where the recipe is, moved once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.plans.digest import WORDS, digest_of_sums, encode, group_digest, hash_words, pack, row_digest, unpack
from runledger.plans.lineage import Rounds, cut
from runledger.plans.pointers import chase
from runledger.plans.scan import large_keys

# Nodes and edges of a recipe that are held in one row; larger recipes go by rounds.
SMALL_ROWS = 256


def build_edges(steps: DataFrame, wiring: DataFrame, after: DataFrame, by: Sequence[str] = ("recipe",)) -> DataFrame:
    """Edges of a recipe: what wiring reads from, and what `after` names. (by, src, dst, kind)

    An edge that is both is a data edge.

    Args:
        steps: (by, step). wiring: (by, step, src_step). after: (by, step, after).
    """
    by = list(by)
    names = steps.select(*by, "step").distinct()
    data = wiring.where("src_step is not null").select(*by, F.col("src_step").alias("src"), F.col("step").alias("dst"), F.lit(0).alias("order_only"))
    order = after.select(*by, F.col("after").alias("src"), F.col("step").alias("dst"), F.lit(1).alias("order_only"))
    merged = data.unionByName(order).groupBy(*by, "src", "dst").agg(F.min("order_only").alias("order_only"))
    known = merged.join(names.withColumnRenamed("step", "src"), [*by, "src"], "left_semi").join(names.withColumnRenamed("step", "dst"), [*by, "dst"], "left_semi")
    return known.select(*by, "src", "dst", F.when(F.col("order_only") == 1, F.lit("order")).otherwise(F.lit("data")).alias("kind"))


def _large(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame | None:
    """The recipes of too many nodes and edges for one row, if there are any."""
    return large_keys(nodes.select(*by).unionByName(edges.select(*by)), by, SMALL_ROWS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gathered(nodes: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """A row a recipe: what is in column `__node` of `nodes` and `__arc` of `arcs` as lists `nodes` and `arcs`."""
    rows = nodes.select(*by, "__node").unionByName(arcs.select(*by, "__arc"), allowMissingColumns=True)
    return rows.groupBy(*by).agg(F.collect_list("__node").alias("nodes"), F.collect_list("__arc").alias("arcs"))


def _settled(into: Column, kind: str, rule: Callable[[Column, Column, Column], Column]) -> Column:
    """A value per node once all nodes it reads have theirs, null on and behind a cycle.

    Args:
        into: List of arcs per node; `at` of an arc is the 1-based place of the node it reads.
        kind: Type of a value.
        rule: (place of the node from 0, its arcs, values of what they read) -> its value, not null.
    """

    def again(into: Column, values: Column) -> Column:
        def value(old: Column, i: Column) -> Column:
            def judged(arcs: Column) -> Column:
                return _let(F.transform(arcs, lambda a: F.get(values, a["at"] - 1)), lambda read: F.when(~F.exists(read, F.isnull), rule(i, arcs, read)))

            return F.when(old.isNotNull(), old).otherwise(_let(F.get(into, i), judged))

        return F.transform(values, value)

    def loop(into: Column) -> Column:
        start = F.struct(F.transform(into, lambda _: F.lit(None).cast(kind)).alias("values"), F.lit(True).alias("moving"))
        turns = F.sequence(F.lit(1), F.greatest(F.size(into), F.lit(1)))

        def turn(state: Column, _: Column) -> Column:
            moved = _let(again(into, state["values"]), lambda new: F.struct(new.alias("values"), (new != state["values"]).alias("moving")))
            return F.when(state["moving"], moved).otherwise(state)

        return F.aggregate(turns, start, turn, lambda state: state["values"])

    return _let(into, loop)


def _into(nodes: Column, arcs: Column) -> Column:
    """For each node the arcs that lead to it from nodes that are there, with their place as `at`."""

    def found(names: Column) -> Column:
        placed = F.transform(arcs, lambda a: a.withField("at", F.array_position(names, a["src"]).cast("int")))
        return _let(F.filter(placed, lambda a: a["at"] > 0), lambda present: F.transform(names, lambda n: F.filter(present, lambda a: a["dst"] == n)))

    return _let(F.transform(nodes, lambda n: n["node"]), found)


def topo_levels(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ("recipe",), node: str = "idx") -> DataFrame:
    """Length of the longest path from a source to each node; null on and behind a cycle.

    A recipe of at most `SMALL_ROWS` nodes and edges is moved to one place and
    settled there. Others go by rounds over all of them.
    """
    by = list(by)
    large = _large(nodes, edges, by)
    if large is None:
        return _levels_in_place(nodes, edges, by, node)
    small = _levels_in_place(nodes.join(large, by, "left_anti"), edges.join(large, by, "left_anti"), by, node)
    return small.unionByName(_levels_by_rounds(nodes.join(large, by, "left_semi"), edges.join(large, by, "left_semi"), by, node))


def _levels_in_place(nodes: DataFrame, edges: DataFrame, by: list[str], node: str) -> DataFrame:
    """Levels of small recipes, each worked out in its own row."""
    grouped = _gathered(nodes.select(*by, F.struct(F.col(node).alias("node")).alias("__node")), edges.select(*by, F.struct("src", "dst").alias("__arc")), by)

    def level(_i: Column, _arcs: Column, read: Column) -> Column:
        return F.coalesce(F.array_max(read) + 1, F.lit(0)).cast("int")

    def leveled(names: Column) -> Column:
        values = _settled(_into(names, F.array_distinct("arcs")), "int", level)
        return _let(values, lambda v: F.transform(names, lambda n, i: F.struct(n["node"].alias(node), F.get(v, i).alias("level"))))

    rows = grouped.select(*by, F.inline(_let(F.array_distinct("nodes"), leveled)))
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, node)])
    return rows.select(*by, node, F.when(named, F.col("level")).alias("level"))


def _levels_by_rounds(nodes: DataFrame, edges: DataFrame, by: list[str], node: str) -> DataFrame:
    """Levels of recipes of any size.

    A round takes the nodes whose last predecessor the one before has freed. It
    touches what those lead to and what is freed in part, not the rest.
    """
    place = [*by, node]
    known = cut(nodes.select(*place).distinct())
    # An edge from a node that is not there holds nobody back.
    present = edges.select(*by, "src", F.col("dst").alias(node)).distinct().join(known.withColumnRenamed(node, "src"), [*by, "src"], "left_semi")
    needs = present.groupBy(*place).agg(F.count(F.lit(1)).alias("need"))
    arcs = cut(present.join(needs, place))
    zero = F.lit(0).cast("bigint")
    rounds = Rounds(known.sparkSession)
    touched = rounds.add(known.join(needs, place, "left_anti").select(*place, zero.alias("freed"), zero.alias("need")))
    while True:
        ready = touched.where("freed = need")
        if ready.isEmpty():
            break
        ahead = ready.select(*by, F.col(node).alias("src")).join(arcs, [*by, "src"]).select(*place, F.lit(1).cast("bigint").alias("freed"), "need")
        again = ahead.unionByName(touched.where("freed < need"))
        touched = rounds.add(again.groupBy(*place).agg(F.sum("freed").alias("freed"), F.max("need").alias("need")))
    levels = rounds.all().where("freed = need").select(*place, "level")
    return known.join(levels, place, "left")


def in_declaration_order(df: DataFrame, by: Sequence[str] = ("recipe",), index: str = "idx") -> DataFrame:
    """Rows in the order steps were declared, whatever order they finished in."""
    return df.orderBy(*by, index)


def in_topological_order(levels: DataFrame, by: Sequence[str] = ("recipe",), node: str = "idx") -> DataFrame:
    """Steps sorted so that every step comes after what it depends on."""
    return levels.orderBy(*by, "level", node)


def _peel(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges left when nodes with no way in, or no way out, are taken off until there are none."""
    size = edges.count()
    while True:
        heads = edges.select(*by, F.col("dst").alias("src")).distinct()
        tails = edges.select(*by, F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(heads, [*by, "src"], "left_semi").join(tails, [*by, "dst"], "left_semi"))
        before, size = size, edges.count()
        if size == before:
            return edges


def find_cycles(edges: DataFrame, by: Sequence[str] = ("recipe",)) -> DataFrame:
    """Nodes on a cycle, and which one: (by, node, cycle); nothing that merely leads to or from it.

    Cycles that share a node are one. Each is named by its largest node. Every
    round spreads the largest label forwards, then walks back from the nodes
    that kept their own: what both reach is one component. Memory stays in
    proportion to the edges, however long a cycle is.
    """
    by = list(by)
    rest = cut(edges.select(*by, "src", "dst").distinct())
    loops = rest.where("src = dst").select(*by, F.col("src").alias("node"))
    found = []
    while True:
        rest = _peel(rest, by)
        if rest.isEmpty():
            break
        nodes = rest.select(*by, F.col("src").alias("node")).union(rest.select(*by, "dst")).distinct()
        labels = cut(nodes.withColumn("label", F.col("node")))
        while True:
            into = rest.join(labels.withColumnRenamed("node", "src"), [*by, "src"]).groupBy(*by, F.col("dst").alias("node")).agg(F.max("label").alias("__in"))
            spread = cut(labels.join(into, [*by, "node"], "left").select(*by, "node", F.greatest("label", F.coalesce("__in", "label")).alias("label"), (F.col("__in") > F.col("label")).alias("__up")))
            labels = spread.drop("__up")
            if spread.where("__up").isEmpty():
                break
        same = cut(
            rest.join(labels.select(*by, F.col("node").alias("src"), "label"), [*by, "src"]).join(labels.select(*by, F.col("node").alias("dst"), "label"), [*by, "dst", "label"])
        )
        marked = cut(labels.where("node = label"))
        frontier = marked
        while not frontier.isEmpty():
            back = same.join(frontier.withColumnRenamed("node", "dst"), [*by, "dst", "label"]).select(*by, F.col("src").alias("node"), "label").distinct()
            frontier = cut(back.join(marked, [*by, "node"], "left_anti"))
            marked = cut(marked.unionByName(frontier))
        sizes = marked.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("__n"))
        found.append(marked.join(sizes.where("__n > 1"), [*by, "label"]).select(*by, "node", F.col("label").alias("cycle")))
        gone = marked.select(*by, "node")
        rest = cut(rest.join(gone.withColumnRenamed("node", "src"), [*by, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [*by, "dst"], "left_anti"))
    # A node that waits for itself is a cycle even where no other node is.
    alone = loops.withColumn("cycle", F.col("node")).distinct()
    if not found:
        return alone
    cycles = reduce(DataFrame.unionByName, found)
    return cycles.unionByName(alone.join(cycles, [*by, "node"], "left_anti"))


def reachable(edges: DataFrame, seeds: DataFrame, by: Sequence[str] = ("recipe",), node: str = "idx", carry: Sequence[str] = ()) -> DataFrame:
    """Nodes that edges lead to from the seeds, themselves not included unless a cycle leads back.

    Args:
        seeds: (by, node, carry). `carry` columns travel along, so that each
            seed keeps its own reach.
    """
    by, carry = list(by), list(carry)
    steps = cut(edges.select(*by, F.col("src").alias(node), F.col("dst").alias("__to")).distinct())
    frontier = seeds.select(*by, node, *carry).distinct()
    seen = None
    while True:
        ahead = frontier.join(steps, [*by, node]).select(*by, F.col("__to").alias(node), *carry).distinct()
        fresh = cut(ahead if seen is None else ahead.join(seen, [*by, node, *carry], "left_anti"))
        if fresh.isEmpty():
            return fresh if seen is None else seen
        seen = fresh if seen is None else seen.unionByName(fresh)
        frontier = fresh


def blocked(edges: DataFrame, failed: DataFrame, by: Sequence[str] = ("recipe",), node: str = "idx") -> DataFrame:
    """Steps that cannot run because something upstream failed."""
    failed = cut(failed.select(*by, node).distinct())
    return reachable(edges, failed, by, node).join(failed.select(*by, node), [*by, node], "left_anti")


def lineage(edges: DataFrame, nodes: DataFrame, direction: str = "upstream", by: Sequence[str] = ("recipe",), node: str = "idx") -> DataFrame:
    """Everything each of the given nodes depends on, or everything that depends on it: (by, of, node)."""
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"direction is upstream or downstream, not {direction!r}")
    turned = edges if direction == "downstream" else edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(turned, nodes.withColumn("of", F.col(node)), by, node, carry=["of"])


def own_digest(steps: DataFrame, params: DataFrame, by: Sequence[str] = ("recipe",), node: str = "idx", carry: Sequence[str] = ()) -> DataFrame:
    """The part of a step's key that needs nothing upstream: (by, node, own, carry).

    Args:
        steps: (by, node, image, identity, venv), and columns to `carry` along.
        params: (by, node, field, value, is_path, mutated, wired, fingerprint).
            A path that nothing produced counts by its text and its content;
            one rewritten in place, or wired, by its text only.
    """
    by = list(by)
    content = F.when(F.col("is_path") & ~F.col("mutated") & ~F.col("wired") & F.col("value").isNotNull(), F.coalesce("fingerprint", F.lit("absent")))
    entries = params.groupBy(*by, node).agg(group_digest(encode("field", "value", content)).alias("params"))
    return steps.join(entries, [*by, node], "left").select(*by, node, row_digest("image", "identity", "venv", "params").alias("own"), *carry)


def step_keys(own: DataFrame, wiring: DataFrame, by: Sequence[str] = ("recipe",), node: str = "idx") -> DataFrame:
    """A key per step that changes when anything it is computed from does: (by, node, key).

    A step on or behind a cycle has no key. A step whose `own` is null is not
    cached: it has no key and adds none downstream. A recipe of at most
    `SMALL_ROWS` steps and inputs is moved to one place and settled there.
    Others go by rounds over all of them.

    Args:
        own: see `own_digest`.
        wiring: (by, node, field, pos, src), the inputs produced by other steps.
    """
    by = list(by)
    base = cut(own.select(*by, node, pack(F.col("own")).alias("own")))
    large = _large(base, wiring, by)
    if large is None:
        return _keys_in_place(base, wiring, by, node)
    small = _keys_in_place(base.join(large, by, "left_anti"), wiring.join(large, by, "left_anti"), by, node)
    rest = base.join(large, by, "left_semi").select(*by, node, unpack(F.col("own")).alias("own"))
    return small.unionByName(_keys_by_rounds(rest, wiring.join(large, by, "left_semi"), by, node))


def _keys_in_place(base: DataFrame, wiring: DataFrame, by: list[str], node: str) -> DataFrame:
    """Keys of small recipes, each worked out in its own row; `own` of `base` is packed."""
    grouped = _gathered(base.select(*by, F.struct(F.col(node).alias("node"), "own").alias("__node")), wiring.select(*by, F.struct("src", F.col(node).alias("dst"), "field", "pos").alias("__arc")), by)

    def upstream(arcs: Column, read: Column) -> Column:
        def entry(arc: Column, found: Column) -> Column:
            return F.when(found["key"].isNotNull(), F.sha2(encode(arc["field"], arc["pos"], found["key"]), 256))

        hashed = F.array_compact(F.zip_with(arcs, read, entry))

        def word(w: int) -> Callable[[Column, Column], Column]:
            return lambda total, h: total + hash_words(h)[w]

        def total(entries: Column) -> Column:
            sums = [F.aggregate(entries, F.lit(0).cast("bigint"), word(w)) for w in range(WORDS)]
            return F.when(F.size(entries) > 0, digest_of_sums(F.size(entries), sums))

        return _let(hashed, total)

    def key(i: Column, arcs: Column, read: Column) -> Column:
        own = unpack(F.get("nodes", i)["own"])
        return F.struct(F.when(own.isNotNull(), row_digest(own, upstream(arcs, read))).alias("key"))

    values = _settled(_into(F.col("nodes"), F.col("arcs")), "struct<key:string>", key)
    steps = _let(values, lambda v: F.transform("nodes", lambda n, i: F.struct(n["node"].alias(node), F.get(v, i)["key"].alias("key"))))
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, node)])
    return grouped.select(*by, F.inline(steps)).select(*by, node, F.when(named, F.col("key")).alias("key"))


def _keys_by_rounds(own: DataFrame, wiring: DataFrame, by: list[str], node: str) -> DataFrame:
    """Keys of recipes of any size.

    The digest of what a step reads is a sum, so each round only adds the keys
    just found to the sums of the steps that read them, and touches no others.
    """
    place = [*by, node]
    words = [f"__w{i}" for i in range(WORDS)]
    base = cut(own.select(*place, "own"))
    present = wiring.select(*place, "field", "pos", "src").join(base.select(*by, F.col(node).alias("src")), [*by, "src"], "left_semi")
    needs = present.groupBy(*place).agg(F.count(F.lit(1)).alias("need"))
    arcs = cut(present.join(needs.join(base, place), place))
    zero = F.lit(0).cast("bigint")
    upstream = F.when(F.col("__n") > 0, digest_of_sums(F.col("__n"), [F.col(w) for w in words]))
    key = F.when((F.col("freed") == F.col("need")) & F.col("own").isNotNull(), row_digest(F.col("own"), upstream)).alias("key")
    state = [*place, "own", "freed", "need", "__n", *words]
    rounds = Rounds(base.sparkSession)
    first = base.join(needs, place, "left_anti").select(*place, "own", *[zero.alias(c) for c in state[len(place) + 1 :]])
    touched = rounds.add(first.select(*state, key))
    while True:
        ready = touched.where("freed = need")
        if ready.isEmpty():
            break
        sources = ready.select(*by, F.col(node).alias("src"), F.col("key").alias("src_key"))
        entry = F.when(F.col("src_key").isNotNull(), F.sha2(encode("field", "pos", "src_key"), 256)).alias("__h")
        read = sources.join(arcs, [*by, "src"]).select(*place, "own", "need", entry)
        added = read.select(*place, "own", F.lit(1).cast("bigint").alias("freed"), "need", F.col("__h").isNotNull().cast("bigint").alias("__n"), *[F.coalesce(v, zero).alias(w) for v, w in zip(hash_words(F.col("__h")), words)])
        both = added.unionByName(touched.where("freed < need").select(*state))
        sums = both.groupBy(*place).agg(F.first("own").alias("own"), F.max("need").alias("need"), *[F.sum(c).alias(c) for c in ("freed", "__n", *words)])
        touched = rounds.add(sums.select(*state, key))
    keys = rounds.all().where("freed = need").select(*place, "key")
    return base.select(*place).join(keys, place, "left")


def output_keys(refs: DataFrame, output_wiring: DataFrame, leaf_keys: DataFrame) -> DataFrame:
    """The key of each output across recipe boundaries: (path, field, leaf, leaf_field, key).

    An output of a recipe is the output of the step it is wired from, down to
    the leaf that made it; the leaf's own field names the state. An output with
    no keyed leaf behind it has a null key.

    Args:
        refs: (path, field) to resolve.
        output_wiring: (path, field, src_path, src_field), unique per output.
        leaf_keys: (path, key).
    """
    ends = chase(output_wiring.select("path", "field", "src_path", "src_field"), ["path", "field"], ["src_path", "src_field"])
    wired = ends.withColumn("__w", F.lit(True))
    joined = refs.select("path", "field").join(wired, ["path", "field"], "left")
    leaf = F.when(F.col("__w"), F.col("src_path")).otherwise(F.col("path"))
    leaf_field = F.when(F.col("__w"), F.col("src_field")).otherwise(F.col("field"))
    return joined.select("path", "field", leaf.alias("leaf"), leaf_field.alias("leaf_field")).join(leaf_keys.withColumnRenamed("path", "leaf"), "leaf", "left").select("path", "field", "leaf", "leaf_field", "key")


def merge_edges(a: DataFrame, b: DataFrame, by: Sequence[str] = ("recipe",)) -> DataFrame:
    """Both edge sets without duplicates."""
    return a.select(*by, "src", "dst").unionByName(b.select(*by, "src", "dst")).distinct()


def forward_edges(edges: DataFrame) -> DataFrame:
    """Edges that do not point to an earlier step; a compiled order has none."""
    return edges.where("src >= dst")


def propagate_static(outputs: DataFrame, inputs: DataFrame, wiring: DataFrame, by: Sequence[str] = ("recipe",), node: str = "idx") -> DataFrame:
    """Output values that are known before anything runs: (by, node, field, value, known).

    An output has the value of the input of the same name, wired or constant,
    else its default. A wired one points at the output it reads, so values
    travel along chains of pointers.

    Args:
        outputs: (by, node, field, default).
        inputs: (by, node, field, value), constants.
        wiring: (by, node, field, src, src_field), one source per input; wiring hides a constant.
    """
    by = list(by)
    place = [*by, node, "field"]
    declared = outputs.join(wiring.select(*place, "src", "src_field"), place, "left").join(
        inputs.select(*place, "value", F.lit(True).alias("__given")), place, "left"
    )
    table = cut(
        declared.select(*place, "src", "src_field", F.when(F.col("src").isNull(), F.when(F.col("__given"), F.col("value")).otherwise(F.col("default"))).alias("value"))
    )
    to = [f"__t_{b}" for b in by]
    pointers = table.where("src is not null").select(*place, *[F.col(b).alias(t) for b, t in zip(by, to)], "src", "src_field")
    ends = chase(pointers, place, [*to, "src", "src_field"])
    at_end = table.where("src is null").select(*[F.col(b).alias(t) for b, t in zip(by, to)], F.col(node).alias("src"), F.col("field").alias("src_field"), "value")
    travelled = ends.join(at_end, [*to, "src", "src_field"], "left").select(*place, "value")
    fixed = table.where("src is null").select(*place, "value")
    return fixed.unionByName(travelled).withColumn("known", F.col("value").isNotNull())


def unresolved_inputs(wiring: DataFrame, known: DataFrame, by: Sequence[str] = ("recipe",), node: str = "idx") -> DataFrame:
    """Inputs that read an output whose value only a run can tell: (by, node, field, src, src_field)."""
    given = known.where("known").select(*by, F.col(node).alias("src"), F.col("field").alias("src_field"))
    return wiring.join(given, [*by, "src", "src_field"], "left_anti").select(*by, node, "field", "src", "src_field")
