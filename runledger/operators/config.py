"""Layered settings and nested documents in long form: (doc, path, value, rank)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.plans.deal import dealt, merged, tasks_for
from runledger.plans.lineage import cut
from runledger.plans.paths import ancestors, normalize, parent, within

# Fixed value: the key of a directive that names what its node inherits.
USE = "_use"
# Fixed value: the key of a directive that names the documents its node is read from.
INCLUDE = "_include"
# How readers write a map without keys.
EMPTY_MAP = "{}"


def effective(settings: DataFrame, key: str = "setting_key", rank: str = "layer_rank", value: str = "value") -> DataFrame:
    """Each key's value from its highest layer that gives one, and that layer."""
    given = F.when(F.col(value).isNotNull(), F.col(rank))
    return settings.groupBy(key).agg(F.max_by(value, given).alias(value), F.max(given).alias(rank))


def _prefixes(path: Column) -> Column:
    """Proper ancestors of a dotted path."""
    parts = F.split(path, r"\.")
    numbers = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda n: F.array_join(F.slice(parts, 1, n), "."))


def deep_merge(layers: DataFrame, by: Sequence[str] = ("doc",), rank: str = "rank") -> DataFrame:
    """Merge layers of documents: maps key by key, anything else replaced by the higher layer.

    A value hides, in lower layers, values at its path, values under its path
    (it replaced their map), and values at the paths above it (its map replaced
    them).

    Args:
        layers: (by, path, value, rank), one row per leaf; a larger rank wins.
    """
    by = list(by)
    # Texts and trails of ranks are kept several times over on the way.
    tasks = tasks_for(layers, weight=8)
    top = dealt(layers, tasks, [*by, "path"]).groupBy(*by, "path").agg(F.max_by("value", rank).alias("value"), F.max(rank).alias("__r"))
    up = top.select(*by, F.col("path").alias("leaf"), F.col("__r").alias("leaf_rank"), F.explode(_prefixes(F.col("path"))).alias("path"))
    up = dealt(up, tasks, [*by, "path"])
    # An empty map replaces values at and above its path, but merges with the map below it.
    maps = top.where(~F.col("value").eqNullSafe(EMPTY_MAP))
    replaced_map = up.join(merged(maps.select(*by, "path", "__r"), tasks), [*by, "path"]).where(F.col("__r") > F.col("leaf_rank")).select(*by, F.col("leaf").alias("path"))
    map_above = up.groupBy(*by, "path").agg(F.max("leaf_rank").alias("__m"))
    replaced_value = top.join(merged(map_above, tasks), [*by, "path"]).where(F.col("__m") > F.col("__r")).select(*by, "path")
    hidden = dealt(replaced_map.unionByName(replaced_value), tasks, [*by, "path"]).distinct()
    left = top.join(merged(hidden, tasks), [*by, "path"], "left_anti")
    # An empty map with something left below it is that map. Only documents that hold one are looked at.
    empty = left.where(F.col("value") == EMPTY_MAP).select(*by, "path")
    beside = left.join(empty.select(*by).distinct(), by, "left_semi")
    filled = beside.select(*by, F.explode(_prefixes(F.col("path"))).alias("path")).join(empty, [*by, "path"], "left_semi")
    shown = left.join(filled, [*by, "path"], "left_anti")
    return shown.select(*by, "path", "value", F.col("__r").alias(rank))


def unknown_uses(leaves: DataFrame, by: Sequence[str] = ("doc",)) -> DataFrame:
    """Directives that name a path the document does not have: (by, at, target, stuck_at)."""
    by = list(by)
    named = _directives(leaves, by).select(*by, "at", "target").distinct()
    nodes = leaves.select(*by, F.explode(F.concat(_prefixes(F.col("path")), F.array("path"))).alias("prefix")).distinct()
    parts = F.split("target", r"\.")
    steps = named.select("*", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).withColumn("prefix", F.array_join(F.slice(F.split("target", r"\."), F.lit(1), F.col("n")), "."))
    missing = steps.join(nodes, [*by, "prefix"], "left_anti").groupBy(*by, "at", "target").agg(F.min("n").alias("n"))
    return missing.select(*by, "at", "target", F.element_at(parts, F.col("n").cast("int")).alias("stuck_at"))


def _directives(leaves: DataFrame, by: list[str], key: str = USE) -> DataFrame:
    """(by, at, target, pos) of `<at>.<key>` leaves, or `<key>` at the root; a list names several, last wins."""
    at = F.when(F.col("path") == key, F.lit("")).otherwise(F.regexp_replace("path", rf"\.{key}$", ""))
    rows = leaves.where((F.col("path") == key) | F.col("path").endswith(f".{key}"))
    carried = [c for c in rows.columns if c not in (*by, "path", "value")]
    return rows.select(*by, *carried, at.alias("at"), F.posexplode(F.split("value", r"\s*,\s*")).alias("pos", "target"))


# What a node says itself wins over all it inherits.
OWN = (1 << 20, 0)


def _pulled(pending: DataFrame, under: DataFrame, place: list[str], named: list[str]) -> DataFrame:
    """Leaves that directives bring to their nodes, as (place, path, value, trail).

    `trail` says how a leaf came: the depth and list position of each directive
    on the way, depths counted from the node the table is relative to.
    """
    depth = F.when(F.col("at") == "", F.lit(0)).otherwise(F.size(F.split("at", r"\.")))
    way = under.select(*named, F.col("rest").alias("__rest"), F.col("value").alias("__value"), F.col("trail").alias("__trail"))
    path = F.when(F.col("at") == "", F.col("__rest")).when(F.col("__rest") == "", F.col("at")).otherwise(F.concat("at", F.lit("."), "__rest"))
    here = F.array(F.struct(depth.alias("depth"), F.col("pos").alias("pos")))
    further = F.transform("__trail", lambda hop: F.struct((hop["depth"] + depth).alias("depth"), hop["pos"].alias("pos")))
    joined = pending.join(way, named)
    return joined.select(*place, path.alias("path"), F.col("__value").alias("value"), F.concat("trail", here, further).alias("trail"))


def _followed(source: DataFrame, under: DataFrame, by: list[str], shared: list[str], key: str, longest: int) -> DataFrame:
    """Documents with their directives followed to the end: (by, path, value).

    Every round replaces the directives still open in what a name stands for by
    what their own names stand for so far, so a chain of n takes log2(n) rounds.

    Args:
        source: (by, path, value). under: (shared, target, rest, value), what a name stands for.
        shared: Columns within which names are unique.
        longest: Steps of the longest chain there can be without a ring.
    """
    is_open = lambda column: (F.col(column) == key) | F.col(column).endswith(f".{key}")
    none = F.array().cast("array<struct<depth:int,pos:int>>")
    place, named = [*shared, "__of"], [*shared, "target"]
    under = cut(under.withColumn("trail", none))
    for _ in range(longest.bit_length() + 1):
        opened = under.where(is_open("rest"))
        if opened.isEmpty():
            break
        pending = _directives(opened.select(*shared, F.col("target").alias("__of"), F.col("rest").alias("path"), "value", "trail"), place, key)
        more = _pulled(pending, under, place, named).withColumnsRenamed({"__of": "target", "path": "rest"})
        under = cut(under.where(~is_open("rest")).unionByName(more))
    else:
        raise ValueError(f"`{key}` directives name each other in a ring")
    own = source.withColumn("trail", none)
    brought = _pulled(_directives(own, by, key), under, by, named)
    last = F.struct(F.lit(OWN[0]).alias("depth"), F.lit(OWN[1]).alias("pos"))
    every = own.where(~is_open("path")).unionByName(brought)
    ranked = cut(every.withColumn("rank", F.concat("trail", F.array(last))).drop("trail"))
    return deep_merge(ranked, by).drop("rank")


def resolve_uses(leaves: DataFrame, by: Sequence[str] = ("doc",)) -> DataFrame:
    """Documents with every `_use: dotted.path` replaced by what it names: (by, path, value).

    A node's own keys win over what it inherits, what a later directive of a
    list names wins over an earlier one, and a directive deeper in the tree
    wins over one above it. Inherited directives are followed in turn, a chain
    of n in log2(n) rounds; a chain of more steps than its document has
    directives goes round in a ring, which is an error.

    Args:
        leaves: (by, path, value).
    """
    by = list(by)
    source = cut(leaves.select(*by, "path", "value"))
    # Every node a directive may name, with the leaves under it (and itself).
    nodes = F.explode(F.concat(_prefixes(F.col("path")), F.array("path"))).alias("target")
    directives = _directives(source, by)
    named = directives.select(*by, "target").distinct()
    rest = F.substr(F.col("path"), F.length("target") + 2).alias("rest")
    under = source.select(*by, nodes, "path", "value").join(named, [*by, "target"], "left_semi").select(*by, "target", rest, "value")
    longest = directives.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return _followed(source, under, by, by, USE, longest)


def resolve_includes(leaves: DataFrame, doc: str = "doc") -> DataFrame:
    """Documents with every `_include: name` replaced by that document's content: (doc, path, value).

    The content lies at the node that includes it, under the node's own keys; of
    a list of names a later one wins over an earlier one, and what is included
    deeper in the tree over what is above it. Included documents include in
    turn, a chain of n in log2(n) rounds; one of more steps than documents
    include is a ring, an error. A name without a document includes nothing.

    Args:
        leaves: (doc, path, value).
    """
    source = cut(leaves.select(F.col(doc).alias("doc"), "path", "value"))
    directives = _directives(source, ["doc"], INCLUDE)
    content = source.select(F.col("doc").alias("target"), F.col("path").alias("rest"), "value").join(directives.select("target").distinct(), "target", "left_semi")
    longest = directives.select("doc").distinct().count()
    return _followed(source, content, ["doc"], [], INCLUDE, longest).withColumnRenamed("doc", doc)


def named_includes(leaves: DataFrame, packages: DataFrame | None = None, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Includes as users write them, by the documents they mean: (leaves for `resolve_includes`, problems).

    Documents are named by their paths. An entry is a path relative to the
    including document's folder, or `(package.sub)file`, which lies in folder
    `sub` of the package with the longest name that the dotted one begins with.
    What a package holds may include nothing outside its root. Problems are
    (doc, at, entry, reason); such entries include nothing.

    Args:
        leaves: (doc, path, value).
        packages: (package, root), the folders of packages; none by default.
    """
    rows = cut(leaves.select(normalize(F.col(doc)).alias("doc"), "path", "value"))
    if packages is None:
        packages = rows.sparkSession.createDataFrame([], "package string, root string")
    roots = packages.select("package", normalize(F.col("root")).alias("root"))
    entries = _directives(rows, ["doc"], INCLUDE).withColumnRenamed("target", "entry").where("entry <> ''")
    package = F.nullif(F.regexp_extract("entry", r"^\(([\w.]+)\)", 1), F.lit(""))
    file = F.regexp_replace("entry", r"^\([\w.]+\)", "")
    told = entries.select("*", package.alias("dotted"), file.alias("file"))
    # The package by its longest name, and the one whose folder the document lies in: both by equality on what leads there.
    names = told.where("dotted is not null").select("dotted").distinct().select("dotted", F.explode(F.concat(_prefixes(F.col("dotted")), F.array("dotted"))).alias("package"))
    folders = names.join(roots, "package").groupBy("dotted").agg(F.max_by(F.struct("package", "root"), F.length("package")).alias("p"))
    rest = F.translate(F.substr("dotted", F.length("p.package") + 1), ".", "/")
    folders = folders.select("dotted", F.concat("p.root", rest).alias("folder"))
    # All documents of a package share its root, so the roots, one a package, are sent to them.
    tasks = tasks_for(rows, weight=8)
    holders = dealt(told.select("doc"), tasks, ["doc"]).distinct().select("doc", F.explode(ancestors(F.col("doc"))).alias("root")).join(F.broadcast(roots.select("root")), "root", "left_semi")
    holders = holders.groupBy("doc").agg(F.max_by("root", F.length("root")).alias("held_by"))
    placed = dealt(told.join(folders, "dotted", "left"), tasks, ["doc"]).join(merged(holders, tasks), "doc", "left")
    base = F.when(F.col("dotted").isNotNull(), F.col("folder")).otherwise(parent(F.col("doc")))
    target = normalize(F.when(F.col("dotted").isNull() & F.col("file").startswith("/"), F.col("file")).otherwise(F.concat(base, F.lit("/"), F.col("file"))))
    bound = F.coalesce("folder", "held_by")
    known = dealt(rows.select(F.col("doc").alias("target")), tasks, ["target"]).distinct().withColumn("there", F.lit(True))
    placed = placed.select("doc", "at", "pos", "entry", "dotted", "folder", "file", bound.alias("bound"), target.alias("target"))
    meant = cut(dealt(placed, tasks, ["target"]).join(merged(known, tasks), "target", "left"))
    reason = (
        F.when(F.col("file") == "", F.lit("no file name"))
        .when(F.col("dotted").isNotNull() & F.col("folder").isNull(), F.lit("no such package"))
        .when(F.col("bound").isNotNull() & ~within(F.col("target"), F.col("bound")), F.lit("outside the package root"))
        .when(F.col("there").isNull(), F.lit("no such document"))
    )
    judged = meant.withColumn("reason", reason)
    at = F.when(F.col("at") == "", F.lit(INCLUDE)).otherwise(F.concat("at", F.lit(f".{INCLUDE}")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda e: e["target"])
    named = judged.where("reason is null").groupBy("doc", at.alias("path")).agg(F.array_join(in_order, ",").alias("value"))
    others = rows.where((F.col("path") != INCLUDE) & ~F.col("path").endswith(f".{INCLUDE}"))
    return others.unionByName(named).withColumnRenamed("doc", doc), judged.where("reason is not null").select(F.col("doc").alias(doc), "at", "entry", "reason")


def merge_meta(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """One row per field declared on either side: the output's attributes where they say something.

    Args:
        defaults: attribute -> the value that means nothing was said.
    """
    a = inputs.select(*keys, *[F.col(c).alias(f"__i_{c}") for c in defaults], F.lit(True).alias("__in"))
    b = outputs.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in defaults], F.lit(True).alias("__out"))
    columns = []
    for name, default in defaults.items():
        said = F.col("__out").isNotNull() & (F.col("__in").isNull() | ~F.col(f"__o_{name}").eqNullSafe(F.lit(default)))
        columns.append(F.when(said, F.col(f"__o_{name}")).otherwise(F.col(f"__i_{name}")).alias(name))
    return a.join(b, list(keys), "full_outer").select(*keys, *columns)


def contained(includes: DataFrame, roots: DataFrame) -> DataFrame:
    """Includes with their resolved path and whether it stays under the root they were reached through.

    Args:
        includes: (package, base, entry), `entry` being relative to `base`.
        roots: (package, root).
    """
    joined = F.when(F.col("entry").startswith("/"), F.col("entry")).otherwise(F.concat("base", F.lit("/"), "entry"))
    resolved = includes.withColumn("resolved", normalize(joined)).join(roots.select("package", normalize(F.col("root")).alias("root")), "package", "left")
    return resolved.select(*includes.columns, "resolved", F.coalesce(within(F.col("resolved"), F.col("root")), F.lit(False)).alias("contained"))
