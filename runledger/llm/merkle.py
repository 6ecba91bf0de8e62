"""Merkle manifest of a table: every row's proof by a butterfly exchange.

Rows are numbered along their order and dealt into aligned blocks of a power of
the fan-out. A task folds a block to one digest. Then blocks swap digests round
by round: in round r each block meets those that differ from it in digit r of
its number alone, gets the digests of their subtrees and hashes the parent for
itself. All blocks of a subtree repeat that hash, and so after a number of rounds
that is the logarithm of the blocks every block holds its whole upper proof; no
pass leads down again. The roots of the groups are folded the same way.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.plans.lineage import cut

FANOUT = 8
#: Rows that one task folds by itself, a power of the fan-out.
BLOCK = FANOUT**4
STEP = "struct<left: string, right: string>"
ARROW_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values, each as byte count, colon and text, or `-` if null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, digest: str, group: str, order: str, block: int = BLOCK) -> DataFrame:
    """`rows` with subroot, root and proof; every row is a leaf of its group's tree.

    Leaves of a group ascend by `order`, rows of one `order` by digest. While a
    level has several nodes, each run of 8 becomes the hash of its digests as
    text; a run that ends the level may be shorter, down to one node. A single
    leaf is its own subroot. Subroots, by group, are the leaves of the tree
    whose root is `root`. `proof` lists, from the leaf up, the joined digests
    left and right of the node's own in its run.

    Null groups are one group, the first; null order values come first. Repeated
    rows are leaves each. An empty table gives no rows. Columns named subroot,
    root or proof are replaced; others are carried along, so give those that are
    needed. `rows` must give the same rows in the same partitions when it is
    read again, as files do.

    Args:
        digest: Column with the leaves' digests, hex text, not null.
        block: How many rows a task folds at once; a power of 8.
    """
    kept = [c for c in rows.columns if c not in ("subroot", "root", "proof")]
    nodes = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.struct(F.col(order)).alias("o"), F.col(digest).alias("h"), F.struct(*kept).alias("row")
    )
    leaves = _numbered(nodes, block)
    upper = _exchanged(leaves, block)
    tops = upper.where("block = 0").select(F.lit("").alias("g"), F.struct("g").alias("o"), "h", F.struct("g").alias("row"))
    top_leaves = _numbered(tops, block)
    above = _proved(top_leaves, _exchanged(top_leaves, block).withColumn("root", F.col("h")), block).select("row.g", F.col("root"), F.col("proof").alias("above"))
    paths = upper.join(above, "g").select("g", "block", "h", "root", F.concat("path", "above").alias("path"))
    return _proved(leaves, paths, block).select("row.*", "subroot", "root", "proof")


def _numbered(nodes: DataFrame, block: int) -> DataFrame:
    """(g, block, pos, n, h, row): rows by their place in their group and the group's size.

    Ranges of (g, o, h) are sorted in their tasks; a salt lets rows that are
    equal in all three lie in many ranges. A range adds what earlier ones hold.
    """
    salted = nodes.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranges = salted.repartitionByRange("g", "o", "h", "salt").sortWithinPartitions("g", "o", "h")
    held = cut(ranges.select("g", "h", "row", F.monotonically_increasing_id().alias("id")))
    part = F.shiftright("id", 33)
    pieces = held.groupBy("g", part.alias("part")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("g").orderBy("part")
    starts = pieces.select(
        "g", "part", "first", (F.sum("rows").over(earlier) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy("g")).alias("n")
    )
    placed = held.withColumn("part", part).join(starts, ["g", "part"]).withColumn("pos", F.col("before") + F.col("id") - F.col("first"))
    return placed.select("g", F.floor(F.col("pos") / block).alias("block"), "pos", "n", "h", "row")


def _levels(digests: list[str], whole: bool, block: int) -> list[list[str]]:
    """Nodes of a block level by level, the last of which is one node."""
    levels, width = [digests], 1
    while len(levels[-1]) > 1 or (not whole and width < block):
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
        width *= FANOUT
    return levels


def _exchanged(leaves: DataFrame, block: int) -> DataFrame:
    """(g, block, h, path): the group's root and, for each block, the siblings on the way up to it."""

    def folded(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        root = _levels(table["h"].to_pylist(), table["n"][0].as_py() <= block, block)[-1][0]
        return pa.table({c: table[c][:1] for c in ("g", "block", "n")} | {"h": [root]})

    blocks = leaves.select("g", "block", "pos", "n", "h").groupBy("g", "block").applyInArrow(folded, "g string, block long, n long, h string")
    blocks = cut(blocks.select("g", "block", F.ceil(F.col("n") / block).alias("n"), "h", F.array().cast(f"array<{STEP}>").alias("path")))
    most = blocks.agg(F.max("n")).first()[0] or 0
    span = 1
    while span < most:
        blocks = _swapped(blocks, span)
        span *= FANOUT
    return cut(blocks.select("g", "block", "h", "path"))


def _swapped(blocks: DataFrame, span: int) -> DataFrame:
    """One round: subtrees of `span` blocks become ones of eight times as many.

    A block meets one block of every other subtree of its run. The last subtree
    of a level may have fewer blocks; each of them then answers several.
    """
    low, digit = F.col("block") % span, F.floor(F.col("block") / span) % FANOUT
    width = F.least(F.lit(span), F.col("n") - F.floor(F.col("block") / span) * span)
    grows = F.col("n") > span
    to = F.explode(F.when(grows & (digit > 0), F.sequence(low, F.lit(span - 1).cast("long"), width)).otherwise(F.array(low)))
    sent = blocks.select("g", "block", "n", "h", "path", low.alias("low"), digit.alias("digit"), F.floor(F.col("block") / (span * FANOUT)).alias("run"), to.alias("to"))
    own = F.col("low") == F.col("to")
    member = F.struct("digit", "h", F.when(own, F.col("block")).alias("block"), F.when(own, F.col("path")).alias("path"), "n")
    runs = sent.groupBy("g", "run", "to").agg(F.sort_array(F.collect_list(member)).alias("m"))
    me = runs.select("g", "m", F.explode(F.filter("m", lambda x: x["block"].isNotNull())).alias("me"))

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("m", keep), lambda x: x["h"]), "")

    digit, grows = F.col("me.digit"), F.col("me.n") > span
    step = F.struct(joined(lambda x: x["digit"] < digit).alias("left"), joined(lambda x: x["digit"] > digit).alias("right"))
    return me.select(
        "g",
        "me.block",
        "me.n",
        F.when(grows, F.sha2(joined(lambda x: x["digit"] >= 0), 256)).otherwise(F.col("me.h")).alias("h"),
        F.when(grows, F.concat("me.path", F.array(step))).otherwise(F.col("me.path")).alias("path"),
    )


def _proved(leaves: DataFrame, paths: DataFrame, block: int) -> DataFrame:
    """(row, subroot, root, proof) of every leaf, from (g, block, h, root, path)."""
    row = leaves.schema["row"]
    schema = T.StructType([row, *[T.StructField(c, T.StringType()) for c in ("subroot", "root")], T.StructField("proof", T._parse_datatype_string(f"array<{STEP}>"))])

    def proofs(mine: pa.Table, path: pa.Table) -> pa.Table:
        mine = mine.sort_by("pos")
        levels = _levels(mine["h"].to_pylist(), len(mine) == 0 or mine["n"][0].as_py() <= block, block)
        upper = path["path"][0].as_py() if len(path) else []
        sides = []
        for nodes in levels[:-1]:
            runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
            sides.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
        left, right = [], []
        for i in range(len(mine)):
            for side in sides:
                own = side[i]
                left.append(own[0])
                right.append(own[1])
                i //= FANOUT
            for s in upper:
                left.append(s["left"])
                right.append(s["right"])
        steps = len(sides) + len(upper)
        values = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(range(0, (len(mine) + 1) * steps, steps) if steps else [0] * (len(mine) + 1), pa.int32()), values)
        root = {c: pa.array([path[f][0].as_py()] * len(mine), pa.string()) for c, f in (("subroot", "h"), ("root", "root"))}
        return pa.table({"row": mine["row"]} | root | {"proof": proof.cast(ARROW_PROOF)})

    paths = paths.select("g", "block", "h", "root", "path")
    return leaves.select("g", "block", "pos", "n", "h", "row").groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(proofs, schema)
