"""Plans over file inventories: what to keep, clear, rescue and promote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.paths import literal_prefix
from runledger.operators.joins import containment_join
from runledger.plans.paths import ancestors, normalize, parent, within


def glob_regex(pattern: Column) -> Column:
    """A glob as an anchored regex; `*` and `?` stay within a segment, `**` spans them."""
    text = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    text = F.replace(F.replace(text, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0002"))
    text = F.regexp_replace(F.regexp_replace(text, r"\*", "[^/]*"), r"\?", "[^/]")
    text = F.replace(F.replace(text, F.lit("[!"), F.lit("[^")), F.lit("\u0002"), F.lit(".*"))
    return F.concat(F.lit("^"), F.replace(text, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("$"))


def harvest_plan(files: DataFrame, patterns: DataFrame, outputs: DataFrame) -> DataFrame:
    """What to rescue from a run's scratch tree, files and directories, and whether each was declared.

    A directory is there if a file lies below it. What is reached both as a
    declared output and through a glob is declared. Absolute patterns name what
    is already in place, patterns with `..` leave the tree; both are skipped.

    Args:
        files: (run, path), relative.
        patterns: (run, pattern), resolved.
        outputs: (run, path), declared.
    """
    declared = outputs.where(~F.col("path").startswith("/")).select("run", normalize(F.col("path")).alias("path"), F.lit(True).alias("declared"))
    usable = patterns.where(~F.col("pattern").startswith("/") & ~F.col("pattern").rlike(r"(^|/)\.\.(/|$)"))
    # The literal prefix of a glob is an ancestor of whatever it matches: join
    # on that, then test the regex on the few pairs left.
    keyed = usable.select("run", F.coalesce(literal_prefix(F.col("pattern")), F.lit("")).alias("__p"), glob_regex(F.col("pattern")).alias("__g")).distinct()
    prefixes = F.concat(F.array(F.lit("")), ancestors(F.col("path"), proper=True))
    products = files.select("run", F.explode(ancestors(normalize(F.col("path")))).alias("path")).distinct()
    pairs = products.select("run", "path", F.explode(prefixes).alias("__p")).join(keyed, ["run", "__p"]).where("path rlike __g")
    matched = pairs.select("run", "path", F.lit(False).alias("declared"))
    return declared.unionByName(matched).groupBy("run", "path").agg(F.bool_or("declared").alias("declared"))


def promote_plan(files: DataFrame, patterns: DataFrame, outputs: DataFrame, workspace: DataFrame) -> DataFrame:
    """What becomes of each scratch file: (run, path, product, action).

    A file goes with the outermost thing to rescue that it is or lies in, its
    `product`; one that is in none stays behind.

    Args:
        workspace: (path, is_dir), what lies at the destinations now.
    """
    plan = harvest_plan(files, patterns, outputs)
    there = workspace.groupBy("path").agg(F.bool_or("is_dir").alias("is_dir"))
    inside = files.select("run", "path").distinct().select("run", "path", F.explode(ancestors(normalize(F.col("path")))).alias("product"))
    rescued = inside.join(plan.withColumnRenamed("path", "product"), ["run", "product"])
    outermost = rescued.groupBy("run", "path").agg(F.min_by(F.struct("product", "declared"), F.length("product")).alias("o")).select("run", "path", "o.*")
    judged = files.select("run", "path").distinct().join(outermost, ["run", "path"], "left").join(there.withColumnRenamed("path", "product"), "product", "left")
    action = (
        F.when(F.col("declared").isNull(), F.lit("leave"))
        .when(F.col("is_dir").isNull(), F.lit("move"))
        .when(F.col("is_dir") & ~F.col("declared"), F.lit("refuse"))
        .otherwise(F.lit("replace"))
    )
    return judged.select("run", "path", "product", action.alias("action"))


def keep_paths(inputs: DataFrame, write_targets: DataFrame) -> DataFrame:
    """Paths of inputs that carry data in: path inputs that are no write targets.

    Args:
        inputs: (step, field, path). write_targets: (step, field).
    """
    return inputs.where("path is not null").join(write_targets, ["step", "field"], "left_anti").select("step", normalize(F.col("path")).alias("path")).distinct()


def stale_outputs(outputs: DataFrame, kept: DataFrame, existing: DataFrame, workspace: str) -> DataFrame:
    """Declared outputs that exist already, and whether to clear them first: (step, path, action).

    An output that overlaps a kept input is that input's data; one that holds
    the workspace is never cleared.

    Args:
        outputs: (step, path). kept: (step, path). existing: (path).
    """
    present = outputs.select("step", normalize(F.col("path")).alias("path")).distinct().join(existing.select("path"), "path", "left_semi")
    touching = containment_join(present, kept, by=["step"]).select("step", F.col("l.path").alias("path")).distinct().withColumn("kept", F.lit(True))
    holds = within(F.lit(workspace), F.col("path"))
    action = F.when(F.col("kept"), F.lit("keep: input")).when(holds, F.lit("keep: holds the workspace")).otherwise(F.lit("clear"))
    return present.join(touching, ["step", "path"], "left").select("step", "path", action.alias("action"))


def declared_dirs(outputs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Directories a scope is declared to write into, each with its first declaration.

    Outputs come before patterns; `.`, and paths with `..`, declare nothing.

    Args:
        outputs: (scope, pos, path, source). patterns: (scope, pos, pattern, source).
    """
    from_outputs = outputs.select("scope", F.lit(0).alias("rank"), "pos", parent(normalize(F.col("path"))).alias("dir"), "source").where(
        r"dir <> '.' and not dir rlike '(^|/)\\.\\.(/|$)'"
    )
    from_patterns = patterns.select("scope", F.lit(1).alias("rank"), "pos", literal_prefix(F.col("pattern")).alias("dir"), "source")
    every = from_outputs.unionByName(from_patterns.where("dir is not null"))
    first = F.min(F.struct("rank", "pos", "source"))
    return every.groupBy("scope", "dir").agg(first.alias("f")).select("scope", "dir", "f.rank", "f.pos", "f.source")


def directory_modes(paths: DataFrame) -> DataFrame:
    """Parent directories of a scope's paths: writable if any contributor writes, and first position.

    Args:
        paths: (scope, pos, path, writable).
    """
    return paths.select("scope", "pos", "writable", parent(normalize(F.col("path"))).alias("dir")).groupBy("scope", "dir").agg(
        F.bool_or("writable").alias("writable"), F.min("pos").alias("first_pos")
    )


def tree_size(files: DataFrame, root: str = "root") -> DataFrame:
    """Bytes and files under each root."""
    return files.groupBy(root).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_files"))


def can_afford(needed: Column, available: Column, shares_blocks: Column) -> Column:
    """Whether a copy fits; one that shares blocks with its source always does."""
    return shares_blocks | (needed <= available)
