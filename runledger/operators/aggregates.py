"""Aggregates over run records, files and version tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.operators.scatter import gather
from runledger.plans.digest import encode, group_digest
from runledger.plans.paths import ancestors

# An unlimited quota as the newer and the older control-group
# files write it.
NO_LIMIT = "max"
UNLIMITED = 1 << 62


def is_pinned(containerized: Column, image_digest: Column, venv: Column) -> Column:
    """Whether one step's environment is fixed: no venv, and a digest if it ran in a container."""
    return (~containerized | image_digest.isNotNull()) & venv.isNull()


def _pinned() -> Column:
    return is_pinned(F.col("containerized"), F.col("image_digest"), F.col("venv"))


def pinned(records: DataFrame, run: str = "run_id") -> DataFrame:
    """Whether every step of each run, at any depth, is pinned."""
    return records.groupBy(run).agg(F.bool_and(_pinned()).alias("pinned"))


def unpinned_steps(records: DataFrame, run: str = "run_id", index: str = "idx", name: str = "step") -> DataFrame:
    """The steps that make a run unpinned, with their pre-order index to sort by."""
    return records.where(~_pinned()).select(run, index, name)


def tree_fingerprint(files: DataFrame, roots: DataFrame | None = None, root: str = "root", sample: str | None = None) -> DataFrame:
    """One digest per tree over (relpath, mtime, size[, sample]), in no particular order.

    Args:
        files: (root, relpath, mtime, size).
        roots: (root, status), status null, `missing` or `unreadable`. A missing
            tree has no fingerprint; an unreadable one has a fixed other one; a
            readable one without files has that of the empty tree.
    """
    fields = ["relpath", "mtime", "size", *([sample] if sample else [])]
    found = files.groupBy(root).agg(group_digest(encode(*fields)).alias("fingerprint"))
    if roots is None:
        return found
    empty = F.sha2(F.lit("empty tree"), 256)
    value = (
        F.when(F.col("status") == "missing", F.lit(None).cast("string"))
        .when(F.col("status") == "unreadable", F.sha2(F.lit("unreadable tree"), 256))
        .otherwise(F.coalesce("fingerprint", empty))
    )
    return roots.join(found, root, "left").select(root, value.alias("fingerprint"))


def combine_keys(df: DataFrame, by: Sequence[str], key: str, order: str) -> DataFrame:
    """One key standing for an ordered list of keys; null only if all of them are."""
    digest = group_digest(encode(order, key))
    return df.groupBy(*by).agg(F.when(F.count(key) > 0, digest).alias("combined"))


def dists_digest(df: DataFrame, by: Sequence[str], name: str = "name", version: str = "version") -> DataFrame:
    """One digest per environment over its `name==version` entries, in no particular order."""
    return df.groupBy(*by).agg(group_digest(F.concat(F.col(name), F.lit("=="), F.col(version))).alias("digest"))


def run_outcome(records: DataFrame, run: str = "run_id", index: str = "idx") -> DataFrame:
    """A run's return code: that of its first failing step in declaration order, else 0."""
    failed_at = F.when(F.col("returncode") != 0, F.col(index))
    return records.groupBy(run).agg(F.coalesce(F.min_by("returncode", failed_at), F.lit(0)).alias("returncode"))


def collect_outputs(results: DataFrame, output_wiring: DataFrame) -> DataFrame:
    """A recipe's own outputs: (run_id, field, value), null where the source gave none.

    Args:
        results: (run_id, step, field, value).
        output_wiring: (run_id, field, src_step, src_field).
    """
    sources = results.select("run_id", F.col("step").alias("src_step"), F.col("field").alias("src_field"), "value")
    return output_wiring.join(sources, ["run_id", "src_step", "src_field"], "left").select("run_id", "field", "value")


def collect_text(records: DataFrame, text: str, run: str = "run_id", index: str = "idx") -> DataFrame:
    """The steps' text joined in declaration order, blanks left out (in parts, see `gather`)."""
    return gather(records, [run], index, [], texts=[text])


def any_resources(steps: DataFrame, path: str = "path") -> DataFrame:
    """For each dotted path and each of its parents, whether anything at or under it declares a footprint."""
    parts = F.split(path, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    declared = F.col("cpus").isNotNull() | F.col("memory").isNotNull()
    return steps.select(F.explode(prefixes).alias(path), declared.alias("declared")).groupBy(path).agg(F.bool_or("declared").alias("any_resources"))


def parse_limit(raw: Column) -> Column:
    """A control-group memory limit in bytes; null where it does not limit."""
    value = raw.try_cast("bigint")
    return F.when((raw != NO_LIMIT) & (value < UNLIMITED), value)


def parse_cpu_limit(raw: Column) -> Column:
    """A `quota period` pair in cores; null where it does not limit."""
    quota = F.substring_index(raw, " ", 1)
    period = F.when(raw.contains(" "), F.substring_index(raw, " ", -1).try_cast("bigint")).otherwise(F.lit(100000))
    return F.when((quota != NO_LIMIT) & (period != 0), F.try_divide(quota.try_cast("bigint"), period))


def tightest_limit(leaves: DataFrame, limits: DataFrame) -> DataFrame:
    """The smallest limit on each leaf or any of its ancestors, null where none limits.

    Args:
        leaves: (path). limits: (path, limit), null limit = none.
    """
    up = leaves.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("__p"))
    held = limits.where("limit is not null").select(F.col("path").alias("__p"), "limit")
    return up.join(held, "__p", "left").groupBy("path").agg(F.min("limit").alias("limit"))


def resolve_demand(steps: DataFrame, pools: DataFrame) -> DataFrame:
    """Footprints with `all` replaced by the pool's count, and whether they can ever fit.

    Args:
        steps: (pool, step, cpus, cpus_all, memory). pools: (pool, total_cpus, total_memory).
    """
    cpus = F.when(F.coalesce("cpus_all", F.lit(False)), F.col("total_cpus")).otherwise(F.col("cpus"))
    exceeds = F.coalesce(cpus > F.col("total_cpus"), F.lit(False)) | F.coalesce(F.col("memory") > F.col("total_memory"), F.lit(False))
    return steps.join(pools, "pool", "left").select("pool", "step", cpus.alias("cpus"), "memory", exceeds.alias("exceeds"))


def step_status(job_ids: DataFrame, jobs: DataFrame) -> DataFrame:
    """State of each step's job, `UNKNOWN` until accounting has its row.

    Args:
        job_ids: (step, job_id). jobs: (job_id, state); rows of parts of a job
            (`id.batch`) never equal its id.
    """
    return job_ids.join(jobs.select("job_id", "state"), "job_id", "left").select("step", "job_id", F.coalesce("state", F.lit("UNKNOWN")).alias("state"))


def status_rollup(records: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Counts at each level and its subtotals; `all` stands for what is summed over."""
    labels = [F.when(F.grouping(c) == 1, F.lit("all")).otherwise(F.col(c).cast("string")).alias(f"{c}_label") for c in levels]
    return records.rollup(*levels).agg(*labels, F.count(F.lit(1)).alias("n")).select(*[F.col(f"{c}_label").alias(c) for c in levels], "n")


def version_key(tag: Column) -> Column:
    """A `v1.2.3` tag as numbers to compare; trailing zeros do not count. Null for other tags."""
    numbers = F.transform(F.split(F.substr(tag, F.lit(2)), r"\."), lambda p: p.try_cast("bigint"))
    last = F.aggregate(
        F.sequence(F.lit(1), F.size(numbers)), F.lit(0), lambda acc, i: F.when(F.element_at(numbers, i) != 0, i).otherwise(acc)
    )
    return F.when(tag.rlike(r"^v[0-9]+(\.[0-9]+)*$"), F.slice(numbers, 1, last))


def latest_version(tags: DataFrame, by: Sequence[str], tag: str = "tag") -> DataFrame:
    """The newest version tag of each group; of equal ones the longest spelling."""
    key = version_key(F.col(tag))
    return tags.where(key.isNotNull()).groupBy(*by).agg(F.max_by(F.col(tag), F.struct(key, F.length(tag))).alias(tag))


def loop_counts(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Declared, performed and skipped iterations."""
    skipped = F.coalesce("skipped", F.lit(False))
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("declared"), F.count_if(~skipped).alias("performed"), F.count_if(skipped).alias("skipped")
    )


def eligible_fields(fields: DataFrame) -> DataFrame:
    """Which mutated fields can be snapshotted, and why the others cannot.

    Args:
        fields: (step, field, paths array, scattered, wired, keys array); a
            field without a value has null paths and is left out. A list of
            one path or one key is that path or key.
    """
    n_keys = F.when(F.col("keys").isNull(), F.lit(0)).otherwise(F.size("keys"))
    single = (n_keys == 1) & F.get("keys", 0).isNotNull()
    reason = (
        F.when(F.col("scattered"), F.lit("scattered"))
        .when(F.size("paths") != 1, F.concat(F.lit("holds "), F.size("paths").cast("string"), F.lit(" paths")))
        .when(F.col("wired") & ~F.coalesce(single, F.lit(False)), F.lit("producer has no key"))
    )
    return fields.where("paths is not null").select("step", "field", reason.isNull().alias("protected"), reason.alias("reason"))
