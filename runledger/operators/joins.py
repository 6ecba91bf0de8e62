"""Joins over pipeline and version tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.names import parse_platform, state_name
from runledger.plans.digest import row_digest
from runledger.plans.paths import ancestors, normalize
from runledger.plans.scan import LastBefore, ordered_scan

# What an environment record must hold.
ENV_SCHEMA = 1
ENV_FIELDS = ("env_id", "lock_sha256", "pyproject_sha256", "mode", "platform_triple")
ENV_MODES = ("uv-sync", "uv-pip-sync", "uv-pip-install")


def resolve_wiring(params: DataFrame, wiring: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The value of every step input: constants overlaid by what is wired.

    Args:
        params: (recipe, step, field, value), constants.
        wiring: (recipe, step, field, pos, src_kind, src_step, src_field);
            `pos` numbers the sources of a list, null for a single source.
        inputs: (recipe, field, value), the recipe's own inputs.
        outputs: (recipe, step, field, value), what steps produced.

    Returns:
        (recipe, step, field, pos, value, origin), one row per list element.
    """
    sources = inputs.select("recipe", F.lit("input").alias("src_kind"), F.lit("").alias("src_step"), F.col("field").alias("src_field"), "value").unionByName(
        outputs.select("recipe", F.lit("output").alias("src_kind"), F.col("step").alias("src_step"), F.col("field").alias("src_field"), "value")
    )
    wired = (
        wiring.withColumn("src_step", F.coalesce("src_step", F.lit("")))
        .join(sources, ["recipe", "src_kind", "src_step", "src_field"], "left")
        .select("recipe", "step", "field", "pos", "value", F.lit("wired").alias("origin"))
    )
    constant = params.join(wiring.select("recipe", "step", "field"), ["recipe", "step", "field"], "left_anti").select(
        "recipe", "step", "field", F.lit(None).cast("int").alias("pos"), "value", F.lit("constant").alias("origin")
    )
    return wired.unionByName(constant)


def containment_join(left: DataFrame, right: DataFrame, by: Sequence[str] = (), left_path: str = "path", right_path: str = "path") -> DataFrame:
    """Pairs of rows whose normalized paths are equal or contain one another.

    Each path is exploded into its ancestors and the joins are on equality, so
    no pair is compared that does not match. Columns: `by`, `l` and `r` (the
    rows as structs), and `relation` of the left path to the right one.
    """
    by = list(by)
    left_rows = left.select(*by, F.struct(*left.columns).alias("l"), normalize(F.col(left_path)).alias("__lp"))
    right_rows = right.select(*by, F.struct(*right.columns).alias("r"), normalize(F.col(right_path)).alias("__rp"))
    up_left = left_rows.select("*", F.explode(ancestors(F.col("__lp"))).alias("__p"))
    inside = up_left.join(right_rows.withColumnRenamed("__rp", "__p"), [*by, "__p"])
    up_right = right_rows.select("*", F.explode(ancestors(F.col("__rp"), proper=True)).alias("__p"))
    contains = left_rows.withColumnRenamed("__lp", "__p").join(up_right, [*by, "__p"])
    relation = F.when(F.col("__lp") == F.col("__p"), F.lit("equal")).otherwise(F.lit("inside"))
    return inside.select(*by, "l", "r", relation.alias("relation")).unionByName(contains.select(*by, "l", "r", F.lit("contains").alias("relation")))


def cache_check(keys: DataFrame, entries: DataFrame, outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each step may reuse its recorded result, and if not why.

    Args:
        keys: (step_path, cache_key) as computed now.
        entries: (step_path, cache_key) as recorded.
        outputs: (step_path, path) declared by the recorded result.
        files: (path), what exists.
    """
    gone = outputs.where("path is not null and path <> ''").join(files.select("path"), "path", "left_anti").select("step_path").distinct().withColumn("gone", F.lit(True))
    recorded = entries.select("step_path", F.col("cache_key").alias("recorded_key"), F.lit(True).alias("recorded"))
    reason = (
        F.when(F.col("recorded").isNull(), F.lit("no entry"))
        .when(~F.col("cache_key").eqNullSafe(F.col("recorded_key")), F.lit("key changed"))
        .when(F.col("gone"), F.lit("output gone"))
    )
    joined = keys.join(recorded, "step_path", "left").join(gone, "step_path", "left")
    return joined.select("step_path", "cache_key", reason.isNull().alias("hit"), reason.alias("reason"))


def replay_diff(records: DataFrame, steps: DataFrame) -> DataFrame:
    """Where a recorded run and the current definition differ: (recipe, step, difference)."""
    then = records.select("recipe", "step", F.col("kind").alias("kind_then"))
    now = steps.select("recipe", "step", F.col("kind").alias("kind_now"))
    difference = (
        F.when(F.col("kind_now").isNull(), F.lit("no longer exists"))
        .when(F.col("kind_then").isNull(), F.lit("not in the record"))
        .when(F.col("kind_now") != F.col("kind_then"), F.concat(F.lit("was "), "kind_then", F.lit(", now "), "kind_now"))
    )
    return then.join(now, ["recipe", "step"], "full_outer").select("recipe", "step", difference.alias("difference")).where("difference is not null")


def longest_prefix_join(names: DataFrame, roots: DataFrame, name: str = "name", root: str = "root", sep: str = ".") -> DataFrame:
    """For each dotted name the longest root that is a prefix of it on segment boundaries, or null.

    Args:
        names: any columns; `name` need not be unique.
        roots: `root`, unique, and any columns, returned with the match.
    """
    parts = F.split(F.col(name), "\\" + sep)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    distinct = names.select(name).distinct()
    found = (
        distinct.select(name, F.explode(prefixes).alias(root))
        .join(roots, root)
        .groupBy(name)
        .agg(F.max_by(F.struct(*roots.columns), F.length(root)).alias("__r"))
        .select(name, "__r.*")
    )
    return names.join(found, name, "left")


def reconcile(chains: DataFrame, entries: DataFrame, trash: DataFrame) -> DataFrame:
    """What to do about each step that was in flight when its run died.

    It completed only if the cache has an entry of the same step with the same
    key, recorded by the same run.

    Args:
        chains: (chain, path, marker_step, marker_key, marker_run); no marker, no action.
        entries: (step_path, cache_key, run_id).
        trash: (path, run_id), the quarantined trees present.
    """
    marked = chains.where("marker_run is not null")
    recorded = entries.select(
        F.col("step_path").alias("marker_step"), F.col("cache_key").alias("marker_key"), F.col("run_id").alias("marker_run"), F.lit(True).alias("completed")
    ).distinct()
    kept = trash.select("path", F.col("run_id").alias("marker_run"), F.lit(True).alias("has_trash")).distinct()
    joined = marked.join(recorded, ["marker_step", "marker_key", "marker_run"], "left").join(kept, ["path", "marker_run"], "left")
    completed, has_trash = F.coalesce("completed", F.lit(False)), F.coalesce("has_trash", F.lit(False))
    action = (
        F.when(completed & has_trash, F.lit("discard trash"))
        .when(completed, F.lit("clear marker"))
        .when(has_trash, F.lit("roll back"))
        .otherwise(F.lit("restore before re-run"))
    )
    status = F.when(completed, F.lit("unchanged")).otherwise(F.lit("untrusted"))
    return joined.select("chain", "path", completed.alias("completed"), action.alias("action"), status.alias("status"))


def required_state(plans: DataFrame, chains: DataFrame, consumed: DataFrame) -> DataFrame:
    """The state each planned access calls for, and where that answer comes from.

    Args:
        plans: (step_path, field, path, wired_key, wired_field, fingerprint).
        chains: (path, head).
        consumed: (path, step_path, field, name), what each step took last time.
    """
    joined = plans.join(chains.select("path", "head", F.lit(True).alias("tracked")), "path", "left").join(
        consumed.select("path", "step_path", "field", F.col("name").alias("consumed_name")), ["path", "step_path", "field"], "left"
    )
    wired = F.col("wired_key").isNotNull() & F.col("wired_field").isNotNull()
    first = F.concat(F.lit("gen0__"), F.substring(row_digest("path", "fingerprint"), 1, 32))
    tracked = F.coalesce("tracked", F.lit(False))
    required = (
        F.when(wired, state_name(F.col("wired_key"), F.col("wired_field")))
        .when(tracked & F.col("consumed_name").isNotNull(), F.col("consumed_name"))
        .when(tracked, F.col("head"))
        .otherwise(first)
    )
    origin = (
        F.when(wired, F.lit("wired"))
        .when(tracked & F.col("consumed_name").isNotNull(), F.lit("consumed"))
        .when(tracked, F.lit("head"))
        .otherwise(F.lit("generation 0"))
    )
    return joined.select("step_path", "field", "path", required.alias("required"), origin.alias("origin"))


def state_as_of(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], value: str, tie: str, chunk: Sequence[Column]) -> DataFrame:
    """For each left row the latest right `value` at or before its `on`, by key.

    Args:
        tie: Column that orders right rows of equal `on`; it also makes the
            order of left rows total.
        chunk: See `ordered_scan`; bounds the rows of one key in one task.
    """
    extra = [c for c in left.columns if c not in (*by, on, tie)]
    versions = right.select(*by, on, F.col(tie).alias(tie), F.lit(0).alias("__side"), F.col(value).alias("__v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra])
    asked = left.select(*by, on, tie, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), *extra)
    both = versions.unionByName(asked)
    scanned = ordered_scan(both, by, [on, "__side", tie], chunk, {"as_of": LastBefore(F.col("__v"))})
    return scanned.where("__side = 1").select(*left.columns, "as_of")


def read_env(payload: Column) -> Column:
    """An environment record's JSON as struct(status, detail, platform, env_id).

    status is `present`, `foreign` (another schema) or `absent` (nothing usable).
    """
    doc = F.try_parse_json(payload)

    def text_field(name: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(doc, f"$.{name}", "string"))

    schema = F.try_variant_get(doc, "$.schema", "bigint")
    missing = F.concat_ws(", ", *[F.when(F.coalesce(text_field(n), F.lit("")) == "", F.lit(n)) for n in ENV_FIELDS])
    blank = payload.isNull() | (F.trim(payload) == "")
    is_object = F.schema_of_variant(doc).startswith("OBJECT")
    detail = (
        F.when(blank, F.lit("no record"))
        .when(doc.isNull(), F.lit("not valid JSON"))
        .when(~is_object, F.lit("not a JSON object"))
        .when(~schema.eqNullSafe(F.lit(ENV_SCHEMA)), F.lit("foreign schema"))
        .when(missing != "", F.concat(F.lit("missing: "), missing))
        .when(~text_field("mode").isin(*ENV_MODES), F.lit("bad mode"))
    )
    status = F.when(detail.isNull(), F.lit("present")).when(detail == "foreign schema", F.lit("foreign")).otherwise(F.lit("absent"))
    return F.struct(status.alias("status"), detail.alias("detail"), text_field("platform_triple").alias("platform"), text_field("env_id").alias("env_id"))


def usable_envs(sentinels: DataFrame, hosts: DataFrame, payload: str = "payload") -> DataFrame:
    """Environment records with their status, and whether some host has their platform.

    Args:
        hosts: (platform), the platform triples at hand.
    """
    known = hosts.where(parse_platform(F.col("platform")).isNotNull()).select("platform").distinct().withColumn("matched", F.lit(True))
    read = sentinels.withColumn("__e", read_env(F.col(payload))).select(*[c for c in sentinels.columns if c != payload], "__e.*")
    usable = (F.col("status") == "present") & F.coalesce("matched", F.lit(False))
    reason = F.coalesce("detail", F.when(~usable, F.lit("platform differs")))
    return read.join(known, "platform", "left").select(*[c for c in sentinels.columns if c != payload], "status", "env_id", usable.alias("usable"), reason.alias("reason"))


def aliased_chains(chains: DataFrame) -> DataFrame:
    """Tracked paths that share one inode with another path, and one such other.

    A group is reduced to its first and last path, so its size does not matter.
    """
    groups = chains.groupBy("dev", "ino").agg(F.min("path").alias("first"), F.max("path").alias("last")).where("first <> last")
    other = F.when(F.col("path") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    return chains.join(groups, ["dev", "ino"]).select("path", other.alias("alias"))


def orphan_trash(files: DataFrame, chains: DataFrame, suffix: str = ".trash.") -> DataFrame:
    """Quarantined trees of tracked paths that no marker explains.

    Args:
        files: (path) of whatever lies beside the tracked paths.
        chains: (path, marker_run).
    """
    escaped = suffix.replace(".", "\\.")
    found = files.where(F.col("path").contains(suffix)).select(F.col("path").alias("trash"), F.regexp_extract("path", f"^(.*?){escaped}", 1).alias("path"))
    explained = chains.where("marker_run is not null").select(F.concat("path", F.lit(suffix), "marker_run").alias("trash"))
    return found.join(chains.select("path").distinct(), "path", "left_semi").join(explained, "trash", "left_anti").select("trash").distinct()


def resolve_names(df: DataFrame, mapping: DataFrame, name: str = "name", target: str = "target") -> DataFrame:
    """Replace mapped names by what they stand for; others stay as they are.

    Args:
        mapping: (name, target), names unique.
    """
    known = mapping.select(F.col(name), F.col(target).alias("__t"))
    return df.join(known, name, "left").select(*[F.coalesce("__t", name).alias(c) if c == name else c for c in df.columns])


def readonly_conflicts(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """Things that must be written inside an input marked not writable.

    Args:
        inputs: (scope, field, path, writable).
        targets: (scope, path, source), directories declared to be written.
    """
    shut = inputs.groupBy("scope", "path").agg(F.min(F.when(~F.col("writable"), F.col("field"))).alias("field")).where("field is not null")
    writers = targets.select("scope", "path", F.col("source").alias("by")).unionByName(
        inputs.where("writable").select("scope", "path", F.concat(F.lit("input "), F.col("field")).alias("by"))
    ).distinct()
    # Only "writer inside the read-only path" matters, so one direction of the
    # containment join is enough: explode the writer's ancestors.
    up = writers.select("scope", F.col("path").alias("written"), "by", F.explode(ancestors(F.col("path"))).alias("path"))
    return up.join(shut, ["scope", "path"]).select("scope", "field", "path", "written", "by")


def env_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Environments whose digests are both known and differ: (env, digest_a, digest_b)."""
    return (
        a.select("env", F.col("digest").alias("digest_a")).join(b.select("env", F.col("digest").alias("digest_b")), "env").where("digest_a <> digest_b")
    )
