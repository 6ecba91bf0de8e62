"""Audits of declared pipelines: wiring, names, eligibility."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.plans.deal import dealt, tasks_for

STEP = ["recipe", "step"]


def duplicate_names(steps: DataFrame) -> DataFrame:
    """Step names used more than once in a recipe."""
    return steps.groupBy(*STEP).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(refs: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """References (recipe, step, rule, detail) without a target, each once."""
    return refs.join(known, list(on), "left_anti").select("recipe", "step", "rule", "detail").distinct()


def _labelled(refs: DataFrame, rule: str, detail: str) -> DataFrame:
    return refs.withColumns({"rule": F.lit(rule), "detail": F.col(detail).cast("string")})


def _undeclared(refs: DataFrame, steps: DataFrame, fields: DataFrame, holder: str = "step", field: str = "field") -> DataFrame:
    """References to fields that no step of the named kind declares: (recipe, step, rule, detail).

    The few fields referred to are looked up, not all that a scope declares. A
    reference to a step that is not there is left to the rule about steps.
    """
    scopes = steps.select("recipe", F.col("step").alias(holder), "scope").distinct()
    declared = fields.select("scope", F.col("field").alias(field), F.lit(True).alias("found")).distinct()
    looked = refs.join(scopes, ["recipe", holder]).join(declared, ["scope", field], "left")
    judged = looked.groupBy("recipe", "step", "rule", "detail").agg(F.bool_or(F.coalesce("found", F.lit(False))).alias("found"))
    return judged.where("not found").select("recipe", "step", "rule", "detail")


def validate_graph(
    steps: DataFrame,
    wiring: DataFrame,
    input_fields: DataFrame,
    output_fields: DataFrame,
    recipe_inputs: DataFrame,
    after: DataFrame,
    params: DataFrame,
    scattered: DataFrame,
) -> DataFrame:
    """Every reference of a pipeline that names nothing: (recipe, step, rule, detail).

    Args:
        steps: (recipe, step, scope).
        wiring: (recipe, step, field, src_kind, src_step, src_field).
        input_fields, output_fields: (scope, field).
        recipe_inputs: (recipe, field).
        after: (recipe, step, after). params, scattered: (recipe, step, field).
    """
    columns = ["recipe", "step", "rule", "detail"]
    from_input, from_output = wiring.where("src_kind = 'input'"), wiring.where("src_kind = 'output'")
    # What is wrong with a reference to a field, and with one to a step, by its number.
    rules = ["unknown scatter field", "unknown constant", "unknown input", None, "unknown output"]
    absent = [None, None, None, "unknown after", "unknown step"]
    reads = len(rules) - 1

    def refs(rows: DataFrame, number: int, holder: str, field: Column) -> DataFrame:
        return rows.select("recipe", "step", F.lit(number).alias("number"), F.col(holder).alias("holder"), field.alias("field"))

    every = reduce(
        DataFrame.unionByName,
        [refs(rows, i, "step", F.col("field")) for i, rows in enumerate((scattered, params, wiring))]
        + [refs(after.where("after <> step"), reads - 1, "after", F.lit(None).cast("string")), refs(from_output, reads, "src_step", F.col("src_field"))],
    )
    # Every reference, once, meets the step it names and then the field. What is
    # found there is gone; only names that several scopes share are judged together.
    scopes = steps.select("recipe", F.col("step").alias("holder"), "scope").repartition("recipe", "holder").distinct()
    scopes = scopes.withColumn("held", F.least(F.count(F.lit(1)).over(Window.partitionBy("recipe", "holder")), F.lit(2)).cast("tinyint"))
    met = every.repartition("recipe", "holder").distinct().join(scopes, ["recipe", "holder"], "left").withColumn("held", F.coalesce("held", F.lit(0).cast("tinyint")))
    # A reference that no scope can hold has a side without fields, one of many, so that these are spread.
    nowhere = -1 - F.pmod(F.xxhash64("recipe", "step"), F.lit(4096)).cast("int")
    side = F.when(F.col("scope").isNotNull() & F.col("field").isNotNull(), (F.col("number") == reads).cast("int")).otherwise(nowhere)
    # A step's own fields need no name of the holder, which is the step.
    met = met.withColumns({"side": side, "holder": F.when(F.col("number") >= reads - 1, F.col("holder"))})
    declared = reduce(DataFrame.unionByName, [fields.select("scope", "field", F.lit(i).alias("side")) for i, fields in enumerate((input_fields, output_fields))])
    looked = met.join(declared.distinct().withColumn("found", F.lit(True)), ["scope", "field", "side"], "left")
    wrong = looked.where((F.col("found").isNull() & ((F.col("number") != reads - 1) | (F.col("held") == 0))) | (F.col("held") == 2))
    place = ["recipe", "step", "number", "holder", "field"]
    judged = wrong.repartition("recipe", "step").groupBy(*place).agg(F.bool_or(F.coalesce("found", F.lit(False))).alias("found"), (F.max("held") > 0).alias("held")).where("not found")
    texts = {held: F.get(F.array(*[F.lit(r).cast("string") for r in named]), "number") for held, named in ((True, rules), (False, absent))}
    label = F.when(~F.col("held"), F.col("holder")).when(F.col("number") == reads, F.concat("holder", F.lit("."), "field")).otherwise(F.col("field"))
    broken = judged.select("recipe", "step", F.when(F.col("held"), texts[True]).otherwise(texts[False]).alias("rule"), label.cast("string").alias("detail"))
    broken = broken.where("rule is not null")
    found = [
        _labelled(duplicate_names(steps), "duplicate name", "step").select(*columns),
        _labelled(after.where("after = step"), "after itself", "after").select(*columns).distinct(),
        broken.distinct(),
        dangling(_labelled(from_input, "unknown recipe input", "src_field"), recipe_inputs.withColumnRenamed("field", "src_field"), ["recipe", "src_field"]),
    ]
    return reduce(DataFrame.unionByName, found)


def nested_resources(steps: DataFrame) -> DataFrame:
    """Nested recipes that declare a footprint, which only the steps doing the work may: (recipe, step).

    Args:
        steps: (recipe, step, kind, cpus, cpus_all, memory).
    """
    declared = F.col("cpus").isNotNull() | F.coalesce("cpus_all", F.lit(False)) | F.col("memory").isNotNull()
    return steps.where((F.col("kind") == "recipe") & declared).select("recipe", "step")


def validate_outputs(output_wiring: DataFrame, steps: DataFrame, output_fields: DataFrame, recipe_outputs: DataFrame) -> DataFrame:
    """The same for a recipe's own outputs: (recipe, step, rule, detail), step being the source.

    Args:
        output_wiring: (recipe, field, src_step, src_field).
        recipe_outputs: (recipe, field).
    """
    refs = output_wiring.withColumn("step", F.col("src_step"))
    producers = steps.select("recipe", F.col("step").alias("src_step")).distinct()
    return (
        dangling(_labelled(refs, "unknown recipe output", "field"), recipe_outputs, ["recipe", "field"])
        .unionByName(dangling(_labelled(refs, "unknown step", "src_step"), producers, ["recipe", "src_step"]))
        .unionByName(_undeclared(_labelled(refs, "unknown output", "src_field").drop("field"), steps, output_fields, "src_step", "src_field"))
    )


def eligibility(steps: DataFrame, wiring: DataFrame, mutable_values: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every reason a recipe cannot be handed to a batch system: (recipe, step, reason, detail).

    Args:
        steps: (recipe, step, kind, flavour, has_func, scattered, venv).
        wiring: (recipe, step, field, src_kind, src_step, src_field).
        mutable_values: (recipe, step, field), inputs rewritten in place that are no paths.
        outputs: (recipe, step, field, is_path, parsed), what tool steps give.
    """
    tasks = tasks_for(steps, wiring, mutable_values, outputs)
    tool = F.col("kind") == "tool"
    own = {
        "scattered": F.col("scattered"),
        "has a function": F.col("has_func"),
        "not a tool": ~tool,
        "runs in a venv": tool & F.col("venv").isNotNull(),
        "flavour": tool & (F.col("flavour") != "binary"),
    }
    of_step = steps.select(*STEP, F.explode(F.array(*[F.when(c, F.lit(r)) for r, c in own.items()])).alias("reason")).where("reason is not null")
    tools = dealt(steps.where(tool).select(*STEP), tasks, STEP)
    mutable = dealt(mutable_values, tasks, STEP).join(tools, STEP, "left_semi").select(*STEP, F.lit("mutable value").alias("reason"), F.col("field").alias("detail"))
    why = F.when(F.col("parsed"), F.lit("reads a parsed output")).when(~F.col("is_path"), F.lit("reads a non-path output"))
    given = outputs.select(*STEP, F.col("field").alias("src_field"), why.alias("reason")).where("reason is not null")
    given = dealt(given, tasks, STEP).join(tools, STEP, "left_semi").withColumnRenamed("step", "src_step")
    wires = dealt(wiring.where("src_kind = 'output'").select(*STEP, "src_step", "src_field"), tasks, ["recipe", "src_step"])
    flows = wires.join(given, ["recipe", "src_step", "src_field"]).select(*STEP, "reason", F.concat_ws(".", "src_step", "src_field").alias("detail"))
    found = of_step.withColumn("detail", F.lit(None).cast("string")).unionByName(mutable).unionByName(flows)
    return dealt(found, tasks, STEP).distinct()
