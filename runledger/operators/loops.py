"""Bounded loops over pipeline bodies, unrolled as tables.

Tables: loops (loop, max_iter, until, index_input), body (loop, sub; empty sub
where the body is one step), body_inputs (loop, field, default), body_outputs (loop,
field, sub, sub_field, is_path), body_wiring (loop, sub, field, src_kind,
src_sub, src_field), carry (loop, out_field, in_field), initial (loop, field,
value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The planner takes a table of exploded rows for as small as what it was exploded
# from, and would send it whole to the driver and every executor.
MERGED = "merge"


def loop_errors(loops: DataFrame, body_inputs: DataFrame, body_outputs: DataFrame, carry: DataFrame, body_wiring: DataFrame, initial: DataFrame) -> DataFrame:
    """Everything wrong with loop declarations: (loop, rule, detail).

    Each table says what it knows of the names of a loop; what is said of one
    name meets in one aggregation, so nothing is joined or broadcast.
    """
    facts = ("until", "output", "producer", "no_path", "carried", "carry_target", "input", "index", "needed", "supplied")

    def told(df: DataFrame, name: str, **said: Column) -> DataFrame:
        flags = [F.coalesce(said.get(f, F.lit(False)), F.lit(False)).alias(f) for f in facts]
        return df.select("loop", F.col(name).cast("string").alias("detail"), *flags)

    def named(df: DataFrame, name: str) -> DataFrame:
        """Only rows that can be found: a null is no name."""
        return df.where(F.col("loop").isNotNull() & F.col(name).isNotNull())

    yes = F.lit(True)
    index = loops.where("index_input is not null")
    parts = [
        told(loops, "until", until=yes),
        told(named(body_outputs, "field"), "field", output=yes, producer=F.col("sub").isNotNull(), no_path=~F.col("is_path")),
        told(carry, "out_field", carried=yes),
        told(carry, "in_field", carry_target=yes),
        told(named(body_inputs, "field"), "field", input=yes, supplied=F.col("default").isNotNull()),
        told(index, "index_input", index=yes, supplied=F.col("loop").isNotNull()),
        told(named(initial, "field"), "field", supplied=yes),
        told(body_wiring.where("src_kind = 'input'"), "src_field", needed=yes),
    ]
    names = reduce(DataFrame.unionByName, parts).groupBy("loop", "detail").agg(*[F.bool_or(f).alias(f) for f in facts])
    c = F.col
    wrong = {
        "until is not an output": c("until") & ~c("output"),
        "until is not a path": c("until") & c("no_path"),
        "until has no producer": c("until") & c("output") & ~c("producer"),
        "carry key is not an output": c("carried") & ~c("output"),
        "carry value is not an input": c("carry_target") & ~c("input"),
        "index is not an input": c("index") & ~c("input"),
        "input has no value": c("needed") & ~c("supplied"),
    }
    found = F.explode(F.array_compact(F.array(*[F.when(holds, F.lit(rule)) for rule, holds in wrong.items()])))
    below = loops.where("max_iter < 1").select("loop", F.lit("max_iter below 1").alias("rule"), F.col("max_iter").cast("string").alias("detail")).distinct()
    return below.unionByName(names.select("loop", found.alias("rule"), "detail"))


def body_errors(body: DataFrame) -> DataFrame:
    """Body steps a loop cannot hold: (loop, sub, rule).

    Args:
        body: (loop, sub, scattered, nested).
    """
    rules = F.array_compact(F.array(F.when(F.col("scattered"), F.lit("body step is scattered")), F.when(F.col("nested"), F.lit("body step is a nested recipe"))))
    return body.select("loop", "sub", F.explode(rules).alias("rule"))


def clashing_names(unrolled: DataFrame, existing: DataFrame) -> DataFrame:
    """Unrolled step names that a recipe already has: (recipe, step)."""
    return unrolled.select("recipe", "step").join(existing.select("recipe", "step"), ["recipe", "step"], "left_semi")


def iteration_step(loop: Column, k: Column, sub: Column) -> Column:
    """`loop.k.sub`, or `loop.k` where the body is a single step (empty sub)."""
    return F.concat_ws(".", loop, k.cast("string"), F.nullif(sub, F.lit("")))


def unroll_steps(loops: DataFrame, body: DataFrame, body_wiring: DataFrame, body_outputs: DataFrame) -> DataFrame:
    """One step per body step and iteration: (loop, k, sub, step, prev_step, sentinel_step, sentinel_field, after).

    A step that reads no other step of its iteration waits for the sentinel of
    the one before; the others wait through what they read.
    """
    ends = body_outputs.select("loop", F.col("field").alias("until"), F.col("sub").alias("u_sub"), F.col("sub_field").alias("u_field"))
    until = loops.where("max_iter >= 1").join(ends.hint(MERGED), ["loop", "until"])
    inner = body_wiring.where("src_kind = 'output'").select("loop", "sub").distinct().withColumn("inner", F.lit(True))
    steps = (
        body.join(inner.hint(MERGED), ["loop", "sub"], "left")
        .join(until.hint(MERGED), "loop")
        .select("loop", "sub", "u_sub", "u_field", "inner", F.explode(F.sequence(F.lit(1), F.col("max_iter"))).alias("k"))
    )
    loop, k, sub, later = F.col("loop"), F.col("k"), F.col("sub"), F.col("k") > 1
    sentinel = F.when(later, iteration_step(loop, k - 1, F.col("u_sub")))
    return steps.select(
        "loop",
        "k",
        "sub",
        iteration_step(loop, k, sub).alias("step"),
        F.when(later, iteration_step(loop, k - 1, sub)).alias("prev_step"),
        sentinel.alias("sentinel_step"),
        F.col("u_field").alias("sentinel_field"),
        F.when(F.col("inner").isNull(), sentinel).alias("after"),
    )


def unroll_wiring(loops: DataFrame, body_wiring: DataFrame, body_inputs: DataFrame, body_outputs: DataFrame, carry: DataFrame, initial: DataFrame) -> DataFrame:
    """The inputs of every unrolled step: (step, field, src_step, src_field, value).

    A source inside the body is the same step of this iteration. A body input is
    the iteration number if it is the index; the previous iteration's carried
    output from the second iteration on; else what the loop was given, or the
    default.
    """
    sources = body_outputs.select("loop", F.col("field").alias("out_field"), F.col("sub").alias("c_sub"), F.col("sub_field").alias("c_field"))
    carried = carry.join(sources.hint(MERGED), ["loop", "out_field"]).select("loop", F.col("in_field").alias("src_field"), "c_sub", "c_field")
    given = initial.select("loop", F.col("field").alias("src_field"), F.col("value").alias("given"))
    default = body_inputs.select("loop", F.col("field").alias("src_field"), "default")
    wired = (
        body_wiring.join(carried.hint(MERGED), ["loop", "src_field"], "left")
        .join(given.hint(MERGED), ["loop", "src_field"], "left")
        .join(default.hint(MERGED), ["loop", "src_field"], "left")
        .join(loops.where("max_iter >= 1").select("loop", "index_input", "max_iter").hint(MERGED), "loop")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("max_iter"))))
    )
    loop, k = F.col("loop"), F.col("k")
    own = F.col("src_kind") == "output"
    index = ~own & F.coalesce(F.col("src_field") == F.col("index_input"), F.lit(False))
    back = ~own & ~index & F.col("c_field").isNotNull() & (k > 1)
    return wired.select(
        iteration_step(loop, k, F.col("sub")).alias("step"),
        "field",
        F.when(own, iteration_step(loop, k, F.col("src_sub"))).when(back, iteration_step(loop, k - 1, F.col("c_sub"))).alias("src_step"),
        F.when(own, F.col("src_field")).when(back, F.col("c_field")).alias("src_field"),
        F.when(index, k.cast("string")).when(~own & ~back, F.coalesce("given", "default")).alias("value"),
    )


def loop_outputs(loops: DataFrame, body_outputs: DataFrame) -> DataFrame:
    """What a loop gives: the outputs of its last iteration: (loop, field, src_step, src_field)."""
    return body_outputs.where("sub is not null").join(loops.where("max_iter >= 1").select("loop", "max_iter").hint(MERGED), "loop").select(
        "loop", "field", iteration_step(F.col("loop"), F.col("max_iter"), F.col("sub")).alias("src_step"), F.col("sub_field").alias("src_field")
    )
