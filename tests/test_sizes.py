"""What must not grow with the tables: what is sent whole, what meets in one task, how often rows move."""

from pyspark.sql import functions as F

from runledger.operators import loops as L
from runledger.operators.config import deep_merge, named_includes
from runledger.operators.declared import document_errors
from runledger.operators.validate import eligibility
from runledger.plans import deal
from runledger.plans.scan import RowNumber, SumBefore, ordered_scan
from runledger.sources import writers
from runledger.sources.readers import parse_yaml


def plan_of(df) -> str:
    """The physical plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def loop_tables(spark, n: int):
    """Tables of n loops whose rows are exploded, so that the planner takes them for small."""
    loops = spark.range(n).select(F.col("id").alias("loop"), F.lit(2).alias("max_iter"), F.when(F.col("id") > 0, "done").alias("until"), F.lit("k").alias("index_input"))

    def rows(schema: str, *values: tuple):
        structs = F.array(*[F.struct(*[F.lit(v).alias(c.split()[0]) for v, c in zip(value, schema.split(", "))]) for value in values])
        return loops.select("loop", F.explode(structs.cast(f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))).alias("r")).select("loop", "r.*")

    inputs = rows("field string, default string", ("ms", None), ("k", "0"), (None, "x"))
    outputs = rows("field string, sub string, sub_field string, is_path boolean", ("done", "b", "stop", True), ("ms", "a", "out", True), (None, "a", "x", False))
    wiring = rows("sub string, field string, src_kind string, src_sub string, src_field string", ("a", "ms", "input", None, "ms"), ("b", "n", "input", None, "k"), ("b", "in", "output", "a", "out"))
    carry = rows("out_field string, in_field string", ("ms", "ms"), ("gone", "away"))
    initial = loops.where("loop > 1").select("loop", F.lit("ms").alias("field"), F.lit("/d").alias("value"))
    return loops, inputs, outputs, wiring, carry, initial


def test_loops_send_no_table_whole(spark, rows):
    loops, inputs, outputs, wiring, carry, initial = loop_tables(spark, 3)
    wrong = L.loop_errors(loops, inputs, outputs, carry, wiring, initial)
    assert "Broadcast" not in plan_of(wrong)
    each = [(i, rule, d) for i in range(3) for rule, d in (("carry key is not an output", "gone"), ("carry value is not an input", "away"))]
    assert rows(wrong, "loop", "rule", "detail") == sorted([*each, (0, "input has no value", "ms"), (1, "input has no value", "ms"), (0, "until is not an output", None)], key=repr)
    wired = L.unroll_wiring(loops, wiring, inputs, outputs, carry, initial)
    assert "Broadcast" not in plan_of(wired)
    assert rows(wired.where("step like '2.%'"), "step", "field", "src_step", "src_field", "value") == sorted(
        [
            ("2.1.a", "ms", None, None, "/d"), ("2.2.a", "ms", "2.1.a", "out", None), ("2.1.b", "n", None, None, "1"), ("2.2.b", "n", None, None, "2"),
            ("2.1.b", "in", "2.1.a", "out", None), ("2.2.b", "in", "2.2.a", "out", None),
        ],
        key=repr,
    )


def test_unrolled_steps_send_no_table_whole(spark, rows):
    loops, _inputs, outputs, wiring, _carry, _initial = loop_tables(spark, 3)
    steps = L.unroll_steps(loops, wiring.select("loop", "sub").distinct(), wiring, outputs)
    assert "Broadcast" not in plan_of(steps)
    assert rows(steps.where("loop = 1"), "k", "sub", "step", "after") == [(1, "a", "1.1.a", None), (1, "b", "1.1.b", None), (2, "a", "1.2.a", "1.1.b"), (2, "b", "1.2.b", None)]
    assert "Broadcast" not in plan_of(L.loop_outputs(loops, outputs))


def test_small_keys_are_scanned_in_one_exchange(spark, rows):
    """Rows of small keys move once; a large key among them is still cut into chunks."""
    df = spark.range(40_000).select((F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("p"))
    chunk, outputs = [F.floor(F.col("p") / 500)], {"n": RowNumber(), "s": SumBefore(F.col("p"))}
    few = ordered_scan(df.where("k <> 0 or p < 100"), ["k"], ["p"], chunk, outputs)
    plan = plan_of(few)
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("Exchange hashpartitioning") == 1 and "Join" not in final
    assert rows(few.where("k = 0"), "p", "n", "s") == sorted(((p, p // 2 + 1, p // 2 * (p // 2 - 1)) for p in range(0, 100, 2)), key=repr)
    mixed = ordered_scan(df, ["k"], ["p"], chunk, outputs)
    assert mixed.where("k = 0").agg(F.max("n"), F.count_distinct("n")).first()[:] == (20_000, 20_000)
    assert mixed.where("k <> 0").agg(F.count("n"), F.max("n"), F.max("s")).first()[:] == (20_000, 1, 0)


def test_declarations_are_parsed_once_on_all_cores(spark, rows):
    """A thousand documents in one split are walked by many tasks, and by each of them once."""
    walked = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            walked.add(len(frame))
            yield frame

    text = "cabs: {c: {inputs: {a: {dtype: int}, b: 5}}}"
    docs = spark.range(1000).coalesce(1).select(F.col("id").alias("file"), F.lit(text).alias("text"))
    tasks = parse_yaml(docs).groupBy(F.spark_partition_id()).count().count()
    assert tasks > 8
    leaves = parse_yaml(docs)
    seen = document_errors(leaves.mapInPandas(counted, leaves.schema))
    assert seen.count() == 1000 and seen.select("name", "reason").distinct().collect() == [("b", "not a mapping")]
    assert walked.value == leaves.count()


def test_a_large_partition_is_dealt_by_its_bytes(spark, tmp_path, monkeypatch):
    """Rows that compress to nothing are dealt by what they take in a task; a small partition stays one file."""
    monkeypatch.setattr(writers, "FILE_BYTES", 64_000, raising=False)
    df = spark.range(40_000).select((F.col("id") % 100 == 0).cast("string").alias("k"), (F.col("id") % 5000).alias("v"))
    out = str(tmp_path / "out")
    writers.write_outputs(df, out, ["k"])
    back = spark.read.parquet(out)
    assert back.count() == 40_000 and back.where("k = 'true'").count() == 400
    files = back.groupBy("k", F.input_file_name().alias("f")).count()
    most, small = files.agg(F.max("count")).first()[0], files.where("k = 'true'").count()
    assert most < 10_000 and small == 1


def test_rows_of_a_task_are_bounded_by_their_number(spark, rows, monkeypatch):
    """Ten times the steps are ten times the tasks, whatever their rows compress to, and every reason is there once."""
    monkeypatch.setattr(deal, "ROWS_OF_TASK", 500)
    n = 2000
    ids = spark.range(n).select(F.col("id").alias("recipe"))
    steps = ids.select("recipe", F.explode(F.array(F.lit("a"), F.lit("a.b"), F.lit("z"), F.lit("a"))).alias("step")).select(
        "recipe", "step", F.when(F.col("step") == "z", "recipe").otherwise("tool").alias("kind"), F.lit("binary").alias("flavour"),
        F.lit(False).alias("has_func"), (F.col("step") == "a").alias("scattered"), F.when(F.col("step") == "a.b", "env").alias("venv"),
    )
    wiring = ids.select("recipe", F.lit("z").alias("step"), F.lit("in").alias("field"), F.lit("output").alias("src_kind"), F.explode(F.expr("array(('a', 'b.c'), ('a.b', 'c'), ('z', 'c'), (null, 'c'))")).alias("s"))
    wiring = wiring.select("recipe", "step", "field", "src_kind", F.col("s.col1").alias("src_step"), F.col("s.col2").alias("src_field"))
    values = steps.select("recipe", "step", F.lit(None).cast("string").alias("field")).where("step <> 'a.b'")
    outputs = ids.select("recipe", F.explode(F.expr("array(('a', 'b.c', true), ('a.b', 'c', true), ('a.b', 'c', false), ('z', 'c', true))")).alias("o"))
    outputs = outputs.select("recipe", F.col("o.col1").alias("step"), F.col("o.col2").alias("field"), F.lit(False).alias("is_path"), F.col("o.col3").alias("parsed"))
    found = eligibility(steps, wiring, values, outputs)
    each = [("a", "mutable value", None), ("a", "scattered", None), ("a.b", "runs in a venv", None), ("z", "not a tool", None), ("z", "reads a non-path output", "a.b.c"), ("z", "reads a parsed output", "a.b.c")]
    assert rows(found, "recipe", "step", "reason", "detail") == sorted(((i, *r) for i in range(n) for r in each), key=repr)
    assert found.rdd.getNumPartitions() >= 4 * n / 500
    few = eligibility(steps.where("recipe < 9"), wiring.where("recipe < 9"), values.where("recipe < 9"), outputs.where("recipe < 9"))
    assert few.count() == 54 and few.rdd.getNumPartitions() <= 8


def test_documents_are_merged_in_tasks_of_bounded_rows(spark, rows, monkeypatch):
    """Rows are dealt by document and path, and no exploded table is sent whole to all tasks."""
    monkeypatch.setattr(deal, "ROWS_OF_TASK", 4000)
    n = 3000
    layers = spark.range(n).select(F.col("id").alias("doc"), F.explode(F.expr("array(('a', 'low', 1), ('a.b', 'high', 2), ('c.d', 'low', 1), ('c', 'high', 2))")).alias("r"))
    shown = deep_merge(layers.select("doc", F.col("r.col1").alias("path"), F.col("r.col2").alias("value"), F.col("r.col3").alias("rank")))
    assert rows(shown.select("doc", "path", "value")) == sorted(((i, p, "high") for i in range(n) for p in ("a.b", "c")), key=repr)
    assert shown.rdd.getNumPartitions() >= 4 * n * 8 / 4000
    leaves = spark.range(n).select(F.concat(F.lit("/lib/d"), F.col("id").cast("string")).alias("doc"), F.explode(F.expr("array(('_include', if(id % 2 = 0, concat('d', id + 1), '/out')), ('own', 'x'))")).alias("r"))
    packages = spark.createDataFrame([("lib", "/lib")], "package string, root string")
    named, problems = named_includes(leaves.select("doc", F.col("r.col1").alias("path"), F.col("r.col2").alias("value")), packages)
    assert named.where("path = '_include'").count() == n // 2
    assert problems.groupBy("reason").count().collect() == [("outside the package root", n // 2)]
