"""Typed steps, incremental work, documents and streams."""

import dataclasses
import datetime
import hashlib
import json
import os
import sys
import typing
from dataclasses import dataclass
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from runledger.operators import incremental as I
from runledger.operators import steps as S
from runledger.operators.extract import Rule, extract_values
from runledger.sources import logs as L
from runledger.sources import readers as R
from runledger.sources import writers as W
from runledger.sources.inventory import walk_files
from runledger.streaming import live as V

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Out:
    total: int
    words: list[str]
    note: str | None


@S.row_step
def good(ctx, a: int, b: str, k: int = 1) -> Out:
    if a < 0:
        raise ValueError("negative")
    return Out(a * k + ctx["base"], b.split(), None)


def test_step_runs_and_isolates_failures(spark, rows):
    df = spark.createDataFrame([(1, "x y"), (-1, "z")], "a bigint, b string")
    got = S.apply_step(df, good(k=10), keep=["a"], ctx={"base": 5}, on_error="record")
    assert rows(got) == [(-1, None, None, None, 1, "ValueError: negative"), (1, 15, ["x", "y"], None, 0, None)]
    assert S.apply_step(df.where("a > 0"), good, ctx={"base": 0}).columns == ["total", "words", "note"]
    with pytest.raises(Exception, match="negative"):
        S.apply_step(df, good, ctx={"base": 0}).collect()


def test_step_signatures_are_checked(spark):
    def no_hint(a) -> Out: ...
    def many(*a: int) -> Out: ...
    def positional(a: int, /) -> Out: ...
    def wrong_result(a: int) -> int: ...

    for fn in (no_hint, many, positional, wrong_result):
        with pytest.raises(TypeError):
            S.row_step(fn)
    with pytest.raises(TypeError, match="nope"):
        good(nope=1)
    with pytest.raises(ValueError, match="'b'"):
        S.apply_step(spark.range(1).withColumnRenamed("id", "a"), good)


def test_pipeline_names_what_is_wrong(spark):
    p = S.Pipeline(x=spark.range(3)).add("late", lambda d: d.where("id > 0"), ["early"]).add("early", lambda d: d, ["x"])
    assert p.frames()["late"].count() == 2
    with pytest.raises(ValueError, match="already"):
        p.add("x", lambda d: d, [])
    with pytest.raises(ValueError, match="'ghost'"):
        S.Pipeline().add("a", lambda d: d, ["ghost"]).frames()
    with pytest.raises(ValueError, match="a -> b -> a"):
        S.Pipeline().add("a", lambda d: d, ["b"]).add("b", lambda d: d, ["a"]).frames()


def double(df, factor=2):
    return df.select("g", (F.col("v") * factor).alias("w"))


def test_only_changed_partitions_are_redone(spark, rows, tmp_path):
    ledger, out = I.VersionedTable(spark, str(tmp_path / "ledger")), str(tmp_path / "out")
    frame = lambda data: spark.createDataFrame(data, "g int, v int")
    first = [(1, 1), (1, 2), (2, 3)]
    assert rows(I.process_changed(frame(first), ["g"], double, ledger, out)) == [(1, "no entry"), (2, "no entry")]
    assert I.process_changed(frame(first[::-1]), ["g"], double, ledger, out).isEmpty()
    assert rows(I.process_changed(frame([(1, 1), (1, 2), (2, 4), (3, 0)]), ["g"], double, ledger, out)) == [(2, "key changed"), (3, "no entry")]
    assert rows(spark.read.parquet(out), "g", "w") == [(1, 2), (1, 4), (2, 8), (3, 0)]
    for name in os.listdir(f"{out}/g=1"):
        os.remove(f"{out}/g=1/{name}")
    assert rows(I.process_changed(frame([(1, 1), (1, 2), (2, 4), (3, 0)]), ["g"], double, ledger, out)) == [(1, "output gone")]
    redone = I.process_changed(frame([(1, 1), (1, 2), (2, 4), (3, 0)]), ["g"], double, ledger, out, {"factor": 3})
    assert redone.count() == 3 and rows(spark.read.parquet(out), "g", "w") == [(1, 3), (1, 6), (2, 12), (3, 0)]


def test_a_state_is_published_last(spark, tmp_path):
    table = I.VersionedTable(spark, str(tmp_path / "t"))
    assert table.head() is None and table.read() is None
    table.save(spark.range(2), "one")
    spark.range(5).write.parquet(f"{tmp_path}/t/states/two")  # a job that died before publishing
    assert table.head() == "one" and table.read().count() == 2
    table.save(spark.range(3), "three")
    table.roll_back("one")
    assert table.head() == "one"
    with pytest.raises(ValueError):
        table.roll_back("two")


def shrink(df, iteration):
    return df.select((F.col("v") - iteration).alias("v"))


def test_fixed_point_stops_at_the_sentinel_or_the_bound(spark):
    df = spark.createDataFrame([(10,)], "v int")
    result, k, done = I.iterate(df, shrink, 10, lambda d: d.agg(F.max("v") <= 4))
    assert (result.first().v, k, done) == (4, 3, True)
    assert I.iterate(df, shrink, 2, lambda d: d.agg(F.lit(False)))[1:] == (2, False)
    with pytest.raises(ValueError):
        I.iterate(df, shrink, 0, lambda d: d)


def test_run_documents_of_any_depth_and_age(spark, rows, tmp_path):
    leaf = {"name": "c", "returncode": 1, "inputs": {"n": 3, "p": "x", "l": [1, 2]}}
    leaf["resources"] = {"cpus": 4}
    old = {"generated_at": "2024-01-01T00:00:00", "root": {"name": "r", "steps": [{"name": "a", "steps": [{"name": "b", "steps": [leaf]}]}, {"name": "d"}]}}
    (tmp_path / "r.20240101.1.run.json").write_text(json.dumps(old, indent=2))
    got = R.read_runs(spark, str(tmp_path))
    assert rows(got, "idx", "depth", "path") == [(0, 0, "r"), (1, 1, "r.a"), (2, 2, "r.a.b"), (3, 3, "r.a.b.c"), (4, 1, "r.d")]
    assert {(r.generated_at, tuple(sorted(r.resources.items()))) for r in got.where("name in ('a', 'c')").collect()} == {("2024-01-01T00:00:00", ()), ("2024-01-01T00:00:00", (("cpus", "4"),))}
    assert got.where("name = 'c'").select("returncode", "containerized", "inputs").first()[:] == (1, False, {"n": "3", "p": "x", "l": "[1, 2]"})


def test_documents_are_nested_back(spark, rows, tmp_path):
    data = [("1", "r", 0, 0, "r"), ("1", "r.a", 1, 1, "a"), ("1", "r.a.b", 2, 2, "b"), ("1", "r.c", 1, 3, "c")]
    records = spark.createDataFrame(data, "run_id string, path string, depth int, idx int, name string")
    docs = W.nest_records(records, 2).withColumns({"name": F.lit("n"), "generated_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    W.write_runs(docs, str(tmp_path / "runs"))
    assert rows(R.read_runs(spark, str(tmp_path / "runs"), per_line=True), "run_id", "path", "depth", "idx", "name") == data


def test_cache_chain_and_yaml_documents(spark, rows, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"r.a": {"cache_key": "k", "run_id": "1", "outputs": {"o": "/x"}}, "r.b": {"cache_key": "l"}}))
    assert rows(R.read_cache(spark, str(tmp_path / "cache.json")), "step_path", "cache_key", "run_id") == [("r.a", "k", "1"), ("r.b", "l", None)]
    journal = {"/d": {"dev": 1, "ino": 2, "path": "/d", "generations": [{"name": "g0"}, {"name": "g1", "size": 5, "snapshot_present": False}], "consumed": {"r.a::ms": "g0"}}}
    (tmp_path / "chains.json").write_text(json.dumps(journal))
    chains, generations, consumed = R.read_chains(spark, str(tmp_path / "chains.json"))
    assert rows(chains, "chain", "status", "head", "marker_run") == [("/d", "trusted", None, None)]
    assert rows(generations, "pos", "name", "size", "present") == [(0, "g0", 0, True), (1, "g1", 5, False)]
    assert rows(consumed, "step_path", "field", "name") == [("r.a", "ms", "g0")]
    (tmp_path / "cab.yaml").write_text("a:\n  b: 1\n  _use: [x.y, z]\nc: [1, two]\nd: {}\n")
    got = rows(R.read_param_yaml(spark, str(tmp_path / "cab.yaml")), "path", "value")
    assert got == [("a._use", "x.y,z"), ("a.b", "1"), ("c", '[1, "two"]'), ("d", "{}")]


def test_parameter_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"task": "t", "base": "", "parameters": [{"name": "a", "dtype": ["int", "str"]}, {"name": "m", "dtype": "str", "io": "msfile", "required": True}, {"name": "z"}]}))
    got = R.read_param_docs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.name, r.dtype, r.required, r.image, r.command) for r in got] == [("a", "int", False, None, "t"), ("m", "MS", True, None, "t"), ("z", "str", False, None, "t")]


def test_file_samples_see_head_and_tail_only(spark, tmp_path):
    for name, body in (("a", b"x" * 20000), ("b", b"x" * 9000 + b"y" + b"x" * 10999), ("c", b"x" * 19999 + b"y"), ("s", b"xyz")):
        (tmp_path / name).write_bytes(body)
    got = {os.path.basename(r.path): r for r in R.scan_files(spark, str(tmp_path), sample=True).collect()}
    assert got["a"].sample == got["b"].sample != got["c"].sample and got["s"].size == 3
    walked = {r.relpath: r.sample for r in walk_files(spark.createDataFrame([(str(tmp_path),)], "root string"), sample=True).collect()}
    assert walked == {name: r.sample for name, r in got.items()}
    assert R.scan_files(spark, str(tmp_path)).columns == ["path", "mtime_ms", "size"]


def test_walk_sees_what_a_tree_holds(spark, rows, tmp_path):
    tree = tmp_path / "t"
    (tree / "sub" / "deep").mkdir(parents=True)
    (tree / "sub" / "deep" / "f").write_text("abc")
    (tree / "empty").write_text("")
    (tree / "link").symlink_to(tree / "sub" / "deep" / "f")
    (tree / "dangling").symlink_to(tree / "gone")
    (tree / "loop").symlink_to(tree)
    lone = tmp_path / "lone"
    lone.write_text("xy")
    roots = spark.createDataFrame([(str(tree),), (str(lone),), (str(tmp_path / "no"),)], "root string")
    got = walk_files(roots).withColumn("root", F.substring_index("root", "/", -1))
    assert rows(got, "root", "relpath", "kind", "size") == [
        ("lone", ".", "file", 2), ("no", None, "missing", None), ("t", "empty", "file", 0), ("t", "link", "file", 3), ("t", "sub/deep/f", "file", 3),
    ]


def test_accounting_and_run_logs(spark, rows, tmp_path):
    (tmp_path / "acct").write_text("12|COMPLETED|0:0\n12.batch|FAILED|1:0\n")
    assert rows(R.read_accounting(spark, str(tmp_path / "acct"))) == [("12", "COMPLETED", "0:0"), ("12.batch", "FAILED", "1:0")]
    text = "2024-01-02 03:04:05,678 INFO step r.a: cache hit -- skipping run\nno log line\n2024-01-02 03:04:06,000 ERROR [a] boom\n"
    (tmp_path / "log").write_text(text)
    got = L.parse_run_log(L.read_log_lines(spark, str(tmp_path / "log")))
    assert rows(got, "line_no", "level", "step", "event") == [(0, "INFO", "r.a", "cache hit"), (1, None, None, None), (2, "ERROR", "a", "output")]
    with pytest.raises(ValueError):
        L.at_least(F.lit("INFO"), "LOUD")


def test_lines_split_like_console_text(spark):
    df = spark.createDataFrame([("a\r\nb\n\nc\n", "e"), ("", None)], "stdout string, stderr string").withColumn("k", F.length("stdout"))
    got = [(r.k, r.stream, r.line_no, r.text) for r in L.explode_streams(df, ["k"]).orderBy("k", "stream_rank", "line_no").collect()]
    assert got == [(8, "stdout", 0, "a"), (8, "stdout", 1, "b"), (8, "stdout", 2, ""), (8, "stdout", 3, "c"), (8, "stderr", 0, "e")]


def test_stream_ends_where_the_batch_does(spark, rows, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rules = [Rule(r"v=(?P<v>\d+)", "v", "int")]

    def feed():
        lines = V.stream_log_lines(spark, str(source))
        V.write_updates(V.extract_values_stream(lines, rules, ["file"], ["line_no"]), out, str(tmp_path / "cp"), available_now=True).awaitTermination()

    (source / "one").write_text("v=1\nv=2\nnothing\n")
    feed()
    (source / "two").write_text("v=7\n")
    feed()
    live = rows(V.read_latest(spark, out, ["file", "field"]), "file", "int_value")
    assert live == rows(extract_values(L.read_log_lines(spark, str(source)), rules, ["file"], ["line_no"]), "file", "int_value")
    assert [v for _f, v in live] == [2, 7]


@dataclasses.dataclass
class Located:
    where: Path
    kind: str
    pair: tuple[int, str]


@S.row_step
def locate(path: Path, mode: typing.Literal["r", "w"], at: datetime.datetime, parts: tuple[int, ...]) -> Located:
    return Located(path.parent, f"{mode}{at.year}", (sum(parts), path.name))


def test_steps_take_paths_literals_times_and_tuples(spark, rows):
    data = [("/a/b/c", "r", datetime.datetime(2024, 1, 2), [1, 2]), ("/x/y", "z", datetime.datetime(2023, 1, 2), [])]
    df = spark.createDataFrame(data, "path string, mode string, at timestamp, parts array<bigint>")
    got = S.apply_step(df, locate, keep=["path"], on_error="record").collect()
    assert [(r.path, r.where, r.kind, r.pair and tuple(r.pair)) for r in got] == [("/a/b/c", "/a/b", "r2024", (3, "c")), ("/x/y", None, None, None)]
    assert got[1].reason.startswith("ValueError: 'z' is none of")


def test_bad_documents_are_left_out_and_told(spark, rows):
    docs = spark.createDataFrame([("a", '{"name": "r", "steps": [{"name": "s"}]}'), ("b", '{"name": '), ("c", ""), ("d", "[1]"), ("e", None)], "run_id string, text string")
    assert rows(R.flatten_records(docs), "run_id", "path") == [("a", "r"), ("a", "r.s")]
    assert rows(R.rejected_json(docs), "run_id", "reason") == [("b", "not JSON"), ("c", "empty"), ("d", "not of the expected shape"), ("e", "empty")]
    pages = spark.createDataFrame([("a", "x: {y: 1}"), ("b", "x: [1")], "file string, text string")
    assert rows(R.parse_yaml(pages)) == [("a", "x.y", "1")]
    assert [r.doc for r in R.rejected_yaml(pages).collect()] == ["b"]


@dataclass
class Kept:
    n: int | None
    at: datetime.datetime | None
    seen: dict[str, int]


@S.row_step
def keep_values(n: int | None, at: datetime.datetime | None, m: dict[str, int], parts: list[int]) -> Kept:
    assert at is None or at.tzinfo is None
    return Kept(n, at, {**m, "parts": sum(parts)})


def test_steps_see_exact_numbers(spark):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    big = (1 << 53) + 1
    df = spark.createDataFrame([(big, at, {"a": big}, [1, big]), (None, None, {}, [])], "n long, at timestamp, m map<string,long>, parts array<long>").coalesce(1)
    first, second = S.apply_step(df, keep_values, keep=["m"]).collect()
    assert (first.n, first.at, first.seen, first.m) == (big, at, {"a": big, "parts": big + 1}, {"a": big})
    assert (second.n, second.at, second.seen) == (None, None, {"parts": 0})
    assert S.apply_step(df.limit(0), keep_values).collect() == []


def test_partitions_that_left_the_input_go(spark, tmp_path):
    ledger, out = I.VersionedTable(spark, f"{tmp_path}/ledger"), f"{tmp_path}/out"
    rows = spark.createDataFrame([("a b/c", 1), ("x", 2), (None, 3)], "k string, v long")
    run = lambda df: {tuple(r) for r in I.process_changed(df, ["k"], _same, ledger, out).collect()}
    read = lambda: {(r.v, r.k) for r in spark.read.parquet(out).collect()}
    assert run(rows) == {("a b/c", "no entry"), ("x", "no entry"), (None, "no entry")}
    assert run(rows) == set()
    assert run(rows.where("k = 'x'")) == {("a b/c", "input gone"), (None, "input gone")} and read() == {(2, "x")}
    assert [r.k for r in ledger.read().collect()] == ["x"]
    assert run(rows.where("k is null")) == {("x", "input gone"), (None, "no entry")} and read() == {(3, None)}
    assert run(rows.limit(0)) == {(None, "input gone")} and ledger.read().count() == 0
    assert run(rows) == {("a b/c", "no entry"), ("x", "no entry"), (None, "no entry")} and len(read()) == 3


def _same(df):
    return df


def test_walk_and_samples_tell_what_cannot_be_read(spark, rows, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "f").write_text("abc")
    (tmp_path / "t" / "empty").write_text("")
    roots = spark.createDataFrame([(f"file:{tmp_path}/t",), (f"file://{tmp_path}/t/f",), ("nosuchstore://x/y",), (f"{tmp_path}/gone",)], "root string")
    got = walk_files(roots, sample=True).withColumn("root", F.substring_index("root", "/", -1))
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("", "abc")}
    assert rows(got, "root", "relpath", "kind", "size", "sample") == sorted(
        [("t", "empty", "file", 0, digest[""]), ("t", "f", "file", 3, digest["abc"]), ("f", ".", "file", 3, digest["abc"]), ("y", None, "unreadable", None, None), ("gone", None, "missing", None, None)], key=repr
    )
    assert R.sample_of(f"{tmp_path}/gone", 3) == (None, "missing") and R.sample_of(f"{tmp_path}/t", 3) == (None, "unreadable")
