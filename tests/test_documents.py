"""Documents that are misshapen, and the fields that documents declare."""

import json

import pytest
from pyspark.sql import functions as F

from runledger.operators import config as C
from runledger.operators import declared as D
from runledger.sources import readers as R


def leaves(spark, text):
    return R.parse_yaml(spark.createDataFrame([("d", text)], "file string, text string"))


@pytest.mark.parametrize(
    "text, rows",
    [
        ("d: 2020-01-02", [("d", "2020-01-02")]),
        ("t: 2020-01-02 03:04:05", [("t", "2020-01-02T03:04:05")]),
        ("b: !!binary aGk=", [("b", "aGk=")]),
        ("l: [2020-01-02, 1]", [("l", '["2020-01-02", 1]')]),
        ("2020-01-02: {1: x}", [("2020-01-02.1", "x")]),
        ("s: !!set {b, a}", [("s", '["a", "b"]')]),
        ("- a", [("", '["a"]')]),
    ],
)
def test_values_that_json_lacks(spark, text, rows):
    assert [(r.path, r.value) for r in leaves(spark, text).collect()] == rows


@pytest.mark.parametrize("text", ["d: 2020-13-45", "d: &a {x: *a}", "? [1, 2]\n: x\n? {a: b}\n: y", "a: [", "x: !!python/object:os.x {}", "i: !!int x"])
def test_no_document_kills_the_job(spark, text):
    docs = spark.createDataFrame([("good", "a: 1"), ("bad", text)], "file string, text string")
    assert [tuple(r) for r in R.parse_yaml(docs).collect() if r.doc == "good"] == [("good", "a", "1")]
    rejected = {r.doc for r in R.rejected_yaml(docs).collect()}
    assert rejected == ({"bad"} if not [r for r in R.parse_yaml(docs).collect() if r.doc == "bad"] else set())


RECORDS = {
    "a step is no object": {"steps": ["x"]},
    "inputs is no object": {"inputs": [1]},
    "steps is no list": {"steps": {"a": 1}},
    "returncode is no whole number": {"steps": [{"returncode": 1.5}]},
    "image is no text": {"steps": [{"steps": [{"image": 3}]}]},
    "generated_at is no text": {"generated_at": 5},
    "not of the expected shape": [1],
}


def test_misshapen_records_are_told(spark):
    rows = [(reason, json.dumps(document)) for reason, document in RECORDS.items()] + [("empty", " "), ("not JSON", "{"), ("big", json.dumps({"returncode": 2**40})), ("sound", json.dumps({"name": "r", "steps": [{"name": "s", "returncode": 1, "inputs": {"a": [1]}}]}))]
    docs = spark.createDataFrame(rows, "run_id string, text string")
    assert {r.path for r in R.flatten_records(docs).collect()} == {"r", "r.s"}
    told = {r.run_id: r.reason for r in R.rejected_records(docs).collect()}
    assert told.pop("big") == "returncode is no whole number"
    assert told == {reason: reason for reason in [*RECORDS, "empty", "not JSON"]}


def test_a_mapping_with_any_key_of_a_field_is_one(spark):
    text = "cabs: {probe: {command: probe, inputs: {stem: {write_path: true}, inplace: {mutable: true}, data: {ms: {dtype: MS, required: true}, column: {default: DATA}, sub: {x: {}}}}, outputs: {out: {dtype: File, required: true, implicit: '{stem}.fits'}}}}"
    fields = {(r.side, r.field): r for r in D.document_fields(leaves(spark, text)).collect()}
    assert set(fields) == {("in", "stem"), ("in", "inplace"), ("in", "data_ms"), ("in", "data_column"), ("in", "data_sub_x"), ("out", "out")}
    assert fields["in", "stem"].write_path and fields["in", "inplace"].mutable and fields["in", "data_ms"].is_path and fields["in", "data_ms"].required
    assert fields["in", "data_ms"].flag == "data.ms" and fields["in", "stem"].flag is None and fields["in", "data_column"].field_default == "DATA"
    assert not fields["out", "out"].required and fields["out", "out"].implicit == "{stem}.fits"


def test_a_mapping_inside_a_field_is_no_field(spark):
    """Keys of a default or a policy look like those of fields; the outer mapping counts."""
    text = "cabs: {p: {inputs: {x: {default: {info: a, deep: {dtype: int}}, choices: [1, 2], policies: {positional: true}}}}}"
    (row,) = D.document_fields(leaves(spark, text)).collect()
    assert (row.field, row.dtype, row.positional, row.choices) == ("x", "str", True, "[1, 2]")
    assert json.loads(row.field_default) == {"info": "a", "deep.dtype": "int"}


def test_no_fields(spark):
    for text in ("", "cabs: {}", "cabs: {p: {inputs: {}}}", "other: {p: {inputs: {x: {dtype: int}}}}"):
        assert D.document_fields(leaves(spark, text)).collect() == [] == D.document_errors(leaves(spark, text)).collect()


def test_parameters_keep_their_file(spark):
    docs = spark.createDataFrame([("f.json", '{"task": "t", "parameters": [{"name": "a"}]}')], "file string, text string")
    assert [(r.file, r.task, r.name) for r in R.parse_param_docs(docs).collect()] == [("f.json", "t", "a")]


INCLUDING = {
    "/w/main.yml": "_include: [sub/base.yml, '(cult)gen/shared.yml']\na: {own: 1}",
    "/w/sub/base.yml": "_include: ../more.yml\na: {base: 2, own: 2}",
    "/w/more.yml": "a: {more: 3, base: 3}",
    "/pkg/cult/gen/shared.yml": "s: {_include: deep/x.yaml}",
    "/pkg/cult/gen/deep/x.yaml": "dtype: MS",
    "/w/combined.yml": "in: {_include: (cult.gen.deep)x.yaml}",
    "/w/listed.yml": "_include:\n  - (cult):\n      - gen/shared.yml\n      - gen/deep/x.yaml",
    "/w/longest.yml": "_include: (cult.gen.own)y.yaml",
    "/own/y.yaml": "y: 1",
    "/w/out1.yml": "_include: (cult)../../outside.yaml\nkept: 1",
    "/pkg/cult/out2.yml": "_include: ../../outside.yaml\nkept: 1",
    "/outside.yaml": "stolen: 1",
    "/w/none.yml": "_include: [(nopkg)a.yml, (cult), gone.yml]\nkept: 1",
}


def test_includes_by_path_and_package(spark):
    docs = spark.createDataFrame(list(INCLUDING.items()), "file string, text string")
    packages = spark.createDataFrame([("cult", "/pkg/cult/"), ("cult.gen.own", "/own")], "package string, root string")
    named, problems = C.named_includes(R.parse_yaml(docs), packages)
    merged = {}
    for r in C.resolve_includes(named).collect():
        merged.setdefault(r.doc, {})[r.path] = r.value
    assert merged["/w/main.yml"] == {"a.own": "1", "a.base": "2", "a.more": "3", "s.dtype": "MS"}
    assert merged["/w/combined.yml"] == {"in.dtype": "MS"} and merged["/w/listed.yml"] == {"s.dtype": "MS", "dtype": "MS"}
    assert merged["/w/longest.yml"] == {"y": "1"}
    assert merged["/w/out1.yml"] == merged["/pkg/cult/out2.yml"] == merged["/w/none.yml"] == {"kept": "1"}
    assert sorted((r.doc, r.entry, r.reason) for r in problems.collect()) == [
        ("/pkg/cult/out2.yml", "../../outside.yaml", "outside the package root"),
        ("/w/none.yml", "(cult)", "no file name"),
        ("/w/none.yml", "(nopkg)a.yml", "no such package"),
        ("/w/none.yml", "gone.yml", "no such document"),
        ("/w/out1.yml", "(cult)../../outside.yaml", "outside the package root"),
    ]


def test_includes_without_packages(spark):
    docs = spark.createDataFrame([("a/m.yml", "_include: ./n.yml"), ("a/n.yml", "x: 1"), ("a/p.yml", "_include: (p)n.yml")], "file string, text string")
    named, problems = C.named_includes(R.parse_yaml(docs))
    assert sorted(map(tuple, C.resolve_includes(named).collect())) == [("a/m.yml", "x", "1"), ("a/n.yml", "x", "1")]
    assert [tuple(r) for r in problems.collect()] == [("a/p.yml", "", "(p)n.yml", "no such package")]
