"""Schema, extraction, scatter and configuration rules on hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.operators import config as C
from runledger.operators import extract as X
from runledger.operators import files as P
from runledger.operators import scatter as G
from runledger.operators import schema as S
from runledger.plans.lineage import cut


def test_declared_types():
    assert S.spark_type("int") == T.LongType()
    assert S.spark_type("List[Tuple[int, List[float]]]").simpleString() == "array<struct<_0:bigint,_1:array<double>>>"
    assert S.spark_type("list:MS") == T.ArrayType(T.StringType())
    assert S.spark_type("Union[int, str]") == T.StringType() and S.spark_type("thing") == T.StringType()
    assert S.is_path_type("List[MS]") and S.is_path_type("Union[int, File]") and not S.is_path_type("str")
    built = S.build_schema([S.Field("a", "int", required=True), S.Field("b", "File"), S.Field("c", "int", required=True, default=1)])
    assert [f.nullable for f in built] == [False, True, True] and built["b"].metadata["is_path"]


def test_union_reads_as_its_first_fitting_arm(spark, rows):
    df = spark.createDataFrame([("3",), ("3.5",), ("x",)], "v string")
    assert rows(df.select("v", S.cast_union(F.col("v"), ["int", "float", "str"]).alias("arm"))) == [("3", "int"), ("3.5", "float"), ("x", "str")]


def test_rejects_carry_all_reasons(spark, rows):
    fields = [S.Field("n", "int", required=True), S.Field("mode", choices=("a", "b")), S.Field("x", "float", default=0.5)]
    df = spark.createDataFrame([(1, "7", "a", None, None), (2, None, "c", "no", "odd")], "k int, n string, mode string, x string, extra string")
    valid, rejects = S.validate_rows(df, fields, ["k"])
    assert rows(valid) == [(1, 7, "a", 0.5)]
    assert rejects.select("reasons").first()[0] == ["n: missing", "mode: not a choice", "x: not float", "extra: unknown"]


def test_absent_required_column_is_missing(spark):
    _valid, rejects = S.validate_rows(spark.range(2), [S.Field("n", "int", required=True)], ["id"])
    assert rejects.count() == 2


def test_colliding_names_are_refused(spark):
    assert S.sanitize_columns(spark.range(1).select(F.lit(1).alias("a-b"), F.lit(2).alias("2c"))).columns == ["a_b", "_2c"]
    with pytest.raises(ValueError, match="a_b"):
        S.sanitize_columns(spark.range(1).select(F.lit(1).alias("a-b"), F.lit(2).alias("a.b")))


def test_longest_attribute_wins_wherever_it_stands(spark):
    last = S.Family([".+?", ["int", "time-int"]], "-")
    first = S.Family([["dirty", "restored"], ".+"], ".")
    df = spark.createDataFrame([("g1-time-int",), ("dirty.per-band.mfs",), ("none",)], "v string")
    got = [tuple(r) for r in df.select(S.match_family(F.col("v"), last).alias("a"), S.match_family(F.col("v"), first).alias("b")).collect()]
    assert got == [(("g1", "time-int"), None), (None, ("per-band.mfs", "dirty")), (None, None)]
    with pytest.raises(ValueError):
        S.Family(["a", "b"]).pattern()


def test_templates(spark):
    df = spark.createDataFrame([("p", 3)], "prefix string, n int")
    assert df.select(S.template("{prefix}-{n}.fits", df.columns), S.template("log", df.columns)).first()[:] == ("p-3.fits", "log")
    with pytest.raises(ValueError, match="gone"):
        S.template("{gone}", df.columns)


def test_a_null_input_still_hides_what_is_weaker(spark, rows):
    declared = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "run int, field string")
    given = spark.createDataFrame([(1, "a", None)], "run int, field string, value string")
    implicit = spark.createDataFrame([(1, "a", "t"), (1, "b", "t")], "run int, field string, value string")
    assert rows(S.fill_outputs(declared, ["run"], given, implicit), "field", "value") == [("a", None), ("b", "t"), ("c", None)]


LINES = "run int, line_no int, text string"


def test_last_match_wins_and_types_are_checked(spark, rows):
    rules = [
        X.Rule(r"rms=(?P<rms>[0-9.]+)", "rms", "float"),
        X.Rule(r"n=(?P<n>\S+)", "n", "int"),
        X.Rule(r"tag(?P<tag>:\w+)?", "tag", "str", optional=True),
        X.Rule(r"flag=(?P<flag>\w+)", "flag", "bool"),
    ]
    df = spark.createDataFrame([(1, 0, "rms=1.5 n=2"), (1, 1, "rms=2.5 n=oops"), (1, 2, "tag flag=False"), (2, 0, "nothing")], LINES)
    got = {r.field: r for r in X.extract_values(df, rules, ["run"], ["line_no"]).collect()}
    assert got["rms"].float_value == 2.5
    assert got["n"].int_value is None and got["n"].error == "not an int"
    assert got["tag"].text_value == "None"
    assert got["flag"].bool_value is True
    assert all(r.run == 1 for r in got.values())


def test_actions():
    rules = X.rules_from({r"(?P<a>\d+)": ["PARSE_OUTPUT:a:int", "HIGHLIGHT:red"], r"(?P<b>x)": ["PARSE_OUTPUT:b:other"]})
    assert [(r.field, r.type) for r in rules] == [("a", "int"), ("b", "str")]
    with pytest.raises(ValueError, match="one group"):
        X.rules_from({"x": ["PARSE_OUTPUT:a"]})
    with pytest.raises(ValueError, match="no group"):
        X.Rule("x", "a").compiled()


def test_required_marker_missing_is_reported(spark, rows):
    df = spark.createDataFrame([(1, 0, "noise"), (1, 1, " PLAT x/y/z "), (1, 2, "PLAT a/b/c"), (2, 0, "UV 0.4")], LINES)
    got = X.extract_markers(df, {"platform": "PLAT", "uv": "UV"}, ["run"], ["line_no"], required=["platform"])
    assert rows(got, "run", "platform", "uv", "missing") == [(1, "a/b/c", None, ""), (2, None, "0.4", "platform")]


SLICES = "k int, idx int, v int, rc int, on boolean, out string"


def test_scatter_checks(spark, rows):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [1], ["a", "b"]), (3, None, []), (4, [], [])], "k int, xs array<int>, ys array<string>")
    assert rows(G.scatter(df, ["xs", "ys"])) == [(1, 0, 1, "a"), (1, 1, 2, "b")]
    assert rows(G.scatter_rejects(df, ["xs", "ys"]), "k", "reason") == [(2, "different lengths: 1,2"), (3, "not a list: xs")]
    for fields in ([], ["zs"], ["k"]):
        with pytest.raises(ValueError):
            G.scatter(df, fields)


def test_gather_in_index_order_failure_and_empty(spark):
    data = [(1, 1, 20, 0, False, "b"), (1, 0, 10, 0, True, "a"), (1, 2, 30, 0, False, ""), (2, 1, 1, 7, False, "y"), (2, 0, 2, 0, False, "x"), (2, 2, 2, 9, False, None)]
    df = spark.createDataFrame(data, SLICES)
    expected = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    got = {r.k: r for r in G.gather(df, ["k"], "idx", ["v"], rc="rc", flags=["on"], texts=["out"], expected=expected).collect()}
    assert (got[1].v, got[1].rc, got[1].on, got[1].out) == ([10, 20, 30], 0, True, "a\nb")
    assert (got[2].v, got[2].rc, got[2].on, got[2].out) == ([], 7, False, "x\ny")
    assert (got[3].v, got[3].rc, got[3].on, got[3].out) == ([], 0, False, "")


def test_gather_in_parts_loses_nothing(spark, rows):
    df = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("idx"), (F.col("id") * 2).alias("v"))
    got = G.gather(df, ["k"], "idx", ["v"], part_rows=4)
    assert rows(got, "part", "v") == [(0, [0, 2, 4, 6]), (1, [8, 10, 12, 14]), (2, [16, 18])]


def test_gathered_schema():
    inputs, outputs = T.StructType().add("xs", T.IntegerType()).add("n", T.IntegerType()), T.StructType().add("o", T.StringType())
    wide_in, wide_out = G.gathered_schema(inputs, outputs, ["xs"])
    assert wide_in.simpleString() == "struct<xs:array<int>,n:int>" and wide_out.simpleString() == "struct<o:array<string>>"


LEAVES = "doc string, path string, value string, rank int"


def test_merge_replaces_maps_by_values_and_back(spark, rows):
    data = [("d", "a.x", "1", 1), ("d", "a", "s", 2), ("d", "a.y", "3", 3), ("d", "b.x", "1", 1), ("d", "b.y", "2", 2), ("d", "b.x", "9", 2), ("d", "c", "1", 1), ("d", "c.k", "2", 2)]
    got = C.deep_merge(spark.createDataFrame(data, LEAVES))
    assert rows(got, "path", "value") == [("a.y", "3"), ("b.x", "9"), ("b.y", "2"), ("c.k", "2")]


def test_uses_nest_and_own_keys_win(spark, rows):
    data = [
        ("d", "lib.base.x", "base"), ("d", "lib.base.y", "base"), ("d", "lib.base.z.q", "base"),
        ("d", "lib.mid._use", "lib.base"), ("d", "lib.mid.y", "mid"),
        ("d", "lib.other.y", "other"), ("d", "lib.other.w", "other"),
        ("d", "top._use", "lib.mid, lib.other"), ("d", "top.x", "own"),
        ("d", "deep._use", "lib.base"), ("d", "deep.z._use", "lib.other"),
    ]
    got = C.resolve_uses(spark.createDataFrame(data, "doc string, path string, value string"))
    mine = [(p, v) for p, v in rows(got, "path", "value") if p.startswith(("top", "deep"))]
    assert mine == [
        ("deep.x", "base"), ("deep.y", "base"), ("deep.z.q", "base"), ("deep.z.w", "other"), ("deep.z.y", "other"),
        ("top.w", "other"), ("top.x", "own"), ("top.y", "other"), ("top.z.q", "base"),
    ]


def test_a_ring_of_uses_is_an_error(spark):
    data = [("d", "a._use", "b"), ("d", "b._use", "a")]
    with pytest.raises(ValueError, match="ring"):
        C.resolve_uses(spark.createDataFrame(data, "doc string, path string, value string"))


def test_a_chain_of_forty_uses_is_followed(spark, rows):
    data = [("d", "n0.x", "base"), *[("d", f"n{i}._use", f"n{i - 1}") for i in range(1, 41)]]
    got = C.resolve_uses(spark.createDataFrame(data, "doc string, path string, value string"))
    assert rows(got, "path", "value") == sorted((f"n{i}.x", "base") for i in range(41))


def test_a_chain_of_a_thousand_uses_takes_ten_rounds(spark, rows, monkeypatch):
    written = []
    monkeypatch.setattr(C, "cut", lambda df: written.append(1) or cut(df))
    data = [("d", "n0.x", "base"), *[("d", f"n{i}._use", f"n{i - 1}") for i in range(1, 1001)], ("d", "n500.y", "mid"), ("d", "n900.y", "top")]
    got = C.resolve_uses(spark.createDataFrame(data, "doc string, path string, value string"))
    assert len(written) <= 14
    expected = [(f"n{i}.x", "base") for i in range(1001)] + [(f"n{i}.y", "mid" if i < 900 else "top") for i in range(500, 1001)]
    assert rows(got, "path", "value") == sorted(expected)


def plain_uses(doc):
    """The rule as it reads, for leaves of one document: what a node says, then what it names, deepest first."""

    def leaves_of(target, depth):
        inside = {p[len(target) + 1 :]: v for p, v in doc.items() if p == target or p.startswith(target + ".")}
        return resolve(inside, depth)

    def resolve(leaves, depth):
        ranked = [(p, v, ((1 << 20, 0),)) for p, v in leaves.items() if not (p == "_use" or p.endswith("._use"))]
        for p, v in leaves.items():
            if p == "_use" or p.endswith("._use"):
                at = p[: -len("._use")] if p != "_use" else ""
                below = len(at.split(".")) if at else 0
                for pos, target in enumerate(v.split(",")):
                    for q, w, trail in leaves_of(target, depth + below):
                        path = q if not at else at if not q else f"{at}.{q}"
                        ranked.append((path, w, ((depth + below, pos), *trail)))
        return ranked

    best = {}
    for path, value, trail in resolve(doc, 0):
        if path not in best or trail > best[path][0]:
            best[path] = (trail, value)
    return {p: v for p, (_, v) in best.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_uses_match_the_plain_rule(spark, seed):
    """Random documents: nodes name earlier ones, at their root or below, singly or in lists."""
    rng = random.Random(seed)
    docs = {}
    for d in range(12):
        leaves = {}
        for i in range(9):
            for name in rng.sample(["a", "b.x", "b.y", "c.d.z"], rng.randint(1, 3)):
                leaves[f"n{i}.{name}"] = f"{i}{name}"
            if i and rng.random() < 0.8:
                at = rng.choice([f"n{i}", f"n{i}.b", f"n{i}.c.d"])
                leaves[f"{at}._use"] = ",".join(f"n{j}" for j in rng.sample(range(i), rng.randint(1, min(2, i))))
        docs[f"d{d}"] = leaves
    data = [(d, p, v) for d, leaves in docs.items() for p, v in leaves.items()]
    got = C.resolve_uses(spark.createDataFrame(data, "doc string, path string, value string")).collect()
    for d, leaves in docs.items():
        assert {r["path"]: r["value"] for r in got if r["doc"] == d} == plain_uses(leaves)


def test_an_empty_map_hides_values_but_not_the_map_below(spark, rows):
    data = [("d", "a.b", "1", 0), ("d", "a", "{}", 1), ("e", "a", "1", 0), ("e", "a", "{}", 1), ("f", "a", "{}", 0), ("f", "a.b", "2", 1), ("g", "a.b", "1", 0), ("g", "a", "5", 1), ("h", "a", "1", 0), ("h", "a", "{}", 1), ("h", "a.c", "2", 2)]
    got = C.deep_merge(spark.createDataFrame(data, "doc string, path string, value string, rank int"))
    assert rows(got, "doc", "path", "value") == [("d", "a.b", "1"), ("e", "a", "{}"), ("f", "a.b", "2"), ("g", "a", "5"), ("h", "a.c", "2")]


def test_texts_of_all_parts_stay_where_a_slice_failed(spark, rows):
    df = spark.createDataFrame([(1, i, i, int(i == 2), False, t) for i, t in enumerate("abcd")], SLICES)
    got = G.gather(df, ["k"], "idx", ["v"], rc="rc", texts=["out"], part_rows=2)
    assert rows(got, "part", "v", "rc", "out") == [(0, [], 1, "a\nb"), (1, [], 1, "c\nd")]


def test_effective_setting_skips_nulls(spark, rows):
    df = spark.createDataFrame([("k", 1, "low"), ("k", 3, None), ("k", 2, "mid"), ("n", 1, None)], "setting_key string, layer_rank int, value string")
    assert rows(C.effective(df)) == [("k", "mid", 2), ("n", None, None)]


def test_a_directory_is_rescued_whole(spark, rows):
    files = spark.createDataFrame([(1, "x.ms/table.dat"), (1, "x.ms/sub/a.dat"), (1, "out.ms/t"), (1, "log.txt")], "run int, path string")
    patterns = spark.createDataFrame([(1, "*.ms")], "run int, pattern string")
    outputs = spark.createDataFrame([(1, "./out.ms")], "run int, path string")
    assert rows(P.harvest_plan(files, patterns, outputs)) == [(1, "out.ms", True), (1, "x.ms", False)]
    there = spark.createDataFrame([("x.ms", True), ("out.ms", True)], "path string, is_dir boolean")
    assert rows(P.promote_plan(files, patterns, outputs, there)) == [(1, "log.txt", None, "leave"), (1, "out.ms/t", "out.ms", "replace"), (1, "x.ms/sub/a.dat", "x.ms", "refuse"), (1, "x.ms/table.dat", "x.ms", "refuse")]


def test_includes_merge_under_own_keys_and_rings_are_errors(spark, rows):
    data = [("base", "x", "1"), ("base", "m.a", "1"), ("more", "x", "2"), ("more", "_include", "deep"), ("deep", "z", "9"), ("top", "_include", "base,more"), ("top", "m.b", "own"), ("top", "n._include", "base"), ("top", "n.x", "mine")]
    got = C.resolve_includes(spark.createDataFrame(data, "doc string, path string, value string"))
    assert rows(got.where("doc = 'top'"), "path", "value") == [("m.a", "1"), ("m.b", "own"), ("n.m.a", "1"), ("n.x", "mine"), ("x", "2"), ("z", "9")]
    with pytest.raises(ValueError, match="ring"):
        C.resolve_includes(spark.createDataFrame([("a", "_include", "b"), ("b", "_include", "a")], "doc string, path string, value string"))


def test_gathered_rows_keep_one_shape(spark, rows):
    df = spark.createDataFrame(
        [("a", 0, 1, 0, False, "x"), ("a", 1, 2, 0, True, ""), ("b", 0, 3, 0, False, "y"), ("b", 1, 4, 7, False, None), ("b", 2, 5, 9, False, "z"), (None, 0, 6, 0, False, "n")],
        "k string, idx int, v int, rc int, on boolean, out string",
    )
    expected = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("c",)], "k string")
    got = G.gather_rows(df, ["k"], "idx", ["v"], rc="rc", flags=["on"], texts=["out"], expected=expected)
    assert rows(got.status, "k", "slices", "rc", "on") == sorted([("a", 2, 0, True), ("b", 3, 7, False), ("c", 0, 0, False), (None, 1, 0, False)], key=repr)
    assert rows(got.values) == sorted([("a", 0, 1), ("a", 1, 2), (None, 0, 6)], key=repr)
    assert rows(got.texts) == sorted([("a", 0, "out", "x"), ("b", 0, "out", "y"), ("b", 2, "out", "z"), (None, 0, "out", "n")], key=repr)
    plain = G.gather_rows(df, ["k"], "idx", ["v"])
    assert plain.status.columns == ["k", "slices"] and plain.values.count() == 6 and plain.texts.count() == 0
