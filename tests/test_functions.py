"""Scalar rules on hand-made values."""

import pytest
from pyspark.sql import functions as F

from runledger.functions import codes, names, paths, sizes
from runledger.plans.paths import ancestors, normalize


def values(spark, inputs, fn, ddl="v string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, {ddl}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_sizes(spark):
    given = ["200GB", "250 GiB", "2T", "1024", " 1.5k ", ".5MiB", "0", "12 parsecs", "-5", "", "1.2.3GB", None]
    want = [200 * 10**9, 250 * 2**30, 2 * 10**12, 1024, 1500, 2**19, 0, None, None, None, None, None]
    assert values(spark, given, sizes.parse_size) == want
    assert values(spark, given[7:], sizes.size_error) == ["unknown unit", "not a size", "not a size", "not a size", "missing"]


def test_format_size_rounds_halves_to_even(spark):
    given = [0, 1023, 1024, 1280, 1792, 1075, 270 * 2**30, 2**50, 2**60 + 2**49]
    steps = (("PiB", 2**50), ("TiB", 2**40), ("GiB", 2**30), ("MiB", 2**20), ("KiB", 2**10))
    want = [next((f"{n / s:.1f}{u}" for u, s in steps if n >= s), f"{n}B") for n in given]
    assert values(spark, given, sizes.format_size, "v bigint") == want


def test_six_significant_digits(spark):
    given = [4.0, 2.5, 0.1, 10.0, 123456.7, 999999.5, 1e6, 1234567.0, 0.00012345678, 1e-7, 0.0, 3.14159265]
    assert values(spark, given, sizes.format_g, "v double") == [f"{x:g}" for x in given]


def test_return_codes_and_status(spark):
    assert values(spark, [0, 3, -15, -9, -200], codes.explain_returncode, "v int") == ["0", "3", "-15 (SIGTERM)", f"-9 ({codes.OOM_NOTE})", "-200"]
    given = ["0\n".strip(), " 7 ", "RUNNING", "UNKNOWN", "-1", ""]
    assert values(spark, given, codes.run_status) == ["FINISHED (success)", "FINISHED (exit 7)", "RUNNING", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert values(spark, ["123;cluster", " 9 "], codes.job_id) == ["123", "9"]


def test_references(spark):
    hub = "registry-1.docker.io"
    given = ["alpine", "org/tool:1", "quay.io/a/b@sha256:x", "localhost:5000/t", "docker://reg:1/a:2", "oras://x/y"]
    got = values(spark, given, names.split_ref)
    assert [tuple(g) if g else None for g in got] == [
        (hub, "library/alpine", "latest"),
        (hub, "org/tool", "1"),
        ("quay.io", "a/b", "sha256:x"),
        ("localhost:5000", "t", "latest"),
        ("reg:1", "a", "2"),
        None,
    ]
    pinned = values(spark, ["a:1", "docker://h:5000/a:1", "h:5000/a@sha256:old"], lambda c: names.pin_ref(c, F.lit("sha256:new")))
    assert pinned == ["a@sha256:new", "docker://h:5000/a@sha256:new", "h:5000/a@sha256:new"]


def test_labels_and_names(spark):
    assert values(spark, ["r.a.b", "solo", "x."], names.display_label) == ["a.b", "solo", ""]
    assert values(spark, [" a \n b ", "x" * 12, "ab cd efgh ij"], lambda c: names.shorten(c, 9)) == ["a b", "xxxxxx...", "ab cd..."[:8]]
    assert values(spark, ["a==1", "a>=1", "a", "a===2 ", "a==1,<2"], names.is_unpinned) == [False, True, True, False, True]
    assert values(spark, ["2x", "for", "a-b", "ok"], names.sanitize) == ["_2x", "for_", "a_b", "ok"]
    assert values(spark, ["a_b.c-1", "a b", ""], names.is_safe_name) == [True, False, False]


def test_remotes_and_platforms(spark):
    got = values(spark, ["me@h:/d", "h:/d:e", "h", ":/d", "h:", "-o@h:/d"], names.parse_remote)
    assert [tuple(g) if g else None for g in got] == [("me@h", "/d"), ("h", "/d:e"), None, None, None, None]
    got = values(spark, ["x/glibc-2.39/3.12", "x/y", "x/y/z/w", "x/ /z"], names.parse_platform)
    assert [tuple(g) if g else None for g in got] == [("x", "glibc-2.39", "3.12"), None, None, None]


@pytest.mark.parametrize("a,b,want", [("/a", "/a/b", True), ("/a/b", "/a", True), ("/a", "/ab", False), ("/a/./b/", "/a//b", True), ("/a/../b", "/b", True), ("/", "/x", True)])
def test_overlap(spark, a, b, want):
    assert spark.range(1).select(paths.paths_overlap(F.lit(a), F.lit(b))).first()[0] is want


def test_path_helpers(spark):
    assert values(spark, ["/a/./b/../c/", "a//b", "./", "../x/..", "/../a"], normalize) == ["/a/c", "a/b", ".", "..", "/a"]
    assert values(spark, ["/a/b", "a/b", "/"], ancestors) == [["/", "/a", "/a/b"], ["a", "a/b"], ["/"]]
    assert values(spark, ["/a/b", "a", "/"], lambda c: ancestors(c, proper=True)) == [["/", "/a"], [], []]
    given = ["a/b/*.fits", "/x*", "*.fits", "../a/*", "a/[b]/c", "a/b/", "/d/e"]
    assert values(spark, given, paths.literal_prefix) == ["a/b", "/", None, None, "a", "a", "/d"]
    rel = values(spark, ["/w/a", "/w", "/wx", "b"], lambda c: paths.relativize(c, F.lit("/w/")))
    assert rel == ["a", ".", "/wx", "b"]


def test_paths_with_one_spelling_are_told(spark):
    """The pattern and the fold agree on every short path of a few parts."""
    import itertools
    import posixpath

    from runledger.plans.paths import FOLDABLE, normalize

    paths = ["".join(p) for n in range(0, 7) for p in itertools.product(["/", ".", "a"], repeat=n)] + ["/..a/.b", "a..b/c.", "/" + "x/" * 30 + "..", "...", "/a\nb/"]
    want = {p: "/" + posixpath.normpath(p).lstrip("/") if p.startswith("/") else posixpath.normpath(p) for p in paths}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", normalize(F.col("p")).alias("n"), (~F.col("p").rlike(FOLDABLE)).alias("plain")).collect()
    for r in rows:
        assert r.n == want[r.p], r
        assert not r.plain or r.n == r.p
    assert sum(r.plain for r in rows) > 50
