"""Ordered scans and access order against plain loops of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from runledger.operators.windows import access_order, access_order_within, converge
from runledger.plans.scan import FirstAfter, LastBefore, RowNumber, SumBefore, ordered_scan


def expected_scan(data):
    out = []
    for key in {k for k, _p, _v in data}:
        mine = sorted((p, v) for k, p, v in data if k == key)
        for i, (p, v) in enumerate(mine):
            before = [x for _, x in mine[:i] if x is not None]
            after = [x for _, x in mine[i + 1 :] if x is not None]
            out.append((key, p, v, i + 1, sum(before), before[-1] if before else None, after[0] if after else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span,coarse", [(1, None), (7, None), (1000, None), (3, 2)])
def test_scan_matches_a_loop_for_any_chunk(spark, rows, span, coarse):
    rng = random.Random(span)
    data = [(k, p, rng.choice([None, rng.randint(1, 9)])) for k in range(4) for p in rng.sample(range(100), 5 + 20 * k)]
    df = spark.createDataFrame(data, "k int, p int, v int")
    got = ordered_scan(
        df,
        ["k"],
        ["p"],
        [F.floor(F.col("p") / span)],
        {"n": RowNumber(), "s": SumBefore(F.col("v")), "l": LastBefore(F.col("v")), "f": FirstAfter(F.col("v"))},
        coarse=None if coarse is None else lambda c: [F.floor(c[0] / coarse)],
    )
    assert rows(got) == expected_scan(data)


def test_global_scan_has_no_key(spark, rows):
    df = spark.createDataFrame([(i, 1) for i in range(50)], "p int, v int")
    got = ordered_scan(df, [], ["p"], [F.floor(F.col("p") / 8)], {"s": SumBefore(F.col("v"))})
    assert rows(got, "p", "s") == sorted(((i, i) for i in range(50)), key=repr)


def overlap(a, b):
    return a == b or a.startswith(b + "/") or b.startswith(a + "/")


def order_edges(accesses, contains):
    """The rule as it reads: a state per path, fed one access at a time."""
    last, readers, edges = {}, {}, set()
    for step, path, mutates in accesses:
        touched = [q for q in last if (overlap(path, q) if contains else path == q)]
        for q in touched:
            if mutates and readers[q]:
                edges |= {(step, r) for r in readers[q]}
            elif last[q] is not None:
                edges.add((step, last[q]))
        last.setdefault(path, None)
        readers.setdefault(path, [])
        if mutates:
            for q in {*touched, path}:
                last[q], readers[q] = step, []
        else:
            readers[path].append(step)
    return {(s, d) for s, d in edges if s != d}


def random_accesses(rng, steps, nested):
    names = ["/a", "/a/b", "/a/b/c", "/d", "/a/e", "/ab"] if nested else ["x", "y", "z"]
    out = []
    for step in range(steps):
        for path in rng.sample(names, rng.choice([1, 1, 2])):
            out.append((step, path, rng.random() < 0.4))
        if rng.random() < 0.1:  # one step that reads and rewrites one path
            out.append((step, out[-1][1], not out[-1][2]))
    return out


@pytest.mark.parametrize("nested", [False, True])
def test_access_order_matches_the_loop(spark, nested):
    rng = random.Random(5)
    recipes = {r: random_accesses(rng, 14, nested) for r in range(60)}
    spell = lambda p: p if not nested else rng.choice([p, f"/.{p}", re.sub("^/a(?=/|$)", "/a/x/..", p), f"{p}/"])
    data = [(r, pos, step, spell(path), mutates) for r, accesses in recipes.items() for pos, (step, path, mutates) in enumerate(accesses)]
    df = spark.createDataFrame(data, "recipe int, pos int, step int, path string, mutates boolean")
    chunk = [F.floor(F.col("pos") / 4)]
    if nested:
        edges = access_order_within(df, ["recipe"], "pos", chunk)
    else:
        edges = access_order(df, ["recipe", "path"], ["pos"], chunk).select("recipe", "step", "dep").distinct()
    got = {tuple(r) for r in edges.collect()}
    assert got == {(r, *e) for r, accesses in recipes.items() for e in order_edges(accesses, nested)}


def test_converge_keeps_rows_without_a_loop(spark, rows):
    df = spark.createDataFrame([(None, 1, True, "a"), (None, 2, False, "b")], "loop int, k int, done boolean, out string")
    assert rows(converge(df, ["loop"], ["k"], "done", ["out"]), "k", "skipped", "out") == [(1, False, "a"), (2, True, "a")]


def test_converge_early_never_and_at_once(spark, rows):
    data = [(1, k, k >= 3, f"m{k}") for k in range(1, 6)] + [(2, k, False, f"m{k}") for k in range(1, 4)] + [(3, 1, True, "m1"), (3, 2, None, "m2")]
    df = spark.createDataFrame(data, "loop int, k int, done boolean, out string")
    got = rows(converge(df, ["loop"], ["k"], "done", ["out"]), "loop", "k", "skipped", "out")
    assert got == sorted(
        [(1, 1, False, "m1"), (1, 2, False, "m2"), (1, 3, False, "m3"), (1, 4, True, "m3"), (1, 5, True, "m3")]
        + [(2, k, False, f"m{k}") for k in range(1, 4)]
        + [(3, 1, False, "m1"), (3, 2, True, "m1")],
        key=repr,
    )


def test_one_hot_key_is_spread_over_tasks(spark):
    """Two thirds of the rows share a key; no task may hold more than a part of them."""
    df = spark.range(60_000).select((F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered_scan(df, ["k"], ["p"], [F.floor(F.col("p") / 500)], {"n": RowNumber()}).where("k = 0")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("t")).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 20_000
        assert got.agg(F.max("n"), F.count_distinct("n")).first()[:] == (40_000, 40_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
