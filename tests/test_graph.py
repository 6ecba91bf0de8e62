"""Graph, key and version rules on small pipelines."""

import random

import pytest
from pyspark.sql import functions as F

from runledger.operators import aggregates as A
from runledger.operators import graph as G
from runledger.operators import versions as V
from runledger.operators import windows as W
from runledger.operators.joins import resolve_wiring
from runledger.operators.loops import body_errors, unroll_steps
from runledger.operators.validate import nested_resources, validate_graph
from runledger.plans import scan
from runledger.plans.pointers import chase

EDGES = "recipe int, src int, dst int"


def test_cycles_without_their_tails(spark, rows):
    ring = [(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4), (1, 0, 1), (1, 4, 5)]
    two_joined_by_a_path = [(2, 1, 2), (2, 2, 1), (2, 2, 3), (2, 3, 4), (2, 4, 5), (2, 5, 4)]
    itself = [(3, 7, 7), (3, 7, 8)]
    got = rows(G.find_cycles(spark.createDataFrame(ring + two_joined_by_a_path + itself, EDGES)))
    assert got == [(1, 1, 3), (1, 2, 3), (1, 3, 3), (2, 1, 2), (2, 2, 2), (2, 4, 5), (2, 5, 5), (3, 7, 7)]


def test_no_cycle(spark):
    assert G.find_cycles(spark.createDataFrame([(1, 1, 2), (1, 1, 3)], EDGES)).isEmpty()


def test_levels_stop_at_a_cycle_and_ignore_strangers(spark, rows):
    nodes = spark.createDataFrame([(1, i) for i in range(1, 7)], "recipe int, idx int")
    edges = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 3), (1, 4, 5), (1, 5, 4), (1, 5, 6), (1, 99, 1)], EDGES)
    assert rows(G.topo_levels(nodes, edges)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, None), (1, 5, None), (1, 6, None)]


def test_failure_blocks_downstream_only(spark, rows):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 4, 3), (1, 4, 5)], EDGES)
    assert rows(G.blocked(edges, spark.createDataFrame([(1, 1)], "recipe int, idx int"))) == [(1, 2), (1, 3)]


def keys_of(spark, image="i", value="/d", fingerprint="f", mutated=False, sibling="s", wired=True):
    steps = spark.createDataFrame([(1, 1, image, "cal", None), (1, 2, "i", "image", None), (1, 3, "i", sibling, None)], "recipe int, idx int, image string, identity string, venv string")
    params = spark.createDataFrame(
        [(1, 1, "ms", value, True, mutated, False, fingerprint), (1, 2, "n", "3", False, False, False, None)],
        "recipe int, idx int, field string, value string, is_path boolean, mutated boolean, wired boolean, fingerprint string",
    )
    wiring = spark.createDataFrame([(1, 2, "vis", 0, 1 if wired else 3)], "recipe int, idx int, field string, pos int, src int")
    return {r.idx: r.key for r in G.step_keys(G.own_digest(steps, params), wiring).collect()}


def test_which_change_flips_which_key(spark):
    base = keys_of(spark)
    assert len(set(base.values())) == 3

    def flipped(**change):
        return {i for i, k in keys_of(spark, **change).items() if k != base[i]}

    assert flipped() == set()
    assert flipped(image="j") == {1, 2}
    assert flipped(fingerprint="g") == {1, 2}
    assert flipped(value="/e") == {1, 2}  # a copy elsewhere is another input
    assert flipped(fingerprint=None) == {1, 2}
    assert flipped(sibling="t") == {3}  # a sibling's change is nobody else's
    assert flipped(wired=False) == {2}
    inside = keys_of(spark, mutated=True)
    assert inside == keys_of(spark, mutated=True, fingerprint="g")  # rewritten in place: by path only


def test_two_missing_paths_differ(spark):
    assert keys_of(spark, value="/no1", fingerprint=None)[1] != keys_of(spark, value="/no2", fingerprint=None)[1]


def test_combined_key_is_null_only_if_all_are(spark, rows):
    df = spark.createDataFrame([(1, 0, None), (1, 1, None), (2, 0, "a"), (2, 1, None), (3, 0, None), (3, 1, "a")], "g int, pos int, key string")
    got = dict(rows(A.combine_keys(df, ["g"], "key", "pos")))
    assert got[1] is None and got[2] and got[3] and got[2] != got[3]


def test_pointers_end_at_the_last_and_rings_nowhere(spark, rows):
    data = [(i, i + 1) for i in range(37)] + [(100, 101), (101, 100), (102, 100), (200, 201)]
    got = dict(rows(chase(spark.createDataFrame(data, "k int, t int"), ["k"], ["t"])))
    assert all(got[i] == 37 for i in range(37))
    assert got[100] is None and got[101] is None and got[102] is None and got[200] == 201


def test_versions_compare_as_numbers(spark, rows):
    df = spark.createDataFrame([(1, "v1.9"), (1, "v1.10"), (1, "v1.10.0rc1"), (1, "main"), (2, "v2"), (2, "v2.0.0"), (2, "v1.99"), (3, "x")], "g int, tag string")
    assert rows(A.latest_version(df, ["g"])) == [(1, "v1.10"), (2, "v2.0.0")]


def evicted(chains, generations, consumed, target):
    """The rule as a loop: superseded newest first chain by chain, then dead ones by age."""
    live = {c for c, _h, _t, alive in chains if alive}
    held = {h for c, h, _t, alive in chains if alive} | {t for c, _h, t, alive in chains if alive} | {n for c, n in consumed if c in live}
    first = [(n, s) for c in sorted(live) for cc, _p, n, s, there, _a in sorted(generations, key=lambda g: -g[1]) if cc == c and there and n not in held]
    dead = sorted((a, n, s) for c, _p, n, s, there, a in generations if c not in live and there and n not in held)
    out, seen, freed = [], set(), 0
    for name, size in first + [(n, s) for _a, n, s in dead]:
        if freed >= target:
            break
        if name not in seen:
            seen.add(name)
            out.append(name)
            freed += size
    return out


@pytest.mark.parametrize("seed", range(4))
def test_eviction_matches_the_loop(spark, seed):
    rng = random.Random(seed)
    chains = [(c, f"g{c}_9", rng.choice([None, f"g{c}_2"]), rng.random() < 0.6) for c in range(6)]
    generations = [(c, p, rng.choice([f"g{c}_{p}", f"g{c}_{p}", f"shared{p}"]), rng.randint(0, 50), rng.random() < 0.8, p * 10 + c) for c in range(6) for p in range(10)]
    # A shared name has one size; the first place it is met decides the order.
    sizes = {}
    generations = [(c, p, n, sizes.setdefault(n, s), there, a) for c, p, n, s, there, a in generations]
    consumed = [(c, f"g{c}_{rng.randint(0, 9)}") for c in range(6)]
    target = rng.choice([0, 100, 500, 10_000])
    plan = V.evict_plan(
        spark.createDataFrame(chains, "chain int, head string, tainted_through string, alive boolean"),
        spark.createDataFrame(generations, "chain int, pos int, name string, size int, present boolean, age int"),
        spark.createDataFrame(consumed, "chain int, name string"),
        target,
        chain_span=2,
        pos_span=3,
    )
    got = [r.name for r in plan.orderBy("phase", "major", "minor", "name", "size").collect()]
    assert got == evicted(chains, generations, consumed, target)


def test_restore_decisions(spark, rows):
    chains = spark.createDataFrame(
        [(1, "g2", "trusted", None, None), (2, "g2", "trusted", None, "g1"), (3, "g2", "untrusted", None, "g1"), (4, "g2", "trusted", "run", None), (5, "g2", "trusted", None, "lost")],
        "chain int, head string, status string, marker_run string, tainted_through string",
    )
    generations = spark.createDataFrame([(c, p, f"g{p}") for c in range(1, 6) for p in range(3)], "chain int, pos int, name string")
    required = spark.createDataFrame([(1, "g2"), (1, "g1"), (1, "g9"), (2, "g1"), (2, "g2"), (3, "g0"), (4, "g2"), (5, "g1"), (6, "g1"), (1, None)], "chain int, name string")
    snapshots = spark.createDataFrame([("g0",), ("g1",), ("g2",)], "name string")
    assert rows(V.restore_plan(chains, generations, required, snapshots)) == [
        (1, "g1", "restore"), (1, "g2", "noop"), (1, "g9", "missing"), (1, None, "noop"), (2, "g1", "refuse: tainted"), (2, "g2", "noop"),
        (3, "g0", "forced: discards work"), (4, "g2", "forced"), (5, "g1", "refuse: tainted"), (6, "g1", "noop"),
    ]


def test_propagation_follows_wires(spark, rows):
    outputs = spark.createDataFrame([(1, 1, "o", None), (1, 2, "o", "d"), (1, 3, "o", None), (1, 4, "o", "d")], "recipe int, idx int, field string, default string")
    inputs = spark.createDataFrame([(1, 1, "o", "c"), (1, 2, "o", "hidden")], "recipe int, idx int, field string, value string")
    wiring = spark.createDataFrame([(1, 2, "o", 1, "o"), (1, 3, "o", 2, "o"), (1, 3, "p", 9, "o")], "recipe int, idx int, field string, src int, src_field string")
    known = G.propagate_static(outputs, inputs, wiring)
    assert rows(known, "idx", "value") == [(1, "c"), (2, "c"), (3, "c"), (4, "d")]
    assert rows(G.unresolved_inputs(wiring, known), "idx", "field", "src") == [(3, "p", 9)]


def test_tree_fingerprint_ignores_order_but_nothing_else(spark):
    schema = "root string, relpath string, mtime bigint, size bigint"

    def digest(files, status=None):
        roots = spark.createDataFrame([("r", status)], "root string, status string")
        return A.tree_fingerprint(spark.createDataFrame(files, schema), roots).first().fingerprint

    base = [("r", "a", 1, 2), ("r", "b", 3, 4)]
    assert digest(base) == digest(base[::-1])
    others = [digest([("r", "a", 1, 2)]), digest([("r", "a", 1, 2), ("r", "b", 3, 5)]), digest([("r", "a", 3, 2), ("r", "b", 1, 4)]), digest([]), digest(base, "unreadable")]
    assert len({digest(base), *others}) == 6
    assert digest(base, "missing") is None


def test_declarations_that_cannot_stand(spark, rows):
    steps = spark.createDataFrame([(1, "a", "recipe", 2.0, None, None), (1, "b", "tool", 2.0, None, None), (1, "c", "recipe", None, True, None), (1, "d", "recipe", None, False, None)], "recipe int, step string, kind string, cpus double, cpus_all boolean, memory bigint")
    assert rows(nested_resources(steps)) == [(1, "a"), (1, "c")]
    body = spark.createDataFrame([(1, "x", True, True), (1, "y", False, False)], "loop int, sub string, scattered boolean, nested boolean")
    assert rows(body_errors(body)) == [(1, "x", "body step is a nested recipe"), (1, "x", "body step is scattered")]


def test_single_step_loop_bodies_have_no_inner_name(spark, rows):
    loops = spark.createDataFrame([("cal", 3, "done", "n")], "loop string, max_iter int, until string, index_input string")
    body = spark.createDataFrame([("cal", "")], "loop string, sub string")
    outputs = spark.createDataFrame([("cal", "done", "", "done")], "loop string, field string, sub string, sub_field string")
    wiring = spark.createDataFrame([], "loop string, sub string, src_kind string")
    got = unroll_steps(loops, body, wiring, outputs)
    assert rows(got, "step", "prev_step", "after") == [("cal.1", None, None), ("cal.2", "cal.1", "cal.1"), ("cal.3", "cal.2", "cal.2")]


def test_step_names_use_no_row_order(spark):
    df = spark.range(3).select(F.lit(1).alias("recipe"), F.col("id").alias("idx"), (2 - F.col("id")).alias("level"))
    assert [r.idx for r in G.in_topological_order(df).collect()] == [2, 1, 0]


def test_eviction_splits_one_age_of_like_names(spark):
    """Dead generations of one age whose names begin alike are scanned in many ranges, and the totals are those of one."""
    n = 20_000
    chains = spark.createDataFrame([(1, False, "h", None)], "chain long, alive boolean, head string, tainted_through string")
    generations = spark.range(n).select(F.lit(1).cast("bigint").alias("chain"), F.col("id").alias("pos"), F.concat(F.lit("same-prefix-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), (F.col("id") % 7 + 1).alias("size"), F.lit(True).alias("present"), F.lit(3).cast("bigint").alias("age"))
    consumed = spark.createDataFrame([], "chain long, step_path string, field string, name string")
    plan = V.evict_plan(chains, generations, consumed, 10**9)
    rows = sorted((r.name, r.freed_before) for r in plan.collect())
    total = 0
    for i, (name, before) in enumerate(rows):
        assert name.endswith(f"{i:06d}") and before == total
        total += i % 7 + 1
    assert len(rows) == n


@pytest.mark.parametrize("seed", range(3))
def test_chains_roll_back_as_a_loop_says(spark, rows, seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(5)]
    chains, generations, want = [], [], []
    for c in range(12):
        names = [f"{rng.choice(keys)}__{rng.randint(0, 3)}" if rng.random() < 0.8 else f"plain{rng.randint(0, 3)}" for _ in range(rng.randint(1, 12))]
        places = sorted(rng.sample(range(100), len(names)))
        generations += [(c, p, n) for p, n in zip(places, names)]
        head = rng.choice([names[-1], names[0], None])
        if rng.random() < 0.9:
            chains.append((c, head))
        for k in keys:
            mine = [n for n in names if n.startswith(f"{k}__")]
            stay = [n for n in names if not n.startswith(f"{k}__")]
            if mine:
                known = head if any(x[0] == c for x in chains) else None
                want.append((f"s{k}", c, len(mine), (stay[-1] if stay else None) if known in mine else known))
    entries = spark.createDataFrame([(f"s{k}", k) for k in keys] + [("none", None)], "step_path string, cache_key string")
    got = V.invalidate_chains(entries, spark.createDataFrame(generations, "chain int, pos int, name string"), spark.createDataFrame(chains, "chain int, head string"), span=3)
    assert rows(got, "invalidated", "chain", "n_dropped", "new_head") == sorted(want, key=repr)


def random_recipes(spark, seed):
    """Nodes and edges of recipes of up to 12 steps, with cycles, strangers, repeats and nulls."""
    rng = random.Random(seed)
    nodes, edges = [(None, 1), (1, None)], [(None, 1, 1), (1, None, 2), (2, 1, None)]
    for recipe in range(1, 40):
        n = rng.randint(1, 12)
        nodes += [(recipe, i) for i in range(n)]
        edges += [(recipe, rng.randint(0, n), rng.randint(0, n)) if rng.random() < 0.1 else (recipe, *sorted((rng.randint(0, n), rng.randint(0, n + 1)))) for _ in range(rng.randint(0, 2 * n))]
    return spark.createDataFrame(nodes, "recipe int, idx int"), spark.createDataFrame(edges, EDGES)


def no_rounds(*_):
    raise AssertionError("a small recipe is settled where it is")


def test_levels_of_small_and_large_recipes_agree(spark, rows, monkeypatch):
    nodes, edges = random_recipes(spark, 5)
    with monkeypatch.context() as m:
        m.setattr(G, "Rounds", no_rounds)
        small = rows(G.topo_levels(nodes, edges))
    assert {level for *_, level in small} >= {None, 0, 1, 2}
    for bound in (0, 12):
        monkeypatch.setattr(G, "SMALL_ROWS", bound)
        assert rows(G.topo_levels(nodes, edges)) == small


def test_keys_of_small_and_large_recipes_agree(spark, rows, monkeypatch):
    nodes, edges = random_recipes(spark, 6)
    digest = F.sha2(F.concat_ws("-", "recipe", "idx"), 256)
    # Own parts that are no digests are texts as any other, upper-case digits too.
    text = F.when(F.col("idx") % 5 == 0, F.upper(digest)).when(F.col("idx") % 5 == 1, F.lit("")).when(F.col("idx") % 5 != 2, digest)
    own = nodes.dropna().withColumn("own", text)
    wiring = edges.select("recipe", F.col("dst").alias("idx"), F.concat(F.lit("f"), F.col("src") % 3).alias("field"), F.when(F.col("src") % 2 == 0, F.col("src")).alias("pos"), "src")
    with monkeypatch.context() as m:
        m.setattr(G, "Rounds", no_rounds)
        small = rows(G.step_keys(own, wiring))
    assert len({key for *_, key in small}) > 100
    for bound in (0, 12):
        monkeypatch.setattr(G, "SMALL_ROWS", bound)
        assert rows(G.step_keys(own, wiring)) == small


def test_batches_of_small_and_large_recipes_agree(spark, rows, monkeypatch):
    nodes, edges = random_recipes(spark, 7)
    deps = edges.select("recipe", F.col("dst").alias("idx"), (F.col("src") % 2).alias("dep"))
    steps, chunk = nodes.where("recipe is not null and idx is not null"), [F.floor(F.col("idx") / 4)]
    with monkeypatch.context() as m:
        m.setattr(W, "ordered_scan", no_rounds)
        small = rows(W.batches(steps, deps, ["recipe"], "idx", chunk))
    held = {}
    for recipe, idx, dep in rows(deps):
        held.setdefault((recipe, idx), set()).add(dep)
    want, last = [], {}
    for recipe, idx in sorted((r.recipe, r.idx) for r in steps.collect()):
        batch, before = last.get(recipe, (0, None))
        now = held.get((recipe, idx), set())
        last[recipe] = (batch + (now != before), now)
        want.append((recipe, idx, last[recipe][0]))
    assert small == sorted(want, key=repr)
    monkeypatch.setattr(scan, "WHOLE_ROWS", 3)
    assert rows(W.batches(steps, deps, ["recipe"], "idx", chunk)) == small


def test_references_are_judged_by_every_scope_of_a_name(spark, rows):
    steps = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 1), (2, "b", None)], "recipe int, step string, scope int")
    wiring = spark.createDataFrame(
        [(1, "b", "x", "output", "a", "out"), (1, "b", "y", "output", "a", "no"), (1, "b", "x", "output", "z", "out"), (1, "b", None, "output", None, "out"), (2, "b", "x", "input", None, "rin")],
        "recipe int, step string, field string, src_kind string, src_step string, src_field string",
    )
    inputs = spark.createDataFrame([(1, "x")], "scope int, field string")
    outputs = spark.createDataFrame([(2, "out")], "scope int, field string")
    after = spark.createDataFrame([(1, "b", "b"), (1, "b", "a"), (1, "b", "q"), (1, "b", None)], "recipe int, step string, after string")
    params = spark.createDataFrame([(1, "a", "x"), (1, "gone", "x"), (1, "b", None)], "recipe int, step string, field string")
    recipe_inputs = spark.createDataFrame([(1, "rin")], "recipe int, field string")
    audit = validate_graph(steps, wiring, inputs, outputs, recipe_inputs, after, params, params.limit(0))
    assert rows(audit) == sorted(
        [
            (1, "a", "duplicate name", "a"), (1, "b", "after itself", "b"), (1, "b", "unknown after", "q"), (1, "b", "unknown constant", None), (1, "b", "unknown input", "y"),
            (1, "b", "unknown input", None), (1, "b", "unknown output", "a.no"), (1, "b", "unknown step", "z"), (1, "b", "unknown step", None), (2, "b", "unknown input", "x"), (2, "b", "unknown recipe input", "rin"),
        ],
        key=repr,
    )
    # Steps are met by the references once, by whatever the rule.
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Left") == 3, plan


def test_constants_give_way_to_wires_without_a_further_pass(spark, rows):
    params = spark.createDataFrame([(1, 1, "x", "a"), (1, 1, "y", "b"), (1, 2, "x", "c")], "recipe int, step int, field string, value string")
    wiring = spark.createDataFrame(
        [(1, 2, "x", 0, "input", None, "rin"), (1, 2, "x", 1, "output", "1", "out"), (1, 2, "z", None, "output", "9", "out")],
        "recipe int, step int, field string, pos int, src_kind string, src_step string, src_field string",
    )
    inputs = spark.createDataFrame([(1, "rin", "i")], "recipe int, field string, value string")
    outputs = spark.createDataFrame([(1, "1", "out", "o")], "recipe int, step string, field string, value string")
    resolved = resolve_wiring(params, wiring, inputs, outputs)
    assert rows(resolved) == sorted(
        [(1, 2, "x", 0, "i", "wired"), (1, 2, "x", 1, "o", "wired"), (1, 2, "z", None, None, "wired"), (1, 1, "x", None, "a", "constant"), (1, 1, "y", None, "b", "constant")], key=repr
    )
    assert "Aggregate" not in resolved._jdf.queryExecution().optimizedPlan().toString()
