"""Dependency-graph rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.base import query
from runledger.catalog.ledger import GROUP_SHA, enc
from runledger.operators import graph as G
from runledger.operators import loops as L

# Levels the SQL statement of `step_keys` is unrolled to; it raises where there are more.
DEPTH = 24


@query(
    "recipe_edges",
    "GR1",
    """
    with n as (select distinct recipe, step from steps), a as (select recipe, step, concat('s', scope % 7) as after from steps where scope % 6 = 0),
    e as (select recipe, src_step as src, step as dst, 'data' as kind from wiring where src_step is not null
          union select recipe, after, step, 'order' from a where (recipe, after, step) not in (select recipe, src_step, step from wiring where src_step is not null))
    select * from e where (recipe, src) in (from n)""",
)
def _(t):
    after = t.steps.where("scope % 6 = 0").select("recipe", "step", F.concat(F.lit("s"), (F.col("scope") % 7).cast("string")).alias("after"))
    return G.build_edges(t.steps, t.wiring, after)


@query(
    "topo_levels",
    "GR2 ST2",
    """
    with recursive walk as (select recipe, idx, 0 as level from steps union select d.recipe, d.dst, w.level + 1 from walk w join dag d on d.recipe = w.recipe and d.src = w.idx)
    select recipe, idx, max(level) as level from walk group by 1, 2""",
)
def _(t):
    return G.in_topological_order(G.topo_levels(t.steps, t.dag))


@query("declared_order", "ST1", "select recipe, step, idx from steps")
def _(t):
    return G.in_declaration_order(t.steps.select("recipe", "step", "idx"))


@query(
    "cycle_nodes",
    "GR3",
    """
    with recursive r as (select distinct recipe, src, dst from edges union select r.recipe, r.src, e.dst from r join edges e on e.recipe = r.recipe and e.src = r.dst),
    c as (select a.recipe, a.src as node, max(a.dst) as cycle from r a join r b on b.recipe = a.recipe and b.src = a.dst and b.dst = a.src group by 1, 2)
    select * from c""",
)
def _(t):
    return G.find_cycles(t.edges)


@query(
    "blocked_steps",
    "GR4",
    """
    with recursive f as (select run_id as recipe, idx from step_records where returncode = 3),
    b as (select d.recipe, d.dst as idx from f join dag d on d.recipe = f.recipe and d.src = f.idx union select d.recipe, d.dst from b join dag d on d.recipe = b.recipe and d.src = b.idx)
    select * from b where (recipe, idx) not in (from f)""",
)
def _(t):
    failed = t.step_records.where("returncode = 3").select(F.col("run_id").alias("recipe"), "idx")
    return G.blocked(t.dag, failed)


@query(
    "upstream_lineage",
    "GR5",
    """
    with recursive s as (select recipe, idx from steps where scope % 20 = 0),
    u as (select d.recipe, s.idx as of, d.src as idx from s join dag d on d.recipe = s.recipe and d.dst = s.idx union select d.recipe, u.of, d.src from u join dag d on d.recipe = u.recipe and d.dst = u.idx)
    select * from u""",
)
def _(t):
    return G.lineage(t.dag, t.steps.where("scope % 20 = 0").select("recipe", "idx"))


@query(
    "downstream_impact",
    "GR5",
    """
    with recursive s as (select recipe, idx from steps where scope % 20 = 1),
    u as (select d.recipe, s.idx as of, d.dst as idx from s join dag d on d.recipe = s.recipe and d.src = s.idx union select d.recipe, u.of, d.dst from u join dag d on d.recipe = u.recipe and d.src = u.idx)
    select * from u""",
)
def _(t):
    return G.lineage(t.dag, t.steps.where("scope % 20 = 1").select("recipe", "idx"), "downstream")


def _key_levels() -> str:
    """One pair of CTEs per level: what a level reads, and its keys."""
    parts = []
    for k in range(1, DEPTH):
        before = " union all ".join(f"from k{j}" for j in range(k))
        parts.append(
            f"""u{k} as (select recipe, idx, {GROUP_SHA} as up from (select e.recipe, e.dst as idx, sha256({enc("'x'", "null", "p.key")}) as h
                from dag e join lv on lv.recipe = e.recipe and lv.idx = e.dst and lv.level = {k} join ({before}) p on p.recipe = e.recipe and p.idx = e.src where p.key is not null) x group by 1, 2),
            k{k} as (select o.recipe, o.idx, case when own is not null then sha256({enc("own", "up")}) end as key from own o join lv on lv.recipe = o.recipe and lv.idx = o.idx and lv.level = {k}
                left join u{k} u on u.recipe = o.recipe and u.idx = o.idx)"""
        )
    return ",\n".join(parts)


@query(
    "step_keys",
    "GR6",
    f"""
    with recursive walk as (select recipe, idx, 0 as level from steps union select d.recipe, d.dst, w.level + 1 from walk w join dag d on d.recipe = w.recipe and d.src = w.idx),
    lv as (select recipe, idx, max(level) as level from walk group by 1, 2),
    prm as (select recipe, idx, 'ms' as field, concat('/d/', l_suppkey) as value, case when scope % 3 = 0 then concat('fp', scope % 2) when scope % 3 = 1 and l_suppkey % 2 = 0 then 'absent'
              when scope % 3 = 1 then concat('fp', scope % 2) end as content from steps union all select recipe, idx, 'n', cast(l_quantity::bigint as varchar), null from steps),
    pd as (select recipe, idx, {GROUP_SHA} as params from (select recipe, idx, sha256({enc("field", "value", "case when field = 'ms' then content end")}) as h from prm) x group by 1, 2),
    own as (select s.recipe, s.idx, case when s.scope % 50 <> 0 then sha256({enc("concat('img', s.scope % 5)", "concat('tool', s.scope)", "case when s.scope % 9 = 0 then 'env' end", "pd.params")}) end as own
            from steps s join pd on pd.recipe = s.recipe and pd.idx = s.idx),
    k0 as (select o.recipe, o.idx, case when own is not null then sha256({enc("own", "null")}) end as key from own o join lv on lv.recipe = o.recipe and lv.idx = o.idx and lv.level = 0),
    {_key_levels()}
    {" union all ".join(f"select * from k{j}" for j in range(DEPTH))}
    union all select recipe, idx, error('deeper than the statement') from lv where level >= {DEPTH}""",
)
def _(t):
    scope = F.col("scope")
    ms = F.struct(
        F.lit("ms").alias("field"),
        F.concat(F.lit("/d/"), F.col("l_suppkey").cast("string")).alias("value"),
        F.lit(True).alias("is_path"),
        (scope % 3 == 2).alias("mutated"),
        F.lit(False).alias("wired"),
        F.when((scope % 3 == 0) | (F.col("l_suppkey") % 2 == 1), F.concat(F.lit("fp"), (scope % 2).cast("string"))).alias("fingerprint"),
    )
    n = F.struct(
        F.lit("n").alias("field"), F.col("l_quantity").cast("bigint").cast("string").alias("value"),
        F.lit(False).alias("is_path"), F.lit(False).alias("mutated"), F.lit(False).alias("wired"), F.lit(None).cast("string").alias("fingerprint"),
    )
    # Both in one pass, so that a step's entries meet before they are moved.
    params = t.steps.select("recipe", "idx", F.inline(F.array(ms, n)))
    declared = t.steps.select(
        "recipe", "idx", "scope", F.concat(F.lit("img"), (scope % 5).cast("string")).alias("image"), F.concat(F.lit("tool"), scope.cast("string")).alias("identity"), F.when(scope % 9 == 0, F.lit("env")).alias("venv")
    )
    own = G.own_digest(declared, params, carry=["scope"])
    own = own.select("recipe", "idx", F.when(scope % 50 != 0, F.col("own")).alias("own"))
    wiring = t.dag.select("recipe", F.col("dst").alias("idx"), F.lit("x").alias("field"), F.lit(None).cast("int").alias("pos"), "src")
    return G.step_keys(own, wiring)


NEST = """
    select path, field, src_path, src_field from (
      select concat('r', cast(o_custkey as varchar(20))) as path, concat('o', cast(o_orderkey as varchar(20))) as field,
             concat('r', cast(o_custkey as varchar(20)), '.a', cast(o_orderkey % 3 as varchar(20))) as src_path, concat('m', cast(o_orderkey as varchar(20))) as src_field from orders
      union all
      select concat('r', cast(o_custkey as varchar(20)), '.a', cast(o_orderkey % 3 as varchar(20))), concat('m', cast(o_orderkey as varchar(20))),
             concat('r', cast(o_custkey as varchar(20)), '.a', cast(o_orderkey % 3 as varchar(20)), '.leaf', cast(o_orderkey % 4 as varchar(20))), 'ms' from orders where o_orderkey % 5 <> 0) n"""


@query(
    "output_keys",
    "GR7",
    """
    with o as (select o_orderkey as k, concat('r', o_custkey) as path, concat('r', o_custkey, '.a', o_orderkey % 3) as mid from orders)
    select path, concat('o', k) as field, case when k % 5 <> 0 then concat(mid, '.leaf', k % 4) else mid end as leaf, case when k % 5 <> 0 then 'ms' else concat('m', k) end as leaf_field,
           case when k % 5 <> 0 and k % 4 <> 3 then concat('key-', mid, '.leaf', k % 4) end as key from o""",
)
def _(t):
    wiring = t.sql(NEST)
    leaves = wiring.where("src_field = 'ms' and not src_path like '%leaf3'").select(F.col("src_path").alias("path"), F.concat(F.lit("key-"), "src_path").alias("key")).distinct()
    return G.output_keys(wiring.where("field like 'o%'"), wiring, leaves)


LOOPS = "select c_custkey as loop, c_nationkey % 5 as max_iter, case when c_custkey % 10 = 9 then 'nope' when c_custkey % 10 = 8 then 'score' else 'done' end as until, case when c_custkey % 3 = 0 then 'cycle' end as index_input from customer"


def _loop_tables(t):
    loops = t.sql(LOOPS)
    key = loops.select("loop")

    def rows(*values: tuple, names: list[str]):
        structs = [F.struct(*[F.lit(v).cast("boolean" if n == "is_path" else "string").alias(n) for n, v in zip(names, value)]) for value in values]
        return key.select("loop", F.explode(F.array(*structs)).alias("r")).select("loop", "r.*")

    body = rows(("cal",), ("image",), names=["sub"])
    inputs = rows(("ms", None), ("mask", "none"), ("cycle", "0"), ("name", None), names=["field", "default"])
    outputs = rows(("ms", "cal", "out", True), ("mask", "image", "mask", True), ("done", "image", "stop", True), ("score", "image", "score", False), ("lost", None, None, True), names=["field", "sub", "sub_field", "is_path"])
    wiring = rows(
        ("cal", "ms", "input", None, "ms"), ("cal", "mask", "input", None, "mask"), ("image", "ms", "output", "cal", "out"), ("image", "n", "input", None, "cycle"), ("image", "name", "input", None, "name"),
        names=["sub", "field", "src_kind", "src_sub", "src_field"],
    )
    carry = rows(("ms", "ms"), ("mask", "mask"), names=["out_field", "in_field"])
    initial = rows(("ms", "/d/obs.ms"), names=["field", "value"]).unionByName(key.where("loop % 4 <> 0").select("loop", F.lit("name").alias("field"), F.concat(F.lit("n"), F.col("loop").cast("string")).alias("value")))
    return loops, body, inputs, outputs, wiring, carry, initial


@query(
    "unrolled_steps",
    "GR9",
    f"""
    with l as ({LOOPS}), x as (select loop, k, sub, until from (select loop, until, unnest(range(1, max_iter + 1)) as k from l where until <> 'nope') e, (values ('cal'), ('image')) b(sub))
    select loop, k, sub, concat_ws('.', loop, k, sub) as step, case when k > 1 then concat_ws('.', loop, k - 1, sub) end as prev_step, case when k > 1 then concat_ws('.', loop, k - 1, 'image') end as sentinel_step,
           case until when 'done' then 'stop' else 'score' end as sentinel_field, case when k > 1 and sub = 'cal' then concat_ws('.', loop, k - 1, 'image') end as after from x""",
)
def _(t):
    loops, body, _inputs, outputs, wiring, _carry, _initial = _loop_tables(t)
    return L.unroll_steps(loops.withColumn("max_iter", F.col("max_iter").cast("int")), body, wiring, outputs)


@query(
    "unrolled_wiring",
    "GR9",
    f"""
    with l as ({LOOPS}), x as (select loop, index_input, unnest(range(1, max_iter + 1)) as k from l)
    select concat_ws('.', loop, k, 'cal') as step, 'ms' as field, case when k > 1 then concat_ws('.', loop, k - 1, 'cal') end as src_step, case when k > 1 then 'out' end as src_field, case when k = 1 then '/d/obs.ms' end as value from x
    union all select concat_ws('.', loop, k, 'cal'), 'mask', case when k > 1 then concat_ws('.', loop, k - 1, 'image') end, case when k > 1 then 'mask' end, case when k = 1 then 'none' end from x
    union all select concat_ws('.', loop, k, 'image'), 'ms', concat_ws('.', loop, k, 'cal'), 'out', null from x
    union all select concat_ws('.', loop, k, 'image'), 'n', null, null, case when index_input = 'cycle' then cast(k as varchar) else '0' end from x
    union all select concat_ws('.', loop, k, 'image'), 'name', null, null, case when loop % 4 <> 0 then concat('n', loop) end from x""",
)
def _(t):
    loops, _body, inputs, outputs, wiring, carry, initial = _loop_tables(t)
    return L.unroll_wiring(loops.withColumn("max_iter", F.col("max_iter").cast("int")), wiring, inputs, outputs, carry, initial)


@query(
    "loop_errors",
    "GR9",
    f"""
    with l as ({LOOPS})
    select loop, 'max_iter below 1' as rule, cast(max_iter as varchar) as detail from l where max_iter < 1
    union all select loop, 'until is not an output', 'nope' from l where until = 'nope'
    union all select loop, 'until is not a path', 'score' from l where until = 'score'
    union all select loop, 'carry key is not an output', 'gone' from l where loop % 6 = 0
    union all select loop, 'carry value is not an input', 'away' from l where loop % 6 = 0
    union all select loop, 'input has no value', 'name' from l where loop % 4 = 0""",
)
def _(t):
    loops, _body, inputs, outputs, wiring, carry, initial = _loop_tables(t)
    wrong = loops.where("loop % 6 = 0").select("loop", F.lit("gone").alias("out_field"), F.lit("away").alias("in_field"))
    return L.loop_errors(loops, inputs, outputs, carry.unionByName(wrong), wiring, initial)


@query(
    "loop_outputs",
    "GR10",
    f"""
    with l as ({LOOPS})
    select loop, f as field, concat_ws('.', loop, max_iter, s) as src_step, o as src_field from l, (values ('ms', 'cal', 'out'), ('mask', 'image', 'mask'), ('done', 'image', 'stop'), ('score', 'image', 'score')) b(f, s, o) where max_iter >= 1""",
)
def _(t):
    loops, _body, _inputs, outputs, _wiring, _carry, _initial = _loop_tables(t)
    return L.loop_outputs(loops, outputs)


@query(
    "merged_edges",
    "GR11",
    """
    select recipe, src, dst from dag union select recipe, idx - 1, idx from steps where idx > 1 and scope % 2 = 0""",
)
def _(t):
    order = t.steps.where("idx > 1 and scope % 2 = 0").select("recipe", (F.col("idx") - 1).alias("src"), F.col("idx").alias("dst"))
    return G.merge_edges(t.dag, order)


@query("forward_edges", "GR11", "select recipe, src, dst from edges where src >= dst")
def _(t):
    return G.forward_edges(t.edges)


@query(
    "static_values",
    "GR12",
    """
    with recursive decl as (select s.recipe, s.idx, d.src, s.scope, s.l_suppkey from steps s left join dag d on d.recipe = s.recipe and d.dst = s.idx),
    v as (select recipe, idx, case when scope % 4 = 0 then null when scope % 4 = 1 then concat('k', l_suppkey) else 'default' end as value from decl where src is null
          union all select d.recipe, d.idx, v.value from v join decl d on d.recipe = v.recipe and d.src = v.idx)
    select recipe, idx, 'out' as field, value, value is not null as known from v""",
)
def _(t):
    outputs = t.steps.select("recipe", "idx", F.lit("out").alias("field"), F.when(F.col("scope") % 4 >= 2, F.lit("default")).alias("default"))
    inputs = t.steps.where("scope % 4 = 1").select("recipe", "idx", F.lit("out").alias("field"), F.concat(F.lit("k"), F.col("l_suppkey").cast("string")).alias("value"))
    wiring = t.dag.select("recipe", F.col("dst").alias("idx"), F.lit("out").alias("field"), "src", F.lit("out").alias("src_field"))
    return G.propagate_static(outputs, inputs, wiring)
