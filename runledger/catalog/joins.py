"""Joins, audits and file plans over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.base import query
from runledger.operators import files as P
from runledger.operators import joins as J
from runledger.operators import validate as V

LIST_WIRING = """
    select recipe, idx as step, 'ys' as field, 0 as pos, 'input' as src_kind, cast(null as bigint) as src_step, 'rin' as src_field from steps where scope % 3 = 0
    union all select recipe, dst, 'ys', 1, 'output', src, 'out' from dag where dst % 2 = 0
    union all select recipe, dst, 'x', null, 'output', src, 'out' from dag where dst % 3 <> 0"""


@query(
    "resolved_wiring",
    "JN1",
    f"""
    with w as ({LIST_WIRING}),
    wired as (select w.recipe, w.step, w.field, w.pos, case when w.src_kind = 'input' then concat('r', w.recipe) else (
                select cast(s.scope as varchar) from steps s where s.recipe = w.recipe and s.idx = w.src_step and s.scope % 10 <> 0) end as value, 'wired' as origin from w),
    const as (select recipe, idx as step, f as field, null as pos, concat('k', l_suppkey) as value, 'constant' as origin from steps, (select unnest(['x', 'z']) as f) n
              where (recipe, idx, f) not in (select recipe, step, field from w))
    select * from wired union all select * from const""",
)
def _(t):
    wiring = t.sql(LIST_WIRING)
    params = t.steps.select(
        "recipe", F.col("idx").alias("step"), F.explode(F.array(F.lit("x"), F.lit("z"))).alias("field"), F.concat(F.lit("k"), F.col("l_suppkey").cast("string")).alias("value")
    )
    inputs = t.steps.select("recipe", F.lit("rin").alias("field"), F.concat(F.lit("r"), F.col("recipe").cast("string")).alias("value")).distinct()
    outputs = t.steps.where("scope % 10 <> 0").select("recipe", F.col("idx").alias("step"), F.lit("out").alias("field"), F.col("scope").cast("string").alias("value"))
    as_text = wiring.withColumn("src_step", F.col("src_step").cast("string"))
    resolved = J.resolve_wiring(params, as_text, inputs, outputs.withColumn("step", F.col("step").cast("string")))
    return resolved.withColumn("step", F.col("step").cast("bigint"))


@query(
    "dangling_references",
    "JN2",
    """
    with takes as (select distinct s.recipe, s.step, f.field from steps s join input_fields f on f.scope = s.scope),
    gives as (select distinct s.recipe, s.step, f.field from steps s join output_fields f on f.scope = s.scope),
    names as (select distinct recipe, step from steps),
    aft as (select recipe, step, concat('s', scope % 9) as a from steps where scope % 10 = 0),
    par as (select recipe, step, case when scope % 13 = 0 then 'q' else 'b' end as field from steps),
    sca as (select recipe, step, case when scope % 17 = 0 then 'n' else 'c' end as field from steps where scope % 5 = 0)
    select recipe, step, 'duplicate name' as rule, step as detail from steps group by 1, 2 having count(*) > 1
    union select recipe, step, 'after itself', a from aft where a = step
    union select recipe, step, 'unknown after', a from aft where a <> step and (recipe, a) not in (from names)
    union select recipe, step, 'unknown scatter field', field from sca where (recipe, step, field) not in (from takes)
    union select recipe, step, 'unknown constant', field from par where (recipe, step, field) not in (from takes)
    union select recipe, step, 'unknown input', field from wiring where (recipe, step, field) not in (from takes)
    union select recipe, step, 'unknown recipe input', src_field from wiring where src_kind = 'input' and src_field <> 'rin'
    union select recipe, step, 'unknown step', src_step from wiring where src_kind = 'output' and (recipe, src_step) not in (from names)
    union select recipe, step, 'unknown output', concat(src_step, '.', src_field) from wiring where src_kind = 'output' and (recipe, src_step) in (from names)
          and (recipe, src_step, src_field) not in (from gives)""",
)
def _(t):
    after = t.steps.where("scope % 10 = 0").select("recipe", "step", F.concat(F.lit("s"), (F.col("scope") % 9).cast("string")).alias("after"))
    params = t.steps.select("recipe", "step", F.when(F.col("scope") % 13 == 0, F.lit("q")).otherwise(F.lit("b")).alias("field"))
    scattered = t.steps.where("scope % 5 = 0").select("recipe", "step", F.when(F.col("scope") % 17 == 0, F.lit("n")).otherwise(F.lit("c")).alias("field"))
    recipe_inputs = t.steps.select("recipe", F.lit("rin").alias("field")).distinct()
    return V.validate_graph(t.steps, t.wiring, t.input_fields, t.output_fields, recipe_inputs, after, params, scattered)


@query(
    "dangling_outputs",
    "JN2",
    """
    with ow as (select recipe, concat('o', scope % 3) as field, concat('s', scope % 9) as src_step, case when scope % 2 = 0 then 'aux' else 'out' end as src_field from steps),
    names as (select distinct recipe, step from steps), gives as (select distinct s.recipe, s.step, f.field from steps s join output_fields f on f.scope = s.scope)
    select distinct recipe, src_step as step, 'unknown recipe output' as rule, field as detail from ow where field = 'o2'
    union select recipe, src_step, 'unknown step', src_step from ow where (recipe, src_step) not in (from names)
    union select recipe, src_step, 'unknown output', src_field from ow where (recipe, src_step) in (from names) and (recipe, src_step, src_field) not in (from gives)""",
)
def _(t):
    wiring = t.steps.select(
        "recipe",
        F.concat(F.lit("o"), (F.col("scope") % 3).cast("string")).alias("field"),
        F.concat(F.lit("s"), (F.col("scope") % 9).cast("string")).alias("src_step"),
        F.when(F.col("scope") % 2 == 0, F.lit("aux")).otherwise(F.lit("out")).alias("src_field"),
    )
    declared = t.steps.select("recipe", F.explode(F.array(F.lit("o0"), F.lit("o1"))).alias("field")).distinct()
    return V.validate_outputs(wiring, t.steps, t.output_fields, declared)


ROOTS = "select distinct split_part(path, '/', 1) as root from files union select distinct concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) from files where page_id % 3 = 0 union select concat(path, '/sub') from files where page_id % 2 = 0"


@query(
    "path_containment",
    "JN3",
    f"""
    with r as ({ROOTS})
    select page_id, path, root, case when path = root then 'equal' when starts_with(path, root || '/') then 'inside' else 'contains' end as relation
    from files, r where path = root or starts_with(path, root || '/') or starts_with(root, path || '/')""",
)
def _(t):
    pairs = J.containment_join(t.files.select("page_id", "path"), t.sql(ROOTS), right_path="root")
    return pairs.select("l.page_id", "l.path", "r.root", "relation")


@query(
    "cache_lookup",
    "JN4",
    """
    select step_path, now_key as cache_key, has_entry and now_key = old_key and output_exists as hit,
           case when not has_entry then 'no entry' when now_key <> old_key then 'key changed' when not output_exists then 'output gone' end as reason
    from lookups""",
)
def _(t):
    looked = t.lookups
    keys = looked.select("step_path", F.col("now_key").alias("cache_key"))
    entries = looked.where("has_entry").select("step_path", F.col("old_key").alias("cache_key"))
    outputs = looked.where("has_entry").select("step_path", F.col("output_path").alias("path"))
    return J.cache_check(keys, entries, outputs, looked.where("output_exists").select(F.col("output_path").alias("path")))


@query(
    "replay_differences",
    "JN5 SO2",
    """
    with k as (select recipe, concat(step, '_', idx) as step, scope from steps)
    select recipe, step, case when scope % 8 = 0 then 'no longer exists' when scope % 9 = 0 then 'not in the record' else 'was recipe, now tool' end as difference
    from k where (scope % 8 = 0) <> (scope % 9 = 0) or (scope % 8 <> 0 and scope % 9 <> 0 and scope % 11 = 0)""",
)
def _(t):
    named = t.steps.select("recipe", F.concat_ws("_", "step", F.col("idx").cast("string")).alias("step"), "scope")
    records = named.where("scope % 9 <> 0").withColumn("kind", F.when(F.col("scope") % 11 == 0, F.lit("recipe")).otherwise(F.lit("tool")))
    return J.replay_diff(records, named.where("scope % 8 <> 0").withColumn("kind", F.lit("tool")))


HARVEST_FILES = "select page_id % 10 as run, path from files"
HARVEST_PATTERNS = """
    select page_id % 10 as run, concat(split_part(path, '/', 1), case page_id % 4 when 0 then '/*/?' when 1 then '/en/*[05]' when 2 then '/**' else '/f*/1*' end) as pattern
    from files where page_id % 6 = 0
    union all select page_id % 10, concat(split_part(path, '/', 1), '/d?') from files where page_id % 13 = 0
    union all select page_id % 10, concat('/', path) from files where page_id % 7 = 0
    union all select page_id % 10, concat('../', split_part(path, '/', 1), '/*') from files where page_id % 7 = 1"""
HARVEST_OUTPUTS = "select page_id % 10 as run, case when page_id % 4 = 0 then concat('/', path) else concat('./', path) end as path from files where page_id % 3 = 0 union all select page_id % 10, concat('./', split_part(path, '/', 1), '/', split_part(path, '/', 2)) from files where page_id % 17 = 0"
HARVEST_SQL = f"""
    f as ({HARVEST_FILES}), p as (select distinct run, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[:i], '/'))) as path from f), pat as ({HARVEST_PATTERNS}), o as ({HARVEST_OUTPUTS}),
    decl as (select distinct run, path[3:] as path from o where path[1] <> '/'),
    m as (select distinct f.run, f.path from p as f join pat on f.run = pat.run and pat.pattern[1] <> '/' and pat.pattern[1:2] <> '..'
          and regexp_full_match(f.path, replace(replace(replace(replace(replace(pat.pattern, '.', '\\.'), '**', '\t'), '*', '[^/]*'), '?', '[^/]'), '\t', '.*'))),
    plan as (select run, path, true as declared from decl union all select run, path, false from m where (run, path) not in (from decl))"""


@query("harvest_plan", "JN6", f"with {HARVEST_SQL} select run, path, declared from plan")
def _(t):
    return P.harvest_plan(t.sql(HARVEST_FILES), t.sql(HARVEST_PATTERNS), t.sql(HARVEST_OUTPUTS))


@query(
    "promote_plan",
    "TP5",
    f"""
    with {HARVEST_SQL}, there as (select path, bool_or(page_id % 2 = 0) as is_dir from files where page_id % 5 < 3 group by path),
    i as (select f.run, f.path, arg_min(plan.path, length(plan.path)) as product, arg_min(declared, length(plan.path)) as declared
          from f join plan on plan.run = f.run and (plan.path = f.path or starts_with(f.path, plan.path || '/')) group by 1, 2)
    select distinct f.run, f.path, product, case when declared is null then 'leave' when is_dir is null then 'move' when is_dir and not declared then 'refuse' else 'replace' end as action
    from f left join i using (run, path) left join there on there.path = product""",
)
def _(t):
    there = t.files.where("page_id % 5 < 3").select("path", (F.col("page_id") % 2 == 0).alias("is_dir"))
    return P.promote_plan(t.sql(HARVEST_FILES), t.sql(HARVEST_PATTERNS), t.sql(HARVEST_OUTPUTS), there)


NAME_ROOTS = """
    select distinct root, length(root) as size from (
      select split_part(path, '.', 1) as root from files where page_id % 2 = 0
      union all select concat(split_part(path, '.', 1), '.', split_part(path, '.', 2)) from files where page_id % 3 = 0) r"""


@query(
    "longest_prefix",
    "JN7",
    f"""
    with r as ({NAME_ROOTS})
    select page_id, path as name, root, r.size from files left join r on path = root or starts_with(path, root || '.')
    qualify row_number() over (partition by page_id order by r.size desc) = 1""",
)
def _(t):
    return J.longest_prefix_join(t.files.select("page_id", F.col("path").alias("name")), t.sql(NAME_ROOTS))


FLIGHTS = """
    select o_orderkey as chain, concat('/ws/m', cast(o_orderkey as varchar(20))) as path, concat('s', cast(o_custkey as varchar(20))) as marker_step,
           case when o_orderkey % 10 <> 0 then concat('k', o_orderstatus) end as marker_key,
           case when o_orderkey % 4 <> 0 then concat('run', cast(o_orderkey % 5 as varchar(20))) end as marker_run from orders"""
FLIGHT_ENTRIES = """
    select concat('s', cast(o_custkey as varchar(20))) as step_path, concat('k', o_orderstatus) as cache_key,
           case when o_orderkey % 9 = 0 then null else concat('run', cast(o_orderkey % 5 as varchar(20))) end as run_id from orders where o_orderkey % 3 = 0"""
FLIGHT_TRASH = """
    select concat('/ws/m', cast(o_orderkey as varchar(20))) as path, concat('run', cast(o_orderkey % 10 as varchar(20))) as run_id from orders where o_orderkey % 2 = 0"""


@query(
    "interrupted_runs",
    "JN8",
    f"""
    with c as ({FLIGHTS}), e as ({FLIGHT_ENTRIES}), x as ({FLIGHT_TRASH}),
    j as (select chain, path, coalesce((marker_step, marker_key, marker_run) in (select (step_path, cache_key, run_id) from e where run_id is not null) and marker_key is not null, false) as completed,
                 (path, marker_run) in (select (path, run_id) from x) as kept from c where marker_run is not null)
    select chain, path, completed, case when completed and kept then 'discard trash' when completed then 'clear marker' when kept then 'roll back' else 'restore before re-run' end as action,
           case when completed then 'unchanged' else 'untrusted' end as status from j""",
)
def _(t):
    return J.reconcile(t.sql(FLIGHTS), t.sql(FLIGHT_ENTRIES), t.sql(FLIGHT_TRASH))


PLANS = """
    select concat('s', cast(turn % 3 as varchar(20))) as step_path, 'ms' as field, concat('/ws/c', cast(conv_id as varchar(20))) as path,
           case when turn % 5 = 0 then concat('key', cast(turn as varchar(20))) end as wired_key, case when turn % 10 <> 0 then 'out/a' end as wired_field,
           length(text) as fingerprint, conv_id, turn from conversations"""


@query(
    "required_state",
    "JN9",
    f"""
    with p as ({PLANS}), ch as (select path, head from chains where chain % 3 <> 0), co as (select concat('/ws/c', chain) as path, step_path, field, name from consumed)
    select p.step_path, p.field, p.path,
           case when wired_key is not null and wired_field is not null then wired_key || '__out_a' when ch.path is not null then coalesce(co.name, ch.head)
                else concat('gen0__', substr(sha256(concat(length(p.path), ':', p.path, chr(31), length(cast(fingerprint as varchar)), ':', fingerprint)), 1, 32)) end as required,
           case when wired_key is not null and wired_field is not null then 'wired' when ch.path is null then 'generation 0' when co.name is not null then 'consumed' else 'head' end as origin
    from p left join ch on p.path = ch.path left join co on co.path = p.path and co.step_path = p.step_path and co.field = p.field""",
)
def _(t):
    consumed = t.consumed.select(F.concat(F.lit("/ws/c"), F.col("chain").cast("string")).alias("path"), "step_path", "field", "name")
    return J.required_state(t.sql(PLANS), t.chains.where("chain % 3 <> 0"), consumed)


@query(
    "state_as_of",
    "JN10",
    """
    with v as (select user_id, date_trunc('hour', ts) as at, event_id from events where event_type = 'purchase'),
    a as (select user_id, date_trunc('hour', ts) as at, event_id from events where event_type <> 'purchase')
    select a.user_id, a.event_id, (select arg_max(v.event_id, (v.at, v.event_id)) from v where v.user_id = a.user_id and v.at <= a.at) as as_of from a""",
)
def _(t):
    hourly = t.events.select("user_id", F.date_trunc("hour", "ts").alias("at"), "event_id", "event_type")
    versions = hourly.where("event_type = 'purchase'").withColumn("version", F.col("event_id"))
    asked = hourly.where("event_type <> 'purchase'").select("user_id", "at", "event_id")
    return J.state_as_of(asked, versions, "at", ["user_id"], "version", "event_id", [F.to_date("at")]).select("user_id", "event_id", "as_of")


SENTINELS = """
    select c_custkey, case c_custkey % 8 when 0 then null when 1 then '{oops' when 2 then '[1]' else
      concat('{"schema":', case when c_custkey % 8 = 3 then '2' else '1' end, ',"env_id":"e', cast(c_custkey as varchar(20)), '","lock_sha256":', case when c_custkey % 8 = 4 then '""' else '"l"' end,
             ',"pyproject_sha256":', case when c_custkey % 16 = 5 then '7' else '"p"' end, ',"mode":"', case when c_custkey % 8 = 6 then 'magic' else 'uv-sync' end,
             '","platform_triple":"x86_64/glibc-2.', cast(c_nationkey as varchar(20)), '/3.12"}') end as payload from customer"""


@query(
    "usable_environments",
    "JN11",
    """
    select c_custkey, case when c_custkey % 8 in (0, 1, 2, 4, 6) or c_custkey % 16 = 5 then 'absent' when c_custkey % 8 = 3 then 'foreign' else 'present' end as status,
           case when c_custkey % 8 > 2 then concat('e', c_custkey) end as env_id,
           (c_custkey % 8 = 7 or c_custkey % 16 = 13) and c_nationkey % 2 = 0 as usable,
           case when c_custkey % 8 = 0 then 'no record' when c_custkey % 8 = 1 then 'not valid JSON' when c_custkey % 8 = 2 then 'not a JSON object' when c_custkey % 8 = 3 then 'foreign schema'
                when c_custkey % 8 = 4 then 'missing: lock_sha256' when c_custkey % 16 = 5 then 'missing: pyproject_sha256' when c_custkey % 8 = 6 then 'bad mode'
                when c_nationkey % 2 = 1 then 'platform differs' end as reason from customer""",
)
def _(t):
    hosts = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("x86_64/glibc-2."), F.col("n_nationkey").cast("string"), F.lit("/3.12")).alias("platform"))
    return J.usable_envs(t.sql(SENTINELS), hosts)


@query(
    "aliased_chains",
    "JN12",
    """
    with c as (select concat('/ws/', l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) as path, l_suppkey as dev, l_partkey as ino from lineitem),
    d as (select distinct * from c)
    select path, coalesce((select min(o.path) from d o where o.dev = d.dev and o.ino = d.ino and o.path < d.path),
                          (select max(o.path) from d o where o.dev = d.dev and o.ino = d.ino and o.path > d.path)) as alias
    from d where (select count(*) from d o where o.dev = d.dev and o.ino = d.ino) > 1""",
)
def _(t):
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    chains = t.lineitem.select(F.concat(F.lit("/ws/"), F.concat_ws("/", *parts)).alias("path"), F.col("l_suppkey").alias("dev"), F.col("l_partkey").alias("ino")).distinct()
    return J.aliased_chains(chains)


BESIDE = """
    select concat('/ws/c', cast(conv_id as varchar(20)), case when turn % 4 = 0 then '' else concat('.trash.run', cast(turn % 3 as varchar(20))) end, case when turn % 7 = 6 then '/x' else '' end) as path
    from conversations"""


@query(
    "orphan_trash",
    "JN13",
    f"""
    with b as ({BESIDE}), cut as (select distinct path, split_part(path, '.trash.', 1) as base, split_part(path, '.trash.', 2) as run from b where contains(path, '.trash.'))
    select path as trash from cut where exists (select 1 from chains c where c.path = base and c.chain % 2 = 0)
      and not exists (select 1 from chains c where c.path = base and c.chain % 2 = 0 and c.marker_run = run)""",
)
def _(t):
    return J.orphan_trash(t.sql(BESIDE), t.chains.where("chain % 2 = 0").select("path", "marker_run"))


@query(
    "resolved_names",
    "JN14",
    "select page_id, case when page_id % 3 = 0 then concat('img', page_id, ':1') else path end as name from files",
)
def _(t):
    names = t.files.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("n"), F.col("page_id").cast("string"))).otherwise(F.col("path")).alias("name"))
    table = t.files.where("page_id % 3 = 0").select(
        F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("name"), F.concat(F.lit("img"), F.col("page_id").cast("string"), F.lit(":1")).alias("target")
    )
    return J.resolve_names(names, table).select("page_id", "name")


@query(
    "readonly_conflicts",
    "JN15",
    """
    with g as (select page_id % 5 as scope, concat('f', page_id) as field, case when page_id % 3 = 0 then '/' || split_part(path, '/', 1) else '/' || path end as path, page_id % 4 = 0 as writable from files),
    tgt as (select page_id % 5 as scope, '/' || path || '/cal' as path, concat('output ', page_id) as source from files where page_id % 7 = 0),
    ro as (select scope, path, min(field) as field from g where not writable group by 1, 2),
    w as (select scope, path, source as by from tgt union select scope, path, 'input ' || field from g where writable)
    select w.scope, ro.field, ro.path, w.path as written, w.by from w join ro on w.scope = ro.scope and (w.path = ro.path or starts_with(w.path, ro.path || '/'))""",
)
def _(t):
    full, host = F.concat(F.lit("/"), F.col("path")), F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(1)))
    scope = (F.col("page_id") % 5).alias("scope")
    number = F.col("page_id").cast("string")
    inputs = t.files.select(
        scope, F.concat(F.lit("f"), number).alias("field"), F.when(F.col("page_id") % 3 == 0, host).otherwise(full).alias("path"), (F.col("page_id") % 4 == 0).alias("writable")
    )
    targets = t.files.where("page_id % 7 = 0").select(scope, F.concat(full, F.lit("/cal")).alias("path"), F.concat(F.lit("output "), number).alias("source"))
    return J.readonly_conflicts(inputs, targets)


@query(
    "diverging_environments",
    "JN16",
    """select c_custkey as env, c_mktsegment as digest_a, o as digest_b from (
         select c_custkey, c_mktsegment, case when c_custkey % 5 = 0 then null when c_custkey % 3 = 0 then 'OTHER' else c_mktsegment end as o from customer) c
       where c_custkey % 3 = 0 and c_custkey % 5 <> 0""",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("env"), F.col("c_mktsegment").alias("digest"))
    key = F.col("c_custkey")
    b = t.customer.select(key.alias("env"), F.when(key % 5 != 0, F.when(key % 3 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment"))).alias("digest"))
    return J.env_divergence(a, b)


@query(
    "kept_paths",
    "SO3",
    """
    select distinct page_id % 20 as step, path from files where (page_id % 20, concat('f', page_id % 3)) not in (select page_id % 20, concat('f', page_id % 3) from files where page_id % 6 = 1)""",
)
def _(t):
    field = F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string")).alias("field")
    inputs = t.files.select((F.col("page_id") % 20).alias("step"), field, F.concat(F.lit("./"), "path", F.lit("/")).alias("path"))
    targets = t.files.where("page_id % 6 = 1").select((F.col("page_id") % 20).alias("step"), field)
    return P.keep_paths(inputs, targets)


@query(
    "stale_outputs",
    "SO4",
    """
    with o as (select distinct page_id % 4 as step, case when page_id % 5 = 0 then '/w' when page_id % 5 = 1 then '/w/' || split_part(path, '/', 1) else '/w/' || path end as path from files),
    k as (select distinct page_id % 4 as step, '/w/' || path || case when page_id % 2 = 0 then '/in' else '' end as path from files where page_id % 9 = 0),
    e as (select distinct '/w/' || path as path from files where page_id % 3 <> 0 union select '/w' union select '/w/' || split_part(path, '/', 1) from files where page_id % 2 = 0),
    p as (select * from o where path in (from e))
    select step, path, case when exists (select 1 from k where k.step = p.step and (k.path = p.path or starts_with(k.path, p.path || '/') or starts_with(p.path, k.path || '/')))
                            then 'keep: input' when path = '/w' then 'keep: holds the workspace' else 'clear' end as action from p""",
)
def _(t):
    step, key = (F.col("page_id") % 4).alias("step"), F.col("page_id")
    full, host = F.concat(F.lit("/w/"), F.col("path")), F.concat(F.lit("/w/"), F.split_part("path", F.lit("/"), F.lit(1)))
    outputs = t.files.select(step, F.when(key % 5 == 0, F.lit("/w")).when(key % 5 == 1, host).otherwise(full).alias("path"))
    kept = t.files.where("page_id % 9 = 0").select(step, F.concat(full, F.when(key % 2 == 0, F.lit("/in")).otherwise(F.lit(""))).alias("path")).distinct()
    existing = t.files.where("page_id % 3 <> 0").select(full.alias("path")).union(t.files.where("page_id % 2 = 0").select(host.alias("path"))).union(t.files.select(F.lit("/w")))
    return P.stale_outputs(outputs, kept, existing, "/w/run")


@query(
    "declared_dirs",
    "SO5",
    """
    with o as (select page_id % 6 as scope, 0 as rank, page_id as pos, path, concat('output ', page_id) as source from files where page_id % 3 <> 0),
    p as (select page_id % 6 as scope, 1 as rank, page_id as pos, split_part(path, '/', 1) || case when page_id % 2 = 0 then '/' || split_part(path, '/', 2) else '' end as dir, concat('glob ', page_id) as source from files where page_id % 3 = 0),
    d as (select scope, rank, pos, path[1:length(path) - 1 - length(split_part(path, '/', -1))] as dir, source from o where contains(path, '/') union all select scope, rank, pos, dir, source from p)
    select scope, dir, rank, pos, source from d qualify row_number() over (partition by scope, dir order by rank, pos, source) = 1""",
)
def _(t):
    scope, number = (F.col("page_id") % 6).alias("scope"), F.col("page_id").cast("string")
    outputs = t.files.where("page_id % 3 <> 0").select(scope, F.col("page_id").alias("pos"), F.concat(F.lit("./"), "path").alias("path"), F.concat(F.lit("output "), number).alias("source"))
    second = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2)))).otherwise(F.lit(""))
    globs = t.files.where("page_id % 3 = 0").select(
        scope, F.col("page_id").alias("pos"), F.concat(F.split_part("path", F.lit("/"), F.lit(1)), second, F.lit("/*.fits")).alias("pattern"), F.concat(F.lit("glob "), number).alias("source")
    )
    return P.declared_dirs(outputs, globs)


@query("duplicate_steps", "SO6", "select recipe, step, count(*) as n from steps group by 1, 2 having count(*) > 1")
def _(t):
    return V.duplicate_names(t.steps)


@query(
    "eligibility",
    "AG13",
    """
    with s as (select recipe, step, scope, case when scope % 9 = 0 then 'recipe' else 'tool' end as kind from steps),
    tools as (select distinct recipe, step from s where kind = 'tool')
    select recipe, step, 'scattered' as reason, null as detail from s where scope % 10 = 0
    union select recipe, step, 'has a function', null from s where scope % 11 = 0
    union select recipe, step, 'not a tool', null from s where kind <> 'tool'
    union select recipe, step, 'runs in a venv', null from s where kind = 'tool' and scope % 8 = 0
    union select recipe, step, 'flavour', null from s where kind = 'tool' and scope % 13 = 0
    union select recipe, step, 'mutable value', 'gain' from s where scope % 14 = 0 and (recipe, step) in (from tools)
    union select w.recipe, w.step, case when s.scope % 2 = 0 then 'reads a parsed output' else 'reads a non-path output' end, concat(w.src_step, '.', w.src_field)
          from wiring w join s on s.recipe = w.recipe and s.step = w.src_step and w.src_kind = 'output' and w.src_field = 'out' and (s.recipe, s.step) in (from tools)
          where s.scope % 2 = 0 or s.scope % 3 = 0""",
)
def _(t):
    scope = F.col("scope")
    steps = t.steps.select(
        "recipe",
        "step",
        F.when(scope % 9 == 0, F.lit("recipe")).otherwise(F.lit("tool")).alias("kind"),
        F.when(scope % 13 == 0, F.lit("code")).otherwise(F.lit("binary")).alias("flavour"),
        (scope % 11 == 0).alias("has_func"),
        (scope % 10 == 0).alias("scattered"),
        F.when(scope % 8 == 0, F.lit("env")).alias("venv"),
    )
    values = t.steps.where("scope % 14 = 0").select("recipe", "step", F.lit("gain").alias("field"))
    outputs = t.steps.select("recipe", "step", F.lit("out").alias("field"), (scope % 3 != 0).alias("is_path"), (scope % 2 == 0).alias("parsed"))
    return V.eligibility(steps, t.wiring, values, outputs)


@query(
    "directory_modes",
    "AG21",
    """
    select page_id % 6 as scope, case when contains(path, '/') then path[1:length(path) - 1 - length(split_part(path, '/', -1))] else '.' end as dir,
           bool_or(page_id % 4 = 0) as writable, min(page_id) as first_pos from files group by 1, 2""",
)
def _(t):
    return P.directory_modes(t.files.select((F.col("page_id") % 6).alias("scope"), F.col("page_id").alias("pos"), "path", (F.col("page_id") % 4 == 0).alias("writable")))


@query(
    "tree_sizes",
    "AG12",
    """
    with s as (select split_part(path, '/', 1) as root, sum(size) as bytes, count(*) as n_files from files group by 1)
    select root, bytes, n_files, bytes <= 20000 or root like '%org' as affordable from s""",
)
def _(t):
    sizes = P.tree_size(t.files.withColumn("root", F.split_part("path", F.lit("/"), F.lit(1))))
    return sizes.withColumn("affordable", P.can_afford(F.col("bytes"), F.lit(20000), F.col("root").like("%org")))
