"""Run, cache and version-chain rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.base import query
from runledger.operators import aggregates as A
from runledger.operators.scatter import PART_ROWS
from runledger.operators import joins as J
from runledger.operators import versions as V
from runledger.operators import windows as W

GROUP_SHA = """sha256(concat_ws(chr(31), count(h), {words}))""".format(
    words=", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 6 * i}, 6))::bigint), 0)::bigint" for i in range(6))
)


def enc(*cols: str) -> str:
    """SQL of the canonical encoding."""
    return "concat_ws(chr(31), " + ", ".join(f"coalesce(length(({c})::varchar) || ':' || ({c})::varchar, '-')" for c in cols) + ")"


@query("accounting_rows", "SRC11", "select o_orderkey as step, cast(o_orderkey as varchar) as job_id, o_orderstatus as state from orders where o_orderkey % 9 <> 0")
def _(t):
    wanted = t.orders.select(F.col("o_orderkey").alias("step"), F.col("o_orderkey").cast("string").alias("job_id"))
    return A.step_status(wanted, t.jobs).where("state <> 'UNKNOWN'")


@query(
    "step_status",
    "AG15",
    "select o_orderkey as step, cast(o_orderkey as varchar) as job_id, case when o_orderkey % 9 = 0 then 'UNKNOWN' else o_orderstatus end as state from orders",
)
def _(t):
    return A.step_status(t.orders.select(F.col("o_orderkey").alias("step"), F.col("o_orderkey").cast("string").alias("job_id")), t.jobs)


@query("pinned_runs", "AG2", "select run_id, count(*) filter (not ((not containerized or image_digest is not null) and venv is null)) = 0 as pinned from step_records group by 1")
def _(t):
    return A.pinned(t.step_records)


@query("unpinned_steps", "AG3", "select run_id, idx, step from step_records where (containerized and image_digest is null) or venv is not null")
def _(t):
    return A.unpinned_steps(t.step_records)


@query(
    "tree_fingerprints",
    "AG4",
    f"""
    with e as (select split_part(path, '/', 1) as root, sha256({enc("path", "page_id", "size")}) as h from files),
    f as (select root, {GROUP_SHA} as fp from e group by root),
    r as (select distinct split_part(path, '/', 1) as root from files union select 'absent' || page_id from files where page_id % 50 = 0)
    select root, case when root like '%7' then null when root like '%com' then sha256('unreadable tree') else coalesce(fp, sha256('empty tree')) end as fingerprint
    from r left join f using (root)""",
)
def _(t):
    root = F.split_part("path", F.lit("/"), F.lit(1)).alias("root")
    files = t.files.select(root, F.col("path").alias("relpath"), F.col("page_id").alias("mtime"), "size")
    absent = t.files.where("page_id % 50 = 0").select(F.concat(F.lit("absent"), F.col("page_id").cast("string")).alias("root"))
    roots = files.select("root").union(absent).distinct()
    status = F.when(F.col("root").endswith("7"), F.lit("missing")).when(F.col("root").endswith("com"), F.lit("unreadable"))
    return A.tree_fingerprint(files, roots.withColumn("status", status))


@query(
    "inventory_fingerprints",
    "AG4",
    f"""with e as (select l_suppkey as root, sha256({enc("l_orderkey", "l_partkey", "l_linenumber")}) as h from lineitem) select root, {GROUP_SHA} as fingerprint from e group by root""",
)
def _(t):
    inventory = t.lineitem.select(F.col("l_suppkey").alias("root"), F.col("l_orderkey").alias("relpath"), F.col("l_partkey").alias("mtime"), F.col("l_linenumber").alias("size"))
    return A.tree_fingerprint(inventory)


@query(
    "combined_keys",
    "AG5",
    f"""with e as (select run_id, image_digest, sha256({enc("idx", "image_digest")}) as h from step_records)
        select run_id, case when count(image_digest) > 0 then {GROUP_SHA} end as combined from e group by run_id""",
)
def _(t):
    return A.combine_keys(t.step_records, ["run_id"], "image_digest", "idx")


@query(
    "dists_digests",
    "AG6",
    f"""with e as (select p_brand, sha256(concat(p_name, '==', p_size)) as h from part) select p_brand, {GROUP_SHA} as digest from e group by 1""",
)
def _(t):
    return A.dists_digest(t.part.select("p_brand", F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version")), ["p_brand"])


@query("run_outcomes", "AG7", "select run_id, coalesce(arg_min(returncode, idx) filter (returncode <> 0), 0) as returncode from step_records group by 1")
def _(t):
    return A.run_outcome(t.step_records)


@query(
    "recipe_outputs",
    "AG8",
    """
    with w as (select recipe as run_id, concat('o', idx) as field, 1 + scope % 8 as src_step, case when scope % 2 = 0 then 'out' else 'log' end as src_field from steps)
    select w.run_id, w.field, case when w.src_field = 'out' then s.scope end as value from w left join steps s on s.recipe = w.run_id and s.idx = w.src_step""",
)
def _(t):
    results = t.steps.select(F.col("recipe").alias("run_id"), F.col("idx").alias("step"), F.lit("out").alias("field"), F.col("scope").alias("value"))
    wiring = t.steps.select(
        F.col("recipe").alias("run_id"),
        F.concat(F.lit("o"), F.col("idx").cast("string")).alias("field"),
        (F.col("scope") % 8 + 1).alias("src_step"),
        F.when(F.col("scope") % 2 == 0, F.lit("out")).otherwise(F.lit("log")).alias("src_field"),
    )
    return A.collect_outputs(results, wiring)


@query(
    "run_console",
    "AG8",
    f"select run_id, idx // {PART_ROWS} as part, coalesce(string_agg(step, chr(10) order by idx) filter (not skipped), '') as text from step_records group by 1, 2",
)
def _(t):
    return A.collect_text(t.step_records.withColumn("text", F.when(~F.col("skipped"), F.col("step"))), "text", "run_id", "idx")


TREE_STEPS = """
    select concat('r', cast(l_orderkey as varchar(20)), '.p', cast(l_linenumber % 3 as varchar(20)), '.s', cast(l_partkey as varchar(20))) as path,
           case when l_partkey % 9 = 0 then 2.0 end as cpus, case when l_suppkey % 20 = 0 then 100 end as memory from lineitem"""


@query(
    "declared_footprints",
    "AG9",
    f"""
    with s as ({TREE_STEPS}), d as (select path, cpus is not null or memory is not null as has from s),
    u as (select split_part(path, '.', 1) as path, has from d union all select split_part(path, '.', 1) || '.' || split_part(path, '.', 2), has from d union all select path, has from d)
    select path, bool_or(has) as any_resources from u group by path""",
)
def _(t):
    return A.any_resources(t.sql(TREE_STEPS))


@query(
    "tightest_limits",
    "AG10",
    """
    with l as (select split_part(path, '/', 1) as path, case when min(page_id) % 2 = 0 then 1000 + min(page_id) end as lim from files group by 1
               union all select path, case when min(page_id) % 3 = 0 then null else min(page_id) end from files where contains(path, '/') group by 1)
    select f.path, min(l.lim) as limit from (select distinct path from files) f left join l on f.path = l.path or starts_with(f.path, l.path || '/') group by 1""",
)
def _(t):
    host = F.split_part("path", F.lit("/"), F.lit(1)).alias("path")
    number = F.min("page_id")
    raw = (
        t.files.groupBy(host)
        .agg(F.when(number % 2 == 0, (number + 1000).cast("string")).otherwise(F.lit("max")).alias("raw"))
        .unionByName(t.files.where("path like '%/%'").groupBy("path").agg(F.when(number % 3 == 0, F.lit(str(A.UNLIMITED))).otherwise(number.cast("string")).alias("raw")))
    )
    return A.tightest_limit(t.files, raw.select("path", A.parse_limit(F.col("raw")).alias("limit")))


@query(
    "resolved_demand",
    "AG11",
    """
    select o_orderkey as step, c_custkey as pool, case when o_orderkey % 7 = 0 then c_nationkey else o_orderkey % 30 end as cpus, cast(round(o_totalprice) as bigint) as memory,
           (o_orderkey % 7 <> 0 and o_orderkey % 30 > c_nationkey) or (c_custkey % 3 <> 0 and cast(round(o_totalprice) as bigint) > 200000) as exceeds
    from orders join customer on o_custkey = c_custkey""",
)
def _(t):
    pools = t.customer.select(
        F.col("c_custkey").alias("pool"), F.col("c_nationkey").alias("total_cpus"), F.when(F.col("c_custkey") % 3 != 0, F.lit(200000)).alias("total_memory")
    )
    steps = t.orders.select(
        F.col("o_custkey").alias("pool"), F.col("o_orderkey").alias("step"), (F.col("o_orderkey") % 30).alias("cpus"), (F.col("o_orderkey") % 7 == 0).alias("cpus_all"), F.round("o_totalprice").cast("bigint").alias("memory")
    )
    return A.resolve_demand(steps, pools)


@query(
    "status_rollup",
    "AG16",
    """
    select case when grouping(linestatus) = 1 then 'all' else linestatus end as l_linestatus, case when grouping(step) = 1 then 'all' else step end as step,
           case when grouping(rc) = 1 then 'all' else rc end as returncode, count(*) as n
    from (select l_linestatus as linestatus, concat('s', l_linenumber) as step, case when l_returnflag = 'R' then cast(1 + l_partkey % 3 as varchar) else '0' end as rc from lineitem) x
    group by rollup (linestatus, step, rc)""",
)
def _(t):
    rows = t.steps.withColumn("returncode", F.when(F.col("l_returnflag") == "R", 1 + F.col("scope") % 3).otherwise(0))
    return A.status_rollup(rows, ["l_linestatus", "step", "returncode"])


TAGS = """
    select p_brand, concat(case when p_partkey % 7 = 0 then 'rel' else 'v' end, cast(p_size % 12 as varchar(10)), '.', cast(p_partkey % 30 as varchar(10)),
           case p_partkey % 5 when 0 then '' when 1 then '.0' when 2 then '.1' when 3 then 'rc1' else '.10' end) as tag from part"""


@query(
    "latest_versions",
    "AG17",
    f"""
    with v as (select p_brand, tag, list_transform(string_split(tag[2:], '.'), lambda x: cast(x as bigint)) as k from ({TAGS}) t where regexp_full_match(tag, 'v[0-9]+(\\.[0-9]+)*'))
    select p_brand, arg_max(tag, (coalesce(k[1], 0), coalesce(k[2], 0), coalesce(k[3], 0), length(tag))) as tag from v group by 1""",
)
def _(t):
    return A.latest_version(t.sql(TAGS), ["p_brand"])


@query("loop_counts", "AG18", "select run_id, step, count(*) as declared, count(*) filter (not skipped) as performed, count(*) filter (skipped) as skipped from step_records group by 1, 2")
def _(t):
    return A.loop_counts(t.step_records, ["run_id", "step"])


@query(
    "eligible_fields",
    "AG19",
    """
    with s as (select p_partkey, len(string_split(p_name, ' ')) - p_partkey % 2 as n, p_partkey % 10 = 3 as sc, p_partkey % 4 = 0 as w, p_partkey % 8 as k from part where p_partkey % 6 <> 5)
    select p_partkey as step, 'ms' as field, not (sc or n <> 1 or (w and k = 4)) as protected,
           case when sc then 'scattered' when n <> 1 then concat('holds ', n, ' paths') when w and k = 4 then 'producer has no key' end as reason from s""",
)
def _(t):
    key = F.col("p_partkey")
    words = F.split("p_name", " ")
    paths = F.when(key % 2 == 1, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    rows = t.part.select(
        key.alias("step"),
        F.lit("ms").alias("field"),
        F.when(key % 6 != 5, paths).alias("paths"),
        (key % 10 == 3).alias("scattered"),
        (key % 4 == 0).alias("wired"),
        F.when(key % 8 == 0, F.array(F.lit("k"))).when(key % 8 == 4, F.array(F.lit(None).cast("string"))).alias("keys"),
    )
    return A.eligible_fields(rows)


@query(
    "access_order",
    "WN1",
    """
    with w as (select *, max(case when mutates then pos end) over (partition by path order by pos rows between unbounded preceding and 1 preceding) as wpos from accesses),
    readers as (select a.path, a.step, r.step as dep from w a join accesses r on r.path = a.path and not r.mutates and r.pos < a.pos and r.pos > coalesce(a.wpos, 0) where a.mutates)
    select * from readers
    union all
    select a.path, a.step, b.step from w a join accesses b on b.path = a.path and b.pos = a.wpos where not a.mutates or (a.path, a.step) not in (select path, step from readers)""",
)
def _(t):
    touched = t.events.select(F.col("user_id").alias("path"), F.col("event_id").alias("step"), "ts", F.col("event_type").isin("purchase", "signup").alias("mutates"))
    return W.access_order(touched, ["path"], ["ts", "step"], [F.to_date("ts")])


NESTED = """
    select page_id % 7 as recipe, page_id as step, case page_id % 4 when 0 then split_part(path, '/', 1) when 1 then concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) else path end as path,
           page_id % 3 = 0 as mutates from files"""


@query(
    "access_order_within",
    "WN1",
    f"""
    with a as ({NESTED}), q as (select recipe, path as q, min(step) as f from a group by 1, 2),
    p as (select a.recipe, a.step, a.path, a.mutates, q.q, q.f from a join q on q.recipe = a.recipe and q.f < a.step and (q.q = a.path or starts_with(q.q, a.path || '/') or starts_with(a.path, q.q || '/'))),
    w as (select p.*, (select max(m.step) from a m where m.recipe = p.recipe and m.mutates and m.step < p.step and m.step >= p.f
                       and (m.path = p.q or starts_with(m.path, p.q || '/') or starts_with(p.q, m.path || '/'))) as w from p),
    r as (select w.recipe, w.step, w.q, x.step as dep from w join a x on x.recipe = w.recipe and x.path = w.q and not x.mutates and x.step < w.step and x.step > coalesce(w.w, -1) where w.mutates)
    select distinct recipe, step, dep from r
    union
    select recipe, step, w from w where w is not null and (recipe, step, q) not in (select recipe, step, q from r)""",
)
def _(t):
    return W.access_order_within(t.sql(NESTED), ["recipe"], "step", [F.floor(F.col("step") / 100000)])


@query(
    "converged_loops",
    "WN2",
    """
    with s as (select user_id, min((ts, event_id)) as stop, arg_min(event_id, (ts, event_id)) as out from events where event_type = 'error' and value > 5 group by 1)
    select e.user_id, e.event_id, coalesce((e.ts, e.event_id) > s.stop, false) as skipped, case when (e.ts, e.event_id) > s.stop then s.out else e.event_id end as output
    from events e left join s using (user_id)""",
)
def _(t):
    rows = t.events.select("user_id", "ts", "event_id", ((F.col("event_type") == "error") & (F.col("value") > 5)).alias("done"), F.col("event_id").alias("output"))
    return W.converge(rows, ["user_id"], ["ts", "event_id"], "done", ["output"]).select("user_id", "event_id", "skipped", "output")


@query(
    "step_batches",
    "WN3",
    """
    with d as (select s.recipe, s.idx, coalesce((select string_agg(distinct src, ',' order by src) from dag e where e.recipe = s.recipe and e.dst = s.idx), '') as deps from steps s),
    l as (select *, case when lag(deps) over (partition by recipe order by idx) = deps then 0 else 1 end as opened from d)
    select recipe, idx, sum(opened) over (partition by recipe order by idx) as batch from l""",
)
def _(t):
    deps = t.dag.select("recipe", F.col("dst").alias("idx"), F.col("src").alias("dep"))
    return W.batches(t.steps, deps, ["recipe"], "idx", [F.floor(F.col("idx") / 100000)])


@query(
    "display_edges",
    "WN4",
    """
    select recipe, dst as idx, src as dep, 'real' as kind from dag
    union all select recipe, idx, idx - 1, 'display' from steps where idx > 1 and (recipe, idx) not in (select recipe, dst from dag)""",
)
def _(t):
    edges = t.dag.select("recipe", F.col("dst").alias("idx"), F.col("src").alias("dep"))
    return W.display_edges(t.steps, edges, ["recipe"], "idx", [F.floor(F.col("idx") / 100000)])


TARGETS = "select chain, case when pos % 5 = 4 then 'unknown' else name end as name from generations"


@query(
    "taint_blocks",
    "WN5",
    f"""
    select t.chain, t.name, c.tainted_through is not null and coalesce(g.pos <= x.pos, true) as blocked
    from ({TARGETS}) t join chains c using (chain) left join generations g on g.chain = t.chain and g.name = t.name
    left join generations x on x.chain = t.chain and x.name = c.tainted_through""",
)
def _(t):
    return V.taint_blocks(t.generations, t.chains, t.sql(TARGETS))


@query(
    "advanced_taint",
    "WN6",
    """
    with e as (select user_id, pos, case when event_type in ('purchase', 'view') then step % 100 end as produced from (select path as user_id, pos, event_type, step from accesses) a),
    h as (select *, last_value(produced ignore nulls) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding) as head from e)
    select user_id as chain, max(head) as tainted_pos from h where produced is null and head is not null group by 1""",
)
def _(t):
    events = t.events.select(
        F.col("user_id").alias("chain"), F.struct("ts", "event_id").alias("seq"), "ts", F.when(F.col("event_type").isin("purchase", "view"), F.col("event_id") % 100).alias("produced")
    )
    return W.advance_taint(events, chunk=[F.to_date(F.col("seq.ts"))])


AGED = "select *, (pos * 7919 + chain) % 1000 as age from generations where chain % 3 <> 0 or pos % 2 = 0"


@query(
    "eviction_plan",
    "WN7",
    f"""
    with g as ({AGED}), live as (select * from chains where alive),
    held as (select head as name from live union select tainted_through from live where tainted_through is not null union select n.name from consumed n join live using (chain)),
    cand as (select g.name, g.size, not c.alive as dead, case when c.alive then g.chain else g.age end as major, case when c.alive then -g.pos else 0 end as minor
             from g join chains c using (chain) where g.present and g.name not in (from (select name from held))),
    run as (select cast(dead as integer) as phase, major, minor, name, size,
                   coalesce(sum(size) over (order by dead, major, minor, name, size rows between unbounded preceding and 1 preceding), 0) as freed_before from cand)
    select * from run where freed_before < 60000""",
)
def _(t):
    return V.evict_plan(t.chains, t.sql(AGED), t.consumed, 60000)


MADE = """
    select conv_id as chain, turn as pos, concat('k', cast(turn % 3 as varchar(5)), 'c', cast(conv_id % 10 as varchar(5)), '__ms', cast(turn as varchar(5))) as name from conversations"""
MADE_HEADS = """
    select chain, concat('k', cast(p % 3 as varchar(5)), 'c', cast(chain % 10 as varchar(5)), '__ms', cast(p as varchar(5))) as head
    from (select conv_id as chain, max(turn) - max(conv_id) % 2 as p from conversations group by conv_id having max(turn) > 0) h"""
MADE_TAKEN = """
    select conv_id as chain, concat('s', cast(turn as varchar(5))) as step_path, concat('k', cast((turn + 1) % 3 as varchar(5)), 'c', cast(conv_id % 10 as varchar(5)), '__ms', cast(turn + 1 as varchar(5))) as name
    from conversations where turn % 2 = 0"""
MADE_ENTRIES = """
    select distinct concat('step', cast(turn % 3 as varchar(5)), '_', cast(conv_id % 10 as varchar(5))) as step_path, concat('k', cast(turn % 3 as varchar(5)), 'c', cast(conv_id % 10 as varchar(5))) as cache_key
    from conversations where conv_id % 10 < 6"""


@query(
    "invalidated_chains",
    "WN8",
    f"""
    with g as ({MADE}), h as ({MADE_HEADS}), e as ({MADE_ENTRIES}),
    m as (select e.step_path as invalidated, g.* from e join g on starts_with(g.name, e.cache_key || '__')),
    t as (select invalidated, chain, count(*) as n_dropped from m group by 1, 2)
    select t.invalidated, t.chain, t.n_dropped, case when h.head in (select name from m where m.invalidated = t.invalidated and m.chain = t.chain)
       then (select arg_max(g.name, g.pos) from g where g.chain = t.chain and (t.invalidated, g.chain, g.name) not in (select invalidated, chain, name from m)) else h.head end as new_head
    from t left join h using (chain)""",
)
def _(t):
    return V.invalidate_chains(t.sql(MADE_ENTRIES), t.sql(MADE), t.sql(MADE_HEADS))


@query(
    "invalidated_steps",
    "WN8",
    f"""
    with g as ({MADE}), c as ({MADE_TAKEN}), e as ({MADE_ENTRIES}),
    f as (select e.step_path as invalidated, g.chain, min(g.pos) as first from e join g on starts_with(g.name, e.cache_key || '__') group by 1, 2)
    select distinct f.invalidated, f.chain, c.step_path from f join c using (chain) join g on g.chain = c.chain and g.name = c.name where g.pos >= f.first""",
)
def _(t):
    return V.invalidate_steps(t.sql(MADE_ENTRIES), t.sql(MADE), t.sql(MADE_TAKEN))


@query(
    "latest_entries",
    "WN9",
    "select o_custkey as step_path, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as cache_key, max((o_orderdate, o_orderkey))[2] as run_id from orders group by 1",
)
def _(t):
    entries = t.orders.select(F.col("o_custkey").alias("step_path"), F.col("o_orderstatus").alias("cache_key"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("recorded_at"))
    return W.latest_entries(entries, order=["recorded_at", "run_id"]).select("step_path", "cache_key", "run_id")


@query(
    "last_consumed",
    "WN10",
    "select user_id, event_type, arg_max(event_id, (ts, event_id)) as name from events group by 1, 2",
)
def _(t):
    return W.last_consumed(t.events.select("user_id", "event_type", "ts", F.col("event_id").alias("name")), ["user_id", "event_type"], ["ts", "name"]).select("user_id", "event_type", "name")


@query(
    "health_report",
    "AG14",
    """
    with e as (select step_path from consumed where chain % 2 = 0), snap as (select name from generations where pos % 3 <> 1),
    n as (select g.*, c.path from generations g join chains c using (chain))
    select 'unreconciled' as section, path as subject, marker_run as detail from chains where marker_run is not null
    union all select 'off tip', path, head from chains where status = 'untrusted'
    union all select 'unprotected', path, tainted_through from chains where tainted_through is not null
    union all select 'disagreements', path, 'tracked but gone' from chains where not alive
    union all select 'missing snapshots', path, name from n where not present
    union all select 'disagreements', path, name from n where present and pos % 3 = 1
    union all select 'disagreements', c.path, concat_ws(' ', k.step_path, k.name) from consumed k join chains c using (chain) where k.step_path not in (from e)
    union all select 'orphan trash', concat(path, '.trash.old'), 'no marker' from chains where chain % 13 = 0""",
)
def _(t):
    chains = t.chains
    beside = chains.select(F.concat("path", F.lit(".trash."), F.when(F.col("chain") % 13 == 0, F.lit("old")).otherwise(F.col("marker_run"))).alias("path"))
    orphans = J.orphan_trash(beside.where("path is not null"), chains)
    entries = t.consumed.where("chain % 2 = 0").select("step_path").distinct()
    return V.health_report(chains, t.generations, t.consumed, entries, t.generations.where("pos % 3 <> 1").select("name"), orphans)


@query(
    "restore_plan",
    "TP3",
    f"""
    with r as (select distinct chain, name from ({TARGETS}) t), s as (select distinct name from generations where pos % 3 <> 1),
    j as (select r.chain, r.name, c.chain is null as untracked, c.marker_run is not null or c.status = 'untrusted' as forced, c.head = r.name as same,
                 c.tainted_through is not null and coalesce(g.pos <= x.pos, true) as blocked, r.name in (from s) as on_disk
          from r left join (select * from chains where chain % 9 <> 2) c on c.chain = r.chain left join generations g on g.chain = r.chain and g.name = r.name
          left join generations x on x.chain = r.chain and x.name = c.tainted_through)
    select chain, name, case when untracked then 'noop' when not forced and same then 'noop' when not forced and blocked then 'refuse: tainted' when not on_disk then 'missing'
           when forced and blocked then 'forced: discards work' when forced then 'forced' else 'restore' end as action from j""",
)
def _(t):
    snapshots = t.generations.where("pos % 3 <> 1").select("name")
    return V.restore_plan(t.chains.where("chain % 9 <> 2"), t.generations, t.sql(TARGETS).distinct(), snapshots)
