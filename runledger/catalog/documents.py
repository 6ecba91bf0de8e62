"""Settings, nested documents and file formats over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runledger.catalog.base import query
from runledger.catalog.schema import DIRTY
from runledger.operators import config as C
from runledger.operators import declared as D
from runledger.operators import schema as S
from runledger.plans.lineage import scratch_root
from runledger.plans.scan import LastBefore, ordered_scan
from runledger.sources import readers as R
from runledger.sources import writers as O
from runledger.sources.inventory import walk_files


@query(
    "effective_settings",
    "CFG1",
    "select setting_key, arg_max(value, layer_rank) filter (value is not null) as value, max(layer_rank) filter (value is not null) as layer_rank from settings group by 1",
)
def _(t):
    return C.effective(t.settings)


LAYERS = """
    select p_brand as doc, concat('n', cast(p_size % 6 as varchar(5)), case p_partkey % 7 when 0 then '' when 1 then '.a' when 2 then '.b' when 3 then '.b.c' when 4 then '.b.d' when 5 then '.e' else '.e.f.g' end) as path,
           p_name as value, p_partkey as rank from part"""


@query(
    "merged_documents",
    "CFG2",
    f"""
    with l as ({LAYERS})
    select doc, path, value, rank from l where not exists (
      select 1 from l h where h.doc = l.doc and h.rank > l.rank and (h.path = l.path or starts_with(l.path, h.path || '.') or starts_with(h.path, l.path || '.')))""",
)
def _(t):
    return C.deep_merge(t.sql(LAYERS))


def _uses(t):
    """A node for each part, every second of which uses the node of the part before it of its brand."""
    node = lambda key: F.concat(F.lit("n"), key.cast("string"))
    parts = t.part.select("p_brand", "p_partkey", "p_size", "p_type")
    leaf = F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "b.x").otherwise("b.y")
    own = parts.select(F.col("p_brand").alias("doc"), F.concat(node(F.col("p_partkey")), F.lit("."), leaf).alias("path"), F.col("p_type").alias("value"))
    before = ordered_scan(parts, ["p_brand"], ["p_partkey"], [F.floor(F.col("p_partkey") / 4096)], {"prev": LastBefore(F.col("p_partkey"))})
    uses = before.where("prev % 2 = 0").select(F.col("p_brand").alias("doc"), F.concat(node(F.col("p_partkey")), F.lit("._use")).alias("path"), node(F.col("prev")).alias("value"))
    return own.unionByName(uses)


@query(
    "resolved_uses",
    "CFG3",
    """
    with recursive p as (select p_partkey as k, p_brand as doc, p_type as value, case when p_size % 3 = 0 then 'a' when p_size % 3 = 1 then 'b.x' else 'b.y' end as leaf,
                lag(p_partkey) over (partition by p_brand order by p_partkey) as prev from part),
    link as (select k, doc, case when prev % 2 = 0 then prev end as prev from p),
    up as (select k, doc, k as at, 0 as hop from link union all select up.k, up.doc, link.prev, hop + 1 from up join link on link.k = up.at where link.prev is not null)
    select up.doc, concat('n', up.k, '.', p.leaf) as path, arg_min(p.value, up.hop) as value from up join p on p.k = up.at group by 1, 2""",
)
def _(t):
    return C.resolve_uses(_uses(t))


INCLUDES = """
    select concat('p', cast(p_partkey as varchar(20))) as doc, case when p_size % 3 = 0 then 'a' when p_size % 3 = 1 then 'b.x' else 'b.y' end as path, p_type as value from part
    union all select concat('p', cast(p_partkey as varchar(20))), '_include', concat('p', cast(p_partkey - 1 as varchar(20))) from part where p_partkey % 4 <> 0
    union all select concat('p', cast(p_partkey as varchar(20))), 'sub._include', concat('p', cast(p_partkey - 2 as varchar(20))) from part where p_partkey % 4 = 3"""


@query(
    "included_documents",
    "CFG2 SRC8",
    """
    with recursive p as (select p_partkey as k, p_type as value, case when p_size % 3 = 0 then 'a' when p_size % 3 = 1 then 'b.x' else 'b.y' end as leaf from part),
    up as (select k, k as here, 0 as hop from p union all select up.k, here - 1, hop + 1 from up join p on p.k = here - 1 where here % 4 <> 0),
    flat as (select up.k, p.leaf, arg_min(p.value, up.hop) as value from up join p on p.k = up.here group by 1, 2)
    select concat('p', k) as doc, leaf as path, value from flat
    union all select concat('p', k + 2), concat('sub.', leaf), value from flat where (k + 2) % 4 = 3 and k + 2 in (from (select k from p))""",
)
def _(t):
    return C.resolve_includes(t.sql(INCLUDES))


@query(
    "includes_by_path",
    "CFG2 SRC8",
    """
    with p as (select p_partkey as k, concat('/lib/g', p_size % 3, '/', p_partkey, '.yml') as doc, p_name as value, k2 from (select *, p_partkey + 1 as k2 from part)),
    n as (select p.k, p.doc, p.value, q.value as next from p left join p q on q.k = p.k2)
    select doc, 'own' as path, value, null as reason from n
    union all select doc, 'next.own', next, null from n where k % 4 = 1 and next is not null
    union all select doc, 'next.own', next, null from n where k % 4 = 2 and next is not null
    union all select doc, 'next', case k % 4 when 3 then concat('../../out/', k, '.yml') else concat('(nolib)', k, '.yml') end, case k % 4 when 3 then 'outside the package root' else 'no such package' end from n where k % 4 in (0, 3)""",
)
def _(t):
    """Documents that include others by relative paths and by packages, and ones that must not."""
    later = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), (F.col("p_size") % 3).cast("string").alias("g"))
    key, text = F.col("p_partkey"), lambda c: c.cast("string")
    file = F.concat(text(key + 1), F.lit(".yml"))
    entry = (
        F.when(key % 4 == 1, F.concat(F.lit("../g"), "g", F.lit("/"), file)).when(key % 4 == 2, F.concat(F.lit("(lib.g"), "g", F.lit(")"), file))
        .when(key % 4 == 3, F.concat(F.lit("../../out/"), text(key), F.lit(".yml"))).otherwise(F.concat(F.lit("(nolib)"), text(key), F.lit(".yml")))
    )
    rows = t.part.join(later, "p_partkey", "left").select(F.concat(F.lit("/lib/g"), text(F.col("p_size") % 3), F.lit("/"), text(key), F.lit(".yml")).alias("doc"), "p_name", entry.alias("entry"))
    own = rows.select("doc", F.lit("own").alias("path"), F.col("p_name").alias("value"))
    named, problems = C.named_includes(own.unionByName(rows.where("entry is not null").select("doc", F.lit("next._include").alias("path"), F.col("entry").alias("value"))), t.spark.createDataFrame([("lib", "/lib")], "package string, root string"))
    # What is included brings its own includes along; here only the first step is compared.
    merged = C.resolve_includes(named).where(F.col("path").isin("own", "next.own")).withColumn("reason", F.lit(None).cast("string"))
    return merged.unionByName(problems.select("doc", F.col("at").alias("path"), F.col("entry").alias("value"), "reason"))


@query(
    "unknown_uses",
    "CFG3",
    """
    select p_brand as doc, concat('n', p_partkey) as at, concat('n', p_partkey, case p_partkey % 3 when 0 then '.deep.er' when 1 then '.zz' else '.a.q' end) as target,
           case p_partkey % 3 when 0 then 'deep' when 1 then 'zz' else 'q' end as stuck_at from part where p_partkey % 4 = 0""",
)
def _(t):
    n = F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    kind = F.col("p_partkey") % 3
    own = t.part.select(F.col("p_brand").alias("doc"), F.concat(n, F.lit(".a")).alias("path"), F.col("p_type").alias("value"))
    target = F.concat(n, F.when(kind == 0, F.lit(".deep.er")).when(kind == 1, F.lit(".zz")).otherwise(F.lit(".a.q")))
    uses = t.part.where("p_partkey % 4 = 0").select(F.col("p_brand").alias("doc"), F.concat(n, F.lit("._use")).alias("path"), target.alias("value"))
    return C.unknown_uses(own.unionByName(uses))


@query(
    "merged_field_meta",
    "CFG4",
    """
    with i as (select o_orderkey as field, o_orderstatus as dtype, o_orderkey % 2 = 0 as write_path, case when o_orderkey % 3 = 0 then 'in' end as info from orders where o_orderkey % 5 <> 0),
    o as (select o_orderkey as field, case when o_orderkey % 4 = 0 then 'F' else 'str' end as dtype, o_orderkey % 7 = 0 as write_path, case when o_orderkey % 6 = 0 then 'out' end as info from orders where o_orderkey % 11 <> 0)
    select field, case when o.field is null then i.dtype when i.field is null or o.dtype <> 'str' then o.dtype else i.dtype end as dtype,
           coalesce(i.write_path, false) or coalesce(o.write_path, false) as write_path, coalesce(o.info, i.info) as info from i full join o using (field)""",
)
def _(t):
    key = F.col("o_orderkey")
    i = t.orders.where("o_orderkey % 5 <> 0").select(key.alias("field"), F.col("o_orderstatus").alias("dtype"), (key % 2 == 0).alias("write_path"), F.when(key % 3 == 0, F.lit("in")).alias("info"))
    o = t.orders.where("o_orderkey % 11 <> 0").select(
        key.alias("field"), F.when(key % 4 == 0, F.lit("F")).otherwise(F.lit("str")).alias("dtype"), (key % 7 == 0).alias("write_path"), F.when(key % 6 == 0, F.lit("out")).alias("info")
    )
    return C.merge_meta(i, o, ["field"], {"dtype": "str", "write_path": False, "info": None})


@query(
    "contained_includes",
    "CFG5",
    """
    select page_id, case page_id % 4 when 0 then '/pkg/' || path || '/x.yaml' when 1 then '/pkg/x.yaml' when 2 then '/etc/x.yaml' else '/pkgs/x.yaml' end as resolved, page_id % 4 < 2 as contained from files""",
)
def _(t):
    depth = F.size(F.split("path", "/"))
    up = F.repeat(F.lit("../"), depth)
    kind = F.col("page_id") % 4
    entry = (
        F.when(kind == 0, F.lit("./x.yaml")).when(kind == 1, F.concat(up, F.lit("x.yaml"))).when(kind == 2, F.lit("/etc/./x.yaml")).otherwise(F.concat(up, F.lit("../pkgs/x.yaml")))
    )
    package = (F.col("page_id") % 3).alias("package")
    includes = t.files.select("page_id", package, F.concat(F.lit("/pkg/"), "path").alias("base"), entry.alias("entry"))
    return C.contained(includes, t.files.select(package, F.lit("/pkg/").alias("root")).distinct()).select("page_id", "resolved", "contained")


@query(
    "run_documents",
    "SRC1 SRC2 GR8",
    """
    with r as (select run_id, 'r' || run_id as name, 0 as depth, 0 as idx, null as returncode, false as containerized, null as venv, 'r' || run_id as path from step_records where idx = 1),
    s as (select run_id, step as name, 1 as depth, idx, returncode, containerized, venv, concat('r', run_id, '.', step) as path from step_records)
    select cast(run_id as varchar) as run_id, path, depth, cast(idx as integer) as idx, name, returncode, containerized, venv from (select * from r union all select * from s) x""",
)
def _(t):
    records = t.step_records.withColumn("run_id", F.col("run_id").cast("string"))
    root = F.concat(F.lit("r"), "run_id")
    steps = records.select("run_id", F.concat(root, F.lit("."), "step").alias("path"), F.lit(1).alias("depth"), "idx", F.col("step").alias("name"), F.col("returncode").cast("int").alias("returncode"), "containerized", "venv")
    roots = records.where("idx = 1").select(
        "run_id", root.alias("path"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("idx"), root.alias("name"), F.lit(None).cast("int").alias("returncode"), F.lit(False).alias("containerized"), F.lit(None).cast("string").alias("venv")
    )
    docs = O.nest_records(roots.unionByName(steps))
    path = f"{scratch_root(t.spark)}/{uuid.uuid4().hex}"
    stamp = F.timestamp_seconds(F.lit(1700000000) + F.pmod(F.hash("run_id"), F.lit(3)) * 86400)
    O.write_runs(docs.withColumn("name", F.concat(F.lit("n"), F.pmod(F.hash("run_id"), F.lit(2)).cast("string"))).withColumn("generated_at", stamp), path)
    return R.read_runs(t.spark, path, per_line=True).select("run_id", "path", "depth", "idx", "name", "returncode", "containerized", "venv")


@query(
    "cache_documents",
    "SRC3",
    "select o_custkey as owner, concat('step', o_orderkey) as step_path, concat('k', o_orderstatus) as cache_key, concat('run', o_orderkey % 5) as run_id, concat('/out/', o_orderkey) as product, o_orderkey % 2 = 0 as containerized from orders",
)
def _(t):
    number = F.col("o_orderkey").cast("string")
    entry = F.struct(
        F.concat(F.lit("k"), "o_orderstatus").alias("cache_key"),
        F.concat(F.lit("run"), (F.col("o_orderkey") % 5).cast("string")).alias("run_id"),
        F.create_map(F.lit("product"), F.concat(F.lit("/out/"), number)).alias("outputs"),
        (F.col("o_orderkey") % 2 == 0).alias("containerized"),
    )
    # One document per customer and span of orders, so that no owner, however
    # busy, has to fit in one text.
    span = F.floor(F.col("o_orderkey") / 100000)
    docs = t.orders.groupBy(F.col("o_custkey").alias("owner"), span.alias("span")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("step"), number), entry)))).alias("text")
    )
    return R.parse_cache(docs.drop("span")).select("owner", "step_path", "cache_key", "run_id", F.col("outputs")["product"].alias("product"), "containerized")


#: Generations of a chain that one document holds.
SPAN = 10_000


def _journals(t):
    # One document per chain, and one more for each further SPAN generations, which says where it begins.
    span = F.floor(F.col("pos") / SPAN).alias("span")
    generations = t.generations.groupBy("chain", span).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "size", F.col("present").alias("snapshot_present")))), lambda g: F.struct(g["name"].alias("name"), g["size"].alias("size"), g["snapshot_present"].alias("snapshot_present"))).alias("generations")
    )
    consumed = t.consumed.groupBy("chain").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("::", "step_path", "field"), "name"))).alias("consumed"))
    marker = F.when(F.col("marker_run").isNotNull(), F.struct(F.lit("s1").alias("step_path"), F.lit("ms").alias("field"), F.col("marker_run").alias("run_id")))
    chains = t.chains.join(generations, "chain").join(consumed, "chain", "left")
    begins = F.when(F.col("span") > 0, F.col("span") * SPAN).alias("first")
    return chains.select(
        F.to_json(F.create_map("path", F.struct(F.col("chain").alias("dev"), "path", "head", "status", "tainted_through", begins, "generations", "consumed", marker.alias("marker")))).alias("text")
    )


@query(
    "chain_journal",
    "SRC4",
    "select path as chain, chain as dev, head, status, tainted_through, case when marker_run is not null then 's1' end as marker_step, marker_run from chains",
)
def _(t):
    return R.parse_chains(_journals(t))[0].select("chain", "dev", "head", "status", "tainted_through", "marker_step", "marker_run")


@query(
    "chain_generations",
    "SRC4",
    """select c.path as chain, row_number() over (partition by g.chain order by g.pos) - 1 as pos, g.name, g.size, g.present from generations g join chains c using (chain)""",
)
def _(t):
    return R.parse_chains(_journals(t))[1]


@query("chain_consumed", "SRC4", "select c.path as chain, k.step_path, k.field, k.name from consumed k join chains c using (chain)")
def _(t):
    return R.parse_chains(_journals(t))[2]


@query("file_inventory", "SRC5")
def _(t):
    return R.scan_files(t.spark, t.folder)


@query("file_samples", "SRC6")
def _(t):
    return R.scan_files(t.spark, t.folder, sample=True)


LINE = "concat(cast(o_orderkey as varchar(20)), ' ', o_orderstatus, ' ', o_orderpriority)"


def _written(t) -> str:
    """Orders as text files, one for each span of a thousand keys, and the marker of the writer, which is empty."""
    path = f"{scratch_root(t.spark)}/{uuid.uuid4().hex}"
    lines = t.orders.select(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("value"), F.floor(F.col("o_orderkey") / 1000).alias("span"), "o_orderkey")
    lines.repartition("span").sortWithinPartitions("span", "o_orderkey").select("value", "span").write.partitionBy("span").text(path)
    return path


@query(
    "written_inventory",
    "SRC5",
    f"""
    select cast(o_orderkey // 1000 as varchar(20)) as span, sum(length({LINE}) + 1) as size, 1 as files from orders group by 1
    union all select '_SUCCESS', 0, 1""",
)
def _(t):
    """Sizes of files that were just written, the empty one too."""
    roots = t.spark.createDataFrame([(_written(t),)], "root string")
    found = walk_files(roots).where(~F.substring_index("relpath", "/", -1).startswith("."))
    return found.groupBy(F.coalesce(F.nullif(F.regexp_extract("relpath", "^span=([0-9]+)/", 1), F.lit("")), "relpath").alias("span")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"))


@query(
    "written_samples",
    "SRC6",
    f"""
    with f as (select cast(o_orderkey // 1000 as varchar(20)) as span, string_agg({LINE} || chr(10), '' order by o_orderkey) as c from orders group by 1)
    select span, sha256(left(c, 4096) || right(c, cast(greatest(0, least(4096, length(c) - 4096)) as integer))) as sample, null as error from f""",
)
def _(t):
    """Samples of files that were just written."""
    found = R.scan_files(t.spark, _written(t), sample=True)
    return found.select(F.regexp_extract("path", "/span=([0-9]+)/", 1).alias("span"), "sample", "error")


@query(
    "rejected_documents",
    "SRC1 SRC3 SRC7",
    """select o_orderkey, case o_orderkey % 7 when 1 then 'empty' when 2 then 'not JSON' else 'not of the expected shape' end as reason from orders where o_orderkey % 7 between 1 and 3""",
)
def _(t):
    """Files of one document each line, some cut off, empty or a list, written and read back."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 7
    whole = F.to_json(F.create_map(F.concat(F.lit("step"), key.cast("string")), F.struct(F.concat(F.lit("k"), "o_orderstatus").alias("cache_key"))))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.substr(whole, F.lit(1), F.length(whole) - 2)).when(kind == 3, F.lit("[1, 2]")).otherwise(whole)
    path = f"{scratch_root(t.spark)}/{uuid.uuid4().hex}"
    t.orders.select(F.concat_ws("\t", key.cast("string"), text).alias("value")).write.text(path)
    docs = t.spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("bigint").alias("o_orderkey"), F.substring_index("value", "\t", -1).alias("text"))
    return R.rejected_json(docs, schema=R.CACHE_SCHEMA)


@query(
    "parameter_documents",
    "SRC7",
    """
    select concat('task', p_partkey) as task, case when p_partkey % 3 = 0 then 'casa:5' when p_partkey % 3 = 1 then 'wsclean' end as image, case when p_partkey % 2 = 0 then concat('bin', p_partkey) else concat('task', p_partkey) end as command,
           case when p_partkey % 3 = 0 then 'casa-task' else 'binary' end as flavour, pos, case pos when 0 then 'msname' when 1 then p_name else 'mode' end as name,
           case pos when 0 then 'MS' when 1 then 'int' else 'str' end as dtype, pos = 0 as required, case pos when 1 then cast(p_size as varchar) end as default_json, case pos when 0 then 'vis' end as mapping,
           case pos when 2 then '["a","b"]' end as choices_json, case pos when 0 then p_type end as info from part, (select unnest([0, 1, 2]) as pos) x""",
)
def _(t):
    key = F.col("p_partkey")
    task = F.concat(F.lit("task"), key.cast("string"))
    documents = t.part.select(
        F.concat(
            F.lit('{"task":"'), task, F.lit('","base":"'), F.when(key % 3 == 0, F.lit("casa:5")).when(key % 3 == 1, F.lit("wsclean")).otherwise(F.lit("")), F.lit('"'),
            F.when(key % 2 == 0, F.concat(F.lit(',"binary":"bin'), key.cast("string"), F.lit('"'))).otherwise(F.lit("")),
            F.lit(',"parameters":[{"name":"msname","dtype":"file","io":"msfile","required":true,"mapping":"vis","info":"'), "p_type", F.lit('"},{"name":"'), "p_name",
            F.lit('","dtype":["int","str"],"default":'), F.col("p_size").cast("string"), F.lit('},{"name":"mode","choices":["a","b"]}]}'),
        ).alias("text")
    )
    return R.parse_param_docs(documents)


@query(
    "yaml_parameters",
    "SRC8",
    """
    select cast(p_partkey as varchar) as doc, k as path, case k when 'cab.name' then p_name when 'cab.inputs.ms.dtype' then 'MS' when 'cab.inputs.ms.required' then 'true' when 'cab.inputs.n.default' then cast(p_size as varchar)
           when 'cab.inputs.n.choices' then '[1, 2]' else 'lib.a,lib.b' end as value
    from part, (select unnest(['cab.name', 'cab.inputs.ms.dtype', 'cab.inputs.ms.required', 'cab.inputs.n.default', 'cab.inputs.n.choices', 'cab.inputs._use']) as k) x""",
)
def _(t):
    text = F.concat(
        F.lit("cab:\n  name: "), "p_name", F.lit("\n  inputs:\n    _use: [lib.a, lib.b]\n    ms: {dtype: MS, required: true}\n    n:\n      default: "), F.col("p_size").cast("string"), F.lit("\n      choices: [1, 2]\n")
    )
    return R.parse_yaml(t.part.select(F.col("p_partkey").alias("file"), text.alias("text")))


DECLARED = """
    select cast(p_partkey as varchar(20)) as provider, concat('c', cast(p_size % 4 as varchar(5))) as scope, x.* from part,
    (select * from (values ('in', 'data_ms', 'MS', true, true, false, false, 'data.ms', 'data.ms'), ('in', 'data_column', 'str', false, false, true, false, 'data.column', 'data.column'),
                           ('in', 'stem', 'str', false, false, true, true, 'stem', null), ('in', 'bare', 'str', false, false, true, false, 'bare', null), ('in', 'day', 'str', false, false, true, false, 'day', null),
                           ('out', 'out_file', 'File', true, false, true, false, 'out-file', 'product')) v(side, field, dtype, is_path, required, writable, write_path, name, flag)) x"""


def _declarations(t):
    """A YAML document for each part, one a line, written and read back."""
    key = F.col("p_partkey")
    bad = F.when(key % 5 == 0, F.lit(", data.ms2: 5, sec: {deep: 7}")).when(key % 7 == 0, F.lit(", out-x: {dtype: int}, out x: {}")).otherwise(F.lit(""))
    text = F.concat(
        F.lit("cabs: {c"), (F.col("p_size") % 4).cast("string"), F.lit(": {command: x, inputs: {data: {ms: {dtype: MS, required: true, writable: false, policies: {positional: true}}, column: {default: {a: '"), "p_name",
        F.lit("'}}}, stem: {write_path: true}, bare: , day: {default: 2020-01-02}"), bad, F.lit("}, outputs: {out-file: {dtype: File, required: yes, implicit: '{stem}.fits', nom_de_guerre: product}}}}"),
    )
    path = f"{scratch_root(t.spark)}/{uuid.uuid4().hex}"
    t.part.select(F.concat_ws("\t", key.cast("string"), text).alias("value")).write.text(path)
    docs = t.spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("file"), F.substring_index("value", "\t", -1).alias("text"))
    return R.parse_yaml(docs)


@query(
    "document_fields",
    "SRC8 SCH2",
    f"""
    select provider, scope, side, field, dtype, is_path, required, case field when 'data_column' then concat('{{"a":"', p_name, '"}}') when 'day' then '2020-01-02' end as field_default, writable, write_path,
           case field when 'out_file' then '{{stem}}.fits' end as implicit, name, flag, field = 'data_ms' as positional
    from ({DECLARED}) d join part on cast(p_partkey as varchar(20)) = provider
    union all
    select cast(p_partkey as varchar(20)), concat('c', cast(p_size % 4 as varchar(5))), 'in', 'out_x', case n when 'out-x' then 'int' else 'str' end, false, false, null, true, false, null, n, n, false
    from part, (select unnest(['out-x', 'out x']) as n) x where p_partkey % 7 = 0 and p_partkey % 5 <> 0""",
)
def _(t):
    return D.document_fields(_declarations(t)).select(
        "provider", "scope", "side", "field", "dtype", "is_path", "required", "field_default", "writable", "write_path", "implicit", "name", "flag", "positional"
    )


@query(
    "document_errors",
    "SRC8",
    """
    select cast(p_partkey as varchar(20)) as provider, concat('c', cast(p_size % 4 as varchar(5))) as scope, 'in' as side, x.name, x.reason
    from part, (select * from (values (5, 'data.ms2', 'not a mapping'), (5, 'sec.deep', 'not a mapping'), (7, 'out x', 'several names become out_x')) v(k, name, reason)) x
    where p_partkey % x.k = 0 and (x.k = 5 or p_partkey % 5 <> 0)""",
)
def _(t):
    return D.document_errors(_declarations(t))


@query(
    "rows_by_document",
    "SRC8 SCH2",
    f"""
    with d as ({DIRTY})
    select o_orderkey, cast(code as bigint) as code, coalesce(cast(total as double), 0) as total, status, priority from d
    where try_cast(code as bigint) is not null and (total is null or total = '1.5') and status in ('F', 'O') and priority is not null and stray is null""",
)
def _(t):
    """Rows that fit a scope declared in YAML."""
    path = f"{scratch_root(t.spark)}/{uuid.uuid4().hex}"
    text = "cabs: {load: {inputs: {code: {dtype: int, required: true}, total: {dtype: float, required: true, default: 0.0}, status: {choices: [F, O]}, priority: {required: true}}}}"
    t.spark.createDataFrame([(text,)], "value string").write.text(path)
    fields = D.document_fields(R.read_param_yaml(t.spark, path).withColumn("doc", F.lit("orders")))
    return S.validate_rows(t.sql(DIRTY), D.declared_fields(fields, "orders", "load"), ["o_orderkey"])[0].select("o_orderkey", "code", "total", "status", "priority")


@query(
    "rejected_yaml_documents",
    "SRC8",
    """select cast(o_orderkey as varchar(20)) as doc, case o_orderkey % 7 when 1 then 'a value cannot be read' when 2 then 'not YAML' else 'holds itself' end as reason from orders where o_orderkey % 7 between 1 and 3""",
)
def _(t):
    """Documents with a date that is none, an open list, and a list that holds itself, among sound ones."""
    kind = F.col("o_orderkey") % 7
    text = F.when(kind == 1, F.lit("d: 2020-13-45")).when(kind == 2, F.lit("d: [1, 2")).when(kind == 3, F.lit("d: &a [*a]")).when(kind == 4, F.lit("d: {2020-01-02: !!set {x, y}}")).otherwise(F.lit("d: 2020-01-02"))
    found = R.rejected_yaml(t.orders.select(F.col("o_orderkey").alias("file"), text.alias("text")))
    return found.select("doc", F.substring_index("reason", ":", 1).alias("reason"))


@query(
    "rejected_records",
    "SRC1",
    """select cast(o_orderkey as varchar(20)) as run_id, case o_orderkey % 7 when 1 then 'a step is no object' when 2 then 'inputs is no object' when 3 then 'returncode is no whole number' else 'not JSON' end as reason from orders where o_orderkey % 7 between 1 and 4""",
)
def _(t):
    """Run documents with a step that is a text, inputs in a list, a code that is a word, or cut off, among sound ones."""
    step = {1: '"x"', 2: '{"name": "s", "inputs": [1]}', 3: '{"name": "s", "returncode": "one"}', 4: '{"name": '}
    shown = F.lit('{"name": "s", "returncode": 1}')
    for kind, text in step.items():
        shown = F.when(F.col("o_orderkey") % 7 == kind, F.lit(text)).otherwise(shown)
    docs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit('{"name": "r", "steps": ['), shown, F.lit("]}")).alias("text"))
    return R.rejected_records(docs)


@query(
    "replaced_partitions",
    "SRC12",
    """select l_returnflag, case when l_returnflag = 'R' then 'second' else 'first' end as run, count(*) as n from lineitem where l_returnflag <> 'R' or l_linenumber = 1 group by 1""",
)
def _(t):
    path = f"{scratch_root(t.spark)}/{uuid.uuid4().hex}"
    lines = t.lineitem.select("l_returnflag", "l_linenumber", F.lit("first").alias("run"))
    O.write_outputs(lines, path, ["l_returnflag"])
    again = lines.where("l_returnflag = 'R' and l_linenumber = 1").withColumn("run", F.lit("second"))
    O.write_outputs(again, path, ["l_returnflag"])
    return t.spark.read.parquet(path).groupBy("l_returnflag", "run").agg(F.count(F.lit(1)).alias("n"))
