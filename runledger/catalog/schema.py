"""Declared schemas over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.base import query
from runledger.operators import schema as S

ORDER_FIELDS = [
    S.Field("code", "int", required=True),
    S.Field("total", "float", required=True, default=0.0),
    S.Field("status", "str", choices=("F", "O")),
    S.Field("priority", "str", required=True),
]
DIRTY = """
    select o_orderkey, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then 'x1' else cast(o_custkey as varchar(20)) end as code,
           case when o_orderkey % 6 = 0 then null when o_orderkey % 11 = 0 then 'n/a' else '1.5' end as total,
           o_orderstatus as status, case when o_orderkey % 13 = 0 then null else o_orderpriority end as priority,
           case when o_orderkey % 17 = 0 then 'extra' end as stray
    from orders"""


@query(
    "declared_types",
    "SCH1",
    """
    select p_partkey, dtype, case p_partkey % 11 when 0 then 'bigint' when 1 then 'double' when 4 then 'array<string>' when 5 then 'struct<_0:bigint,_1:array<double>>'
           when 7 then 'array<string>' when 9 then 'boolean' else 'string' end as ddl, is_path from scope_fields""",
)
def _(t):
    return t.scope_fields.select("p_partkey", "dtype", S.type_of(F.col("dtype")).alias("t")).select("p_partkey", "dtype", "t.ddl", "t.is_path")


@query(
    "rejected_rows",
    "SCH2",
    f"""
    with d as ({DIRTY}), r as (
      select o_orderkey, concat_ws('; ', case when code is null then 'code: missing' end, case when try_cast(code as bigint) is null and code is not null then 'code: not int' end,
             case when total is not null and try_cast(total as double) is null then 'total: not float' end,
             case when status not in ('F', 'O') then 'status: not a choice' end, case when priority is null then 'priority: missing' end,
             case when stray is not null then 'stray: unknown' end) as reasons from d)
    select * from r where reasons <> ''""",
)
def _(t):
    _valid, rejects = S.validate_rows(t.sql(DIRTY), ORDER_FIELDS, ["o_orderkey"])
    return rejects.select("o_orderkey", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "valid_rows",
    "SCH2",
    f"""
    with d as ({DIRTY})
    select o_orderkey, cast(code as bigint) as code, coalesce(cast(total as double), 0) as total, status, priority from d
    where try_cast(code as bigint) is not null and (total is null or total = '1.5') and status in ('F', 'O') and priority is not null and stray is null""",
)
def _(t):
    valid, _rejects = S.validate_rows(t.sql(DIRTY), ORDER_FIELDS, ["o_orderkey"])
    return valid


@query(
    "field_defaults",
    "SCH3",
    f"""select o_orderkey, code, coalesce(total, '0.0') as total, status, priority, stray, 'native' as engine from ({DIRTY}) d""",
)
def _(t):
    return S.apply_defaults(t.sql(DIRTY), [S.Field("total", "str", default="0.0"), S.Field("engine", "str", default="native")])


@query(
    "choice_members",
    "SCH4",
    """select p_partkey, p_type in ('ECONOMY', 'PROMO') as fixed_choice, p_size % 2 = 0 and p_size <> 20 as data_choice from part""",
)
def _(t):
    options = F.filter(F.sequence(F.lit(0), F.lit(100), F.lit(2)), lambda x: x != 20)
    return t.part.select(
        "p_partkey", S.in_choices(F.col("p_type"), ["ECONOMY", "PROMO"]).alias("fixed_choice"), S.in_choices(F.col("p_size"), options).alias("data_choice")
    )


NAMES = """
    select p_brand as scope, concat(case p_partkey % 3 when 0 then p_name when 1 then replace(p_name, ' ', '-') else replace(p_name, ' ', '.') end,
           cast(p_size % 5 as varchar(10))) as name from part"""


@query(
    "name_collisions",
    "SCH5",
    f"""
    select scope, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') as identifier, count(distinct name) as n_names, min(name) as first_name, max(name) as last_name
    from ({NAMES}) n group by 1, 2 having count(distinct name) > 1""",
)
def _(t):
    return S.name_collisions(t.sql(NAMES), ["scope"], "name")


@query(
    "flat_groups",
    "SCH6",
    """select o_orderkey, o_custkey as who_id, case when o_orderkey % 2 = 0 then o_orderstatus else 'none' end as what_state_code, o_totalprice as what_price from orders""",
)
def _(t):
    nested = t.orders.select(
        "o_orderkey",
        F.struct(F.col("o_custkey").alias("id")).alias("who"),
        F.struct(
            F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("code")).alias("state"), F.col("o_totalprice").alias("price")
        ).alias("what"),
    )
    rebuilt = S.unflatten_struct(S.flatten_struct(nested), nested.schema, defaults={"what_state_code": "none"})
    return S.flatten_struct(rebuilt)


FAMILY = S.Family([".+?", ["int", "time-int", "solvable"]], "-")
TERMS = """
    select p_partkey, concat(replace(p_name, ' ', '-'), '-', case p_partkey % 4 when 0 then 'int' when 1 then 'time-int' when 2 then 'solvable' else 'other' end) as name from part"""


@query(
    "name_families",
    "SCH7",
    f"""
    with n as ({TERMS})
    select p_partkey, name, case when name like '%-time-int' then name[1:length(name) - 9] when name like '%-int' then name[1:length(name) - 4]
           when name like '%-solvable' then name[1:length(name) - 9] end as term,
           case when name like '%-time-int' then 'time-int' when name like '%-int' then 'int' when name like '%-solvable' then 'solvable' end as attr
    from n""",
)
def _(t):
    return t.sql(TERMS).withColumn("m", S.match_family(F.col("name"), FAMILY)).select("p_partkey", "name", "m.term", "m.attr")


@query(
    "melted_family",
    "SCH7",
    """
    select p_partkey, 'g1' as term, 'int' as attr, cast(p_size as varchar) as value from part
    union all select p_partkey, 'g1', 'time-int', p_type from part union all select p_partkey, 'b', 'solvable', p_brand from part""",
)
def _(t):
    wide = t.part.select("p_partkey", F.col("p_size").alias("g1-int"), F.col("p_type").alias("g1-time-int"), F.col("p_brand").alias("b-solvable"), "p_name")
    return S.melt_pattern(wide, ["p_partkey"], FAMILY)


@query(
    "template_column",
    "SCH8",
    """select o_orderkey, concat('{', o_custkey, '}/', o_orderstatus, '-', coalesce(case when o_orderkey % 2 = 0 then o_orderpriority end, 'None'), '-image.fits') as product, 'log.txt' as log from orders""",
)
def _(t):
    df = t.orders.withColumn("suffix", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return df.select(
        "o_orderkey",
        S.template("{{{o_custkey}}}/{o_orderstatus}-{suffix}-image.fits", df.columns).alias("product"),
        S.template("log.txt", df.columns).alias("log"),
    )


@query(
    "filled_outputs",
    "SCH9",
    """
    with f as (select o_orderkey, unnest(['image', 'mask', 'returncode', 'log']) as field, o_custkey, o_orderstatus from orders)
    select o_orderkey, field, case
             when field = 'image' and o_orderkey % 3 = 0 then concat('parsed', o_custkey)
             when field in ('image', 'mask') and o_orderkey % 4 = 0 then case when o_orderkey % 8 = 0 then null else concat('in-', field) end
             when field = 'returncode' then '0'
             when field = 'image' then concat(o_custkey, '-MFS-image.fits')
             when field = 'mask' then 'default.mask' end as value
    from f""",
)
def _(t):
    names = F.array(*[F.lit(n) for n in ("image", "mask", "returncode", "log")])
    declared = t.orders.select("o_orderkey", "o_custkey", F.explode(names).alias("field"))
    key, name = F.col("o_orderkey"), F.col("field")
    extracted = declared.where((name == "image") & (key % 3 == 0)).withColumn("value", F.concat(F.lit("parsed"), F.col("o_custkey").cast("string")))
    given = declared.where(name.isin("image", "mask") & (key % 4 == 0)).withColumn("value", F.when(key % 8 != 0, F.concat(F.lit("in-"), name)))
    reserved = declared.where(name == "returncode").withColumn("value", F.lit("0"))
    implicit = declared.where(name == "image").withColumn("value", S.template("{o_custkey}-MFS-image.fits", declared.columns))
    default = declared.where(name == "mask").withColumn("value", F.lit("default.mask"))
    return S.fill_outputs(declared, ["o_orderkey"], extracted, given, reserved, implicit, default).select("o_orderkey", "field", "value")


@query(
    "field_roles",
    "SCH10 SO1",
    """
    with i as (select * from scope_fields where side = 'in'), o as (select * from scope_fields where side = 'out'),
    names as (select distinct scope, field from i),
    inpath as (select distinct scope, field from i where is_path), outpath as (select distinct scope, field from o where is_path),
    marked as (select distinct scope, field from i where mutable),
    mutated as ((select * from inpath intersect select * from outpath) union (select * from inpath intersect select * from marked)),
    loose as (select distinct scope, field from i where writable), targets as (select distinct scope, field from scope_fields where write_path)
    select scope, field, (scope, field) in (from inpath) as path, (scope, field) in (from inpath) and (scope, field) not in (from loose) as readonly,
           (scope, field) in (from targets) as write_target, (scope, field) in (from mutated) as mutated from names""",
)
def _(t):
    return S.classify_fields(t.scope_fields)


PATTERNS = "select p_brand as scope, concat('{f', cast(p_size % 7 as varchar(10)), '}/*') as pattern from part where p_partkey % 10 = 0"


@query(
    "orphan_write_targets",
    "SCH11",
    f"""
    with decl as (select scope, implicit as text from scope_fields where side = 'out' and implicit is not null union all select scope, pattern from ({PATTERNS}) p)
    select distinct scope, field from scope_fields s where write_path
      and not exists (select 1 from decl d where d.scope = s.scope and contains(d.text, '{{' || s.field))
      and not exists (select 1 from scope_fields o where o.scope = s.scope and o.field = s.field and o.side = 'out' and o.is_path)""",
)
def _(t):
    return S.orphan_write_targets(t.scope_fields, t.sql(PATTERNS))


@query(
    "scope_listing",
    "SCH12",
    """
    select distinct provider, scope, field, concat(dtype, ' ', case when required and field_default is null then 'required'
           else 'default=' || coalesce(field_default, 'None') end) as line from scope_fields""",
)
def _(t):
    return S.describe_scopes(t.scope_fields)


@query(
    "first_provider",
    "SCH13",
    """
    with c as (select p_name as name, p_brand as provider, p_size as rank from part)
    select name, provider, rank, (select count(distinct provider) from c d where d.name = c.name) as n_providers from c
    qualify row_number() over (partition by name order by provider, rank) = 1""",
)
def _(t):
    return S.resolve_provider(t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("provider"), F.col("p_size").alias("rank")))
