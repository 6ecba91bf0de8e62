"""Lines, extracted values, scatter and gather over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runledger.catalog.base import query
from runledger.operators import extract as X
from runledger.operators import scatter as G
from runledger.operators.schema import type_of
from runledger.plans.lineage import scratch_root
from runledger.sources import logs as L

LINES_SQL = r"""
    split as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]') as a from documents),
    kept as (select doc_id, case when a[len(a)] = '' then a[1:len(a) - 1] else a end as a from split),
    lines as (select doc_id, unnest(range(len(a))) as line_no, unnest(a) as text from kept)"""


@query("log_lines", "SRC9", f"with {LINES_SQL} select doc_id, line_no, text from lines")
def _(t):
    return L.explode_lines(t.documents, "text", ["doc_id"])


@query("split_log_lines", "SRC9", f"with {LINES_SQL} select doc_id, line_no, text from lines")
def _(t):
    """Lines written to files of many documents, read in splits; a document's lines are numbered from its first."""
    path = f"{scratch_root(t.spark)}/{uuid.uuid4().hex}"
    lines = L.explode_lines(t.documents, "text", ["doc_id"])
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "line_no").select(F.concat_ws("\t", F.col("doc_id").cast("string"), "text").alias("value")).write.text(path)
    read = L.read_log_lines(t.spark, path).select("file", "line_no", F.substring_index("text", "\t", 1).cast("bigint").alias("doc_id"), F.expr("substring(text, instr(text, '\t') + 1)").alias("text"))
    first = read.groupBy("file", "doc_id").agg(F.min("line_no").alias("first"))
    return read.join(first, ["file", "doc_id"]).select("doc_id", (F.col("line_no") - F.col("first")).alias("line_no"), "text")


RUN_LOG = """
    select event_id, user_id, concat('2024-01-01 00:00:', lpad(cast(event_id % 60 as varchar(2)), 2, '0'), ',', lpad(cast(event_id % 1000 as varchar(3)), 3, '0'), ' ',
             case event_id % 4 when 0 then 'INFO' when 1 then 'WARNING' when 2 then 'ERROR' else 'DEBUG' end, ' ',
             case event_type when 'click' then concat('step r.u', cast(user_id as varchar(20)), ': starting (sandboxed)')
                  when 'view' then concat('step r.u', cast(user_id as varchar(20)), ': finished (returncode 0)')
                  when 'error' then concat('step r.u', cast(user_id as varchar(20)), ': failed (returncode 1)')
                  when 'signup' then concat('[u', cast(user_id as varchar(20)), '] ', props) else 'budget admitted' end) as text from events"""


@query(
    "run_log_events",
    "SRC10",
    f"""
    select event_id, make_timestamp(2024, 1, 1, 0, 0, (event_id % 60) + (event_id % 1000) / 1000.0) as ts,
           case event_id % 4 when 0 then 'INFO' when 1 then 'WARNING' else 'ERROR' end as level,
           case event_type when 'signup' then concat('u', e.user_id) when 'purchase' then null else concat('r.u', e.user_id) end as step,
           case event_type when 'click' then 'starting' when 'view' then 'finished' when 'error' then 'failed' when 'signup' then 'output' end as event
    from ({RUN_LOG}) l join events e using (event_id) where event_id % 4 <> 3""",
)
def _(t):
    parsed = L.parse_run_log(t.sql(RUN_LOG))
    return parsed.where(L.at_least(F.col("level"), "INFO")).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "step", "event")


RULES = [
    X.Rule(r"(?P<number>[0-9]+)", "number", "int"),
    X.Rule(r"^(?P<opening>\S+)", "opening", "str"),
    X.Rule(r"(?P<ratio>[0-9]+\.[0-9]+)", "ratio", "float"),
    X.Rule(r"(?P<mail>[a-z]+@[a-z]+)", "mail", "bool"),
    X.Rule(r"(?P<opening>[A-Z][a-z]+) (?P<next>[0-9]+)?", "opening", "str"),
    X.Rule(r"(?:^| )(?P<odd>[a-z]{12,}[0-9]*)", "odd", "int"),
]


EXTRACTED_SQL = rf"""
    with {LINES_SQL},
    hits as (
      select doc_id, line_no, 0 as rule_no, 'number' as field, 'int' as type, regexp_extract(text, '([0-9]+)', 1) as raw from lines where regexp_matches(text, '([0-9]+)')
      union all select doc_id, line_no, 1, 'opening', 'str', regexp_extract(text, '^(\S+)', 1) from lines where regexp_matches(text, '^(\S+)')
      union all select doc_id, line_no, 2, 'ratio', 'float', regexp_extract(text, '([0-9]+\.[0-9]+)', 1) from lines where regexp_matches(text, '([0-9]+\.[0-9]+)')
      union all select doc_id, line_no, 3, 'mail', 'bool', regexp_extract(text, '([a-z]+@[a-z]+)', 1) from lines where regexp_matches(text, '([a-z]+@[a-z]+)')
      union all select doc_id, line_no, 4, 'opening', 'str', regexp_extract(text, '([A-Z][a-z]+) ([0-9]+)?', 1) from lines where regexp_matches(text, '([A-Z][a-z]+) ([0-9]+)?')
      union all select doc_id, line_no, 5, 'odd', 'int', regexp_extract(text, '(?:^| )([a-z]{{12,}}[0-9]*)', 1) from lines where regexp_matches(text, '(?:^| )([a-z]{{12,}}[0-9]*)')),
    last as (select * from hits qualify row_number() over (partition by doc_id, field order by line_no desc, rule_no desc) = 1)
    select doc_id, field, type, case when type = 'str' then raw end as text_value, case when type = 'int' then try_cast(raw as bigint) end as int_value,
           case when type = 'float' then try_cast(raw as double) end as float_value, case when type = 'bool' then true end as bool_value,
           case when type = 'int' and try_cast(raw as bigint) is null then 'not an int' end as error from last"""


@query("extracted_values", "AG1", EXTRACTED_SQL)
def _(t):
    return X.extract_values(L.explode_lines(t.documents, "text", ["doc_id"]), RULES, ["doc_id"], ["line_no"])


@query(
    "marker_fields",
    "AG20",
    f"""
    with {LINES_SQL}, m as (select doc_id, line_no, trim(text) as text from lines)
    select doc_id, arg_max(trim(text[4:]), line_no) filter (text like 'The%') as platform, nullif(arg_max(trim(text[3:]), line_no) filter (text like 'An%'), '') as tool,
           case when count(*) filter (text like 'The%') = 0 then 'platform' else '' end as missing
    from m group by doc_id""",
)
def _(t):
    lines = L.explode_lines(t.documents, "text", ["doc_id"])
    return X.extract_markers(lines, {"platform": "The", "tool": "An"}, ["doc_id"], ["line_no"], required=["platform"])


@query(
    "scatter_vectors",
    "SG1",
    """
    select vec_id, label, unnest(range(len(embedding))) as idx, unnest(embedding) as x, unnest(list_transform(embedding, lambda v: v * 2)) as y from embeddings""",
)
def _(t):
    two = t.embeddings.select("vec_id", "label", F.col("embedding").alias("x"), F.transform("embedding", lambda v: v * F.lit(2).cast("float")).alias("y"))
    return G.scatter(two, ["x", "y"])


UNEVEN = """
    select p_partkey, split(p_name, ' ') as words, case when p_partkey % 10 = 0 then null when p_partkey % 3 = 0 then split(p_type, 'O') else split(p_name, ' ') end as others from part"""


@query(
    "scatter_rejects",
    "SG2",
    """
    with u as (select p_partkey, len(string_split(p_name, ' ')) as a, case when p_partkey % 10 = 0 then null when p_partkey % 3 = 0
                 then len(string_split(p_type, 'O')) else len(string_split(p_name, ' ')) end as b from part)
    select p_partkey, case when b is null then 'not a list: others' else concat('different lengths: ', least(a, b), ',', greatest(a, b)) end as reason
    from u where b is null or a <> b""",
)
def _(t):
    return G.scatter_rejects(t.sql(UNEVEN), ["words", "others"]).select("p_partkey", "reason")


@query(
    "gathered_scopes",
    "SG3",
    f"""select recipe, idx // {G.PART_ROWS} as part, string_agg(cast(scope as varchar), ',' order by idx) as scopes from steps group by 1, 2""",
)
def _(t):
    return G.gather(t.steps, ["recipe"], "idx", ["scope"]).select("recipe", "part", F.array_join(F.transform("scope", lambda s: s.cast("string")), ",").alias("scopes"))


@query(
    "gathered_runs",
    "SG4",
    f"""
    with s as (select run_id, coalesce(arg_min(returncode, idx) filter (returncode <> 0), 0) as returncode, bool_or(containerized) as containerized from step_records group by run_id),
    r as (select run_id, idx // {G.PART_ROWS} as part, string_agg(image_digest, ',' order by idx) as images, string_agg(case when skipped then '' else step end, chr(10) order by idx) filter (not skipped) as stdout
          from step_records group by 1, 2)
    select run_id, part, returncode, containerized, coalesce(stdout, '') as stdout, case when returncode = 0 then coalesce(images, '') else '' end as images from r join s using (run_id)""",
)
def _(t):
    slices = t.step_records.withColumn("stdout", F.when(F.col("skipped"), F.lit("")).otherwise(F.col("step")))
    out = G.gather(slices, ["run_id"], "idx", ["image_digest"], rc="returncode", flags=["containerized"], texts=["stdout"])
    return out.select("run_id", "part", "returncode", "containerized", "stdout", F.array_join("image_digest", ",").alias("images"))


@query(
    "gathered_with_empty",
    "SG5",
    f"""
    select c_custkey, coalesce(o_orderkey // {G.PART_ROWS}, 0) as part, coalesce(string_agg(o_orderstatus, ',' order by o_orderkey), '') as statuses, count(o_orderkey) as n
    from customer left join (select * from orders where o_orderkey % 4 = 0) o on c_custkey = o_custkey group by 1, 2""",
)
def _(t):
    slices = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    out = G.gather(slices, ["c_custkey"], "o_orderkey", ["o_orderstatus"], expected=t.customer)
    return out.select("c_custkey", "part", F.array_join("o_orderstatus", ",").alias("statuses"), F.size("o_orderstatus").alias("n"))


STATUS_SQL = "select run_id, count(*) as slices, coalesce(arg_min(returncode, idx) filter (returncode <> 0), 0) as returncode, bool_or(containerized) as containerized from step_records where idx > 2 group by 1"


def _gathered(t):
    slices = t.step_records.where("idx > 2").withColumn("stdout", F.when(~F.col("skipped"), F.col("step")))
    return G.gather_rows(slices, ["run_id"], "idx", ["image_digest"], rc="returncode", flags=["containerized"], texts=["stdout"], expected=t.step_records.select("run_id"))


@query(
    "gathered_status",
    "SG4 SG5",
    f"""
    with s as ({STATUS_SQL})
    select r.run_id, coalesce(slices, 0) as slices, coalesce(returncode, 0) as returncode, coalesce(containerized, false) as containerized from (select distinct run_id from step_records) r left join s using (run_id)""",
)
def _(t):
    return _gathered(t).status


@query("gathered_values", "SG3 SG4", f"with s as ({STATUS_SQL}) select run_id, idx, image_digest from step_records join s using (run_id) where idx > 2 and s.returncode = 0")
def _(t):
    return _gathered(t).values


@query("gathered_console", "SG4 AG8", "select run_id, idx, 'stdout' as field, step as text from step_records where idx > 2 and not skipped")
def _(t):
    return _gathered(t).texts


@query(
    "gathered_types",
    "SG6",
    """
    select p_partkey, case when side = 'out' or field in ('f1', 'f2', 'f3') then concat('array<', ddl, '>') else ddl end as ddl from (
      select p_partkey, side, field, case p_partkey % 11 when 0 then 'bigint' when 1 then 'double' when 4 then 'array<string>' when 5 then 'struct<_0:bigint,_1:array<double>>'
             when 7 then 'array<string>' when 9 then 'boolean' else 'string' end as ddl from scope_fields) s""",
)
def _(t):
    typed = t.scope_fields.withColumn("ddl", type_of(F.col("dtype")).getField("ddl"))
    return typed.select("p_partkey", G.gathered_type(F.col("ddl"), F.col("side"), F.col("field").isin("f1", "f2", "f3")).alias("ddl"))


@query(
    "chained_scatter",
    "SG7",
    """select recipe, idx - 1 as pos, scope * 2 as scope, step from (select *, row_number() over (partition by recipe order by idx) as n from steps) s""",
)
def _(t):
    lists = G.gather(t.steps, ["recipe"], "idx", ["scope", "step"])
    again = G.scatter(lists, ["scope", "step"], index="slice")
    return again.select("recipe", (F.col("part") * G.PART_ROWS + F.col("slice")).alias("pos"), (F.col("scope") * 2).alias("scope"), "step")
