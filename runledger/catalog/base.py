"""The registry of queries and the tables they run on.

A query is a function of `Tables` plus, where SQL can say it, an independently
written statement over the same tables. Inputs shaped like ledger tables are
derived from the given ones by the statements in `DERIVED`, which both engines
run as they are; those that number rows are built in Spark by an ordered scan
instead, so that no key has to fit in one task.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.plans.lineage import cut
from runledger.plans.scan import RowNumber, ordered_scan

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SPREAD_BYTES = 4 << 20

STEP_ORDER = (
    "l_linenumber l_partkey l_suppkey l_shipdate l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus"
).split()

DERIVED = {
    "accesses": """
        select user_id as path, event_id as step, ts, event_type, event_type in ('purchase', 'signup') as mutates,
               row_number() over (partition by user_id order by ts, event_id) as pos
        from events""",
    "steps": f"""
        select l_orderkey as recipe, concat('s', cast(l_linenumber as varchar(10))) as step, l_partkey as scope,
               row_number() over (partition by l_orderkey order by {", ".join(STEP_ORDER)}) as idx,
               l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_discount, l_tax, l_quantity
        from lineitem""",
    "edges": """
        select recipe, src, dst from (
          select recipe, idx as dst, case when scope % 97 = 0 then idx + 1 else 1 + scope % greatest(idx - 1, 1) end as src
          from steps where idx > 1) e""",
    "dag": "select recipe, src, dst from edges where src < dst",
    "step_records": """
        select recipe as run_id, idx, step, case when l_returnflag = 'R' then 1 + scope % 3 else 0 end as returncode,
               l_linestatus = 'O' as containerized,
               case when l_discount > 0.02 then concat('sha256:', cast(scope as varchar(20))) end as image_digest,
               case when l_tax > 0.07 then 'env' end as venv, scope % 5 = 0 as skipped
        from steps""",
    "generations": """
        select conv_id as chain, turn as pos, concat('g', cast(conv_id as varchar(20)), '_', cast(turn as varchar(20))) as name,
               cast(length(text) as bigint) as size, turn % 4 <> 3 as present, role
        from conversations""",
    "chains": """
        select chain, concat('/ws/c', cast(chain as varchar(20))) as path, max(pos) as head_pos,
               concat('g', cast(chain as varchar(20)), '_', cast(max(pos) as varchar(20))) as head,
               case when chain % 5 = 0 then 'untrusted' else 'trusted' end as status,
               case when chain % 7 = 0 then concat('run', cast(chain % 3 as varchar(20))) end as marker_run,
               case when chain % 6 = 0 then concat('g', cast(chain as varchar(20)), '_0')
                    when chain % 11 = 0 then 'lost' end as tainted_through,
               chain % 4 <> 1 as alive
        from generations group by chain""",
    "consumed": """
        select chain, concat('s', cast(pos % 3 as varchar(20))) as step_path, 'ms' as field, max(pos) as pos,
               concat('g', cast(chain as varchar(20)), '_', cast(max(pos) as varchar(20))) as name
        from generations where role = 'user' group by chain, pos % 3""",
    "files": """
        select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '') as path,
               cast(length(html) as bigint) as size
        from pages""",
    "settings": """
        select c_custkey as setting_key, 1 as layer_rank, r_name as value
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        union all
        select c_custkey, 2, case when n_nationkey % 3 = 0 then null else n_name end
        from customer join nation on c_nationkey = n_nationkey
        union all
        select c_custkey, 3, case when c_acctbal < 0 then null else c_mktsegment end from customer""",
    "lookups": """
        select o_orderkey as step_path, concat(cast(o_custkey as varchar(20)), o_orderstatus) as now_key,
               concat(cast(o_custkey as varchar(20)), case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end) as old_key,
               o_orderkey % 11 <> 0 as output_exists, o_orderkey % 13 <> 0 as has_entry,
               concat('/out/', cast(o_orderkey as varchar(20)), '.fits') as output_path
        from orders""",
    "jobs": """
        select cast(o_orderkey as varchar(20)) as job_id, o_orderstatus as state, '0:0' as exit_code from orders where o_orderkey % 9 <> 0
        union all
        select concat(cast(o_orderkey as varchar(20)), '.batch'), 'COMPLETED', '0:0' from orders""",
    "scope_fields": """
        select p_type as provider, p_brand as scope, case when p_partkey % 3 = 0 then 'out' else 'in' end as side,
               concat('f', cast(p_size % 12 as varchar(10))) as field,
               case p_partkey % 11 when 0 then 'int' when 1 then 'Float' when 2 then 'File' when 3 then 'MS' when 4 then 'List[str]'
                    when 5 then 'Tuple[int, List[float]]' when 6 then 'Union[int, File]' when 7 then 'list:dir' when 8 then 'whatever'
                    when 9 then 'BOOL' else ' Directory ' end as dtype,
               p_partkey % 11 in (2, 3, 6, 7, 10) as is_path, p_partkey % 4 = 0 as required,
               case when p_partkey % 5 = 0 then p_name end as field_default, p_partkey % 7 = 0 as mutable, p_partkey % 6 <> 2 as writable,
               p_partkey % 6 = 1 as write_path,
               case when p_partkey % 6 = 0 then concat('{f', cast(p_partkey % 12 as varchar(10)), '}-x.fits') end as implicit, p_partkey
        from part""",
    "wiring": """
        select recipe, step, idx, case scope % 7 when 0 then 'zz' when 1 then 'c' else 'a' end as field, cast(null as integer) as pos,
               case when idx = 1 or scope % 4 = 0 then 'input' else 'output' end as src_kind,
               case when idx = 1 or scope % 4 = 0 then null else concat('s', cast((l_linenumber + scope) % 8 as varchar(10))) end as src_step,
               case when idx = 1 or scope % 4 = 0 then case when scope % 6 = 0 then 'missing' else 'rin' end
                    when scope % 2 = 0 then 'aux' else 'out' end as src_field
        from steps""",
    "input_fields": """
        select p_partkey as scope, 'a' as field from part union all select p_partkey, 'b' from part
        union all select p_partkey, 'c' from part where p_partkey % 5 <> 0""",
    "output_fields": """
        select p_partkey as scope, 'out' as field from part union all select p_partkey, 'aux' from part where p_partkey % 3 = 0""",
    "sizes": """
        select p_partkey, p_size, p_type,
               concat(case when p_partkey % 17 = 0 then '-' when p_partkey % 19 = 0 then '1.2.' when p_partkey % 3 = 0 then ' 0.' else '' end,
                      cast(p_size as varchar(10)),
                      case p_partkey % 7 when 0 then '' when 1 then 'GB' when 2 then ' GiB' when 3 then 'k' when 4 then 'mib ' when 5 then 'T'
                           else ' parsecs' end) as text
        from part""",
    "refs": """
        select p_partkey,
               concat(case p_partkey % 8 when 0 then '' when 1 then 'org/' when 2 then 'localhost:5000/team/' when 3 then 'docker://quay.io/lab/'
                           when 4 then 'oras://ghcr.io/' when 5 then 'registry.io:443/' when 6 then 'docker://' else 'localhost/' end,
                      'tool', cast(p_size as varchar(10)),
                      case p_partkey % 5 when 0 then '' when 1 then ':1.2' when 2 then '@sha256:abc' when 3 then ':v3@sha256:def' else ':latest' end) as ref,
               concat('sha256:', cast(p_partkey as varchar(10))) as digest
        from part""",
}


class Tables:
    """The given tables of one scale folder, and what is derived from them."""

    _cache: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Tables":
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, folder)
        return cls._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in DERIVED):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE:
            path = f"{self.folder}/{name}.parquet"
            return self._spread(self.spark.read.parquet(path), path)
        if name == "steps":
            # Stored once per session, as a ledger table would be.
            return cut(self._steps())
        return self.sql(DERIVED[name])

    def _spread(self, df: DataFrame, path: str) -> DataFrame:
        """A table of one file of some size over all local threads; a cluster's tables have files enough."""
        context = self.spark.sparkContext
        lone = context.master.startswith("local") and os.path.isfile(path) and os.path.getsize(path) > SPREAD_BYTES
        return df.repartition(context.defaultParallelism) if lone else df

    def sql(self, text: str) -> DataFrame:
        """Run a statement that names given or derived tables."""
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in [*BASE, *DERIVED]:
            if name in words:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def _steps(self) -> DataFrame:
        chunk = [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 4096)]
        numbered = ordered_scan(self.lineitem, ["l_orderkey"], STEP_ORDER, chunk, {"idx": RowNumber()})
        return numbered.select(
            F.col("l_orderkey").alias("recipe"),
            F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("step"),
            F.col("l_partkey").alias("scope"),
            "idx",
            "l_suppkey",
            "l_linenumber",
            "l_returnflag",
            "l_linestatus",
            "l_discount",
            "l_tax",
            "l_quantity",
        )


@dataclass(frozen=True)
class Query:
    name: str
    rule: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, rule: str, sql: str | None = None) -> Callable:
    """Register a query, the inventory row it answers, and its SQL if it has one."""

    def wrap(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, rule, run, None if sql is None else with_derived(sql))
        return run

    return wrap


def with_derived(sql: str) -> str:
    """Prepend the derived tables a statement names, in the order they depend on each other."""
    body = sql.strip()
    needed: list[str] = []

    def need(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name, definition in DERIVED.items():
            if name in words and name not in needed:
                need(definition)
                if name not in needed:
                    needed.append(name)

    need(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} as ({DERIVED[name]})" for name in needed)
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with recursive {ctes},\n{body[len('with '):]}"
    return f"with recursive {ctes}\n{body}"
