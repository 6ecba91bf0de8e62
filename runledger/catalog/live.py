"""Typed steps, incremental work and streams over the given tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F

from runledger.catalog.base import query
from runledger.catalog.slices import EXTRACTED_SQL, RULES
from runledger.operators import incremental as I
from runledger.operators import steps as S
from runledger.operators.extract import Rule
from runledger.plans.lineage import scratch_root
from runledger.sources.logs import explode_lines
from runledger.streaming import live as V


def _fresh(t) -> str:
    return f"{scratch_root(t.spark)}/{uuid.uuid4().hex}"


@dataclass
class Price:
    net: float | None
    label: str


@S.row_step
def price(ctx, o_totalprice: float, o_orderstatus: str, rate: float = 1.0) -> Price:
    if o_orderstatus == "P":
        raise ValueError("pending")
    return Price(o_totalprice * rate, f"{ctx['prefix']}{o_orderstatus}")


@query(
    "typed_step",
    "UD1 UD2 UD3 UD4",
    """select o_orderkey, case when o_orderstatus <> 'P' then o_totalprice * 2 end as net, case when o_orderstatus <> 'P' then concat('st-', o_orderstatus) end as label,
              case when o_orderstatus = 'P' then 1 else 0 end as returncode, case when o_orderstatus = 'P' then 'ValueError: pending' end as reason from orders""",
)
def _(t):
    return S.apply_step(t.orders, price(rate=2.0), keep=["o_orderkey"], ctx={"prefix": "st-"}, on_error="record")


@dataclass
class Doubled:
    twice: int | None
    digits: str


@S.row_step
def double(number: int | None) -> Doubled:
    return Doubled(None if number is None else 2 * number, str(number))


@query(
    "exact_numbers",
    "UD1",
    """
    with n as (select o_orderkey, case when o_orderkey % 3 > 0 then 4503599627370497 + o_orderkey end as number from orders)
    select o_orderkey, number, 2 * number as twice, coalesce(cast(number as varchar(20)), 'None') as digits from n""",
)
def _(t):
    """Whole numbers that floating point cannot hold, doubled, beside nulls."""
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.lit((1 << 52) + 1) + F.col("o_orderkey")).alias("number"))
    return S.apply_step(rows, double, keep=["o_orderkey", "number"])


def count_lines(df, floor=0):
    return df.where(F.col("l_quantity") > floor).groupBy("shard", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "changed_partitions",
    "TP1",
    "select distinct l_suppkey % 50 as shard, case when l_suppkey % 50 % 7 = 3 then 'no entry' else 'key changed' end as reason from lineitem where l_suppkey % 50 % 5 = 0 or l_suppkey % 50 % 7 = 3",
)
def _(t):
    ledger, out = I.VersionedTable(t.spark, _fresh(t)), _fresh(t)
    lines = t.lineitem.select((F.col("l_suppkey") % 50).alias("shard"), "l_quantity", "l_orderkey", "l_suppkey")
    before = lines.where("shard % 7 <> 3")
    I.process_changed(before, ["shard"], count_lines, ledger, out, {"floor": 10})
    after = lines.withColumn("l_quantity", F.when(F.col("shard") % 5 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return I.process_changed(after, ["shard"], count_lines, ledger, out, {"floor": 10})


def halve(df, iteration):
    return df.select("o_orderkey", (F.floor(F.col("v") / 2)).alias("w"), F.lit(iteration).alias("k"))


@query(
    "emptied_partitions",
    "TP1",
    """select l_suppkey % 50 as shard, l_suppkey, count(*) as n from lineitem where l_quantity > case when l_suppkey % 50 % 5 = 0 then 1000 else 10 end group by 1, 2""",
)
def _(t):
    """The output itself after the rows of every fifth shard have come to nothing."""
    ledger, out = I.VersionedTable(t.spark, _fresh(t)), _fresh(t)
    lines = t.lineitem.select((F.col("l_suppkey") % 50).alias("shard"), "l_quantity", "l_orderkey", "l_suppkey")
    I.process_changed(lines, ["shard"], count_lines, ledger, out, {"floor": 10})
    emptied = lines.withColumn("l_quantity", F.when(F.col("shard") % 5 == 0, F.lit(0).cast(lines.schema["l_quantity"].dataType)).otherwise(F.col("l_quantity")))
    I.process_changed(emptied, ["shard"], count_lines, ledger, out, {"floor": 10})
    return t.spark.read.parquet(out).select(F.col("shard").cast("bigint").alias("shard"), "l_suppkey", "n")


@query(
    "vanished_partitions",
    "TP1",
    """
    with k as (select l_suppkey % 50 as shard, l_suppkey, count(*) as n from lineitem where l_quantity > 10 group by 1, 2),
    d as (select distinct l_suppkey % 50 as shard from lineitem)
    select shard, l_suppkey, n, null as reason from k where shard % 5 <> 0
    union all select shard, null, null, 'input gone' from d where shard % 5 = 0""",
)
def _(t):
    """The output after every fifth shard has left the input, with what was done about it."""
    ledger, out = I.VersionedTable(t.spark, _fresh(t)), _fresh(t)
    lines = t.lineitem.select((F.col("l_suppkey") % 50).alias("shard"), "l_quantity", "l_orderkey", "l_suppkey")
    I.process_changed(lines, ["shard"], count_lines, ledger, out, {"floor": 10})
    done = I.process_changed(lines.where("shard % 5 <> 0"), ["shard"], count_lines, ledger, out, {"floor": 10})
    left = t.spark.read.parquet(out).select(F.col("shard").cast("bigint").alias("shard"), "l_suppkey", "n", F.lit(None).cast("string").alias("reason"))
    return left.unionByName(done.select("shard", F.lit(None).cast("bigint").alias("l_suppkey"), F.lit(None).cast("bigint").alias("n"), "reason"))


#: Far more halvings than a price can take.
MOST_HALVINGS = 64


@query(
    "fixed_point",
    "TP2",
    """
    with m as (select cast(floor(ln(max(cast(floor(o_totalprice) as bigint) // 100)) / ln(2)) as bigint) + 1 as n from orders)
    select o_orderkey, 0 as w, n as k, true as converged, n as rounds from orders, m""",
)
def _(t):
    start = t.orders.select("o_orderkey", F.floor(F.floor("o_totalprice") / 100).alias("v"))
    result, rounds, converged = I.iterate(start, halve, MOST_HALVINGS, lambda df: df.agg(F.max("w") == 0), carry={"w": "v"})
    return result.withColumns({"converged": F.lit(converged), "rounds": F.lit(rounds)})


@query("rolled_back_state", "TP4", "select o_orderkey, o_orderstatus from orders where o_orderkey % 3 = 0")
def _(t):
    table = I.VersionedTable(t.spark, _fresh(t))
    table.save(t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus"), "first")
    table.save(t.orders.select("o_orderkey", "o_orderstatus"), "second")
    table.roll_back("first")
    return table.read()


@query(
    "wired_frames",
    "TP6",
    "select c_nationkey, count(*) as n, sum(o_totalprice > 100000)::bigint as big from orders join customer on o_custkey = c_custkey group by 1",
)
def _(t):
    wired = (
        S.Pipeline(orders=t.orders, customer=t.customer)
        .add("counts", lambda j: j.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("big")), ["joined"])
        .add("joined", lambda o, c: o.join(c, o.o_custkey == c.c_custkey), ["orders", "customer"])
    )
    return wired.frames()["counts"]


#: Bytes of files a batch of a stream takes, one file at least. A batch costs a round of
#: all state and should have work for all cores, so batches follow bytes, not files.
BATCH_BYTES = 512 << 20


def _stream(t, name: str, frame):
    """A table as a stream, whether it is one file or a folder of part files.

    The pattern matches just its name; without one a stream takes the path for a folder.
    """
    return t.spark.readStream.schema(frame.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{t.folder}/{name}.parque[t]")


@query("extracted_stream", "SS1", EXTRACTED_SQL)
def _(t):
    lines = explode_lines(_stream(t, "documents", t.documents), "text", ["doc_id"])
    out = _fresh(t)
    V.write_updates(V.extract_values_stream(lines, RULES, ["doc_id"], ["line_no"]), out, _fresh(t), available_now=True).awaitTermination()
    return V.read_latest(t.spark, out, ["doc_id", "field"])


def _lifecycle(events):
    return events.select(F.col("user_id").alias("step"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query("status_stream", "SS2", "select user_id as step, arg_max(event_type, (ts, event_id)) as event, max((ts, event_id))[2] as event_id from events group by 1")
def _(t):
    out = _fresh(t)
    live = V.status_stream(_lifecycle(_stream(t, "events", t.events)), order=["ts", "event_id"])
    V.write_updates(live, out, _fresh(t), available_now=True).awaitTermination()
    return V.read_latest(t.spark, out, ["step"]).select("step", "event", "event_id")


BOUNDED_SQL = "select user_id as step, arg_max(event_type, (ts, event_id)) as event, max((ts, event_id))[2] as event_id from events group by 1"


@query("bounded_status_stream", "SS3", BOUNDED_SQL)
def _(t):
    out = _fresh(t)
    live = V.status_stream(_lifecycle(_stream(t, "events", t.events)), order=["ts", "event_id"], watermark=("ts", "1 hour"), unique=["event_id"], span="1 day")
    V.write_updates(live, out, _fresh(t), available_now=True).awaitTermination()
    V.compact_updates(t.spark, out, ["step"], ["span"])
    return V.read_latest(t.spark, out, ["step"], ["span"]).select("step", "event", "event_id")


@query(
    "bounded_extracted_stream",
    "SS3",
    """
    with m as (select user_id, ts, event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as v from events where regexp_matches(props, '[0-9]+'))
    select user_id, arg_max(v, (ts, event_id)) as int_value from m group by 1""",
)
def _(t):
    out = _fresh(t)
    lines = _stream(t, "events", t.events).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("props").alias("text"))
    rules = [Rule(r"(?P<v>[0-9]+)", "v", "int")]
    V.write_updates(V.extract_values_stream(lines, rules, ["user_id"], ["ts", "event_id"], ("ts", "1 hour"), ["event_id"], span="1 day"), out, _fresh(t), available_now=True).awaitTermination()
    return V.read_latest(t.spark, out, ["user_id", "field"], ["span"]).select("user_id", "int_value")
