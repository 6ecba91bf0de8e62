"""Doing only the work that changed: versioned tables, skipping, fixed points."""

from __future__ import annotations

import functools
import hashlib
import inspect
import pickle
import types
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.plans.digest import encode, group_digest, row_digest
from runledger.plans.lineage import cut
from runledger.sources.writers import drop_partitions, write_outputs

POINTER_SCHEMA = "seq bigint, name string"
#: Why the output of a partition that is no longer there goes.
INPUT_GONE = "input gone"


def _is_absent(error: AnalysisException) -> bool:
    """Whether there is nothing at a path yet; other errors, such as a denied path, are not that."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class VersionedTable:
    """A table kept as named states, one of which is the head.

    A state is written whole before the pointer that publishes it, so a job
    that dies in between leaves the old head in force. Pointers are only added:
    rolling back publishes an older state again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _state(self, name: str) -> str:
        return f"{self.root}/states/{name}"

    def _pointers(self) -> DataFrame:
        try:
            return self.spark.read.schema(POINTER_SCHEMA).option("recursiveFileLookup", True).json(f"{self.root}/pointers")
        except AnalysisException as error:
            if not _is_absent(error):
                raise
            return self.spark.createDataFrame([], POINTER_SCHEMA)

    def _publish(self, name: str) -> None:
        last = self._pointers().agg(F.max("seq")).first()[0]
        number = 0 if last is None else last + 1
        pointer = self.spark.range(1).select(F.lit(number).cast("bigint").alias("seq"), F.lit(name).alias("name"))
        # Each pointer has a folder of its number: of two writers that took one number, the later fails.
        pointer.coalesce(1).write.mode("error").json(f"{self.root}/pointers/{number}")

    def head(self) -> str | None:
        """Name of the state in force."""
        return self._pointers().agg(F.max_by("name", "seq")).first()[0]

    def save(self, df: DataFrame, name: str | None = None) -> str:
        """Write a state and make it the head; a name is used once."""
        name = name or uuid.uuid4().hex
        df.write.mode("error").parquet(self._state(name))
        self._publish(name)
        return name

    def read(self, name: str | None = None) -> DataFrame | None:
        """A named state, or the head; None before the first."""
        name = name or self.head()
        return None if name is None else self.spark.read.parquet(self._state(name))

    def roll_back(self, name: str) -> None:
        """Make an earlier state the head again."""
        if self._pointers().where(F.col("name") == name).isEmpty():
            raise ValueError(f"no state named {name!r}")
        self._publish(name)


def partition_keys(df: DataFrame, by: Sequence[str], identity: str) -> DataFrame:
    """A key per partition value over its rows, in no particular order, and what is done to them."""
    rest = sorted(c for c in df.columns if c not in by)
    content = df.groupBy(*by).agg(group_digest(encode(*[F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in rest])).alias("content"))
    return content.select(*by, row_digest("content", F.lit(identity)).alias("cache_key"))


def identity_of(fn: Callable, params: Mapping[str, object]) -> str:
    """What a function is, for a key: its code, defaults and closed-over values, and its parameters.

    Two functions that are written alike but close over different values differ;
    where a function is kept in memory does not matter. Global names it uses
    count by name only.
    """
    return hashlib.sha256(repr((_described(fn), _described(dict(params)))).encode()).hexdigest()


def _described(value: object) -> object:
    """A value as nested tuples whose `repr` is the same in every process."""
    match value:
        case functools.partial():
            return "partial", _described(value.func), _described(value.args), _described(value.keywords)
        case types.MethodType():
            return "method", _described(value.__func__), _described(value.__self__)
        case types.FunctionType():
            closed = tuple(_described(c.cell_contents) for c in value.__closure__ or ())
            return "function", _described(value.__code__), _described(value.__defaults__), _described(value.__kwdefaults__), closed
        case types.CodeType():
            return "code", value.co_code, value.co_names, value.co_varnames, tuple(_described(c) for c in value.co_consts)
        case dict():
            return "dict", tuple(sorted((repr(k), _described(v)) for k, v in value.items()))
        case set() | frozenset():
            return "set", tuple(sorted(repr(_described(v)) for v in value))
        case list() | tuple():
            return type(value).__name__, tuple(_described(v) for v in value)
        case None | bool() | int() | float() | complex() | str() | bytes():
            return value
        case type() | types.BuiltinFunctionType() | types.ModuleType():
            return "name", getattr(value, "__module__", None), getattr(value, "__qualname__", value.__name__)
    return type(value).__qualname__, _described(getattr(value, "__dict__", None) or pickle.dumps(value, 4))


def changed_partitions(keys: DataFrame, entries: DataFrame, present: DataFrame, by: Sequence[str]) -> DataFrame:
    """Partition values whose input, record and output do not agree: (by, reason).

    The three are compared at once, a null value as any other. `input gone`
    means that there is a record or an output of what is no longer there.

    Args:
        keys: (by, cache_key) now. entries: (by, cache_key) as recorded.
        present: (by), outputs that exist.
    """
    none = F.lit(None).cast("string")
    sides = (
        keys.select(*by, F.col("cache_key").alias("__now"), none.alias("__recorded"), F.lit(False).alias("__there"))
        .unionByName(entries.select(*by, none.alias("__now"), F.col("cache_key").alias("__recorded"), F.lit(False).alias("__there")))
        .unionByName(present.select(*by, none.alias("__now"), none.alias("__recorded"), F.lit(True).alias("__there")))
    )
    met = sides.groupBy(*by).agg(F.max("__now").alias("now"), F.max("__recorded").alias("recorded"), F.max("__there").alias("there"))
    reason = (
        F.when(F.col("now").isNull(), F.lit(INPUT_GONE))
        .when(F.col("recorded").isNull(), F.lit("no entry"))
        .when(F.col("recorded") != F.col("now"), F.lit("key changed"))
        .when(~F.col("there"), F.lit("output gone"))
    )
    return met.select(*by, reason.alias("reason")).where("reason is not null")


def _matching(df: DataFrame, values: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """A semi or anti join on `by` in which nulls are equal."""
    named = values.select(*[F.col(b).alias(f"__m_{b}") for b in by])
    return df.join(named, reduce(lambda x, y: x & y, [df[b].eqNullSafe(named[f"__m_{b}"]) for b in by]), how)


def _present(spark: SparkSession, out: str, like: DataFrame, by: Sequence[str]) -> DataFrame:
    """The partition values that have files under `out`: the store is listed, no file is opened."""
    try:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(out)
    except AnalysisException as error:
        if not _is_absent(error):
            raise
        return like.select(*by).limit(0)
    if not set(by) <= set(listed.columns):  # nothing but an empty folder
        return like.select(*by).limit(0)
    return listed.select(*[F.col(b).cast(like.schema[b].dataType).alias(b) for b in by])


def process_changed(df: DataFrame, by: Sequence[str], fn: Callable[[DataFrame], DataFrame], ledger: VersionedTable, out: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """Apply `fn` to the partitions of `df` that changed since the last call; returns what was redone or dropped, and why.

    `fn` takes the rows of the changed partitions and `params`, and returns rows
    with the `by` columns. Output and record of a partition that has left `df`
    go. Outputs are written before the ledger, so a job that dies in between
    repeats work and never claims any.
    """
    spark, by, params = df.sparkSession, list(by), dict(params or {})
    keys = cut(partition_keys(df, by, identity_of(fn, params)))
    entries = ledger.read()
    if entries is None:
        entries = keys.limit(0)
    misses = cut(changed_partitions(keys, entries, _present(spark, out, df, by), by))
    if misses.isEmpty():
        return misses
    made = cut(fn(_matching(df, misses.where(F.col("reason") != INPUT_GONE), by, "left_semi"), **params))
    write_outputs(made, out, by)
    # A partition that yields nothing now has no rows that could replace the old ones.
    drop_partitions(spark, out, _matching(misses.select(*by), made.select(*by).distinct(), by, "left_anti"))
    ledger.save(keys)
    return misses


def iterate(df: DataFrame, body: Callable[..., DataFrame], max_iter: int, until: Callable[[DataFrame], DataFrame], carry: Mapping[str, str] | None = None, **params: object) -> tuple[DataFrame, int, bool]:
    """Run `body` on its own output until it converges: (result, iterations run, converged).

    Every iteration's result is written to shared storage, so the plan does not
    grow and a lost executor repeats one iteration at most.

    Args:
        body: Takes the frame, and `params`; gets the iteration number as
            `iteration` if it has such a parameter.
        until: One row and one column from the result; true means converged.
        carry: Output column -> input column for the next iteration; all others
            keep their names.
    """
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")
    takes_index = "iteration" in inspect.signature(body).parameters
    current, k = df, 0
    for k in range(1, max_iter + 1):
        result = cut(body(current, **params, **({"iteration": k} if takes_index else {})))
        if until(result).first()[0]:
            return result, k, True
        current = result.withColumnsRenamed(dict(carry)) if carry else result
    return result, k, False
