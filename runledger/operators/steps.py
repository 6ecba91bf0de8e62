"""Typed Python functions as table steps, and pipelines of DataFrame steps."""

from __future__ import annotations

import dataclasses
import datetime
import inspect
import types
import typing
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SCALAR_HINTS = {
    str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType(),
    Path: T.StringType(), datetime.datetime: T.TimestampType(), datetime.date: T.DateType(),
}
RC, REASON = "returncode", "reason"


def type_of_hint(hint: object) -> T.DataType:
    """The Spark type of a type hint."""
    if hint in SCALAR_HINTS:
        return SCALAR_HINTS[hint]
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        kinds = [a for a in args if a is not type(None)]
        if len(kinds) == 1:
            return type_of_hint(kinds[0])
    elif origin is typing.Literal:
        kinds = {type(a) for a in args}
        if len(kinds) == 1:
            return type_of_hint(kinds.pop())
    elif origin is tuple and len(args) == 2 and args[1] is Ellipsis:
        return T.ArrayType(type_of_hint(args[0]))
    elif origin is tuple and args:
        return T.StructType([T.StructField(f"_{i}", type_of_hint(a)) for i, a in enumerate(args)])
    elif origin is list and args:
        return T.ArrayType(type_of_hint(args[0]))
    elif origin is dict and len(args) == 2:
        return T.MapType(type_of_hint(args[0]), type_of_hint(args[1]))
    elif dataclasses.is_dataclass(hint):
        return schema_of_record(hint)
    raise TypeError(f"no column type for hint {hint!r}")


def as_hinted(value: object, hint: object) -> object:
    """A column's value as the hint has it: text as a path, a list as a tuple; a literal must be one of its values."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if value is None:
        return None
    if hint is Path:
        return Path(value)
    if origin is typing.Literal:
        if value not in args:
            raise ValueError(f"{value!r} is none of {', '.join(map(repr, args))}")
        return value
    if origin in (typing.Union, types.UnionType):
        return next((as_hinted(value, a) for a in args if a is not type(None)), value)
    if origin is tuple:
        parts = list(value.values()) if isinstance(value, dict) else list(value)
        kinds = [args[0]] * len(parts) if args[1:] == (Ellipsis,) else args
        return tuple(as_hinted(v, a) for v, a in zip(parts, kinds))
    if origin is list and args:
        return [as_hinted(v, args[0]) for v in value]
    return value


def as_column(value: object) -> object:
    """A result's value as its column has it: a path as text."""
    if isinstance(value, Path):
        return str(value)
    if isinstance(value, list | tuple):
        return type(value)(map(as_column, value))
    return {k: as_column(v) for k, v in value.items()} if isinstance(value, dict) else value


def schema_of_record(record: type) -> T.StructType:
    """The columns of a declared record, a dataclass."""
    hints = typing.get_type_hints(record)
    return T.StructType([T.StructField(f.name, type_of_hint(hints[f.name])) for f in dataclasses.fields(record)])


@dataclasses.dataclass(frozen=True)
class RowStep:
    """A checked function: its input columns, its record, and the constants bound to it."""

    fn: Callable
    inputs: tuple[str, ...]
    defaults: tuple[str, ...]
    record: type | None
    wants_ctx: bool
    constants: Mapping[str, object] = dataclasses.field(default_factory=dict)
    hints: Mapping[str, object] = dataclasses.field(default_factory=dict)

    def __call__(self, **constants: object) -> "RowStep":
        """The same step with some parameters fixed; each must name a parameter."""
        for name in constants:
            if name not in self.inputs:
                raise TypeError(f"{self.fn.__name__} has no parameter {name!r}")
        return dataclasses.replace(self, constants={**self.constants, **constants})

    def columns(self, available: Sequence[str]) -> list[str]:
        """The columns to read; one that is neither there, constant nor defaulted is an error."""
        needed = [n for n in self.inputs if n not in self.constants]
        for name in needed:
            if name not in available and name not in self.defaults:
                raise ValueError(f"{self.fn.__name__} needs a column {name!r}")
        return [n for n in needed if n in available]

    def output_schema(self) -> T.StructType:
        return T.StructType() if self.record is None else schema_of_record(self.record)


def row_step(fn: Callable) -> RowStep:
    """Check a function's signature and make it a step.

    Every parameter needs a type hint; `*args`, `**kwargs` and positional-only
    parameters are refused. A first parameter called `ctx` receives the context
    instead of a column. The return hint is a dataclass or None.
    """
    hints = typing.get_type_hints(fn)
    inputs, defaults, wants_ctx = [], [], False
    for at, (name, parameter) in enumerate(inspect.signature(fn).parameters.items()):
        if at == 0 and name == "ctx":
            wants_ctx = True
            continue
        if parameter.kind not in (parameter.POSITIONAL_OR_KEYWORD, parameter.KEYWORD_ONLY):
            raise TypeError(f"{fn.__name__}: parameter {name!r} must be a plain named one")
        if name not in hints:
            raise TypeError(f"{fn.__name__}: parameter {name!r} has no type hint")
        type_of_hint(hints[name])
        inputs.append(name)
        if parameter.default is not parameter.empty:
            defaults.append(name)
    record = hints.get("return")
    record = None if record is type(None) else record
    if record is not None and not dataclasses.is_dataclass(record):
        raise TypeError(f"{fn.__name__} must return a dataclass or None")
    return RowStep(fn, tuple(inputs), tuple(defaults), record, wants_ctx, hints={n: hints[n] for n in inputs})


def apply_step(df: DataFrame, step: RowStep, keep: Sequence[str] = (), ctx: Mapping[str, object] | None = None, on_error: str = "raise") -> DataFrame:
    """Run a step over every row, in Arrow batches: `keep` columns and the record's.

    Args:
        ctx: Small read-only context for a step that takes `ctx`.
        on_error: `raise` fails the query on a failing row; `record` gives the
            row null outputs, a non-zero `returncode` and the `reason`, and
            lets the others finish.
    """
    if on_error not in ("raise", "record"):
        raise ValueError(f"on_error is raise or record, not {on_error!r}")
    columns = step.columns(df.columns)
    record_schema = step.output_schema()
    names = record_schema.names
    record, fn, constants, wants_ctx = step.record, step.fn, dict(step.constants), step.wants_ctx
    hints = dict(step.hints)
    isolate = on_error == "record"
    schema = T.StructType([df.schema[c] for c in keep] + record_schema.fields)
    if isolate:
        schema = schema.add(RC, T.IntegerType()).add(REASON, T.StringType())
    context = (dict(ctx or {}),) if wants_ctx else ()

    def run(values: dict) -> dict:
        result = fn(*context, **{n: as_hinted(v, hints[n]) for n, v in values.items()}, **constants)
        if record is None:
            if result is not None:
                raise TypeError(f"{fn.__name__} is declared to return nothing")
            return {}
        if not isinstance(result, record):
            raise TypeError(f"{fn.__name__} returned {type(result).__name__}, not {record.__name__}")
        return as_column(dataclasses.asdict(result))

    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    arrow = to_arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            given = [from_arrow(part.column(c)) for c in columns]
            for values in zip(*given) if columns else [()] * len(part):
                values = dict(zip(columns, values))
                if not isolate:
                    rows.append(run(values))
                    continue
                try:
                    rows.append({**run(values), RC: 0, REASON: None})
                except Exception as exc:  # noqa: BLE001 -- a row's failure is data here
                    rows.append({**dict.fromkeys(names), RC: 1, REASON: f"{type(exc).__name__}: {exc}"})
            made = [*names, RC, REASON] if isolate else names
            arrays = [part.column(c).cast(arrow.field(i).type) for i, c in enumerate(keep)]
            kinds = [arrow.field(len(keep) + i).type for i in range(len(made))]
            arrays += [pa.array([to_arrow(r[n], kind, zone) for r in rows], kind) for n, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    read = list(dict.fromkeys([*keep, *columns])) or df.columns[:1]
    return df.select(*read).mapInArrow(batches, schema)


def from_arrow(column: pa.Array) -> list:
    """A column's values as a step takes them: whole numbers as they are, maps as dicts, times without a zone."""

    def plain(value: object, kind: pa.DataType) -> object:
        if value is None:
            return None
        if pa.types.is_map(kind):
            return {plain(k, kind.key_type): plain(v, kind.item_type) for k, v in value}
        if pa.types.is_list(kind) or pa.types.is_large_list(kind):
            return [plain(v, kind.value_type) for v in value]
        if pa.types.is_struct(kind):
            return {f.name: plain(value[f.name], f.type) for f in kind}
        return value.replace(tzinfo=None) if pa.types.is_timestamp(kind) else value

    values = column.to_pylist()
    nested = pa.types.is_nested(column.type) or pa.types.is_timestamp(column.type)
    return [plain(v, column.type) for v in values] if nested else values


def to_arrow(value: object, kind: pa.DataType, zone: str) -> object:
    """A result's value as Arrow reads it: a tuple by the names of its parts, a time in the session's zone."""
    if value is None:
        return None
    if pa.types.is_map(kind):
        return [(to_arrow(k, kind.key_type, zone), to_arrow(v, kind.item_type, zone)) for k, v in value.items()]
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [to_arrow(v, kind.value_type, zone) for v in value]
    if pa.types.is_struct(kind):
        parts = value if isinstance(value, dict) else {f.name: v for f, v in zip(kind, value, strict=True)}
        return {f.name: to_arrow(parts[f.name], f.type, zone) for f in kind}
    return value.replace(tzinfo=ZoneInfo(zone)) if pa.types.is_timestamp(kind) and value.tzinfo is None else value


class Pipeline:
    """DataFrame steps wired by name; Spark's own laziness decides when they run.

    A step is a function of the frames it names and may read the pipeline's
    inputs or the results of any step, whatever the order of adding.
    """

    def __init__(self, **inputs: DataFrame):
        self._inputs = dict(inputs)
        self._steps: dict[str, tuple[Callable, tuple[str, ...]]] = {}

    def add(self, name: str, fn: Callable[..., DataFrame], inputs: Sequence[str]) -> "Pipeline":
        """Add a step that reads the named frames; a name is used once."""
        if name in self._steps or name in self._inputs:
            raise ValueError(f"there is already a frame named {name!r}")
        self._steps[name] = (fn, tuple(inputs))
        return self

    def frames(self) -> dict[str, DataFrame]:
        """Every step's result; unknown names and rings are errors that name them."""
        results = dict(self._inputs)

        def frame(name: str, trail: tuple[str, ...]) -> DataFrame:
            if name in trail:
                raise ValueError("steps wait for each other: " + " -> ".join([*trail[trail.index(name) :], name]))
            if name not in results:
                if name not in self._steps:
                    raise ValueError(f"step {trail[-1]!r} reads {name!r}, which does not exist")
                fn, reads = self._steps[name]
                results[name] = fn(*[frame(r, (*trail, name)) for r in reads])
            return results[name]

        return {name: frame(name, ()) for name in self._steps}
