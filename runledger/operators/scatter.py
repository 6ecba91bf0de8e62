"""Scatter list columns over rows and gather rows back into lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_ROWS = 1 << 20


def _check_fields(df: DataFrame, fields: Sequence[str]) -> None:
    if not fields:
        raise ValueError("scatter needs at least one field")
    for name in fields:
        if name not in df.columns:
            raise ValueError(f"scatter over {name!r}, but no value is supplied for it")
        if not isinstance(df.schema[name].dataType, T.ArrayType):
            raise ValueError(f"scatter over {name!r}, which is {df.schema[name].dataType.simpleString()}, not a list")


def scatter_error(df: DataFrame, fields: Sequence[str]) -> Column:
    """Why a row cannot be scattered, or null."""
    sizes = [F.size(f) for f in fields]
    none_null = [F.when(F.col(f).isNull(), F.lit(f)) for f in fields]
    missing = F.concat_ws(",", *none_null)
    uneven = F.lit(False)
    for s in sizes[1:]:
        uneven = uneven | (s != sizes[0])
    lengths = F.array_join(F.array_sort(F.array_distinct(F.array(*sizes))), ",")
    return F.when(missing != "", F.concat(F.lit("not a list: "), missing)).when(uneven, F.concat(F.lit("different lengths: "), lengths))


def scatter(df: DataFrame, fields: Sequence[str], index: str = "idx") -> DataFrame:
    """One row per position of the aligned lists, with the 0-based index; other columns repeat.

    Rows whose lists do not align are left out; `scatter_rejects` returns them.
    The check comes before the lists are exploded.
    """
    _check_fields(df, fields)
    rest = [c for c in df.columns if c not in fields]
    zipped = F.arrays_zip(*[F.col(f) for f in fields])
    rows = df.where(scatter_error(df, fields).isNull()).select(*rest, F.posexplode(zipped).alias(index, "__e"))
    return rows.select(*rest, index, *[F.col(f"__e.`{f}`").alias(f) for f in fields])


def scatter_rejects(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows `scatter` leaves out, with the reason."""
    _check_fields(df, fields)
    return df.withColumn("reason", scatter_error(df, fields)).where("reason is not null")


@dataclass
class Gathered:
    """The slices of every key, whatever their number.

    status: (keys, slices, rc, flags), one row a key.
    values: (keys, index, cols), one row a slice of each key that has no failed one.
    texts: (keys, index, field, text), the texts that are not blank, of all slices.
    """

    status: DataFrame
    values: DataFrame
    texts: DataFrame


def gather_rows(
    df: DataFrame, keys: Sequence[str], index: str, cols: Sequence[str], rc: str | None = None, flags: Sequence[str] = (), texts: Sequence[str] = (), expected: DataFrame | None = None
) -> Gathered:
    """What `gather` tells, as rows: the shape is the same for three slices and for a billion.

    Null keys are keys as any other.

    Args:
        rc, flags, expected: As of `gather`; the code is that of the first
            failing index, 0 where there is none.
    """
    failed_at = F.when(F.col(rc) != 0, F.col(index)) if rc is not None else None
    told = [F.count(F.lit(1)).alias("slices"), *([F.coalesce(F.min_by(rc, failed_at), F.lit(0)).alias(rc)] if rc is not None else []), *[F.bool_or(f).alias(f) for f in flags]]
    status = df.groupBy(*keys).agg(*told)
    if expected is not None:
        # Both sides grouped, so that a null key meets itself.
        none = {"slices": F.lit(0).cast("bigint"), **({rc: F.lit(0).cast(df.schema[rc].dataType)} if rc is not None else {}), **{f: F.lit(False) for f in flags}}
        wanted = expected.select(*keys).withColumns({**none, "__wanted": F.lit(True)})
        both = status.withColumn("__wanted", F.lit(False)).unionByName(wanted).groupBy(*keys)
        kept = both.agg(F.sum("slices").alias("slices"), *([F.sum(rc).cast(df.schema[rc].dataType).alias(rc)] if rc is not None else []), *[F.bool_or(c).alias(c) for c in (*flags, "__wanted")])
        status = kept.where("__wanted").drop("__wanted")
    values = df.select(*keys, index, *cols)
    if rc is not None:
        failed = df.where(F.col(rc) != 0).select(*[F.col(k).alias(f"__k_{k}") for k in keys]).distinct()
        values = values.join(failed, reduce(lambda a, b: a & b, [values[k].eqNullSafe(failed[f"__k_{k}"]) for k in keys]), "left_anti")
    said = F.explode(F.array(*[F.struct(F.lit(t).alias("field"), F.col(t).alias("text")) for t in texts])) if texts else None
    lines = df.select(*keys, index, said.alias("t")).select(*keys, index, "t.*") if texts else df.select(*keys, index, F.lit("").alias("field"), F.lit("").alias("text"))
    return Gathered(status, values, lines.where((F.col("text").isNotNull()) & (F.col("text") != "")))


def gather(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    cols: Sequence[str],
    rc: str | None = None,
    flags: Sequence[str] = (),
    texts: Sequence[str] = (),
    expected: DataFrame | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Lists ordered by slice index, one row per key and part; for results as rows see `gather_rows`.

    A part holds the slices whose index falls in one span of `part_rows`, so a
    list never outgrows a row.

    Args:
        rc: Return code column. If any slice of a key failed, its lists are
            empty in every part, while texts stay, and the code is that of the
            first failing index.
        flags: Boolean columns, OR-ed per key.
        texts: Text columns, joined by line breaks in index order without blanks.
        expected: Keys that must appear; one without slices gets empty lists.
    """
    part = F.floor(F.col(index) / part_rows).cast("bigint").alias("part")
    slices = F.array_sort(F.collect_list(F.struct(F.col(index).alias("__i"), *cols, *texts)))
    packed = df.groupBy(*keys, part).agg(slices.alias("__s"))

    def values(name: str) -> Column:
        return F.transform("__s", lambda s: s.getField(name))

    lists = [values(c).alias(c) for c in cols]
    joined = [F.array_join(F.filter(values(t), lambda v: v.isNotNull() & (v != "")), "\n").alias(t) for t in texts]
    out = packed.select(*keys, "part", *lists, *joined)

    if rc is not None or flags:
        failed_at = F.when(F.col(rc) != 0, F.col(index)) if rc is not None else F.lit(None).cast("bigint")
        aggregates = [F.bool_or(f).alias(f) for f in flags]
        if rc is not None:
            aggregates.append(F.coalesce(F.min_by(rc, failed_at), F.lit(0)).alias(rc))
        status = df.groupBy(*keys).agg(*aggregates)
        out = out.join(status, list(keys), "inner")
        if rc is not None:
            out = out.withColumns({c: F.when(F.col(rc) == 0, F.col(c)).otherwise(F.slice(c, 1, 0)) for c in cols})
    if expected is not None:
        out = expected.select(*keys).join(out, list(keys), "left").withColumns(
            {
                "part": F.coalesce("part", F.lit(0)),
                **{c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)) for c in cols},
                **{t: F.coalesce(F.col(t), F.lit("")) for t in texts},
                **{f: F.coalesce(F.col(f), F.lit(False)) for f in flags},
                **({rc: F.coalesce(F.col(rc), F.lit(0))} if rc is not None else {}),
            }
        )
    return out


def gathered_schema(inputs: T.StructType, outputs: T.StructType, fields: Sequence[str]) -> tuple[T.StructType, T.StructType]:
    """Schemas around a scattered step: scattered inputs and all outputs become lists."""
    wide_in = [T.StructField(f.name, T.ArrayType(f.dataType) if f.name in fields else f.dataType, f.nullable, f.metadata) for f in inputs]
    return T.StructType(wide_in), T.StructType([T.StructField(f.name, T.ArrayType(f.dataType), False, f.metadata) for f in outputs])


def gathered_type(ddl: Column, side: Column, scattered: Column) -> Column:
    """Column form of `gathered_schema` for declarations kept as a table."""
    return F.when((side == "out") | scattered, F.concat(F.lit("array<"), ddl, F.lit(">"))).otherwise(ddl)
