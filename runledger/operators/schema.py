"""Declared schemas: types, validation, defaults, templates, field audits."""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.names import RESERVED, sanitize

# The names a declaration may use for scalar and path types.
SCALARS = {
    "str": T.StringType(),
    "string": T.StringType(),
    "int": T.LongType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
}
PATH_TYPES = ("file", "ms", "directory", "dir", "uri", "url")


@dataclass(frozen=True)
class Field:
    """One declared field."""

    name: str
    dtype: str = "str"
    required: bool = False
    default: object = None
    choices: Sequence[object] = field(default_factory=tuple)
    implicit: str | None = None


def _arguments(inner: str) -> list[str]:
    """Split on the commas outside any bracket."""
    depth, start, out = 0, 0, []
    for at, ch in enumerate(inner):
        depth += (ch == "[") - (ch == "]")
        if ch == "," and depth == 0:
            out.append(inner[start:at].strip())
            start = at + 1
    tail = inner[start:].strip()
    return [*out, tail] if tail else out


def spark_type(dtype: str) -> T.DataType:
    """The Spark type of a declared dtype; text where it is not known.

    A union keeps its text, because a column has one type; `cast_union` reads
    the first arm that fits.
    """
    text = str(dtype).strip()
    if text.lower().startswith("list:"):
        return T.ArrayType(spark_type(text[5:]))
    generic = re.match(r"^(list|tuple|union)\[(.+)\]$", text, re.IGNORECASE)
    if generic:
        kind, inner = generic.group(1).lower(), generic.group(2)
        if kind == "list":
            return T.ArrayType(spark_type(inner))
        if kind == "tuple":
            return T.StructType([T.StructField(f"_{i}", spark_type(a)) for i, a in enumerate(_arguments(inner))])
        return T.StringType()
    return SCALARS.get(text.lower(), T.StringType())


def is_path_type(dtype: str) -> bool:
    """Whether a dtype, or the element or any arm of it, is a path."""
    text = str(dtype).strip()
    if text.lower().startswith("list:"):
        return is_path_type(text[5:])
    generic = re.match(r"^(list|tuple|union)\[(.+)\]$", text, re.IGNORECASE)
    if generic:
        arms = _arguments(generic.group(2))
        return any(map(is_path_type, arms)) if generic.group(1).lower() == "union" else bool(arms) and is_path_type(arms[0])
    return text.lower() in PATH_TYPES


@F.pandas_udf(T.StructType().add("ddl", T.StringType()).add("is_path", T.BooleanType()))
def type_of(dtype: pd.Series) -> pd.DataFrame:
    """Column form of `spark_type` and `is_path_type`, for declarations kept as a table."""
    known = {d: (spark_type(d).simpleString(), is_path_type(d)) for d in dtype.dropna().unique()}
    return pd.DataFrame([known.get(d, (None, None)) for d in dtype], columns=["ddl", "is_path"])


def build_schema(fields: Sequence[Field]) -> T.StructType:
    """Declared fields as a Spark schema; required without a default is not nullable."""
    return T.StructType(
        [
            T.StructField(f.name, spark_type(f.dtype), not (f.required and f.default is None), {"is_path": is_path_type(f.dtype)})
            for f in fields
        ]
    )


def cast_union(text: Column, arms: Sequence[str]) -> Column:
    """Which arm a union value reads as: the first whose cast succeeds."""
    out = None
    for arm in arms:
        fits = text.try_cast(spark_type(arm)).isNotNull()
        out = F.when(fits, F.lit(arm)) if out is None else out.when(fits, F.lit(arm))
    return out


def in_choices(value: Column, choices: Sequence[object] | Column) -> Column:
    """Whether a value is one of the choices (a literal list, or an array column)."""
    return F.array_contains(choices, value) if isinstance(choices, Column) else value.isin(list(choices))


def apply_defaults(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Absent values and absent columns take the declared default."""
    values = {}
    for f in fields:
        if f.default is not None:
            values[f.name] = F.coalesce(F.col(f.name), F.lit(f.default)) if f.name in df.columns else F.lit(f.default)
        elif f.name not in df.columns:
            values[f.name] = F.lit(None).cast(spark_type(f.dtype))
    return df.withColumns(values)


def rejection_reasons(df: DataFrame, fields: Sequence[Field], keys: Sequence[str] = ()) -> Column:
    """Array of every rule a row breaks, in declaration order."""
    checks = []
    for f in fields:
        present = F.col(f.name).isNotNull() if f.name in df.columns else F.lit(False)
        if f.required and f.default is None:
            checks.append(F.when(~present, F.lit(f"{f.name}: missing")))
        if f.name not in df.columns:
            continue
        if f.choices:
            checks.append(F.when(present & ~in_choices(F.col(f.name), f.choices), F.lit(f"{f.name}: not a choice")))
        else:
            checks.append(F.when(present & F.col(f.name).try_cast(spark_type(f.dtype)).isNull(), F.lit(f"{f.name}: not {f.dtype}")))
    declared = {f.name for f in fields} | set(keys)
    checks += [F.when(F.col(c).isNotNull(), F.lit(f"{c}: unknown")) for c in df.columns if c not in declared]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def validate_rows(df: DataFrame, fields: Sequence[Field], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split rows into those that fit the declaration (cast) and those that do not (with all reasons)."""
    judged = df.withColumn("reasons", rejection_reasons(df, fields, keys))
    typed = [
        (F.col(f.name) if f.choices else F.col(f.name).try_cast(spark_type(f.dtype))).alias(f.name)
        for f in fields
        if f.name in df.columns
    ]
    valid = apply_defaults(judged.where(F.size("reasons") == 0).select(*keys, *typed), fields)
    return valid, judged.where(F.size("reasons") > 0)


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename columns to identifiers; two that meet in one name are an error."""
    renamed: dict[str, str] = {}
    for name in df.columns:
        clean = re.sub(r"\W", "_", name)
        clean = f"_{clean}" if clean[:1].isdigit() else clean
        clean = f"{clean}_" if clean in RESERVED else clean
        if clean in renamed.values():
            raise ValueError(f"two columns become {clean!r}")
        renamed[name] = clean
    return df.withColumnsRenamed(renamed)


def name_collisions(names: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Identifiers that two or more different names of a group become."""
    return (
        names.select(*by, F.col(name), sanitize(F.col(name)).alias("identifier"))
        .groupBy(*by, "identifier")
        .agg(F.count_distinct(name).alias("n_names"), F.min(name).alias("first_name"), F.max(name).alias("last_name"))
        .where("n_names > 1")
    )


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested groups as `a<sep>b` columns."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            out += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [here]
        return out

    return df.select(*[F.col(".".join(f"`{p}`" for p in leaf)).alias(sep.join(leaf)) for leaf in leaves(df.schema, ())])


def unflatten_struct(df: DataFrame, schema: T.StructType, sep: str = "_", defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Rebuild nested groups; an absent or null leaf keeps the default given for it."""
    defaults = defaults or {}

    def build(dtype: T.DataType, path: tuple[str, ...]) -> Column:
        if isinstance(dtype, T.StructType):
            return F.struct(*[build(f.dataType, (*path, f.name)).alias(f.name) for f in dtype.fields])
        flat = sep.join(path)
        value = F.col(f"`{flat}`") if flat in df.columns else F.lit(None)
        return F.coalesce(value, F.lit(defaults.get(flat))).cast(dtype)

    return df.select(*[build(f.dataType, (f.name,)).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class Family:
    """Names of the form shape<sep>attribute (or the other way round).

    `segments` are regexes, but for one list that enumerates the attributes.
    """

    segments: Sequence[str | Sequence[str]]
    sep: str = "."

    def pattern(self) -> tuple[str, int]:
        """The anchored regex, longest attributes first, and the attribute's group number."""
        lists = [i for i, s in enumerate(self.segments) if not isinstance(s, str)]
        if len(lists) != 1:
            raise ValueError("exactly one segment must enumerate its attributes")
        parts = []
        for s in self.segments:
            options = s if isinstance(s, str) else "|".join(re.escape(a) for a in sorted(s, key=len, reverse=True))
            parts.append(f"({options})")
        return f"^{re.escape(self.sep).join(parts)}$", lists[0] + 1


def match_family(name: Column, family: Family) -> Column:
    """struct(term, attr) of a name in the family, else null; the longest attribute wins."""
    pattern, at = family.pattern()
    terms = [F.regexp_extract(name, pattern, i + 1) for i in range(len(family.segments)) if i + 1 != at]
    return F.when(
        name.rlike(pattern),
        F.struct(F.concat_ws(family.sep, *terms).alias("term"), F.regexp_extract(name, pattern, at).alias("attr")),
    )


def melt_pattern(df: DataFrame, keys: Sequence[str], family: Family) -> DataFrame:
    """Columns of a family as rows (keys, term, attr, value), values as text."""
    pattern, at = family.pattern()
    found = [(c, re.match(pattern, c)) for c in df.columns if c not in keys]
    entries = []
    for c, m in found:
        if m:
            term = family.sep.join(g for i, g in enumerate(m.groups(), 1) if i != at)
            value = F.col(f"`{c}`").cast("string")
            entries.append(F.struct(F.lit(term).alias("term"), F.lit(m.group(at)).alias("attr"), value.alias("value")))
    if not entries:
        raise ValueError("no column belongs to the family")
    return df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def template(text: str, columns: Sequence[str]) -> Column:
    """`"{prefix}-image.fits"` filled from the row; text without braces is a constant."""
    parts = []
    for literal, name, _spec, _conv in string.Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in columns:
                raise ValueError(f"template {text!r} names unknown field {name!r}")
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def fill_outputs(declared: DataFrame, runs: Sequence[str], *sources: DataFrame) -> DataFrame:
    """The value of each declared output of each run, from the first source that has the field.

    Args:
        declared: (runs..., field) to fill.
        sources: (runs..., field, value), strongest first. A row counts even
            where its value is null: a null that was given hides what is weaker.
    """
    ranked = None
    for rank, source in enumerate(sources):
        rows = source.select(*runs, "field", "value", F.lit(rank).alias("rank"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    chosen = ranked.groupBy(*runs, "field").agg(F.min_by("value", "rank").alias("value"), F.min("rank").alias("rank"))
    return declared.select(*runs, "field").join(chosen, [*runs, "field"], "left")


def classify_fields(scope_fields: DataFrame) -> DataFrame:
    """What each input field is: path, read-only, write target, mutated in place.

    Mutated = path inputs that are also path outputs, and path inputs marked mutable.
    """
    sides = scope_fields.groupBy("scope", "field").agg(
        F.bool_or((F.col("side") == "in")).alias("is_input"),
        F.bool_or((F.col("side") == "in") & F.col("is_path")).alias("in_path"),
        F.bool_or((F.col("side") == "out") & F.col("is_path")).alias("out_path"),
        F.bool_or((F.col("side") == "in") & F.col("mutable")).alias("mutable"),
        F.bool_and(F.when(F.col("side") == "in", ~F.col("writable"))).alias("readonly"),
        F.bool_or(F.col("write_path")).alias("write_target"),
    )
    return sides.where("is_input").select(
        "scope",
        "field",
        F.col("in_path").alias("path"),
        (F.col("in_path") & F.coalesce("readonly", F.lit(False))).alias("readonly"),
        "write_target",
        (F.col("in_path") & (F.col("out_path") | F.col("mutable"))).alias("mutated"),
    )


def orphan_write_targets(scope_fields: DataFrame, patterns: DataFrame) -> DataFrame:
    """Write targets no output template, glob or same-named path output mentions.

    Args:
        patterns: (scope, pattern), the globs a scope declares.
    """
    targets = scope_fields.where("write_path").select("scope", "field").distinct()
    texts = (
        scope_fields.where("side = 'out' and implicit is not null")
        .select("scope", F.col("implicit").alias("text"))
        .unionByName(patterns.select("scope", F.col("pattern").alias("text")))
    )
    # A template that mentions `{abc` mentions every prefix of it too, so a
    # mention is exploded into those prefixes and the join is on equality.
    mention = F.explode(F.regexp_extract_all("text", F.lit(r"\{([^{}!:]*)"), F.lit(1)))
    mentioned = texts.select("scope", mention.alias("m"))
    prefixes = mentioned.select(
        "scope",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("m"), F.lit(1))), lambda n: F.substring(F.col("m"), F.lit(1), n))).alias("field"),
    )
    own = scope_fields.where("side = 'out' and is_path").select("scope", "field")
    return targets.join(prefixes.unionByName(own).distinct(), ["scope", "field"], "left_anti")


def describe_scopes(scope_fields: DataFrame) -> DataFrame:
    """One line per field: type, whether it must be given, default."""
    return scope_fields.select(
        "provider",
        "scope",
        "field",
        F.concat_ws(
            " ",
            "dtype",
            F.when(F.col("required") & F.col("field_default").isNull(), F.lit("required")).otherwise(
                F.concat(F.lit("default="), F.coalesce("field_default", F.lit("None")))
            ),
        ).alias("line"),
    ).distinct()


def resolve_provider(catalog: DataFrame) -> DataFrame:
    """The provider each name resolves to: the first by provider name, then by rank."""
    return catalog.groupBy("name").agg(
        F.min(F.struct("provider", "rank")).alias("first"), F.count_distinct("provider").alias("n_providers")
    ).select("name", F.col("first.provider").alias("provider"), F.col("first.rank").alias("rank"), "n_providers")


def latest_by(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order, as a mergeable aggregate (no window)."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*by, "r.*").select(*df.columns)
