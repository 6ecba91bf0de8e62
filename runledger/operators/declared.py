"""From parsed documents to declared fields: which mapping is a field, and what it declares.

Documents come in long form, one row per leaf (see `sources.readers.parse_yaml`),
after layers, includes and uses are merged. A mapping below `inputs` or `outputs`
is a field if it is empty or has a key that only a field has; any other is a
section, whose name its fields carry. Whether a row's mapping is a field may be
told by another row of it, so rows meet on their ancestors: one equality join,
with no document held in one place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.names import sanitize
from runledger.operators.schema import Field, type_of
from runledger.plans.lineage import cut

# The keys of a field's declaration, the sides of a scope, and texts that are false.
FIELD_KEYS = (
    "info dtype default required implicit choices abbreviation policies writable must_exist path_policies nom_de_guerre mkdir element_choices write_path mutable"
).split()
SIDES = {"inputs": "in", "outputs": "out"}
FALSE = ("", "false", "0", "0.0", "[]", "{}")

KEY = ["provider", "scope", "side"]


def _places(leaves: DataFrame, root: str) -> DataFrame:
    """(provider, scope, side, path, names, value, depth): rows of fields with the depth of their field's mapping, null if there is none.

    A mapping inside a field's is part of the field, so the shallowest counts.
    """
    keys = F.split("path", r"\.")
    rows = (
        leaves.select("doc", "path", "value", keys.alias("keys"))
        .where((F.get("keys", F.lit(0)) == root) & F.get("keys", F.lit(2)).isin(*SIDES) & (F.size("keys") > 3))
        .select(
            F.col("doc").alias("provider"),
            F.get("keys", F.lit(1)).alias("scope"),
            F.when(F.get("keys", F.lit(2)) == "inputs", "in").otherwise("out").alias("side"),
            "path",
            F.slice("keys", F.lit(4), F.size("keys")).alias("names"),
            "value",
        )
    )
    # Read by three branches; written, so that documents are parsed once.
    rows = cut(rows)
    size = F.size("names")
    told = F.filter(F.sequence(F.lit(1), size), lambda k: F.get("names", k).isin(*FIELD_KEYS))
    empty = F.when(F.col("value").isNull() | (F.col("value") == "{}"), F.array(size)).otherwise(F.array().cast("array<int>"))
    mapping = lambda depth: F.array_join(F.slice("names", F.lit(1), depth), ".")
    fields = rows.select(*KEY, F.explode(F.concat(told, empty)).alias("depth"), "names").select(*KEY, mapping(F.col("depth")).alias("name")).distinct()
    above = rows.select("*", F.explode(F.sequence(F.lit(1), size)).alias("depth")).withColumn("name", mapping(F.col("depth")))
    matched = above.join(fields, [*KEY, "name"]).groupBy(*KEY, "path").agg(F.min("depth").alias("depth"))
    return rows.join(matched, [*KEY, "path"], "left")


def _is_true(value: Column) -> Column:
    return F.coalesce(~F.lower(value).isin(*FALSE), F.lit(False))


def document_fields(leaves: DataFrame, root: str = "cabs") -> DataFrame:
    """The fields of every scope that documents declare, as `scope_fields` rows and more.

    (provider, scope, side, field, dtype, is_path, required, field_default,
    mutable, writable, write_path, implicit, name, flag, abbreviation, choices,
    positional, info); the provider is the document. `field` is the dotted name
    as an identifier, `flag` the tool's name where it is another. What an
    implicit template gives is not required. A default that is a mapping is
    JSON. Rows that `document_errors` reports give no fields.

    Args:
        leaves: (doc, path, value), each path once a document.
        root: The key that holds the scopes.
    """
    placed = _places(leaves, root).where("depth is not null")
    key = F.get("names", F.col("depth"))
    rest = F.slice("names", F.col("depth") + 2, F.size("names"))
    rows = placed.select(*KEY, F.array_join(F.slice("names", F.lit(1), F.col("depth")), ".").alias("name"), key.alias("key"), rest.alias("rest"), "value")
    whole = F.size("rest") == 0
    one = lambda k: F.max(F.when(whole & (F.col("key") == k), F.col("value")))
    inner = lambda k, r: F.max(F.when((F.col("key") == k) & (F.array_join("rest", ".") == r), F.col("value")))
    nested = F.sort_array(F.collect_list(F.when(~whole & (F.col("key") == "default"), F.struct(F.array_join("rest", ".").alias("k"), F.col("value").alias("v")))))
    found = rows.groupBy(*KEY, "name").agg(
        *[one(k).alias(f"k_{k}") for k in FIELD_KEYS if k not in ("policies", "path_policies", "must_exist", "mkdir", "element_choices")],
        inner("policies", "positional").alias("k_positional"),
        nested.alias("nested"),
    )
    typed = found.withColumn("dtype", F.coalesce("k_dtype", F.lit("str"))).withColumn("type", type_of(F.col("dtype"))).withColumn("field", sanitize(F.col("name")))
    return typed.select(
        *KEY,
        "field",
        "dtype",
        "type.is_path",
        (_is_true(F.col("k_required")) & F.col("k_implicit").isNull()).alias("required"),
        F.when(F.size("nested") > 0, F.to_json(F.map_from_entries("nested"))).otherwise(F.col("k_default")).alias("field_default"),
        _is_true(F.col("k_mutable")).alias("mutable"),
        F.when(F.col("k_writable").isNull(), F.lit(True)).otherwise(_is_true(F.col("k_writable"))).alias("writable"),
        _is_true(F.col("k_write_path")).alias("write_path"),
        F.col("k_implicit").alias("implicit"),
        "name",
        F.coalesce("k_nom_de_guerre", F.when(F.col("name") != F.col("field"), F.col("name"))).alias("flag"),
        F.col("k_abbreviation").alias("abbreviation"),
        F.col("k_choices").alias("choices"),
        _is_true(F.col("k_positional")).alias("positional"),
        F.col("k_info").alias("info"),
    )


def document_errors(leaves: DataFrame, root: str = "cabs") -> DataFrame:
    """What is wrong with declarations: (provider, scope, side, name, reason).

    A value where a field's mapping should be, or names of one side that become
    one identifier.
    """
    placed = cut(_places(leaves, root))
    bare = placed.where("depth is null").select(*KEY, F.array_join("names", ".").alias("name"), F.lit("not a mapping").alias("reason"))
    names = placed.where("depth is not null").select(*KEY, F.array_join(F.slice("names", F.lit(1), F.col("depth")), ".").alias("name")).distinct()
    met = names.groupBy(*KEY, sanitize(F.col("name")).alias("field")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).where("n > 1")
    return bare.unionByName(met.select(*KEY, "name", F.concat(F.lit("several names become "), "field").alias("reason")))


def declared_fields(fields: DataFrame, provider: str, scope: str, side: str = "in") -> Sequence[Field]:
    """One scope's fields for `validate_rows`; a declaration is small, so it is fetched."""

    def value(text: str | None) -> object:
        try:
            return json.loads(text) if text is not None else None
        except ValueError:
            return text

    rows = fields.where((F.col("provider") == provider) & (F.col("scope") == scope) & (F.col("side") == side)).orderBy("field").collect()
    return [Field(r.field, r.dtype, r.required, value(r.field_default), tuple(value(r.choices) or ()), r.implicit) for r in rows]
