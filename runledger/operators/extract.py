"""Named values out of console lines."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE_TYPES = ("str", "int", "float", "bool")
INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
FLOAT_TEXT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"


@dataclass(frozen=True)
class Rule:
    """Take `group` of `pattern` as `field`.

    An `optional` group may take no part in a match; a required one that
    matches nothing gives the empty text.
    """

    pattern: str
    field: str
    type: str = "str"
    optional: bool = False

    def compiled(self) -> tuple[str, int]:
        """The pattern with plain groups, and the number of the field's group."""
        groups = re.compile(self.pattern).groupindex
        if self.field not in groups:
            raise ValueError(f"pattern {self.pattern!r} has no group {self.field!r}")
        return re.sub(r"\(\?P<[^>]+>", "(", self.pattern), groups[self.field]


def parse_action(pattern: str, action: str) -> Rule | None:
    """`PARSE_OUTPUT:<group>:<type>` as a rule; other actions are not extraction."""
    verb, *operands = re.split(r":", action)
    match verb, operands:
        case "PARSE_OUTPUT", [group, kind]:
            return Rule(pattern, group, kind if kind in VALUE_TYPES else VALUE_TYPES[0])
        case _ if action.startswith("PARSE_OUTPUT"):
            raise ValueError(f"{action!r} does not name one group and one type")
    return None


def rules_from(actions: Mapping[str, Sequence[str]]) -> list[Rule]:
    """Rules of a pattern -> actions table, in order."""
    parsed = [parse_action(pattern, action) for pattern, listed in actions.items() for action in listed]
    return [rule for rule in parsed if rule is not None]


def matches_of(text: Column, rules: Sequence[Rule]) -> Column:
    """Array of what each matching rule takes from one line: (field, type, raw, rule_no)."""
    found = []
    for number, rule in enumerate(rules):
        pattern, group = rule.compiled()
        raw = F.regexp_extract(text, pattern, group)
        raw = F.when(raw != "", raw) if rule.optional else raw
        found.append(
            F.when(
                text.rlike(pattern),
                F.struct(F.lit(rule.field).alias("field"), F.lit(rule.type).alias("type"), raw.alias("raw"), F.lit(number).alias("rule_no")),
            )
        )
    return F.array_compact(F.array(*found))


def typed_values(raw: Column, kind: Column) -> dict[str, Column]:
    """The raw text as its declared type, one column per type, and why it has no value.

    A flag is true for any text but the empty one, `False` included.
    """
    as_int = F.when(raw.rlike(INT_TEXT), F.replace(F.trim(raw), F.lit("_"), F.lit("")).try_cast("bigint"))
    as_float = F.when(raw.rlike(FLOAT_TEXT), F.trim(raw).try_cast("double"))
    return {
        "text_value": F.when(kind == "str", F.coalesce(raw, F.lit("None"))),
        "int_value": F.when(kind == "int", as_int),
        "float_value": F.when(kind == "float", as_float),
        "bool_value": F.when(kind == "bool", F.coalesce(F.length(raw) > 0, F.lit(False))),
        "error": F.when(kind.isin("int", "float") & raw.isNull(), F.lit("group did not match"))
        .when((kind == "int") & as_int.isNull(), F.lit("not an int"))
        .when((kind == "float") & as_float.isNull(), F.lit("not a float")),
    }


def extract_values(lines: DataFrame, rules: Sequence[Rule], by: Sequence[str], order: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row per (by, field): the value of the last match.

    Lines are scanned once whatever the number of rules, and each task keeps
    only the latest match per field before anything is shuffled.
    """
    text = F.col(text_col)
    taken = lines.select(*by, *order, F.explode(matches_of(text, rules)).alias("m"))
    latest = taken.groupBy(*by, F.col("m.field").alias("field")).agg(
        F.max_by(F.struct("m.type", "m.raw"), F.struct(*order, F.col("m.rule_no"))).alias("v")
    )
    return latest.select(
        *by, "field", F.col("v.type").alias("type"), *[c.alias(n) for n, c in typed_values(F.col("v.raw"), F.col("v.type")).items()]
    )


def extract_markers(
    lines: DataFrame,
    markers: Mapping[str, str],
    by: Sequence[str],
    order: Sequence[str],
    required: Sequence[str] = (),
    text_col: str = "text",
) -> DataFrame:
    """One row per `by`: for each field the rest of its last `MARK value` line, and the required ones missing.

    Args:
        markers: field -> the text a line starts with.
    """
    text = F.trim(F.regexp_replace(F.col(text_col), r"^\s+|\s+$", ""))
    columns = []
    for name, mark in markers.items():
        hit = text.startswith(mark)
        value = F.trim(F.substr(text, F.lit(len(mark) + 1)))
        columns.append(F.max_by(value, F.when(hit, F.struct(*order))).alias(name))
    wide = lines.groupBy(*by).agg(*columns)
    absent = F.array_compact(F.array(*[F.when(F.col(r).isNull(), F.lit(r)) for r in required])) if required else F.array().cast("array<string>")
    filled = {name: F.when(F.col(name) != "", F.col(name)) for name in markers if name not in required}
    return wide.withColumn("missing", F.array_join(absent, ",")).withColumns(filled)
