"""Byte sizes and resource footprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size suffixes, lower case. GB is 1000**3 and GiB is 1024**3; a
# bare letter is decimal.
SIZE_UNITS = {
    "": 1,
    "b": 1,
    "k": 1000,
    "kb": 1000,
    "kib": 1024,
    "m": 1000**2,
    "mb": 1000**2,
    "mib": 1024**2,
    "g": 1000**3,
    "gb": 1000**3,
    "gib": 1024**3,
    "t": 1000**4,
    "tb": 1000**4,
    "tib": 1024**4,
    "p": 1000**5,
    "pb": 1000**5,
    "pib": 1024**5,
}
SIZE_PATTERN = r"^\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z]*)\s*$"
BINARY_STEPS = (("PiB", 1024**5), ("TiB", 1024**4), ("GiB", 1024**3), ("MiB", 1024**2), ("KiB", 1024))


def _multiplier(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in SIZE_UNITS.items() for x in (k, float(v))])
    return F.try_element_at(table, F.lower(unit))


def parse_size(text: Column) -> Column:
    """Bytes named by `text` (`200GB`, `250 GiB`, `1024`), null where it is no size."""
    number = F.regexp_extract(text, SIZE_PATTERN, 1).try_cast("double")
    product = number * _multiplier(F.regexp_extract(text, SIZE_PATTERN, 2))
    return F.when(text.rlike(SIZE_PATTERN), F.floor(product).try_cast("bigint"))


def size_error(text: Column) -> Column:
    """Why `parse_size` gave null; null where it gave a size."""
    unit = F.regexp_extract(text, SIZE_PATTERN, 2)
    return (
        F.when(text.isNull(), F.lit("missing"))
        .when(~text.rlike(SIZE_PATTERN), F.lit("not a size"))
        .when(_multiplier(unit).isNull(), F.lit("unknown unit"))
        .when(parse_size(text).isNull(), F.lit("too large"))
    )


def format_size(size: Column) -> Column:
    """A byte count in binary units with one decimal, halves to even.

    Worked in integers: whole units and tenths are separate, so no value near a
    tie depends on how a double prints.
    """
    out = None
    for unit, scale in BINARY_STEPS:
        whole = ((size - F.pmod(size, F.lit(scale))) / F.lit(scale)).cast("bigint")
        tenths = whole * 10 + F.bround(F.pmod(size, F.lit(scale)) * 10 / F.lit(scale), 0).cast("bigint")
        text = F.concat(
            ((tenths - tenths % 10) / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit)
        )
        out = F.when(size >= scale, text) if out is None else out.when(size >= scale, text)
    return out.otherwise(F.concat(size.cast("string"), F.lit("B")))


def format_g(value: Column) -> Column:
    """A double with at most six significant digits and no trailing zeros."""

    def trimmed(text: Column) -> Column:
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)

    def scientific(v: Column) -> Column:
        text = F.format_string("%.5e", v)
        return F.concat(trimmed(F.substring_index(text, "e", 1)), F.lit("e"), F.substring_index(text, "e", -1))

    size = F.abs(value)
    out = F.when(size == 0, F.lit("0"))
    # Bounds sit half a unit of the sixth digit below each power of ten: what
    # rounds up to the next power takes that power's format.
    for power in range(-4, 6):
        out = out.when((size >= 9.999995 * 10.0 ** (power - 1)) & (size < 9.999995 * 10.0**power), trimmed(F.format_string(f"%.{5 - power}f", value)))
    return out.otherwise(scientific(value))


def describe_resources(cpus: Column, cpus_all: Column, memory: Column) -> Column:
    """`cpus=4, memory=200.0GiB`, or `unbounded` where nothing is declared."""
    cpu = F.when(cpus_all, F.lit("cpus=all")).when(cpus.isNotNull(), F.concat(F.lit("cpus="), format_g(cpus)))
    mem = F.when(memory.isNotNull(), F.concat(F.lit("memory="), format_size(memory)))
    text = F.concat_ws(", ", cpu, mem)
    return F.when(text == "", F.lit("unbounded")).otherwise(text)


def request_cpus(cpus: Column, cpus_all: Column) -> Column:
    """Whole cores to ask a batch system for; null for `all` and for undeclared."""
    return F.when(~F.coalesce(cpus_all, F.lit(False)) & cpus.isNotNull(), F.greatest(F.lit(1), F.ceil(cpus)).cast("bigint"))


def request_mib(memory: Column) -> Column:
    """Whole MiB to ask a batch system for, rounded up."""
    return F.when(memory.isNotNull(), F.greatest(F.lit(1), F.ceil(memory / F.lit(1024**2))).cast("bigint"))
