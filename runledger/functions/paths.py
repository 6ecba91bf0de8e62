"""Path columns: anchoring, prefixes, containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.plans.paths import normalize, overlap


def absolutize(path: Column, base: Column) -> Column:
    """A relative path under `base`; an absolute one as it is."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), path))


def relativize(path: Column, base: Column) -> Column:
    """A path inside `base` relative to it; anything else unchanged."""
    root = F.regexp_replace(base, "/+$", "")
    inside = F.concat(root, F.lit("/"))
    return F.when(path == root, F.lit(".")).when(path.startswith(inside), _after(path, inside)).otherwise(path)


def _after(text: Column, prefix: Column) -> Column:
    return F.substr(text, F.length(prefix) + 1)


def absolutize_all(paths: Column, base: Column) -> Column:
    """`absolutize` for each element of an array."""
    return F.transform(paths, lambda p: absolutize(p, base))


def relativize_all(paths: Column, base: Column) -> Column:
    """`relativize` for each element of an array."""
    return F.transform(paths, lambda p: relativize(p, base))


def literal_prefix(pattern: Column) -> Column:
    """Directory of a glob up to its first wildcard; null where that is nothing or has `..`."""
    tidy = F.regexp_replace(F.regexp_replace(pattern, r"(^|/)(\./)+", "$1"), "/+", "/")
    # Whole segments without a wildcard, each followed by one more segment.
    lead = F.nullif(F.regexp_extract(tidy, r"^(/?[^*?\[/]+(?:/[^*?\[/]+)*)/[^/]", 1), F.lit(""))
    found = F.coalesce(lead, F.when(pattern.startswith("/"), F.lit("/")))
    return F.when(~found.rlike(r"(^|/)\.\.(/|$)"), found)


def paths_overlap(a: Column, b: Column) -> Column:
    """Whether two paths are equal or one holds the other, on segment boundaries."""
    return overlap(normalize(a), normalize(b))
