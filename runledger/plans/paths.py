"""Path columns as sets of ancestors, so containment becomes an equi join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a path has that another spelling of it has not: an empty or dotted segment, a slash at the end.
FOLDABLE = r"(?s)^$|//|(?:^|/)\.{1,2}(?:/|$)|.+/$"


def segments(path: Column) -> Column:
    """Non-empty, non-`.` segments of a path."""
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def normalize(path: Column) -> Column:
    """One spelling per path: no `.`, no doubled or trailing slash, `..` folded.

    Purely textual, so it does not follow links. A path that has only one
    spelling, as nearly all have, is told by a pattern and not taken apart.
    """
    return F.when(~path.rlike(FOLDABLE), path).otherwise(_folded(path))


def _folded(path: Column) -> Column:
    absolute = path.startswith("/")
    start = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        popped = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        foldable = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != "..")
        return (
            F.when((s == "..") & foldable, popped)
            .when((s == "..") & absolute, acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    body = F.array_join(F.aggregate(segments(path), start, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def ancestors(path: Column, proper: bool = False) -> Column:
    """Every prefix of a normalized path on segment boundaries, shortest first.

    `/a/b` -> [`/`, `/a`, `/a/b`]; `a/b` -> [`a`, `a/b`]. `proper` leaves the path out.
    """
    absolute = path.startswith("/")
    segs = segments(path)
    count = F.size(segs)
    last = count - 1 if proper else count
    lead = F.when(absolute, F.lit("/")).otherwise(F.lit(""))
    numbers = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(numbers, lambda n: F.concat(lead, F.array_join(F.slice(segs, 1, n), "/")))
    with_root = absolute & (F.lit(True) if not proper else (count >= 1))
    return F.when(with_root, F.concat(F.array(F.lit("/")), prefixes)).otherwise(prefixes)


def within(inner: Column, outer: Column) -> Column:
    """Whether normalized `inner` is `outer` or lies under it."""
    return (inner == outer) | (F.when(outer == "/", inner.startswith("/")).otherwise(inner.startswith(F.concat(outer, F.lit("/")))))


def overlap(a: Column, b: Column) -> Column:
    """Whether two normalized paths can name the same bytes."""
    return within(a, b) | within(b, a)


def parent(path: Column) -> Column:
    """Directory of a normalized path (`.` for a bare name, `/` for a root entry)."""
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)
