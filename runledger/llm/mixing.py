"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells of all margins (source, language, topic) are raked: in
turn each margin's classes are scaled to their target, no cell beyond all it
has, until all margins hold. A cell's calibrated share is the probability with
which each of its documents is drawn.

The targets name their classes, a tempered margin adds its frequent values, and
what is left is one class more, so the number of cells is bounded, however large
the corpus: the cells are raked in memory, while weights are summed and documents
drawn by Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.columns import set_aside, unused
from runledger.plans.lineage import cut

#: The class of all values a margin does not name, nulls included.
REST = "(rest)"
#: Values from this share of tokens on are classes of their own where a margin is tempered, so there are 200 at most.
LEAST_SHARE = 0.005
#: 2**52: a hash below it is an exact number between 0 and 1.
_UNIT = 1 << 52


@dataclass(frozen=True)
class Margin:
    """A column's target shares by value; what is left of 1 is for the other values.

    Where nothing is left, other values keep the share of tokens they have, and the
    targets divide what is not theirs.

    With `temper`, frequent other values get targets as well: what the given ones
    leave of 1 is divided as the powers by it of the shares of tokens (1: as they
    are, 0: evenly), values below `LEAST_SHARE` together counting as one.
    """

    name: str
    value: Column
    targets: Mapping[str, float]
    temper: float | None = None

    def tempered(self, tokens: DataFrame, column: str) -> Margin:
        """This margin with a target for each frequent value of `tokens` (the column, and `t`, the token count)."""
        if self.temper is None:
            return self
        others = tokens.where(F.col(column).isNull() | ~F.col(column).isin(list(self.targets))).groupBy(column).agg(F.sum("t").alias("t"))
        total = tokens.agg(F.sum("t")).first()[0] or 0
        left = max(0.0, 1 - sum(self.targets.values()))
        if not total or left <= 0:
            return self
        large = F.col(column).isNotNull() & (F.col(column) != REST) & (F.col("t") >= total * LEAST_SHARE)
        frequent = {r[column]: r["t"] / total for r in others.where(large).orderBy(F.desc("t"), column).collect()}  # at most 1 / LEAST_SHARE
        tail = (others.where(~large | F.col(column).isNull()).agg(F.sum("t")).first()[0] or 0) / total
        weights = {k: v**self.temper for k, v in frequent.items()}
        whole = sum(weights.values()) + (tail**self.temper if tail else 0.0)
        return replace(self, targets={**self.targets, **{k: left * w / whole for k, w in weights.items()}}) if weights else self

    def classes(self) -> list[str]:
        return [*self.targets, REST]

    def shares(self, weights: np.ndarray) -> np.ndarray:
        """The share of each of the classes, which have the given token weights."""
        named = np.array([*self.targets.values()], float)
        rest = 1 - named.sum()
        if rest > 1e-9:
            return np.array([*named, rest])
        rest = weights[-1] / weights.sum() if weights.sum() else 0.0
        return np.array([*named * (1 - rest), rest])

    def of(self) -> Column:
        return F.when(self.value.isin(list(self.targets)), self.value).otherwise(F.lit(REST))


@dataclass(frozen=True)
class Calibration:
    """Probabilities of the cells, and how far margins are from their targets (share of the sample)."""

    probabilities: np.ndarray
    error: float


def rake(weights: np.ndarray, targets: Sequence[np.ndarray], share: float, rounds: int = 2000, tolerance: float = 1e-10) -> Calibration:
    """Probabilities, at most 1, by which cells of `weights` meet the targets.

    Args:
        weights: Token weight of each cell, one axis a margin.
        targets: Share of each class, one array a margin. A class without weight
            gives its share to the others in proportion.
        share: Share of all tokens the sample is to have.

    A class that has less than its target is taken whole, the others of its
    margin share what is missing in proportion. Margins that contradict each
    other, cell by cell, leave the error that is returned.
    """
    total = weights.sum()
    p = np.full(weights.shape, min(1.0, share))
    if not total:
        return Calibration(p, 0.0)
    wanted = []
    for axis, target in enumerate(targets):
        wanted.append(_attainable(target, weights.sum(axis=tuple(i for i in range(weights.ndim) if i != axis)), share * total))
    error = np.inf
    for _ in range(rounds):
        error = 0.0
        for axis, want in enumerate(wanted):
            others = tuple(i for i in range(weights.ndim) if i != axis)
            now = (p * weights).sum(axis=others)
            error = max(error, float(np.abs(now - want).max() / (share * total)))
            scale = np.where(now > 0, want / np.where(now > 0, now, 1), 1)
            p = np.minimum(1.0, p * scale.reshape([-1 if i == axis else 1 for i in range(weights.ndim)]))
        if error < tolerance:
            break
    return Calibration(p, error)


def _attainable(target: np.ndarray, have: np.ndarray, budget: float) -> np.ndarray:
    """`budget` divided as `target` says, as far as each class has as much."""
    whole = (target <= 0) | (have <= 0)
    want = np.zeros(len(have))
    while True:
        open_budget = budget - want[whole].sum()
        t = np.where(whole, 0.0, target)
        if t.sum() <= 0 or open_budget <= 0:
            return want
        share = np.where(whole, want, t / t.sum() * open_budget)
        over = ~whole & (share > have)
        if not over.any():
            return share
        want = np.where(over, have, want)
        whole = whole | over


def token_weight(text: str) -> Column:
    """Words of a text, as runs of what is not ASCII white space."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


ADDED = ("mix_cell", "mix_tokens", "mix_probability", "mix_drawn")


def draw_documents(docs: DataFrame, margins: Sequence[Margin], share: float, seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with mix_cell (an array of classes), mix_tokens, mix_probability and mix_drawn.

    They replace columns of those names. A document is drawn where a hash of its
    key, text and the seed falls below its cell's probability, so repeated rows
    share their fate and a lost executor changes nothing. A null value of a
    margin is in its rest. A null or empty text has no tokens and the
    probability of its cell. An empty table gives no rows.
    """
    base = docs.drop(*ADDED)
    names = [unused(f"margin{i}", base.columns) for i in range(len(margins))]
    counted = base.select(*[(m.of() if m.temper is None else m.value).alias(n) for m, n in zip(margins, names)], token_weight(text).alias("t")).groupBy(*names).agg(F.sum("t").alias("t"))
    if any(m.temper is not None for m in margins):
        # Written, as its values are looked at first and then dealt to classes.
        counted = cut(counted)
    margins = [m.tempered(counted, n) for m, n in zip(margins, names)]
    classes = [m.classes() for m in margins]
    of_counted = [F.col(n) if m.temper is None else replace(m, value=F.col(n)).of() for m, n in zip(margins, names)]
    cells = counted.select(*[c.alias(n) for c, n in zip(of_counted, names)], "t").groupBy(*names).agg(F.sum("t").alias("t"))
    weights = np.zeros([len(c) for c in classes])
    for row in cells.collect():  # no more rows than the targets have cells
        weights[tuple(c.index(row[n]) for c, n in zip(classes, names))] = row["t"]
    targets = [m.shares(weights.sum(axis=tuple(i for i in range(weights.ndim) if i != axis))) for axis, m in enumerate(margins)]
    p = rake(weights, targets, share).probabilities
    table = [(*[c[i] for c, i in zip(classes, at)], float(p[at])) for at in np.ndindex(p.shape)]
    schema = ", ".join([*(f"{n} string" for n in names), "mix_probability double"])
    chances = F.broadcast(base.sparkSession.createDataFrame(table, schema))
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(seed)), F.lit(_UNIT)) / F.lit(float(_UNIT))
    return (
        base.withColumns({n: m.of() for m, n in zip(margins, names)})
        .join(chances, names)
        .withColumns({"mix_cell": F.array(*names), "mix_tokens": token_weight(text), "mix_drawn": unit < F.col("mix_probability")})
        .select(*base.columns, *ADDED)
    )


def topic_of(text: str) -> Column:
    """A topic by form, the first that fits: listing, legal, contact, prose; a null text is prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    any_of = lambda *parts: reduce(lambda x, y: x | y, [t.contains(p) for p in parts])
    return (
        F.when(t.contains(" | "), "listing")
        .when(any_of("icense", "icence", "LICENSE", "LICENCE", "opyright", "COPYRIGHT"), "legal")
        .when(t.contains("@") & t.rlike(r"\w@\w[\w-]*\.\w"), "contact")
        .otherwise("prose")
    )


#: Target shares of tokens, and the share of all tokens that a mix of the documents is to have.
SOURCES = {"src0": 0.30}
LANGUAGES = {"en": 0.54, "de": 0.17, "fr": 0.17, "es": 0.12}
TOPICS = {"prose": 0.91, "listing": 0.03, "legal": 0.03, "contact": 0.03}
#: Sources without a target share what is left as the powers of their shares of tokens by this.
SOURCE_TEMPER = 0.5
MIX_SHARE = 0.75


def document_margins() -> list[Margin]:
    """The margins that documents are mixed by: source, language and topic."""
    return [Margin("source", F.col("source"), SOURCES, SOURCE_TEMPER), Margin("lang", F.col("lang"), LANGUAGES), Margin("topic", topic_of("text"), TOPICS)]


def mix_documents(docs: DataFrame, margins: Sequence[Margin], share: float, seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of `docs` with the columns and values they have, whatever their names.

    Which rows are drawn, and what becomes of nulls, empty texts and repeated
    rows, `draw_documents` says.
    """
    own, back = set_aside(docs, ADDED)
    return draw_documents(own, margins, share, seed, key, text).where("mix_drawn").drop(*ADDED).withColumnsRenamed(back).select(*docs.columns)
