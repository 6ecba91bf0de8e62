"""Toxicity by a linear-chain conditional random field.

Tokens are words; two states, clean and toxic. Labelled tokens come from
labelled documents: words and word beginnings that significantly many toxic
documents share and clean ones do not. The field is trained on them by
likelihood; forward-backward marginals give each token's probability. What they
add up to, the largest of them and the length give the document's score, by a
logistic regression on the labelled documents: a word that clean documents hold
now and then by chance is no proof by itself. Tokens above one half are the
offending offsets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.columns import set_aside
from runledger.llm.labelled import fold, labelled_sample

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
#: Labelled documents of each class that the field is fitted on, at most.
SAMPLE_PER_CLASS = 1200
#: A mark needs this much evidence (nats of a one-sided test) and this precision.
EVIDENCE, PRECISION = 10.0, 0.75
#: Words on each side of a mark that training sees.
CONTEXT = 8
#: Words of a clean text that look like toxic ones and are trained on, about.
LOOKALIKES = 6
#: Words whose potentials a task remembers, and tokens it scores at a time.
REMEMBERED, TOKENS = 400_000, 250_000
#: A longer text is scored in pieces that overlap by this many tokens.
PIECE, OVERLAP = 1_000_000, 512
ROW = 256


def features(word: str) -> list[str]:
    """Names of a lower-cased word's features; every word has the bias."""
    return ["", f"w:{word}", *[f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n], f"s:{word[-3:]}"]


@dataclass
class Field:
    """Weights of the toxic state against the clean one, and log transition weights."""

    weights: dict[str, float] = field(default_factory=dict)
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    document: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def potential(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def scan(m: list[np.ndarray]) -> np.ndarray:
    """Normalised v[t] = v[t-1] @ step[t], v[-1] uniform, as (2, n).

    Rows of a fixed length are multiplied through side by side, their totals in
    turn, and then each row is run again from what comes before it.

    Args:
        m: The entries 00, 01, 10 and 11 of the steps, each of n.
    """
    n = len(m[0])
    rows = -(-n // ROW)
    entries = []
    for x, fill in zip(m, (1.0, 0.0, 0.0, 1.0)):
        padded = np.full(rows * ROW, fill)
        padded[:n] = x
        entries.append(np.ascontiguousarray(padded.reshape(rows, ROW).T))
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for p, q, r, s in zip(*entries):
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        scale = 1 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    first = np.empty((2, rows))
    x, y = 0.5, 0.5
    for i, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        first[:, i] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    out = np.empty((2, ROW, rows))
    x, y = first
    for t, (p, q, r, s) in enumerate(zip(*entries)):
        x, y = x * p + y * r, x * q + y * s
        scale = 1 / (x + y)
        x, y = x * scale, y * scale
        out[0, t], out[1, t] = x, y
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def marginals(potentials: np.ndarray, starts: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token, and the messages alpha, beta and emissions e, each (2, n).

    Args:
        starts: Which tokens begin a sequence; no message crosses a start.
    """
    n = len(potentials)
    s = np.clip(potentials, -40, 40)
    e1 = 1 / (1 + np.exp(-s))
    e = np.stack([1 - e1, e1])
    e[0] = 1 / (1 + np.exp(s))
    a, first = np.exp(transitions), np.exp(start)
    forward = [np.where(starts, first[j], a[i, j]) * e[j] for i in (0, 1) for j in (0, 1)]
    alpha = scan(forward)
    beta = np.full((2, n), 0.5)
    if n > 1:
        # What a token tells the one before it, as steps of the reversed order.
        back = [np.where(starts, 1.0, a[i, j] * e[j])[:0:-1] for j in (0, 1) for i in (0, 1)]
        beta[:, :-1] = scan(back)[:, ::-1]
    both = alpha * beta
    return both[1] / (both[0] + both[1]), alpha, beta, e


def pair_counts(alpha: np.ndarray, beta: np.ndarray, e: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected counts of each pair of neighbouring states."""
    a, told = np.exp(transitions), (e * beta)[:, 1:]
    joint = np.stack([alpha[i, :-1] * a[i, j] * told[j] for i in (0, 1) for j in (0, 1)])
    joint /= np.maximum(joint.sum(axis=0), 1e-300)
    return joint[:, ~starts[1:]].sum(axis=1).reshape(2, 2)


def distinct_texts(sample: Sequence[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """Word lists of the sample without near copies, which would pass their words for marks."""
    seen, kept = set(), []
    for text, y in sample:
        words = [w.lower() for w in WORD.findall(text)]
        runs = {zlib.crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))}
        hashes = np.fromiter(runs, np.uint64)
        least = {(k, int((hashes * np.uint64((2 * k + 1) * 2654435761) % np.uint64(4294967291)).min())) for k in range(4)}
        if not least & seen:
            kept.append((words, y))
        seen |= least
    return kept


def find_marks(texts: Sequence[tuple[list[str], int]]) -> tuple[set[str], set[str]]:
    """Features of words that toxic texts share significantly more than clean ones, and words that
    clean texts hold as often, which a beginning in common does not make toxic."""
    counts = (Counter(), Counter())
    totals = [0, 0]
    for words, y in texts:
        totals[y] += 1
        counts[y].update({f for w in set(words) for f in features(w)[1:-1]})
    if not all(totals):
        return set(), set()
    share = totals[1] / sum(totals)
    marks = set()
    for f, toxic in counts[1].items():
        n = toxic + counts[0][f]
        rate = toxic / n
        # Against equal rates of both classes, so that the mix of the sample does not matter.
        weighed = (toxic / totals[1]) / (toxic / totals[1] + counts[0][f] / totals[0])
        if weighed < PRECISION or rate <= share:
            continue
        evidence = n * (rate * np.log(rate / share) + ((1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0.0))
        if evidence >= EVIDENCE:
            marks.add(f)
    common = lambda f, n: n >= 3 and counts[1][f] / totals[1] < 1.5 * n / totals[0]
    return marks, {f[2:] for f, n in counts[0].items() if f[0] == "w" and common(f, n)}


def train_field(sample: Sequence[tuple[str, int]], rounds: int = 50, rate: float = 0.3, decay: float = 1e-4) -> Field | None:
    """Fit the field; None where the sample shows no toxic tokens."""
    texts = distinct_texts(sample)
    marks, innocent = find_marks(texts)
    if not marks:
        return None
    words, labels, starts = [], [], []
    is_mark = {w: w not in innocent and not marks.isdisjoint(features(w)) for tokens, _ in texts for w in set(tokens)}
    # Features of toxic words, by which clean words could be taken for them.
    alike = {f for tokens, y in texts if y for w in set(tokens) if is_mark[w] for f in features(w)[1:-1]}
    close = {w: not alike.isdisjoint(features(w)[1:-1]) for w in is_mark}
    for n, (tokens, y) in enumerate(texts):
        hits = [i for i, w in enumerate(tokens) if (is_mark if y else close)[w]]
        if not y and tokens:
            # Some lookalikes, and some places that depend on nothing but the text's number.
            hits = sorted({*hits[:: max(1, len(hits) // LOOKALIKES)], *((n * 7919 + k * 104729) % len(tokens) for k in range(3))})
        places = hits
        end = 0
        for i in places:
            if i < end:
                continue
            lo, hi = max(0, i - CONTEXT), min(len(tokens), i + 3 * CONTEXT)
            lo = max(lo, end)
            for j in range(lo, hi):
                words.append(tokens[j])
                labels.append(bool(y and is_mark[tokens[j]]))
                starts.append(j == lo)
            end = hi
    if not any(labels):
        return None
    names: dict[str, int] = {}
    ids = [[names.setdefault(f, len(names)) for f in features(w)] for w in words]
    width = max(map(len, ids))
    table = np.full((len(ids), width), len(names))
    for i, row in enumerate(ids):
        table[i, : len(row)] = row
    y, first = np.array(labels, float), np.array(starts)
    w, trans, start = np.zeros(len(names) + 1), np.zeros((2, 2)), np.zeros(2)
    params = [w, trans, start]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    state = y.astype(int)
    inner = ~first
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (state[:-1][inner[1:]], state[1:][inner[1:]]), 1)
    seen_first = np.bincount(state[first], minlength=2)
    for step in range(1, rounds + 1):
        p, alpha, beta, e = marginals(w[table].sum(axis=1), first, trans, start)
        pairs = pair_counts(alpha, beta, e, first, trans)
        p_first = np.array([(1 - p[first]).sum(), p[first].sum()])
        # A rare feature must be able to move as far as a common one: the step is normalised for each.
        gradients = [np.bincount(table.ravel(), np.repeat(y - p, width), len(names) + 1) - decay * len(y) * w, seen_pairs - pairs, seen_first - p_first]
        gradients[0][-1] = 0
        for x, g, a, b in zip(params, gradients, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6 * len(y))
    model = Field({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}, trans, start)
    found = np.array([x for x in _summaries(model, [" ".join(tokens) for tokens, _ in texts])])
    model.document = _regress(found, np.array([y for _, y in texts], float))
    return model


def summary(p: np.ndarray) -> list[float]:
    """What the marginals of a document amount to."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    q = np.clip(p, 1e-9, 1 - 1e-9)
    likely = q > 0.3
    evidence = np.maximum(0, np.log(q[likely] / (1 - q[likely]))).sum()
    return [1.0, float(np.log1p(p[likely].sum())), float(p.max()), float(np.log1p(evidence)), float(np.log1p(len(p)) / 10)]


def _summaries(model: Field, texts: Sequence[str]) -> Iterator[list[float]]:
    return (summary(p) for _, p in text_marginals(model, texts))


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, clean_weight: float = 3.0, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method; a clean document wrongly rejected counts more than a toxic one missed."""
    weight = np.where(y == 1, 0.5 / y.mean(), clean_weight * 0.5 / (1 - y.mean()))
    b = np.zeros(x.shape[1])
    penalty = np.full(len(b), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * b
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        b = b + step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
    return b


class Potentials(dict):
    """Potentials of words, computed once for each of the words a task remembers."""

    def __init__(self, model: Field):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = self.model.potential(word.lower())
        return value


def score_texts(model: Field | None, texts: Sequence[str | None]) -> Iterator[tuple[float, list[dict]]]:
    """(score, spans) of each text; spans are dicts of start, end (code points) and p."""
    if model is None:
        yield from ((0.0, []) for _ in texts)
        return
    for text, p in text_marginals(model, texts):
        x = float(np.dot(summary(p), model.document))
        yield (float(1 / (1 + np.exp(-np.clip(x, -60, 60)))) if len(p) else 0.0), _spans(text, p)


def text_marginals(model: Field, texts: Sequence[str | None]) -> Iterator[tuple[str, np.ndarray]]:
    """Each text with P(toxic) of its words."""
    known = Potentials(model)
    group: list[tuple[str, list[str]]] = []

    def flush() -> Iterator[tuple[str, np.ndarray]]:
        sizes = [len(words) for _, words in group]
        starts = np.zeros(sum(sizes), bool)
        starts[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)[np.array(sizes) > 0]] = True
        p = marginals(np.array([known[w] for _, words in group for w in words]), starts, model.transitions, model.start)[0] if len(starts) else np.zeros(0)
        at = 0
        for (text, _), size in zip(group, sizes):
            yield text, p[at : at + size]
            at += size
        group.clear()

    held = 0
    for text in texts:
        words = WORD.findall(text or "")
        if len(words) > PIECE:
            yield from flush() if group else ()
            held = 0
            yield text, _long_marginals(model, known, words)
            continue
        group.append((text or "", words))
        held += len(words)
        if held > TOKENS:
            yield from flush()
            held = 0
    if group:
        yield from flush()


def _spans(text: str, p: np.ndarray) -> list[dict]:
    toxic = set(np.flatnonzero(p >= 0.5).tolist())
    return [{"start": m.start(), "end": m.end(), "p": float(p[i])} for i, m in enumerate(WORD.finditer(text)) if i in toxic] if toxic else []


def _long_marginals(model: Field, known: Potentials, words: list[str]) -> np.ndarray:
    """A text in pieces, each seen with OVERLAP tokens on both sides, of which messages keep nothing."""
    p = np.empty(len(words))
    for lo in range(0, len(words), PIECE):
        seen = max(0, lo - OVERLAP)
        piece = words[seen : lo + PIECE + OVERLAP]
        starts = np.zeros(len(piece), bool)
        starts[0] = True
        own = marginals(np.array([known[w] for w in piece]), starts, model.transitions, model.start)[0]
        p[lo : lo + PIECE] = own[lo - seen : lo - seen + PIECE]
    return p


SCORED = ("toxic_score", "toxic_spans")


def score_toxicity(docs: DataFrame, model: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs` with `toxic_score` (0 to 1) and `toxic_spans` (start, end, p) at the end.

    Score and spans replace columns of those names. A null or empty text, or one
    without words, has score 0 and no spans, as has every text where no model
    could be trained. Repeated rows score alike. Only the text is read to score.
    """
    target = docs.drop(*SCORED)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([*target.schema, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = list(score_texts(model, batch.column(text).to_pylist()))
            yield batch.append_column("toxic_score", pa.array([s for s, _ in found], pa.float64())).append_column("toxic_spans", pa.array([x for _, x in found], kind))

    return target.mapInArrow(batches, schema)


def drop_toxic(docs: DataFrame, model: Field | None, reject_from: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that score below `reject_from`, with the columns and values they have, whatever their names.

    Rows of null or empty text score 0 and stay; repeated rows share their fate.
    """
    own, back = set_aside(docs, SCORED)
    return score_toxicity(own, model, key, text).where(F.col("toxic_score") < reject_from).drop(*SCORED).withColumnsRenamed(back).select(*docs.columns)


def learn_toxic_field(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field of `labels.toxic`, from a bounded sample of the rows whose fold of three is not 1."""
    return train_field(labelled_sample(docs, labels, "toxic", fold(F.col("k"), 3) != 1, SAMPLE_PER_CLASS))
