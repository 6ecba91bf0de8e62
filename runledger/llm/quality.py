"""Text quality by a byte-level convolutional network.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters run over each chunk and are max-pooled there; a filter's largest,
mean and smallest value over the chunks are combined into one probability. What
repeats itself has chunks that few filters answer to, which the smallest and the
mean values show.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a chunk, and how many of them the next chunk sees again.
CHUNK, OVERLAP = 256, 32
#: Width and stride of a filter, values of an embedded byte, number of filters.
WIDTH, STRIDE, DIM, FILTERS = 6, 2, 8, 24
#: Stands for what is behind the end of a text.
PAD = 256
#: Labelled documents of each class that the network is fitted on, at most.
SAMPLE_PER_CLASS = 700
#: Chunks a task convolves at a time.
GROUP = 512


@dataclass
class Network:
    """Weights: embedded bytes, filters and their biases, the last layer and its bias."""

    bytes: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.bytes, self.filters, self.bias, self.out, self.out_bias]


def new_network(seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    embedded = rng.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32)
    embedded[PAD] = 0
    return Network(
        embedded,
        rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )


def cut_chunks(text: str) -> np.ndarray:
    """The chunks of a text, (number, CHUNK); an empty text has one, of padding."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hop = CHUNK - OVERLAP
    number = max(1, -(-(len(raw) - OVERLAP) // hop))
    padded = np.full((number - 1) * hop + CHUNK, PAD, np.uint16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::hop]


def _windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    """(chunks, places, WIDTH * DIM) embedded bytes under a filter."""
    embedded = net.bytes[chunks].reshape(len(chunks), CHUNK * DIM)
    return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]


def _pool(net: Network, chunks: np.ndarray, want_places: bool = False):
    """Each chunk's filter values, max-pooled, and where they were."""
    windows = _windows(net, chunks)
    n, places, size = windows.shape
    values = (np.ascontiguousarray(windows).reshape(n * places, size) @ net.filters).reshape(n, places, FILTERS)
    if not want_places:
        return np.maximum(values.max(axis=1) + net.bias, 0)
    at = values.argmax(axis=1)
    top = np.take_along_axis(values, at[:, None, :], axis=1)[:, 0] + net.bias
    return np.maximum(top, 0), at


def _combine(pooled: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.maximum.reduceat(pooled, starts), np.add.reduceat(pooled, starts) / counts[:, None], np.minimum.reduceat(pooled, starts)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def score_quality_texts(net: Network | None, texts: Sequence[str | None], prior: float = 0.5) -> np.ndarray:
    """Probability of label 1 of each text."""
    if net is None:
        return np.full(len(texts), prior)
    pooled, counts, held, rows = [], [], [], 0
    for text in texts:
        chunks = cut_chunks(text or "")
        counts.append(len(chunks))
        for i in range(0, len(chunks), GROUP):
            held.append(chunks[i : i + GROUP])
            rows += len(held[-1])
            if rows >= GROUP:
                pooled.append(_pool(net, np.concatenate(held)))
                held, rows = [], 0
    if held:
        pooled.append(_pool(net, np.concatenate(held)))
    if not counts:
        return np.zeros(0)
    number = np.array(counts)
    features = _combine(np.concatenate(pooled), np.concatenate([[0], np.cumsum(number)[:-1]]), number)
    return _sigmoid(features.astype(float) @ net.out + net.out_bias[0])


def train_network(sample: Sequence[tuple[str, int]], epochs: int = 14, batch: int = 24, rate: float = 0.004, seed: int = 5) -> Network | None:
    """Fit by Adam on whole texts; None where one of the labels is missing."""
    labels = np.array([y for _, y in sample], float)
    if len(set(labels.tolist())) < 2:
        return None
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    net, rng = new_network(seed), np.random.default_rng(seed)
    chunked = [np.ascontiguousarray(cut_chunks(text)) for text, _ in sample]
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(sample))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            number = np.array([len(chunked[i]) for i in ids])
            starts = np.concatenate([[0], np.cumsum(number)[:-1]])
            chunks = np.concatenate([chunked[i] for i in ids])
            parts = [_pool(net, chunks[i : i + GROUP], True) for i in range(0, len(chunks), GROUP)]
            pooled, at = np.concatenate([p for p, _ in parts]), np.concatenate([a for _, a in parts])
            features = _combine(pooled, starts, number)
            error = ((_sigmoid(features @ net.out + net.out_bias[0]) - labels[ids]) * weight[ids] / len(ids)).astype(np.float32)
            d_features = error[:, None] * net.out[None]
            # From documents back to chunks: the largest, the mean, the smallest.
            doc = np.repeat(np.arange(len(ids)), number)
            top, low = features[:, :FILTERS][doc], features[:, 2 * FILTERS :][doc]
            d = d_features[:, FILTERS : 2 * FILTERS][doc] / number[doc][:, None]
            d = d + d_features[:, :FILTERS][doc] * (pooled == top) / np.maximum(np.add.reduceat((pooled == top).astype(np.float32), starts)[doc], 1)
            d = d + d_features[:, 2 * FILTERS :][doc] * (pooled == low) / np.maximum(np.add.reduceat((pooled == low).astype(np.float32), starts)[doc], 1)
            d *= pooled > 0
            d_filters, d_bytes = np.zeros_like(net.filters), np.zeros_like(net.bytes)
            for i in range(0, len(chunks), GROUP):
                windows, own, places = _windows(net, chunks[i : i + GROUP]), d[i : i + GROUP], at[i : i + GROUP]
                row = np.arange(len(own))[:, None]
                d_filters += np.einsum("cfs,cf->sf", windows[row, places], own)
                under = (places * STRIDE)[:, :, None] + np.arange(WIDTH)
                which = chunks[i : i + GROUP][row[:, :, None], under]
                back = (own[:, :, None] * net.filters.T[None]).reshape(*own.shape, WIDTH, DIM)
                flat = which.ravel().astype(np.int64)
                for j in range(DIM):
                    d_bytes[:, j] += np.bincount(flat, back[..., j].ravel(), PAD + 1).astype(np.float32)
            d_bytes[PAD] = 0
            gradients = [d_bytes, d_filters, d.sum(axis=0), features.T @ error + 1e-4 * net.out, np.array([error.sum()], np.float32)]
            step += 1
            speed = rate * min(1.0, 2.0 * (1 - (epoch * len(order) + lo) / (epochs * len(order))))
            for p, g, a, b in zip(net.parts(), gradients, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def score_quality(docs: DataFrame, net: Network | None, prior: float = 0.5, text: str = "text") -> DataFrame:
    """All columns of `docs` with `quality_score` (0 to 1, higher: label 1 likelier) at the end.

    It replaces a column of that name. A null text counts as empty and has the
    score of a chunk of padding; without a network every text has `prior`.
    Repeated rows score alike. Only the text is read to score, and all of it.
    """
    target = docs.drop("quality_score")
    schema = T.StructType([*target.schema, T.StructField("quality_score", T.DoubleType())])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.append_column("quality_score", pa.array(score_quality_texts(net, batch.column(text).to_pylist(), prior), pa.float64()))

    return target.mapInArrow(batches, schema)


def judge_quality(scored: DataFrame, threshold: float) -> DataFrame:
    """`predicted`: 1 where the score reaches the threshold, else 0."""
    return scored.withColumn("predicted", (F.col("quality_score") >= threshold).cast("int"))
