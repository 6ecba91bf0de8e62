"""Language of a text by piece probabilities, summed over all segmentations.

The pieces are a fixed public vocabulary, as bytes. For each language a piece has
a probability; a word's likelihood is the sum over every way to cut it into
pieces, which the forward algorithm adds up from left to right. Probabilities are
fitted the same way: each round counts the pieces that words of the language are
expected to hold, by forward and backward sums. No segmentation is ever chosen.
Words of one length are scored together, for all languages at once, and a text
by its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.plans.lineage import cut

#: Labelled texts of each language that are learnt from, about, and languages learnt at most, the most frequent ones.
SAMPLE_PER_LANGUAGE, LANGUAGES = 2000, 256
#: Rounds of counting, and the times that each piece counts before any is seen.
ROUNDS, PRIOR = 4, 0.01
#: Words are learnt from, and their likelihoods held, up to this many bytes; a task holds so many.
WORD_BYTES, HELD = 48, 1 << 17
#: Bytes after which sums are brought back to 1, so that long words do not vanish.
RESCALE = 16
#: Characters of texts, and bytes of words, that a task works on at a time (longer ones go alone).
PIECE, BLOCK = 1 << 20, 1 << 18
#: An odd number whose powers make the hash of a piece.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>")


class Vocabulary:
    """Pieces as bytes, numbered from 0; the first 256 are the single bytes, so that any text can be cut into them.

    Pieces of several bytes are looked up by a 64-bit hash, one table a length.
    """

    def __init__(self, pieces: list[bytes]):
        self.pieces = [bytes([b]) for b in range(256)] + sorted({p for p in pieces if len(p) > 1})
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(p) for p in self.pieces[256:]}):
            rows = np.array([i for i, p in enumerate(self.pieces) if len(p) == length])
            hashes = _prefix_hashes(np.array([list(self.pieces[i]) for i in rows], np.uint8))[:, -1]
            order = np.argsort(hashes)
            self.by_length[length] = hashes[order], rows[order]

    def __len__(self):
        return len(self.pieces)

    def lookup(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each length, the piece that starts at each place of each word (one word a row), or -1."""
        width = words.shape[1]
        hashes = _prefix_hashes(words)
        found = {1: words.astype(np.int64)}
        power = np.ones(1, np.uint64)
        for length in range(1, width + 1):
            power = power * BASE
            if length in self.by_length:
                known, rows = self.by_length[length]
                h = hashes[:, length:] - hashes[:, : width - length + 1] * power
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                found[length] = np.where(known[at] == h, rows[at], -1)
            elif length > max(self.by_length, default=1):
                break
        return found


def _prefix_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of each row, from the empty one on."""
    hashes = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for k in range(words.shape[1]):
        hashes[:, k + 1] = hashes[:, k] * BASE + words[:, k] + np.uint64(1)
    return hashes


def public_pieces(path: str) -> list[bytes]:
    """Pieces of a model's file that may be in a word: a mark before it and no other space."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i))]
    pieces = [p for i in ids if not BYTE_PIECE.fullmatch(p := processor.id_to_piece(i))]
    return [p.encode() for p in pieces if "▁" not in p[1:]]


def words_of(text: str) -> list[str]:
    """Runs of what is not white space, each with the mark that the vocabulary puts before a word."""
    return ["▁" + w for w in text.split()]


def _blocks(words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """(places, matrix) of words of one length at a time."""
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for length, places in by_length.items():
        step = max(1, BLOCK // length)
        for k in range(0, len(places), step):
            some = places[k : k + step]
            yield some, np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(len(some), length)


def forward(edges: dict[int, np.ndarray], chance: Callable[[np.ndarray], np.ndarray], rescale: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums over all segmentations of each prefix, and the logarithm of what they were divided by.

    Args:
        edges: What `Vocabulary.lookup` found.
        chance: From pieces (-1 for none) to rows of probabilities.
    """
    width, longest = edges[1].shape[1], max(edges)
    held = {k: (e >= 0).any(axis=0) for k, e in edges.items()}
    one = np.ones_like(chance(edges[1][:, 0]))
    sums: list[np.ndarray] = [one]
    scale = np.zeros_like(one)
    for end in range(1, width + 1):
        total = np.zeros_like(one)
        for k, rows in edges.items():
            if k <= end and held[k][end - k]:
                total += sums[end - k] * chance(rows[:, end - k])
        sums.append(total)
        if rescale and end % RESCALE == 0:
            # Only ends that a later piece can start from are needed; older ones are let go.
            for k in range(max(0, end - longest - RESCALE), end):
                sums[k] = sums[k] / total if k > end - longest else None
            sums[end] = np.ones_like(one)
            scale += np.log(total)
    return sums, scale


@dataclass
class Model:
    """Probabilities (piece x language; a last row of zeros for no piece) and the languages in ascending order."""

    vocabulary: Vocabulary
    probabilities: np.ndarray
    languages: list[str]

    def log_likelihoods(self, words: list[bytes]) -> np.ndarray:
        """By word and language, the logarithm of the sum over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        for places, matrix in _blocks(words):
            sums, scale = forward(self.vocabulary.lookup(matrix), lambda rows: self.probabilities[rows])
            out[places] = scale + np.log(sums[-1])
        return out

    def expected(self, words: list[bytes], times: np.ndarray, language: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words (times each) of each language, over all segmentations by their chance."""
        counts = np.zeros((len(self.vocabulary) + 1, len(self.languages)))
        for places, matrix in _blocks(words):
            edges, own = self.vocabulary.lookup(matrix), language[places]
            chance = lambda rows, own=own: self.probabilities[rows, own]
            before, _ = forward(edges, chance, rescale=False)
            width = matrix.shape[1]
            after: list[np.ndarray] = [np.zeros(len(places))] * width + [np.ones(len(places))]
            weight = np.divide(times[places], before[-1], out=np.zeros(len(places)), where=before[-1] > 0)
            for start in range(width - 1, -1, -1):
                total = np.zeros(len(places))
                for k, rows in edges.items():
                    if start + k <= width:
                        way = chance(rows[:, start]) * after[start + k]
                        np.add.at(counts, (rows[:, start], own), before[start] * way * weight)
                        total += way
                after[start] = total
        return counts[:-1]


def train_language_model(docs: DataFrame, path: str, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Probabilities of the pieces in each language, from about `per_language` texts of each.

    Texts are chosen by a hash of key and text, repeated rows once; a language
    with fewer is learnt from all. Rows without text or language are not learnt
    from. Of more than `LANGUAGES` languages the most frequent are learnt, ties
    by name. Without any row to learn from there are no languages.

    Args:
        path: File of a piece model; its vocabulary is used, not its scores.
        learn: Condition on `k`, the key, under which a row may be learnt from.
    """
    usable = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(learn & F.col("t").isNotNull() & F.col("l").isNotNull())
    sizes = usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()
    languages = sorted(r["l"] for r in sizes)
    vocabulary = Vocabulary(public_pieces(path))
    size = len(vocabulary)
    p = np.vstack([np.full((size, len(languages)), 1 / size), np.zeros((1, len(languages)))])
    if not languages:
        return Model(vocabulary, p, languages)
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["l"], languages.index(r["l"]), min(1.0, per_language / r["n"])) for r in sizes], "l string, language int, share double")
    hashed = usable.join(F.broadcast(shares), "l").withColumn("h", F.xxhash64("k", "t"))
    chosen = hashed.where(F.pmod("h", F.lit(1 << 32)) < F.col("share") * (1 << 32)).dropDuplicates(["l", "h"]).select("language", "t")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for language, text in zip(batch.column("language").to_pylist(), batch.column("t").to_pylist()):
                seen.update((language, w) for w in words_of(text) if len(w.encode()) <= WORD_BYTES)
            keys = list(seen)
            yield pa.RecordBatch.from_pydict(
                {"language": pa.array([k[0] for k in keys], pa.int32()), "word": pa.array([k[1] for k in keys], pa.string()), "n": pa.array(seen.values(), pa.int64())}
            )

    words = cut(chosen.mapInArrow(counted, "language int, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Model(vocabulary, p, languages))

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            counts = np.zeros((len(model.vocabulary), len(model.languages)))
            for batch in batches:
                some = [w.encode() for w in batch.column("word").to_pylist()]
                counts += model.expected(some, batch.column("n").to_numpy().astype(float), batch.column("language").to_numpy())
            piece, language = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "language": pa.array(language, pa.int32()), "n": counts[piece, language]})

        # At most as many rows as the model has probabilities.
        sums = words.mapInArrow(expected, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((size, len(languages)), PRIOR)
        counts[sums["piece"], sums["language"]] += sums["n"]
        p = np.vstack([counts / counts.sum(axis=0), np.zeros((1, len(languages)))])
        shared.unpersist()
    return Model(vocabulary, p, languages)


def _pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of whole texts of about as many characters as a task works on at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size > PIECE:
            yield some
            some, size = [], 0
    if some:
        yield some


def identify_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score.

    `lang_pred` is the language under which the whole text is likeliest, all
    languages being as likely before; of equal ones the first by name. `score`
    is its probability. A text that is null or has no letter has `und` and 0,
    as has any text if no language was learnt. Repeated rows get the same
    result each; an empty table gives no rows. Given columns of these two names
    are replaced, all others are kept.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place: dict[str, int] = {}
        held = np.zeros((0, len(model.languages)))

        def totals(texts: list[str | None]) -> Iterator[np.ndarray | None]:
            nonlocal place, held
            counted = [Counter(words_of(t)) if t and model.languages and any(map(str.isalpha, t)) else None for t in texts]
            wanted = {w for c in counted if c for w in c}
            if len(place) > HELD:
                place, held = {}, held[:0]
            new = [w for w in wanted if w not in place]
            here = place | {w: len(held) + i for i, w in enumerate(new)}
            values = np.concatenate([held, model.log_likelihoods([w.encode() for w in new])])
            for c in counted:
                yield np.fromiter(c.values(), float) @ values[[here[w] for w in c]] if c else None
            # Long words are rarely met again.
            short = [i for i, w in enumerate(new) if len(w) <= WORD_BYTES]
            place.update((new[i], len(held) + k) for k, i in enumerate(short))
            held = np.concatenate([held, values[len(held) :][short]])

        for batch in batches:
            language, score = [], []
            for some in _pieces(batch.column(text).to_pylist()):
                for total in totals(some):
                    if total is None:
                        language.append("und")
                        score.append(0.0)
                    else:
                        best = int(np.argmax(total))
                        language.append(model.languages[best])
                        score.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(language, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(scored, schema)
