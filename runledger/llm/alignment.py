"""Alignment of two tokenizers over a corpus, with a fast path for equal tokens.

Byte offsets where tokens of both end cut a text into groups. A group of one
token on either side has the same bytes, so one array from A's ids to the B ids
of equal bytes recognises it: such groups are counted in vectors as long as A's
vocabulary. The last tokens of all other groups are pairs that meet in a
shuffle. Texts are encoded once; a second pass over the written links looks up
what they count in the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.tokens import _least_of_most
from runledger.plans.lineage import cut

#: Irregular pairs that all tasks hold: a bound that does not grow. Rarer ones meet their counts in a shuffle.
HEAD = 1 << 17
#: Characters that a task encodes at a time (a longer text goes alone), and distinct pairs it holds.
PIECE, HELD = 1 << 19, 1 << 18
LINKED = "doc_id long, rid long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, same array<int>, pairs array<long>, vector array<long>, pair long, n long"
COUNTS = "doc_id long, rid long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, n_best long, count_sum long, pair long, times long"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _arrow(schema: str) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of some columns of a schema; the others are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


@dataclass
class Alignment:
    """What `align` finds.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
        groups_sha256 and, if asked for, groups (text).
    pairs: (a, b, links, best): how many links of the corpus hold the ids, and
        whether no other A id has more with this B id.
    """

    documents: DataFrame
    pairs: DataFrame


def visible_bytes() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if it is printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Groups:
    """Groups of some texts: one entry a text, and the links of all in order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    listed: list[str]
    a: np.ndarray
    b: np.ndarray
    same: np.ndarray


class Aligner:
    """Both tokenizers in one task, and the map from A's ids to the B ids of equal bytes (-1 if there is none)."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        with open(path_a) as f:
            described = json.load(f)
        shown, vocabulary = visible_bytes(), described["model"]["vocab"]
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        tokens = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.encode_a = _by_ranks(described, tokens) or _by_library(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, i in tokens.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        # Of pieces with equal bytes the last: plain ones follow bytes and control pieces.
        of_bytes = {t: i for i, t in enumerate(self.bytes_b)}
        self.same = np.array([of_bytes.get(t, -1) if t else -1 for t in self.bytes_a])
        self.length_a, self.length_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        #: An id as it is written before a comma, and before what ends a side, a group and a text.
        self.written = [np.array([f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object) for end in (",", "|", ";", "\n")]

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text; none of one that is null, empty or not given back byte by byte."""
        spaced = [" " + t if t else "" for t in texts]
        a, b = self.encode_a(spaced), self.b.encode([t or "" for t in texts], num_threads=1)
        for i, text in enumerate(spaced):
            whole = text.encode()
            if b"".join([self.bytes_a[t] for t in a[i]]) != whole or b"".join([self.bytes_b[t] for t in b[i]]) != whole:
                a[i], b[i] = [], []
        return a, b

    def groups(self, texts: list[str | None]) -> Groups:
        ids_a, ids_b = self.encode(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        # Both sides of a text have the same bytes, so offsets in all texts joined do as well as those in each.
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        linked_a, linked_b = a[last_a], b[last_b]
        same = (np.bincount(group_a, minlength=len(linked_a)) == 1) & (np.bincount(group_b, minlength=len(linked_a)) == 1) & (self.same[linked_a] == linked_b)
        before = np.concatenate([[0], np.cumsum(last_a)])
        stops = np.cumsum(n_a)
        n_groups = before[stops] - before[stops - n_a]
        # Written down: the A ids of a group, then its B ids.
        mark_b = np.where(last_b, 2, 0)
        mark_b[np.cumsum(n_b)[n_b > 0] - 1] = 3
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids, marks = np.concatenate([a, b])[order], np.concatenate([last_a.astype(np.int64), mark_b])[order]
        words = np.empty(len(ids), object)
        for mark, written in enumerate(self.written):
            at = marks == mark
            words[at] = written[ids[at]]
        listed = iter("".join(words.tolist()).split("\n"))
        return Groups(n_a, n_b, n_groups, [next(listed) if n else "" for n in n_a.tolist()], linked_a, linked_b, same)


def _by_ranks(described: dict, tokens: dict[bytes, int]) -> Callable[[list[str]], list[list[int]]] | None:
    """An encoder by ranks, several times as fast, for a vocabulary whose ids follow its merges and that splits words in the usual way."""
    import public_tokenizers
    from tiktoken import Encoding

    model, split = described["model"], described.get("pre_tokenizer") or {}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if described.get("normalizer") or not usual or merged != sorted(merged) or len(tokens) != 256 + len(merged) or model.get("ignore_merges"):
        return None
    encoding = Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={})
    return lambda texts: [encoding.encode_ordinary(t) for t in texts]


def _by_library(path: str) -> Callable[[list[str]], list[list[int]]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of whole texts of about as many characters as a task encodes at a time."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > PIECE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", with_groups: bool = False, head: int = HEAD) -> Alignment:
    """Links between the tokens of two tokenizers in every text, and their counts over the corpus.

    A encodes a space and the text, B the text, before which it puts a space
    itself; special strings in a text are text. Offsets where an A and a B token
    both end cut the tokens into groups. The A and B token that end there are a
    link. A text that is null or empty, or that a tokenizer does not give back
    byte by byte, has no tokens: its numbers are 0 and its groups ''. Null and
    repeated keys keep a row each; other columns are not read. Equal counts are
    best together. An empty table gives no rows. Texts of any length are aligned
    whole.

    Args:
        path_a: A byte-level BPE (JSON of `tokenizers`) without a normalizer.
        path_b: A piece model that leaves texts as they are and falls back to
            bytes. Every executor has both files.
        with_groups: Also return the groups as text.
        head: How many irregular pairs all tasks hold.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    linked_schema, counts_schema = _arrow(LINKED), _arrow(COUNTS)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each document with its links, partial counts of irregular pairs, and one vector of the equal ones."""
        aligner = Aligner(path_a, path_b)
        vector, pairs, times = np.zeros(len(aligner.same), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in _pieces(texts):
                found = aligner.groups(texts[start:stop])
                irregular = found.a[~found.same] * len(aligner.bytes_b) + found.b[~found.same]
                vector += np.bincount(found.a[found.same], minlength=len(vector))
                here, n = np.unique(irregular, return_counts=True)
                pairs, place = np.unique(np.concatenate([pairs, here]), return_inverse=True)
                times = np.bincount(place, np.concatenate([times, n]), len(pairs)).astype(np.int64)
                if len(pairs) > HELD:
                    yield _rows(linked_schema, pair=pairs, n=times)
                    pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
                # Links of a text lie side by side, so the place of its first one in either list is a count.
                stops = np.concatenate([[0], np.cumsum(found.n_groups)])
                same_at = np.concatenate([[0], np.cumsum(found.same)])[stops]
                yield _rows(
                    linked_schema,
                    doc_id=batch.column("doc_id")[start:stop],
                    rid=batch.column("rid")[start:stop],
                    n_a=found.n_a,
                    n_b=found.n_b,
                    n_groups=found.n_groups,
                    groups_sha256=[hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.listed],
                    **({"groups": found.listed} if with_groups else {}),
                    same=pa.ListArray.from_arrays(pa.array(same_at, pa.int32()), pa.array(found.a[found.same], pa.int32())),
                    pairs=pa.ListArray.from_arrays(pa.array(stops - same_at, pa.int32()), pa.array(irregular)),
                )
        yield _rows(linked_schema, pair=pairs, n=times)
        yield _rows(linked_schema, vector=[vector.tolist()])

    aligner = Aligner(path_a, path_b)
    size_b, same = len(aligner.bytes_b), aligner.same
    parts = cut(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(linked, LINKED))
    # At most as many rows as A has ids.
    sums = parts.where("vector is not null").select(F.posexplode("vector").alias("a", "n")).where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).collect()
    vector = np.zeros(len(same), np.int64)
    vector[[r["a"] for r in sums]] = [r["n"] for r in sums]
    pairs = cut(parts.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")))
    # At most as many rows as B has ids.
    most = np.zeros(size_b, np.int64)
    np.maximum.at(most, same[same >= 0], vector[same >= 0])
    for r in pairs.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("n")).collect():
        most[r["b"]] = max(most[r["b"]], r["n"])
    frequent = pairs.where(F.col("n") >= _least_of_most(pairs, head)).orderBy("pair").toPandas()
    shared = spark.sparkContext.broadcast((vector, (same >= 0) & (vector == most[same]), most, frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each document with what its equal links and frequent pairs add, and one for each of its other pairs."""
        vector, best, most, known, links = shared.value

        def per_row(lists: pa.ListArray, *values: np.ndarray) -> list[np.ndarray]:
            """Sums of the values of each row's entries."""
            stops = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            return [np.diff(np.concatenate([[0], np.cumsum(v)])[stops]).astype(np.int64) for v in values]

        for batch in batches:
            same, pairs = batch.column("same"), batch.column("pairs")
            ids, codes = same.flatten().to_numpy(zero_copy_only=False), pairs.flatten().to_numpy(zero_copy_only=False)
            total, n_best = per_row(same, vector[ids], best[ids])
            place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            held = known[place] == codes if len(known) else np.zeros(len(codes), bool)
            n = np.where(held, links[place] if len(known) else 0, 0)
            more, more_best = per_row(pairs, n, held & (n == most[codes % len(most)]))
            rid = batch.column("rid").to_numpy()
            own = {c: batch.column(c) for c in ("doc_id", "rid", "n_a", "n_b", "n_groups", "groups_sha256", "groups")}
            yield _rows(counts_schema, **own, n_best=n_best + more_best, count_sum=total + more, pair=-1 - rid, times=np.zeros(len(rid), np.int64))
            # What the task has no count of, one row for each pair of a document.
            of_row = np.repeat(rid, np.diff(pairs.offsets.to_numpy()))[~held]
            open_pairs, times = np.unique(np.stack([of_row, codes[~held]]), axis=1, return_counts=True)
            yield _rows(counts_schema, rid=open_pairs[0], pair=open_pairs[1], times=times)

    numbered = parts.where("rid is not null").drop("vector", "pair", "n").mapInArrow(looked_up, COUNTS)
    maxima = spark.createDataFrame([(i, int(n)) for i, n in enumerate(most) if n], "b int, most long")
    rated = pairs.join(maxima, F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    documents = (
        numbered.join(rated, "pair", "left")
        .groupBy("rid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")],
            F.sum("n_groups").alias("n_links"),
            F.sum(F.coalesce("n_best", F.lit(0)) + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.coalesce("count_sum", F.lit(0)) + F.col("times") * F.coalesce("n", F.lit(0))).alias("count_sum"),
            F.max("groups_sha256").alias("groups_sha256"),
            *([F.max("groups").alias("groups")] if with_groups else []),
        )
        .drop("rid")
    )
    equal = spark.createDataFrame([(int(i), int(same[i]), int(vector[i]), bool(vector[i] == most[same[i]])) for i in np.flatnonzero(vector)], "a int, b int, links long, best boolean")
    others = rated.select(F.floor(F.col("pair") / size_b).cast("int").alias("a"), (F.col("pair") % size_b).cast("int").alias("b"), F.col("n").alias("links"), "best")
    return Alignment(documents, equal.unionAll(others))
