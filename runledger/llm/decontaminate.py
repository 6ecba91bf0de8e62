"""Benchmark decontamination by spaced seeds.

Fixed masks pick some words of a window and ignore the others, and are chosen
such that every overlap that is a leak holds one of them, wherever words were
substituted (see `masks_of`). Seeds of the benchmark are joined with those of the
documents; a hit says where an item would lie in a document, and the words are
compared there, one by one, on both sides of the hit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.columns import unused
from runledger.llm.membership import may_hold, membership
from runledger.plans.lineage import cut

WORD = re.compile(r"\w+")
#: Masks for items from so many words on. 1: the word counts; 0: any word may stand there.
#: Found by search; that every leak holds one is shown by enumeration in the tests.
LONG_ITEM_MASKS = ("111011", "1001111", "1110000101")
MASKS = {16: LONG_ITEM_MASKS, 13: (*LONG_ITEM_MASKS, "110010101"), 11: (*LONG_ITEM_MASKS, "110100011", "1110101"), 8: ("11101", "100111", "1101001")}
#: Items of fewer words are looked for as a whole, word for word.
SHORTEST = min(MASKS)
#: No mask is longer.
WIDEST = max(len(m) for masks in MASKS.values() for m in masks)
#: Words of texts that a task looks at together, about; a longer text goes alone.
PIECE = 1 << 18
#: An overlap is a leak from this many equal words on, or this share of the item.
LEAST_WORDS, LEAST_SHARE = 10, 0.6
#: Share of its words that are equal in an overlap, at least: one in four may differ.
LEAST_EQUAL = 0.75
#: Items of fewer words are in texts by chance and by default not looked for; 1 looks for all.
SHORTEST_ITEM = 5

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the words under the mask, at each place where it fits."""
    return seeds_at(words, mask, np.arange(max(0, len(words) - len(mask) + 1)))


def seeds_at(words: np.ndarray, mask: str, at: np.ndarray) -> np.ndarray:
    """The same at some places."""
    out = np.full(len(at), xxhash.xxh3_64_intdigest(mask), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = out * _MULTIPLY + words[at + i]
            out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9) ^ (out >> np.uint64(32))).view(np.int64)


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for batch in batches:
        words = [word_hashes(t, known).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([len(w) for w in words], pa.int32()), pa.array(words, pa.list_(pa.int64()))], ["item_id", "n", "words"])


def masks_of(span: int) -> tuple[str, ...]:
    """The masks an item of `span` words is found by; every overlap that is a leak holds one."""
    return next((masks for least, masks in MASKS.items() if span >= least), ("1" * span,))


def least_equal(span: int) -> int:
    """Equal words from which an overlap with an item of `span` words is a leak."""
    return span if span < SHORTEST else min(LEAST_WORDS, math.ceil(span * LEAST_SHARE))


def widest_overlap(same: np.ndarray) -> tuple[int, int, int]:
    """(begin, length, equal) of the part with most equal words of which at most one in four differs."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    count = np.concatenate([[0], np.cumsum(same)])
    # From each place on, the last one where the sum is no less.
    last = np.searchsorted(-np.maximum.accumulate(total[::-1])[::-1], -total, "right") - 1
    begin = int((count[last] - count).argmax())
    equal = begin + np.flatnonzero(same[begin : last[begin]])
    return (int(equal[0]), int(equal[-1] - equal[0] + 1), len(equal)) if len(equal) else (0, 0, 0)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, item, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for number, n, words in zip(batch.column("item_id").to_pylist(), batch.column("n").to_pylist(), batch.column("words")):
            for mask in masks_of(n):
                found = seeds(words.values.to_numpy().view(np.uint64), mask)
                h.append(found)
                item.append(np.full(len(found), number))
                at.append(np.arange(len(found), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (h, item, at)], ["h", "item_id", "item_at"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best overlap along one alignment: an equal word counts 1, any other costs 3.

    Where that is too short for a leak, a longer one of a lower sum may still be one.
    """
    for batch in batches:
        start, length, equal = [], [], []
        for shift, words, item in zip(batch.column("shift").to_pylist(), batch.column("words"), batch.column("item_words")):
            w, t = words.values.to_numpy(), item.values.to_numpy()
            lo, hi = max(0, -shift), min(len(t), len(w) - shift)
            same = w[lo + shift : hi + shift] == t[lo:hi]
            gain = np.where(same, 1, -3)
            total = np.concatenate([[0], np.cumsum(gain)])
            least = np.minimum.accumulate(total)
            end = int((total - least).argmax())
            begin = int(total[: end + 1].argmin())
            found = (begin, end - begin, int(same[begin:end].sum()))
            if found[2] < least_equal(len(t)):
                found = widest_overlap(same)
            start.append(lo + shift + found[0])
            length.append(found[1])
            equal.append(found[2])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("item_id"), pa.array([int(a + b) for a, b in zip(batch.column("region_at").to_pylist(), start)], pa.int64()), pa.array(length, pa.int32()), pa.array(equal, pa.int32()), pa.array([len(x) for x in batch.column("item_words")], pa.int32())],
            ["row", "item_id", "start_word", "n_words", "equal_words", "item_words"],
        )


def row_hash(key: str, text: str) -> Column:
    """A name for a row: rows of equal key and text are judged alike, so they may share it."""
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shortest_item: int = SHORTEST_ITEM) -> DataFrame:
    """One row for each document row and item that overlap: row (`row_hash` of the document), doc_id, item_id,
    start_word, n_words (of the overlap in the document), equal_words, item_words.

    Of several overlaps of a document with an item the longest is given, the
    first of equal ones. Null texts have no words. Items without an id are not
    looked for. Of an item of fewer than `SHORTEST` words all must be equal, in a
    longer one up to one in four of the overlap may differ. An empty table on either
    side gives no rows. Documents are read whole; what is sent to all tasks are two
    bit arrays of bounded size.
    """
    spark = docs.sparkSession
    listed = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = cut(listed.mapInArrow(_read_items, "item_id long, n int, words array<long>").where(F.col("n") >= max(1, shortest_item)))
    index = cut(items.mapInArrow(_index, "h long, item_id long, item_at int"))
    bounds = items.agg(F.max("n"), F.min("n"), F.collect_set(F.least("n", F.lit(max(MASKS))))).first()
    reach = int(bounds[0] or 0)
    least = min(map(least_equal, range(bounds[1] or 0, max(bounds[1] or 0, SHORTEST) + 1)))
    masks = sorted({m for n in bounds[2] for m in masks_of(n)})
    places = [F.col("h"), F.shiftright("h", 24)]
    words_of = items.select(F.explode("words").alias("h")).distinct()
    shared = spark.sparkContext.broadcast((membership(index, places), membership(words_of, places)))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions of documents with the seeds that may be the benchmark's."""
        known, (bits, word_bits) = _WordHashes(), shared.value

        def regions_of(rows: list[int], docs: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
            """Texts lie in one array, each after a gap that no mask and no region reaches over."""
            gap = np.zeros(reach + WIDEST, np.uint64)
            w = np.concatenate([x for t in texts for x in (gap, t)] + [gap])
            begins = np.cumsum([len(gap) + len(t) for t in texts]) - [len(t) for t in texts]
            signed = w.view(np.int64)
            listed = may_hold(word_bits, signed, signed >> 24) & (w != 0)
            found_at, found_h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for mask in masks:
                # A seed is the benchmark's only if all its words are.
                could = np.ones(max(0, len(w) - len(mask) + 1), bool)
                for i, bit in enumerate(mask):
                    if bit == "1":
                        could &= listed[i : i + len(could)]
                at = np.flatnonzero(could)
                h = seeds_at(w, mask, at)
                held = may_hold(bits, h, h >> 24)
                found_at.append(at[held])
                found_h.append(h[held])
            a, b = np.concatenate(found_at), np.concatenate(found_h)
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            # Hits within an item's length of each other share a region, which holds all they could align.
            text_of = np.searchsorted(begins, a, "right") - 1
            split = np.flatnonzero((np.diff(a) > reach) | (np.diff(text_of) > 0)) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *split], [*split, len(a)]) if len(a) else ():
                k = text_of[lo]
                begin = max(begins[k], a[lo] - reach)
                end = min(begins[k] + len(texts[k]), a[hi - 1] + reach + WIDEST)
                # An overlap has no more equal words than words that any item has.
                if widest_overlap(listed[begin:end])[2] >= least:
                    out.append((rows[k], docs[k], int(begin - begins[k]), signed[begin:end], a[lo:hi] - begins[k], b[lo:hi]))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["row", "doc_id", "region_at", "words", "at", "h"])

        for batch in batches:
            some: tuple[list, list, list] = ([], [], [])
            size = 0
            for row in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for column, value in zip(some, (*row[:2], word_hashes(row[2], known))):
                    column.append(value)
                size += len(some[2][-1])
                if size > PIECE:
                    yield regions_of(*some)
                    some, size = ([], [], []), 0
            if some[0]:
                yield regions_of(*some)

    rows = docs.select(row_hash(key, text).alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    regions = cut(rows.mapInArrow(hits, "row long, doc_id long, region_at long, words array<long>, at array<long>, h array<long>").dropDuplicates(["row", "region_at"]))
    seen = regions.select("row", "region_at", F.explode(F.arrays_zip("at", "h")).alias("hit")).select("row", "region_at", F.col("hit.at").alias("at"), F.col("hit.h").alias("h"))
    aligned = seen.join(index, "h").select("row", "region_at", "item_id", (F.col("at") - F.col("item_at") - F.col("region_at")).alias("shift")).distinct()
    beside = aligned.join(regions.select("row", "region_at", "words"), ["row", "region_at"]).join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
    overlaps = beside.select("row", "item_id", "region_at", "shift", "words", "item_words").mapInArrow(_verify, "row long, item_id long, start_word long, n_words int, equal_words int, item_words int")
    enough = (F.col("equal_words") >= LEAST_WORDS) | (F.col("equal_words") >= F.ceil(F.col("item_words") * LEAST_SHARE))
    leaks = overlaps.where(enough & (F.col("equal_words") >= F.col("n_words") * LEAST_EQUAL))
    best = F.struct("equal_words", (-F.col("start_word")).alias("s"))
    one = leaks.groupBy("row", "item_id").agg(F.max_by(F.struct("start_word", "n_words", "equal_words", "item_words"), best).alias("o"))
    return one.join(regions.select("row", "doc_id").distinct(), "row").select("row", "doc_id", "item_id", "o.*")


def flag_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", shortest_item: int = SHORTEST_ITEM) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_id, start_word, n_words, equal_words.

    The item is the one with most equal words, then the smaller id; where there is
    none, n_items is 0 and the rest null. Null keys and repeated rows have a row each.
    """
    leaks = find_leaks(docs, benchmark, key, text, shortest_item=shortest_item)
    worst = leaks.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_items"), F.max_by(F.struct("item_id", "start_word", "n_words", "equal_words"), F.struct("equal_words", (-F.col("item_id")).alias("i"))).alias("w")
    )
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_hash(key, text).alias("row"))
    return rows.join(worst, "row", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "w.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", shortest_item: int = SHORTEST_ITEM) -> DataFrame:
    """The rows of `docs` that overlap no item, with the columns they have, whatever their names.

    Rows of null or empty text overlap nothing and stay. Repeated rows, and rows
    of one key with different texts, are judged each by its own text. An empty
    table, or an empty benchmark, drops nothing.
    """
    row = unused("row", docs.columns)
    leaks = find_leaks(docs, benchmark, key, text, shortest_item=shortest_item).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_hash(key, text)).join(leaks, row, "left_anti").select(*docs.columns)
