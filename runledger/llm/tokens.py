"""Token counts from distinct pre-tokens.

The library's pieces never span a place where a space follows something else,
so a text's tokens are the sum of those of its pre-tokens: a run of spaces with
what follows it. Each distinct pre-token of the corpus is encoded once; the
counts are joined to the frequencies per document and added up, and no list of
ids is kept. The join splits by frequency: a fixed number of the most frequent
pre-tokens, none of them long, is sent to all tasks; the others meet their counts
in a shuffle, where none of them can be hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.plans.lineage import cut

#: The most frequent pre-tokens that all tasks hold: a bound that does not grow.
HEAD = 1 << 17
#: Longer pre-tokens, such as texts without blanks, are counted where they are: they seldom repeat, and none is held or shuffled.
LONGEST = 64
#: Distinct pre-tokens a task holds before it passes their counts on.
HELD = 1 << 18
PARTS = pa.schema([("rid", pa.int64()), ("token", pa.string()), ("times", pa.int64()), ("base", pa.int64()), ("n_bytes", pa.int64()), ("doc_id", pa.int64())])
#: A space, as the library sees it, is a blank or the mark it writes for one.
PRE_TOKEN = re.compile("[ ▁]+[^ ▁]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens in order; the library puts a space before a text that is not empty."""
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


def piece_counter(model: str):
    """A function from pre-tokens to how many pieces each has.

    A letter goes before the pre-token, so that the library's own leading space
    does not touch it; no piece joins the two.
    """
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=model)
    alone = len(processor.encode("a"))

    def count(tokens: list[str]) -> list[int]:
        return [len(ids) - alone for ids in processor.encode(["a" + t for t in tokens], num_threads=1)]

    return count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (token, n)."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])
        seen.clear()
        return rows

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                seen.update(t for t in pre_tokens(text) if len(t) <= LONGEST)
            if len(seen) > HELD:
                yield flush()
    yield flush()


def _least_of_most(counts: DataFrame, most: int) -> int:
    """A count that no more than `most` rows reach, by a histogram of a few hundred classes of n."""
    level = F.floor(F.log2("n") * 8)
    reached, least = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        reached += row["rows"]
        if reached > most:
            break
        least = row["n"]
    return (1 << 62) if least is None else least


def token_counts(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Counts are those of the library for `model` without begin or end tokens,
    its special strings in a text being text. A null text counts as empty: 0
    tokens. Null and repeated keys keep a row each. Other columns are not read.
    An empty table gives no rows. A text of any length is counted whole.

    Args:
        model: Path of a piece model that leaves texts as they are and has no
            piece with a space after something else; every executor has it.
        head: How many pre-tokens all tasks hold.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(model)
        for batch in batches:
            yield batch.append_column("pieces", pa.array(count(batch.column("token").to_pylist()), pa.int32()))

    distinct = rows.select("text").mapInArrow(_frequencies, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pieces = cut(distinct.mapInArrow(counted, "token string, n long, pieces int"))
    frequent = pieces.where(F.col("n") >= _least_of_most(pieces, head)).select("token", "pieces").toPandas()
    shared = spark.sparkContext.broadcast(dict(zip(frequent["token"], frequent["pieces"].tolist())))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row of a document's own, and one for each pre-token the task has no count of."""
        known, count = shared.value, piece_counter(model)
        for batch in batches:
            rid, token, times, base, size = [], [], [], [], []
            rows = batch.column("rid").to_pylist()
            for row, text in zip(rows, batch.column("text").to_pylist()):
                text = text or ""
                total = 0
                for t, n in Counter(pre_tokens(text)).items():
                    k = count([t])[0] if len(t) > LONGEST else known.get(t)
                    if k is None:
                        rid.append(row)
                        token.append(t)
                        times.append(n)
                    else:
                        total += n * k
                base.append(total)
                size.append(len(text.encode()))
            # A document's own row has a key that no pre-token has: they begin with a space.
            own = [f"#{r}" for r in rows]
            yield pa.RecordBatch.from_pydict({"rid": rows, "token": own, "times": [0] * len(own), "base": base, "n_bytes": size, "doc_id": batch.column("doc_id")}, PARTS)
            if rid:
                none = [None] * len(rid)
                yield pa.RecordBatch.from_pydict({"rid": rid, "token": token, "times": times, "base": [0] * len(rid), "n_bytes": none, "doc_id": none}, PARTS)

    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    parts = numbered.mapInArrow(summed, "rid long, token string, times long, base long, n_bytes long, doc_id long")
    joined = parts.join(pieces.select("token", "pieces"), "token", "left")
    per_row = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("base") + F.col("times") * F.coalesce("pieces", F.lit(0))).alias("n_tokens")
    )
    return per_row.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
