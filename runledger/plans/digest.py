"""Digests of rows and of groups of rows.

A group digest never collects its group. Each entry is hashed with SHA-256,
the first 36 hex digits are read as six 24-bit numbers, and the group keeps
the count and the six sums. Sums are combined map-side, do not depend on row
order, and leave room for 2**39 entries per group before a BIGINT overflows.
Order matters only if the entry itself carries its position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separator and the null token of the canonical encoding. A
# present field starts with its length, so the token cannot be mistaken for one.
SEPARATOR = "\x1f"
NULL_TOKEN = "-"

WORDS = 6
WORD_BITS = 24


def encode(*cols: Column | str) -> Column:
    """Fields joined by the unit separator, nulls as an explicit token.

    A field is prefixed with its length, so no value can imitate a boundary.
    """
    parts = []
    for c in cols:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(NULL_TOKEN)))
    return F.concat_ws(SEPARATOR, *parts)


def row_digest(*cols: Column | str) -> Column:
    """SHA-256 (hex) of the encoded fields."""
    return F.sha2(encode(*cols), 256)


def hash_words(hashed: Column) -> list[Column]:
    """The numbers of one SHA-256 that a group digest sums; two are read at a time."""
    words = []
    for pair in range(WORDS // 2):
        both = F.conv(F.substring(hashed, 1 + 12 * pair, 12), 16, 10).cast("bigint")
        words += [F.shiftright(both, WORD_BITS), both.bitwiseAND((1 << WORD_BITS) - 1)]
    return words


def digest_of_sums(count: Column, sums: Sequence[Column]) -> Column:
    """The digest of a group whose entries and words have been added up."""
    return F.sha2(F.concat_ws(SEPARATOR, count.cast("string"), *[F.coalesce(s, F.lit(0)).cast("string") for s in sums]), 256)


def group_digest(entry: Column) -> Column:
    """Aggregate: order-free digest of the encoded entries of a group."""
    hashed = F.sha2(entry, 256)
    return digest_of_sums(F.count(hashed), [F.sum(w) for w in hash_words(hashed)])


# What a SHA-256 in hexadecimal digits looks like.
HEX_DIGEST = "^[0-9a-f]{64}$"


def pack(text: Column) -> Column:
    """A text in fewer bytes where it is a digest, for tables that are moved whole; `unpack` gives it back."""
    digest = text.rlike(HEX_DIGEST)
    return F.struct(F.when(digest, F.unhex(text)).alias("bytes"), F.when(~digest, text).alias("text"))


def unpack(packed: Column) -> Column:
    """The text that `pack` was given."""
    return F.coalesce(F.lower(F.hex(packed["bytes"])), packed["text"])
