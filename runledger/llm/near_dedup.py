"""Near-duplicate groups by SetSketch registers.

A document is the set of its distinct five-word shingles. Registers are minima
of exponentially distributed values, one value a shingle and register, kept as
truncated logarithms: they merge by their maximum, and two sets agree on a
register about as often as they overlap. Bands of registers name buckets; sets of
one bucket are candidates, a likelihood estimate from the registers sorts out
what cannot be close, and the full sets decide.

No pairs of a group are listed. Equal sets are one class. Every class is first
compared with one hub, the class of its buckets that has most bucket mates; what
this links is contracted. Only buckets that still hold more than one component
are looked at again, and of their pairs only those that could link: by the
estimate and by an exact bound from what both share with a common hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.columns import unused
from runledger.llm.components import components
from runledger.llm.membership import may_hold, membership
from runledger.plans.lineage import cut

WORDS = 5
#: Sets are linked from this overlap on, in hundredths of their union.
PERCENT = 75
#: A pair at the threshold shares none of the bands with a chance of 2 in 100,000.
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Base and rate of the registers.
BASE, RATE = 1.02, 20.0
#: Pairs are verified from this estimate on: 4 standard deviations below the threshold.
LEAST_ESTIMATE = 0.62
#: Members of a bucket that meet in one task.
BLOCK = 1024

_MULTIPLY = (np.random.default_rng(20).integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = np.random.default_rng(21).integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_LOG = np.log(BASE)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    `bytes.split` and `bytes.lower` are the rules: ASCII white space and A-Z.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64) if words else np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    out = h[:n].copy()
    for i in range(1, WORDS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(_mix(out))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(least, (h[i : i + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(x) / _LOG), 0, 65535).astype(np.uint16)


def estimate(equal: np.ndarray, more: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Likeliest overlap of pairs, given how many registers agree and how many are larger in a."""
    u = (sizes_a / (sizes_a + sizes_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG, 1e-12, 1)

    a, b = chance(u - v * j), chance(v - u * j)
    d = equal[:, None]
    m = more[:, None]
    likely = m * np.log(a) + (REGISTERS - d - m) * np.log(b) + d * np.log(np.clip(1 - a - b, 1e-12, 1))
    return np.take_along_axis(j, likely.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for batch in batches:
        size, cls, regs = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text, known)
            size.append(len(s))
            cls.append(_class_of(s))
            regs.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(regs, pa.binary())], ["k", "doc_id", "n", "cls", "regs"])


def _class_of(s: np.ndarray) -> int:
    """A 63-bit name of a set of shingles."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(regs), 1), np.uint64)
        for i in range(ROWS):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, i])
        cls = np.repeat(np.asarray(batch.column("cls")), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(cls), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(regs)))], ["bucket", "cls", "band"])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a set shares with its hub: how much, which of the hub's shingles, and whether that links them."""
    for batch in batches:
        common, linked, bits = [], [], []
        own, hub = batch.column("s"), batch.column("hub_s")
        for i in range(batch.num_rows):
            a, b = own[i].values.to_numpy(), hub[i].values.to_numpy()
            shared = np.isin(b, a, assume_unique=True)
            n = int(shared.sum())
            common.append(n)
            linked.append(100 * n >= PERCENT * (len(a) + len(b) - n))
            bits.append(np.packbits(shared).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("hub"), pa.array(common, pa.int32()), pa.array(linked, pa.bool_()), pa.array(bits, pa.binary())], ["cls", "hub", "common", "linked", "bits"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different components that could link, from rows sorted by bucket and block pair."""
    held: list[pa.RecordBatch] = []
    count = 0

    def work(table: pa.Table) -> pa.RecordBatch:
        get = lambda name: table.column(name).to_numpy()
        run = get("run")
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(run)]]))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        comp, cls, n, band, side, hub, common = (get(c) for c in ("comp", "cls", "n", "band", "side", "hub", "common"))
        bits = [int.from_bytes(x, "big") for x in table.column("bits").to_pylist()]
        found_a, found_b = [], []
        pairs: list[np.ndarray] = []
        waiting = 0

        def decide() -> None:
            nonlocal waiting
            if not pairs:
                return
            both = np.concatenate(pairs, axis=1)
            pairs.clear()
            waiting = 0
            for lo in range(0, both.shape[1], 16384):
                x, y = both[:, lo : lo + 16384]
                same = regs[x] == regs[y]
                shared = same.reshape(-1, BANDS, ROWS).all(axis=2)
                first = shared.argmax(axis=1) == band[x]  # another bucket has the pair otherwise
                x, y, same = x[first], y[first], same[first]
                close = estimate(same.sum(axis=1), (regs[x] > regs[y]).sum(axis=1), n[x].astype(float), n[y].astype(float)) >= LEAST_ESTIMATE
                x, y = x[close], y[close]
                for i, j in zip(x.tolist(), y.tolist()):
                    if hub[i] == hub[j]:
                        # Shared shingles are shared with the hub, or outside it on both sides.
                        most = (bits[i] & bits[j]).bit_count() + min(n[i] - common[i], n[j] - common[j])
                        if 100 * most < PERCENT * (n[i] + n[j] - most):
                            continue
                    found_a.append(cls[i])
                    found_b.append(cls[j])

        for lo, length in zip(starts.tolist(), lengths.tolist()):
            own = slice(lo, lo + length)
            left = np.flatnonzero(side[own] != 2) + lo
            right = np.flatnonzero(side[own] != 1) + lo
            step = max(1, 400_000 // max(1, len(right)))
            for i in range(0, len(left), step):
                x, y = (z.ravel() for z in np.meshgrid(left[i : i + step], right, indexing="ij"))
                near = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])) & ((side[own][0] != 0) | (x < y))
                pairs.append(np.stack([x[near], y[near]]))
                waiting += int(near.sum())
                if waiting > 100_000:
                    decide()
        decide()
        return pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    def ready(last: bool) -> pa.Table | None:
        """Whole runs only: what may go on in the next batch is held back."""
        nonlocal held, count
        if not held:
            return None
        table = pa.Table.from_batches(held)
        run = table.column("run").to_numpy()
        end = len(run)
        if not last:
            change = np.flatnonzero(run[1:] != run[:-1])
            end = int(change[-1]) + 1 if len(change) else 0
        held = table.slice(end).to_batches()
        count = table.num_rows - end
        return table.slice(0, end) if end else None

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= 4 * BLOCK:
            table = ready(False)
            if table is not None:
                yield work(table)
    table = ready(True)
    if table is not None:
        yield work(table)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, row_key, root.

    component_id is the smallest doc_id that links lead to, kept whether that is
    the row's own. A null or empty text, or one of white space, has no shingles
    and is linked with nothing. Rows that repeat a doc_id each have a row. A row
    without doc_id takes part, but does not name a component; its component_id is
    null where no member has an id, and it is kept then only. Other columns are
    not read. An empty table gives no rows. Texts are read whole. row_key is the
    row's `row_key`, root names the component for rows with and without ids.
    """
    spark = docs.sparkSession
    rows = docs.select(row_key(key, text).alias("k"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = cut(rows.mapInArrow(_sketch, "k long, doc_id long, n long, cls long, regs binary"))
    classes = cut(sketched.where("n > 0").groupBy("cls").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("regs").alias("regs")))

    bands = classes.select("cls", "regs").mapInArrow(_bands, "bucket long, cls long, band int")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1")
    members = cut(bands.join(shared, "bucket"))
    hubs = _hubs(members)

    # Full sets of the classes that have bucket mates, from the text of one document of each.
    wanted = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("k")
    bits = spark.sparkContext.broadcast(membership(wanted, [F.xxhash64("k")]))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = _WordHashes(), bits.value
        for batch in batches:
            keep = np.flatnonzero(may_hold(words, np.asarray(batch.column("place"))))
            sets = [shingles(t, known) for t in batch.column("text").take(pa.array(keep)).to_pylist()]
            cls = [_class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cls", "s"])

    placed = rows.select(F.xxhash64("k").alias("place"), "text")
    sets = cut(placed.mapInArrow(filtered, "cls long, s array<long>").dropDuplicates(["cls"]))

    spokes = hubs.where("cls <> hub").join(sets, "cls").join(sets.select(F.col("cls").alias("hub"), F.col("s").alias("hub_s")), "hub")
    profiles = cut(spokes.mapInArrow(_profiles, "cls long, hub long, common int, linked boolean, bits binary"))
    linked = profiles.where("linked").select("cls", "hub")
    # Two steps along the links: enough to see which buckets are settled, the rest is done at the end.
    step = linked.select("cls", F.col("hub").alias("to"))
    partly = step.join(step.select(F.col("cls").alias("to"), F.col("to").alias("next")), "to", "left").select("cls", F.coalesce("next", "to").alias("comp"))
    found = members.join(cut(partly), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    found = cut(found.select("bucket", "cls", "band", "comp", "mates"))
    open_buckets = found.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    contested = cut(found.join(open_buckets, "bucket", "left_semi"))
    own = contested.select("cls").distinct()
    about = classes.join(own, "cls", "left_semi").join(profiles.drop("linked"), "cls", "left")
    about = about.select("cls", "n", "regs", F.coalesce("hub", "cls").alias("hub"), F.coalesce("common", F.lit(0)).alias("common"), F.coalesce("bits", F.lit(b"")).alias("bits"))
    dealt = _deal(contested).join(about, "cls").repartition("run").sortWithinPartitions("run")
    pairs = cut(dealt.mapInArrow(_candidates, "a long, b long"))
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a")
    verified = left.join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    more = verified.select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb")).alias("both")).where(F.col("i") * 100 >= (F.col("both") - F.col("i")) * PERCENT)

    roots = components(linked.select(F.col("cls").alias("a"), F.col("hub").alias("b")).unionAll(more.select("a", "b")))
    named = sketched.where("n > 0").select("doc_id", "n", "k", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = cut(named.select("doc_id", "n", "k", F.coalesce("root", "cls").alias("root")))
    # Written, so that the join has two plain exchanges and a very large component's side is split.
    least = cut(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    full = named.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("k").alias("row_key"), "root")
    # Names of components are not negative, so what is linked with nothing has names of its own below.
    alone = (-1 - F.shiftrightunsigned(F.xxhash64("k"), 1)).alias("root")
    empty = sketched.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("k").alias("row_key"), alone)
    return full.unionAll(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def row_key(key: str, text: str) -> Column:
    """A hash of the id and the text of a row: only rows that repeat both share it."""
    return F.xxhash64(F.coalesce(F.col(key).cast("long").cast("string"), F.lit("none")), F.col(text), F.col(text).isNull())


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without near duplicates: of each group the one with the smallest id, rows without
    one last; of rows that repeat an id and a text, one. Different texts of one id are
    told apart. Columns are those of `docs`."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    stay = near_groups(docs, key, text).groupBy("root").agg(F.min(first).alias("first"))
    named = [unused("id", docs.columns), unused("key", docs.columns)]  # both, so that texts of different ids never meet by a hash
    stay = stay.select(F.coalesce("first.doc_id", F.lit(0)).alias(named[0]), F.col("first.row_key").alias(named[1])).distinct()
    own = docs.withColumns({named[0]: F.coalesce(F.col(key).cast("long"), F.lit(0)), named[1]: row_key(key, text)})
    return own.join(stay, named, "left_semi").dropDuplicates(named).select(*docs.columns)


def _hubs(members: DataFrame) -> DataFrame:
    """(cls, hub): the class with most bucket mates among those a class shares a bucket with, itself included."""
    degree = cut(members.groupBy("cls").agg(F.sum("mates").alias("degree")))
    rank: Column = F.struct(F.col("degree"), F.col("cls"))
    ranked = cut(members.select("bucket", "cls").join(degree, "cls").groupBy("bucket").agg(F.max(rank).alias("top")))
    return cut(members.select("bucket", "cls").join(ranked, "bucket").groupBy("cls").agg(F.max("top").alias("top")).select("cls", F.col("top.cls").alias("hub")))


def _deal(contested: DataFrame) -> DataFrame:
    """Rows with `run` and `side`: members of a bucket meet in tasks of two blocks at most.

    A bucket of one block is a run of its own, side 0. Of a larger one every two
    blocks make a run of sides 1 and 2, and every block one of its own.
    """
    blocks = F.ceil(F.col("mates") / BLOCK).cast("int")
    row = contested.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    other = row.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return other.select("cls", "comp", "band", F.xxhash64("bucket", lo, hi).alias("run"), side.cast("int").alias("side"))
