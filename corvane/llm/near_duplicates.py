"""Near-duplicate documents by SetSketch registers.

A document's set is that of its distinct word shingles. It's sketched by exponentially spaced truncated minima: register
i holds clip(floor(1 - log_b(min of the shingles' i-th exponential hash))). Registers are mergeable by maximum and, base
b being near 1, equal with a probability near the Jaccard similarity. Eight registers make a band, held as one long.

1. Equal sets are one class (a digest of the set), so copies are never compared with each other.
2. Classes that share a band's value are candidates: first each with the cell's least class, its hub. The likelihood of
   the registers' order, given both cardinalities, estimates the similarity; what it can't rule out is confirmed on the
   full sets, exactly.
3. Confirmed links are closed to components. Cells whose members are then in more than one component are gone through
   again with full sets. First, the shingles that stand in one such class alone are counted: they bound what the class can
   share with any other, and so the sizes that a similar one may have. A class that is left no size is done; two classes
   that could only link with smaller ones can't link with each other, so "light" classes (none as large as themselves)
   never meet. Texts that share boilerplate, but less than the threshold, end here, without a pair. What remains meets in
   its cells: of two sets so similar, each has one of the other's among its rarest shingles, early enough in both that
   enough can follow; a pair is compared in the first cell that it shares, unless it's connected already. A cell
   gives the links that connect it and no more. So every candidate pair is tested, ruled out by these bounds, or already
   connected, without all pairs of a group being made. Cells of more than CELL_BYTES are dealt out in blocks.

Bands follow from the threshold: so many that a pair just at it shares none with a chance of MISS.

Only cell keys and class numbers move for the candidate search; full sets are made again from the texts of the classes
in question alone, found by a bitmap over their ids of 32 MB at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, small
from .components import components

ROWS, BASE = 8, 1.1
#: Chance that two equally large sets just at the threshold share no band.
MISS = 2e-5
SIGMAS = 5.0
CELL_BYTES = 8 << 20
#: Largest bitmap over ids, in bits: beyond some 16 million wanted ids, more texts are read than needed, with the same result.
BITMAP_BITS = 28


def _odd(seed: int, n: int, bits: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << bits, n, dtype=np.uint64) | np.uint64(1)


def finish(h: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sets of whole texts: sorted distinct 64-bit hashes of ``width`` words in a row."""

    def __init__(self, width: int = 5, most: int = 150_000):
        import xxhash

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= most:
                    self.clear()
                found = self[word] = xxhash.xxh3_64_intdigest(word)
                return found

        self.words, self.width, self.by = Words(), width, _odd(5, width, 63)

    def set_of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: lowers A-Z alone, splits at ASCII white space alone
        n, w = len(words), self.width
        if not n:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        if n < w:
            total = np.full(1, n, np.uint64)
            for k in range(n):
                total = finish(total * self.by[k] + hashes[k : k + 1])
            return total
        total = hashes[: n - w + 1] * self.by[0]
        for k in range(1, w):
            total = total + hashes[k : n - w + 1 + k] * self.by[k]
        return np.unique(finish(total))


class Sketcher:
    def __init__(self, registers: int, base: float = BASE):
        self.a, self.b = (_odd(seed, registers, 32).astype(np.uint32) for seed in (11, 12))
        self.log, self.registers = math.log(base), registers

    def least(self, hashes: np.ndarray) -> np.ndarray:
        low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        found = np.full(self.registers, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(hashes), 2048):
            block = low[k : k + 2048, None] * self.a + high[k : k + 2048, None] * self.b
            np.minimum(found, block.min(0), out=found)
        return found

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        uniform = (self.least(hashes).astype(np.float64) + 0.5) / 2.0**32
        return np.clip(np.floor(1 - np.log(-np.log1p(-uniform)) / self.log), 0, 255).astype(np.uint8)


def _p(x: np.ndarray, base: float) -> np.ndarray:
    return -np.log1p(-x * (base - 1) / base) / math.log(base)


def likeliest(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float = BASE, steps: int = 200) -> np.ndarray:
    """The Jaccard similarity under which so many registers of a are above, below and equal to b's, jointly with the cardinalities."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for j in np.arange(steps + 1) / steps:
        a, b = u - v * j, v - u * j
        fits = (a >= -1e-12) & (b >= -1e-12)
        p, q = _p(np.maximum(a, 1e-9), base), _p(np.maximum(b, 1e-9), base)
        value = np.where(fits, more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12)), -np.inf)
        at = np.where(value > best, j, at)
        best = np.maximum(best, value)
    return at


def registers_for(threshold: Fraction, base: float = BASE) -> int:
    """Registers of all bands: two registers are equal with probability 1 - 2 p((1 - j) / 2), bands with its ROWS-th power."""
    equal = 1 - 2 * float(_p(np.array([(1 - float(threshold)) / 2]), base)[0])
    return ROWS * (math.ceil(math.log(MISS) / math.log(1 - equal**ROWS)) if equal < 1 else 1)


def sketches(docs: DataFrame, width: int = 5, registers: int = 256) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (null for an empty set) and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher = Shingler(width), Sketcher(registers)
        for batch in batches:
            sizes, digests, bands = [], [], []
            for value in batch.column(1):
                found = shingler.set_of(value.as_py())
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                bands.append(sketcher.sketch(found).view("<i8") if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "digest", "sketch"])

    return lean(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, sketch array<long>")


def _bits(ids: DataFrame, n: int) -> tuple[int, dict[int, bytes]]:
    """A bitmap over hashes of ids, in 4 KB pieces: at most 2 ** BITMAP_BITS bits, 16 for each id below that."""
    size = 1 << min(BITMAP_BITS, max(15, math.ceil(math.log2(16 * max(1, n)))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size)) + 1
    pieces = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    return size, {int(k): bytes(b) for k, b in pieces.collect()}


def full_sets(docs: DataFrame, wanted: DataFrame, width: int = 5) -> DataFrame:
    """(cid, members) of the wanted classes (cid, doc_id, digest): their sets' hashes as bytes, made from their texts."""
    spark = docs.sparkSession
    size, pieces = _bits(wanted, wanted.count())
    held = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bits = Shingler(width), held.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            digests, sets = [], []
            for row, p in enumerate(place.tolist()):
                piece = bits.get(p // 32768 + 1)
                if piece and piece[p % 32768 // 8] >> (p % 8) & 1:
                    found = shingler.set_of(batch.column(1)[row].as_py()).tobytes()
                    digests.append(hashlib.blake2b(found, digest_size=16).digest())
                    sets.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "members"])

    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").select("doc_id", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(size))).alias("place"))
    made = rows.mapInArrow(run, "digest binary, members binary")
    return made.join(wanted.select("cid", "digest"), "digest").dropDuplicates(["cid"]).select("cid", "members")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """Those of the candidate pairs (a, b) whose full sets are as similar as the threshold."""
    spare = float(threshold) - SIGMAS * math.sqrt(float(threshold) * (1 - float(threshold)) / registers_for(threshold))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(i).flatten().to_numpy().astype("<i8").view(np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
                more, less = (x > y).sum(1), (x < y).sum(1)
                found = likeliest(more, less, x.shape[1] - more - less, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
                yield batch.select([0, 1]).filter(pa.array(found >= spare))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (p, q))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * threshold.denominator >= threshold.numerator * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: classes.select(F.col("cid").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    seen = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    seen = materialize(seen.mapInArrow(likely, "a long, b long"), "pairs-likely")
    wanted = materialize(classes.join(seen.select(F.col("a").alias("cid")).union(seen.select("b")).distinct(), "cid").select("cid", "doc_id", "digest"), "pairs-wanted")
    sets = materialize(full_sets(docs, wanted, width), "pairs-sets")
    near = lambda k: sets.select(F.col("cid").alias(k), F.col("members").alias(f"m_{k}"))
    return materialize(seen.join(near("a"), "a").join(near("b"), "b").select("a", "b", "m_a", "m_b").mapInArrow(exact, "a long, b long"), "pairs-confirmed")


def cell_links(sets: list[np.ndarray], labels: list[int], threshold: Fraction, most: list[int] | None = None, sides: list[int] | None = None, apart=None) -> list[tuple[int, int]]:
    """Pairs of members (places in the list) that are as similar as the threshold, enough of them to connect all that are linked.

    Members of one label are connected already. most: the largest set that each can link with; sides: only members of
    different sides meet; apart(i, j): pairs that are settled elsewhere. Exact: ordered by their frequency in the cell, then
    by value, two sets that share the threshold's part of their union share one of each's first n - ceil(threshold * n) + 1,
    and from the first one that they share, enough of both must be left for all that they must share.
    """
    num, den = threshold.numerator, threshold.denominator
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while group.setdefault(x, x) != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(np.lexsort((values, counts)))
    several = counts > 1
    at = np.cumsum([0, *map(len, sets)])
    seen: dict[int, dict[int, list[tuple[int, int]]]] = {}  # by shingle, then by label: members of one's own label aren't looked at
    found = []
    for i in sorted(range(len(sets)), key=lambda k: (len(sets[k]), k)):
        n = len(sets[i])
        own = inverse[at[i] : at[i + 1]]
        first = n - -(-num * n // den) + 1
        alone = n - int(several[own].sum())  # these come first and meet nobody
        ranks = order[own]
        prefix = np.sort(np.partition(ranks, first - 1)[:first] if first < n else ranks).tolist()
        shared = list(enumerate(prefix))[alone:]
        near: set[int] = set()
        for place, r in shared:
            for label, members in seen.get(r, {}).items():
                if root(label) == root(labels[i]):
                    continue
                for j, where in members:
                    m = len(sets[j])
                    if m * den >= num * n and min(n - place, m - where) * (num + den) >= num * (n + m) and (not most or (most[i] >= m and most[j] >= n)):
                        near.add(j)
        for j in sorted(near):
            if (sides and sides[i] == sides[j]) or root(labels[i]) == root(labels[j]) or (apart and apart(i, j)):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * den >= num * (n + len(sets[j]) - both):
                group[root(labels[i])] = root(labels[j])
                found.append((j, i))
        for place, r in shared:
            seen.setdefault(r, {}).setdefault(labels[i], []).append((i, place))
    return found


def bounded(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(cid, size, most) of those sets (cid, members) that may link with another: most is the largest size such a one can have.

    Only shingles' counts are shuffled, with partial sums on every task, so a shingle of all documents is one row for each.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                each = [np.frombuffer(m.as_buffer(), np.int64) for m in batch.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in each])), pa.array(np.concatenate(each))], names=["cid", "shingle"])

    num, den = threshold.numerator, threshold.denominator
    counts = sets.mapInArrow(spread, "cid long, shingle long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("cid").alias("cid"))
    alone = counts.where("k = 1").groupBy("cid").agg(F.count("*").alias("alone"))
    sized = sets.select("cid", (F.octet_length("members") / 8).cast("long").alias("size")).join(alone, "cid", "left")
    most = F.floor((F.col("size") - F.coalesce("alone", F.lit(0))) * (num + den) / F.lit(num) + F.lit(1e-9)).cast("long") - F.col("size")
    return sized.select("cid", "size", most.alias("most")).where(F.col("most") * den >= F.col("size") * num)


def within_cells(docs: DataFrame, classes: DataFrame, cells: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """cells: key, band, cid and label -> confirmed links (a, b) between classes of different labels, enough to connect each cell."""

    def settle(held: list[tuple]) -> list[tuple[int, int]]:
        cids, labels, sets, most, blocks, sketch, bands = zip(*held, strict=True)
        if len(set(labels)) < 2:
            return []
        sets = [np.frombuffer(m, np.uint64) for m in sets]
        before = [np.array(x[: bands[0]]) for x in sketch]
        apart = (lambda i, j: bool((before[i] == before[j]).any())) if bands[0] else None  # they share an earlier cell
        return [(cids[i], cids[j]) for i, j in cell_links(sets, list(labels), threshold, list(most), list(blocks) if len(set(blocks)) > 1 else None, apart)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], []
        for batch in batches:
            for key, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, x, y) != at:
                    found += settle(held) if held else []
                    at, held = (key, x, y), []
                held.append(row)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found = []
        found += settle(held) if held else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    wanted = materialize(classes.join(cells.select("cid").distinct(), "cid").select("cid", "doc_id", "digest"), "cells-wanted")
    sets = materialize(full_sets(docs, wanted, width), "cells-sets")
    able = materialize(bounded(sets, threshold), "cells-bounds")
    heavy = F.col("most") >= F.col("size")
    left = materialize(cells.join(able, "cid").withColumn("heavy", heavy), "cells-able")
    bytes_of = lambda rows: F.coalesce(F.sum(F.when(rows, F.col("size") * 8)), F.lit(0))
    parts = lambda n: F.ceil(n / F.lit(CELL_BYTES)).cast("int")
    told = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), bytes_of(F.col("heavy")).alias("hb"), bytes_of(~F.col("heavy")).alias("lb")).where("low < high and hb > 0")
    whole = F.col("hb") + F.col("lb") <= CELL_BYTES
    told = materialize(told.select("key", F.when(whole, 1).otherwise(parts(F.col("hb"))).alias("h"), F.when(whole, 0).otherwise(parts(F.col("lb"))).alias("l")), "cells-parts")
    # Blocks 0 to h - 1 are heavy, h to h + l - 1 light; each heavy one meets itself and every other block once, in (lesser, greater).
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(F.col("heavy") | (F.col("l") == 0), deal(F.col("h"))).otherwise(F.col("h") + deal(F.col("l")))
    others = F.sequence(F.lit(0), F.when(own < F.col("h"), F.col("h") + F.col("l")).otherwise(F.col("h")) - 1)
    meets = F.transform(others, lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y")))
    rows = left.join(small(told, told.count()), "key").select("key", "band", "cid", "label", "most", own.alias("block"), F.explode(meets).alias("m"))
    rows = rows.join(sets, "cid").join(classes.select("cid", "sketch"), "cid").select("key", "m.x", "m.y", "cid", "label", "members", "most", "block", "sketch", "band")
    return materialize(rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long"), "cells-links")


def _grouped(docs: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest, label (null for an empty set) and component_id of each row of docs."""
    rows = materialize(sketches(docs, width, registers_for(threshold)), "sketches")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keys = classes.select("cid", F.posexplode("sketch").alias("band", "value")).select("cid", "band", F.xxhash64("band", "value").alias("key"))
    cells = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = materialize(keys.join(cells, "key"), "cells")
    firsts = members.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    firsts = materialize(firsts, "pairs-first")
    links = confirmed(docs, classes, firsts, threshold, width)
    labels = components(links)

    label = F.coalesce("component", "cid").alias("label")
    told = members.where("members > 2").join(small(labels, labels.count()).withColumnRenamed("node", "cid"), "cid", "left").select("key", "band", "cid", label)
    mixed = materialize(told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "cells-keys")
    n_mixed = mixed.count()
    if n_mixed:
        told = materialize(told.join(small(mixed, n_mixed), "key"), "cells-mixed")
        second = within_cells(docs, classes, told, threshold, width)
        if second.limit(1).count():
            labels = components(links.union(second))

    found = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("digest", "doc_id", label)
    ids = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = materialize(found.join(ids, "label").select(F.col("digest").alias("d"), "label", "component_id"), "classes-named")
    out = rows.select("doc_id", "text_hash", "n_shingles", "digest").join(named, F.col("digest") == F.col("d"), "left").drop("d")
    return out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def group_documents(docs: DataFrame, threshold: Fraction = Fraction(85, 100), width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the group) and kept for each row of docs.

    A null text or one without words has an empty set and is a group of its own; a text of fewer words than ``width`` has
    its whole sequence as one shingle; repeated rows are copies; an empty table gives an empty one; other columns are
    dropped. Rows with a null doc_id are grouped by their text, as any; with no other id in the group their
    component_id is null and they are kept.
    """
    out = _grouped(docs, threshold, width).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Column names that no table of documents has.
OWN_HASH, GONE_ID, GONE_HASH = "near duplicates text hash", "near duplicates id", "near duplicates hash"


def keep_first(docs: DataFrame, threshold: Fraction, width: int = 5) -> DataFrame:
    """The rows of docs, whole, of one document for each group: that of least doc_id (null last), then of least text hash.

    Texts without words are in no group and all stay. Rows are decided by doc_id and text, so rows that share an id, with
    different texts, don't go with each other; of rows alike in both, one stays. An empty table gives an empty one; columns of
    any names are kept. Only the ids and hashes of rows that go are joined with the texts.
    """
    grouped = materialize(_grouped(docs, threshold, width).where("digest is not null").select("label", "doc_id", "text_hash"), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = grouped.groupBy("label").agg(F.min(rank).alias("first"), F.count("*").alias("rows")).where("rows > 1").select(F.col("label").alias("l"), "first")
    first = materialize(first, "groups-first")  # rows of groups of one stay in any case
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    told = grouped.join(small(first, first.count()), F.col("label") == F.col("l")).select(F.col("doc_id").alias(GONE_ID), F.col("text_hash").alias(GONE_HASH), stays.alias("stays"))
    key = [F.col(f"`{GONE_ID}`"), F.col(f"`{GONE_HASH}`")]
    gone = materialize(told.where("not stays").select(*key).distinct(), "groups-gone")
    again = materialize(told.where("stays").groupBy(*key).count().where("count > 1").select(*key), "groups-again")
    same = F.col("doc_id").cast("long").eqNullSafe(key[0]) & (F.col(f"`{OWN_HASH}`") == key[1])
    left = docs.withColumn(OWN_HASH, F.xxhash64("text")).join(small(gone, gone.count()), same, "left_anti")
    n = again.count()
    if n:
        once = left.join(small(again, n), same, "left_semi").dropDuplicates(["doc_id", OWN_HASH])
        left = left.join(small(again, n), same, "left_anti").unionByName(once)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
