"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector x is rotated at random and kept as the signs of its components; the stored factor is the inner product of
x with its own sign vector s(x) / sqrt(d). For any unit y, <s(x), y> / factor is an unbiased estimate of <x, y>, with an
error of about sqrt(1 - factor^2) / factor / sqrt(d - 1) times a standard normal. Pairs whose upper bound stays under
the threshold are dropped; all others are computed exactly, in double precision, before they count as links.

Candidates: in each of several tables, the largest component (with its sign) in a few more random rotations is the
vector's cell. The chance that a pair just at the threshold agrees in one rotation is estimated for the vectors' own
dimension and threshold by drawing such pairs; rotations for each table and tables follow from it and from the number of
vectors, so that a pair shares no cell with a chance of MISS and most cells hold one vector.

Equal vectors are one, with a weight. Groups of near copies: a vector within half the threshold's angle of a common
leader is linked with all others that are, by the triangle inequality. Such pairs are counted from the group's weight and
never made. Only vectors of different leaders meet in cells. Large cells are dealt out in blocks, all but those of the
cell's main leader with each other. A task counts its links by weight and gives each vector one number and one way to its
component: pairs are never output. A pair counts in the first table in which it shares a cell.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, small
from .components import components
from .vectors import finite, groups_by_length

#: Chance that a pair just at the threshold shares no cell.
MISS = 1e-3
SIGMAS = 4.0
LEADER_TABLES = 8
CELL_ROWS = 2048
MARGIN = 1e-9
#: Dimension up to which rotations are drawn as matrices; beyond it, they are three rounds of random signs and Hadamard transforms.
DENSE = 128


@functools.cache
def agreement(d: int, threshold: float) -> float:
    """Chance that a pair at the threshold has its largest component in the same place and with the same sign after a rotation: three standard errors under the share of some thousand drawn pairs."""
    size = d if d <= DENSE else 1 << (d - 1).bit_length()
    if size < 2:
        return 0.999
    draws, draw = max(2000, min(20_000, (1 << 22) // size)), np.random.default_rng((17, d))
    x, y = draw.standard_normal((2, draws, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold**2) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    i, j, rows = np.abs(x).argmax(1), np.abs(y).argmax(1), np.arange(draws)
    share = float(((i == j) & (np.sign(x[rows, i]) == np.sign(y[rows, j]))).mean())
    return min(0.999, max(0.001, share - 3 * math.sqrt(share * (1 - share) / draws)))


def plan(n: int, d: int, threshold: float = 0.9) -> tuple[int, int, int]:
    """Rotations per table, tables, and rotations per leader table for n vectors of d components: the cheapest, in about microseconds a vector, for a cell's row, the rotations, the rows that move and the pairs."""
    size = d if d <= DENSE else 1 << (d - 1).bit_length()
    p, turn = agreement(d, threshold), (2 * d * d if d <= DENSE else 6 * size * sum(_sides(size))) / 5000
    tables = lambda per: math.ceil(math.log(MISS) / math.log1p(-(p**per)))
    others = lambda per: n / (2.0 * size) ** per
    per = min(range(1, 13), key=lambda k: tables(k) * (2 + k * turn + (20 * min(1.0, others(k)) + others(k)) * max(1, d / 64)))
    return per, tables(per), per + 2


def rotations(d: int, count: int, seed: int) -> np.ndarray:
    """count random orthogonal d x d matrices, side by side."""
    draw = np.random.default_rng((seed, d))
    found = []
    for _ in range(count):
        q, r = np.linalg.qr(draw.standard_normal((d, d)))
        found.append(q * np.sign(np.diag(r)))
    return np.concatenate(found, axis=1)


def _sides(size: int) -> tuple[int, int]:
    bits = size.bit_length() - 1
    return 1 << bits // 2, 1 << bits - bits // 2


@functools.cache
def _signs(size: int) -> np.ndarray:
    """Hadamard's matrix by Sylvester's rule: the sign is that of the parity of the places' common bits."""
    at = np.arange(size)
    return (1 - 2 * (np.bitwise_count(at[:, None] & at) & 1).astype(np.int8)).astype(np.float32)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Hadamard's transform of the rows of x, whose length is a power of two, unscaled: a product of two small ones."""
    a, b = _sides(x.shape[1])
    return (_signs(a) @ (x.reshape(-1, a, b) @ _signs(b))).reshape(x.shape)


def turned(x: np.ndarray, count: int, seed: int, made: dict) -> np.ndarray:
    """The rows of x in count random rotations: rows, rotations, components."""
    n, d = x.shape
    if d <= DENSE:
        if (seed, d) not in made:
            made[seed, d] = rotations(d, count, seed).astype(np.float32)
        return (x @ made[seed, d]).reshape(n, count, d)
    size = 1 << (d - 1).bit_length()
    if (seed, d) not in made:
        made[seed, d] = np.random.default_rng((seed, d)).choice(np.array([-1, 1], np.float32), (count, 3, size))
    found = []
    for signs in made[seed, d]:
        y = np.zeros((n, size), np.float32)
        y[:, :d] = x
        for s in signs:
            y = hadamard(y * s) / np.float32(math.sqrt(size))
        found.append(y)
    return np.stack(found, 1)


def cells(x: np.ndarray, count: int, per: int, seed: int, made: dict) -> np.ndarray:
    """count cell numbers for each row of x, from per rotations each, in single precision: cells only offer pairs, links are computed exactly."""
    x = x.astype(np.float32)
    n, d = x.shape
    key = np.full((n, count), d, np.int64)
    for t in range(count):
        y = turned(x, per, seed * 100_003 + t, made)
        at = np.abs(y).argmax(2)
        digit = at * 2 + (np.take_along_axis(y, at[:, :, None], 2)[:, :, 0] < 0)
        for k in range(per):
            key[:, t] = key[:, t] * np.int64(1_000_003) + digit[:, k]
    return key


def codes(vectors: DataFrame, plans: dict[int, tuple[int, int, int]]) -> DataFrame:
    """uid, cells, leader cells, signs, factor and unit vector of each vector (uid, embedding) that isn't empty or zero; plans by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in batches:
            for rows, x in groups_by_length(batch.column(1)):
                if not x.shape[1]:
                    continue
                per, tables, leader_per = plans[x.shape[1]]
                length = np.sqrt((x * x).sum(1))
                tiny = ~((length > 1e-150) & (length < 1e150))
                x[tiny] /= np.maximum(np.abs(x[tiny]).max(1, keepdims=True), 5e-324)  # scaled before it's squared
                length[tiny] = np.sqrt((x[tiny] * x[tiny]).sum(1))
                x, rows, length = x[length > 0], rows[length > 0], length[length > 0]
                if not len(x):
                    continue
                x = x / length[:, None]
                d = x.shape[1]
                y = rotated(x, made)
                factor = np.abs(y).sum(1) / math.sqrt(d)
                bands, lead = cells(x, tables, per, 1, made), cells(x, LEADER_TABLES, leader_per, 2, made)
                listed = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel()))
                signs = [s.tobytes() for s in np.packbits(y >= 0, axis=1)]
                unit = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), listed(bands), listed(lead), pa.array(signs, pa.binary()), pa.array(factor.astype(np.float32)), pa.array(unit, pa.binary())], names=["uid", "cells", "lead", "signs", "factor", "unit"])

    return lean(vectors).select("uid", "embedding").mapInArrow(run, "uid long, cells array<long>, lead array<long>, signs binary, factor float, unit binary")


def rotated(x: np.ndarray, made: dict) -> np.ndarray:
    """The rows of x in the rotation whose signs are stored."""
    d = x.shape[1]
    if ("r", d) not in made:
        made["r", d] = rotations(d, 1, 7)
    return x @ made["r", d]


def _near(least: float):
    """Keep pairs (a, b, their unit vectors) with an inner product of least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.float64), np.frombuffer(q.as_buffer(), np.float64)
                keep.append(len(x) == len(y) and float(x @ y) >= least)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _meet(threshold: float):
    """Stream rows sorted by cell and blocks; count each row's links by weight, and give it a row that it's connected with."""

    def pairs_of(start: np.ndarray, end: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each row with all later rows of its cell, about at_once pairs at a time."""
        rows = np.arange(len(start))
        many = end - rows - 1
        upto = np.cumsum(many)
        first = 0
        while first < len(rows):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + at_once, "right")))
            own, n = rows[first:last], many[first:last]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = np.repeat(own, n)
            yield a, a + 1 + inner
            first = last

    def settle(t: pa.Table, made: dict) -> Iterator[pa.RecordBatch]:
        uid, leader, key, x, y, block, many = (t[c].to_numpy() for c in ("uid", "leader", "key", "x", "y", "block", "many"))
        factor = t["factor"].to_numpy().astype(np.float64)
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        end = np.repeat(np.append(edge[1:], len(key)), np.diff(np.append(edge, len(key))))
        units, signs = (t[c].to_pylist() for c in ("unit", "signs"))
        listed = t["before"].combine_chunks()
        lengths = pa.compute.list_value_length(listed).to_numpy()
        before = np.repeat(-1 - np.arange(len(uid))[:, None], max(1, int(lengths.max())), axis=1)  # what no other row has, where there's no earlier table
        before[np.arange(before.shape[1]) < lengths[:, None]] = listed.flatten().to_numpy()
        size = np.array([len(u) for u in units]) // 8
        place = np.zeros(len(uid), np.int64)  # of a row among those of its length
        vectors, turns, codes_ = {}, {}, {}
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            place[rows] = np.arange(len(rows))
            vectors[d] = np.frombuffer(b"".join(units[i] for i in rows), np.float64).reshape(-1, d)
            turns[d] = rotated(vectors[d], made).astype(np.float32)
            codes_[d] = np.unpackbits(np.frombuffer(b"".join(signs[i] for i in rows), np.uint8).reshape(len(rows), -1), axis=1, count=int(d)).astype(np.float32) * 2 - 1
        count, label = np.zeros(len(uid), np.int64), np.arange(len(uid))
        for a, b in pairs_of(np.arange(len(uid)), end, max(4096, 12_000_000 // int(size.max()))):
            keep = (leader[a] != leader[b]) & (size[a] == size[b]) & ((x[a] == y[a]) | (block[a] != block[b]))
            a, b = a[keep], b[keep]
            for d in np.unique(size[a]):
                some = size[a] == d
                p, q = a[some], b[some]
                i, j = place[p], place[q]
                f = factor[q]
                estimate = np.einsum("ij,ij->i", turns[d][i], codes_[d][j]) / math.sqrt(d) / f
                error = np.sqrt(np.maximum(1 - f * f, 0)) / f / math.sqrt(max(1, d - 1)) if d > 1 else np.full(len(f), 2.0)
                near = estimate + SIGMAS * error >= threshold
                p, q, i, j = p[near], q[near], i[near], j[near]
                linked = np.einsum("ij,ij->i", vectors[d][i], vectors[d][j]) >= threshold
                p, q = p[linked], q[linked]
                new = ~(before[p] == before[q]).any(1)  # they share no earlier cell
                np.add.at(count, p[new], many[q[new]])
                np.add.at(count, q[new], many[p[new]])
                while len(p) and (label[p] != label[q]).any():
                    low = np.minimum(label[p], label[q])
                    np.minimum.at(label, label[p], low)
                    np.minimum.at(label, label[q], low)
                    while (label[label] != label).any():
                        label = label[label]
        told = np.flatnonzero((count > 0) | (label != np.arange(len(label))))
        if len(told):
            yield pa.RecordBatch.from_arrays([pa.array(uid[told]), pa.array(uid[label[told]]), pa.array(count[told])], names=["uid", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= 16 << 20:
                t = pa.Table.from_batches(held)
                key, x, y = (t[c].to_numpy() for c in ("key", "x", "y"))
                last = np.flatnonzero((key != key[-1]) | (x != x[-1]) | (y != y[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on
                if cut:
                    yield from settle(t.slice(0, cut), made)
                    held = t.slice(cut).combine_chunks().to_batches()
                    size = sum(h.nbytes for h in held)
        if held:
            yield from settle(pa.Table.from_batches(held), made)

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component; vectors of different lengths don't link; repeated rows link with each other, also with equal or null ids;
    a null vec_id counts as any row, is its component's id only if all of it are null, and is then kept; an empty table gives
    an empty one; other columns are dropped. A row for each different length comes to the driver.
    """
    rows = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    usable = rows.where(finite("embedding")).where(F.exists("embedding", lambda x: x != 0))
    plans = {int(d): plan(int(n), int(d), threshold) for d, n in usable.groupBy(F.size("embedding")).count().collect()}

    # Equal vectors are one; their keys are two hashes of 64 bits from different seeds.
    twin = ["k", "l", "d"]
    keyed = usable.select("uid", F.xxhash64("embedding").alias("k"), F.xxhash64(F.lit(1), "embedding").alias("l"), F.size("embedding").alias("d"))
    classes = materialize(keyed.groupBy(*twin).agg(F.min("uid").alias("first"), F.count("*").alias("many")).where("many > 1"), "vector-classes")
    n_classes = classes.count()
    copies = materialize(keyed.join(small(classes, n_classes), twin).where("uid <> first").select("uid", "first"), "vector-copies")
    n_copies = copies.count()
    coded = codes(usable.join(small(copies.select("uid"), n_copies), "uid", "left_anti"), plans)
    weights = classes.select(F.col("first").alias("uid"), "many")
    coded = materialize(coded.join(small(weights, n_classes), "uid", "left").withColumn("many", F.coalesce("many", F.lit(1)).cast("long")), "vector-codes")

    # A leader is the least row that shares a narrow cell, if it's within half of the threshold's angle.
    narrow = coded.select("uid", F.posexplode("lead").alias("t", "cell"))
    least = narrow.groupBy("t", "cell").agg(F.min("uid").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    offered = narrow.join(least, ["t", "cell"]).groupBy("uid").agg(F.min("first").alias("b")).where("b < uid").withColumnRenamed("uid", "a")
    unit = lambda k: coded.select(F.col("uid").alias(k), F.col("unit").alias(f"u_{k}"))
    pairs = offered.join(unit("a"), "a").join(unit("b"), "b").select("a", "b", "u_a", "u_b")
    led = materialize(pairs.mapInArrow(_near(math.sqrt((1 + threshold) / 2) + MARGIN), "a long, b long"), "vector-leaders")
    led = small(led, led.count()).withColumnRenamed("a", "uid")

    cell = coded.select("uid", F.posexplode("cells").alias("t", "cell")).select("uid", "t", F.xxhash64("t", "cell").alias("key"))
    shared = cell.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    cell = cell.join(shared, "key").join(led, "uid", "left").select("uid", "t", "key", F.coalesce("b", "uid").alias("leader"))
    cell = materialize(cell, "vector-cells")
    counts = cell.groupBy("key", "leader").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "leader")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("leaders")).where("leaders > 1")
    parts = lambda n: F.ceil(n / F.lit(CELL_ROWS)).cast("int")
    whole, rest = F.col("all") <= CELL_ROWS, F.col("all") - F.col("main.n")
    mixed = materialize(mixed.select("key", F.col("main.leader").alias("main"), F.when(whole, 1).otherwise(parts(F.col("main.n"))).alias("h"), F.when(whole, 0).otherwise(parts(rest)).alias("l")), "vector-mixed")
    # Blocks 0 to h - 1 are of the main leader and don't meet; h to h + l - 1 meet all blocks once, in (lesser, greater).
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.greatest(n, F.lit(1))).cast("int")
    major = (F.col("leader") == F.col("main")) | (F.col("l") == 0)
    own = F.when(major, deal(F.col("h"))).otherwise(F.col("h") + deal(F.col("l")))
    others = F.when(F.col("l") == 0, F.array(F.lit(0))).when(major, F.sequence(F.col("h"), F.col("h") + F.col("l") - 1)).otherwise(F.sequence(F.lit(0), F.col("h") + F.col("l") - 1))
    meets = F.transform(others, lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y")))
    met = cell.join(small(mixed, mixed.count()), "key").select("uid", "t", "key", "leader", own.alias("block"), F.explode(meets).alias("m"))
    met = met.join(coded.select("uid", "many", "signs", "factor", "unit", "cells"), "uid")
    met = met.select("uid", "leader", "key", "m.x", "m.y", "block", "many", "factor", "unit", "signs", F.slice("cells", 1, F.col("t")).alias("before"))
    found = met.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_meet(threshold), "uid long, other long, n long")
    found = materialize(found, "vector-links")

    leaders = coded.select("uid", "many").join(led, "uid", "left").select("uid", "many", F.coalesce("b", "uid").alias("leader"))
    ends = found.groupBy("uid").agg(F.sum("n").alias("apart"))
    sizes = leaders.groupBy("leader").agg(F.sum("many").alias("together"))
    counted = leaders.join(sizes, "leader").join(ends, "uid", "left").select(F.col("uid").alias("rep"), (F.col("together") - 1 + F.coalesce("apart", F.lit(0))).alias("n_links"))
    labels = components(found.where("uid <> other").select(F.col("uid").alias("a"), F.col("other").alias("b")).union(leaders.where("uid <> leader").select(F.col("uid").alias("a"), F.col("leader").alias("b"))))
    named = rows.select("uid", "vec_id").join(small(copies, n_copies), "uid", "left").select("vec_id", F.coalesce("first", "uid").alias("rep"))
    named = named.join(small(labels, labels.count()).withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    lowest = named.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    out = named.join(lowest, "label").join(counted, "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
