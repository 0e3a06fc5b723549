"""Minimum-cost-flow resharding.

An old layout (``old_shard``) is turned into ``n_new`` shards whose row counts are at most one apart, moving the fewest
bytes. Every new shard holds ``low`` rows or one more, so what an old shard may have to send away is known but for one
row: that of rank ``low`` by falling size. Its size, the shard's edge, cuts the shard into three blocks: rows above the
edge, at it and below it. The flow network is

    block -> its own shard, cost 0      block -> pool, cost: the block's mean bytes      pool -> any shard, cost 0

with the shards' new capacities on the way to the sink, so a cheapest full flow says how many rows of each block stay
and how many go where. Rows above the edge stay and rows below it go in any case, and rows at the edge are of one size,
so the bytes moved are the fewest for the rows themselves, not just for the blocks. Only the blocks' totals come to the
driver: three for each old shard, whatever the rows. The flow there takes one search for each block and shard, about
(shards)^2 steps: a second for a hundred shards, minutes for thousands.

Edges are found from counts by size, summed on every task, in the power of two that holds the edge alone. Each row has
a rank within its block, and the flow gives each block intervals of ranks, each with its new shard and first slot. So a
row's shard and slot follow from its rank, and no shard is ever gathered or sorted. Ranks are counted in sub-blocks of
about the square root of the block's rows: sub-block offsets are summed up, and rows are numbered within their
sub-block alone.

Files: a layout is a folder of generations, each partitioned by shard, with a manifest that says which generation holds
which shard. ``rewrite_affected`` writes the shards that change into a new generation and then a new manifest, so
the other shards' files stay where they are and a run that breaks off changes nothing.
"""

from __future__ import annotations

import heapq
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import materialize, small


class Flow:
    """Cheapest flow by successive shortest paths with potentials; integers throughout."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: int, sink: int) -> int:
        height, sent = [0] * len(self.out), 0
        while True:
            far, via, heap = [math.inf] * len(self.out), [-1] * len(self.out), [(0, source)]
            far[source] = 0
            while heap:
                d, x = heapq.heappop(heap)
                if x == sink:
                    break
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    if self.room[e] and (n := d + self.cost[e] + height[x] - height[self.to[e]]) < far[self.to[e]]:
                        far[self.to[e]], via[self.to[e]] = n, e
                        heapq.heappush(heap, (n, self.to[e]))
            if far[sink] == math.inf:
                return sent
            height = [h + min(d, far[sink]) for h, d in zip(height, far, strict=True)]
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            sent += push


def transfers(blocks: list[tuple[int, int, int, int]], n_new: int) -> list[tuple[int, int, int, int, int, int]]:
    """(old_shard, block, rows, bytes) of each block -> (old_shard, block, first rank, end rank, new shard, first slot)."""
    blocks = sorted(blocks)
    total = sum(b[2] for b in blocks)
    low, extra = divmod(total, n_new)
    n = len(blocks)
    source, pool, more, sink = n, n + 1, n + 2, n + 3
    shard = lambda j: n + 4 + j
    scale = math.lcm(*{max(1, b[2]) for b in blocks})  # means as integers, exact however many blocks there are
    net = Flow(n + 4 + n_new)
    stay, move = {}, []
    for k, (old, _, rows, size) in enumerate(blocks):
        net.arc(source, k, rows, 0)
        if 0 <= old < n_new:
            stay[k] = net.arc(k, shard(old), rows, 0)
        move.append(net.arc(k, pool, rows, max(1, size * scale // max(1, rows))))
    into = []
    for j in range(n_new):
        into.append(net.arc(pool, shard(j), total, 0))
        net.arc(shard(j), sink, low, 0)
        net.arc(shard(j), more, 1, 0)
    net.arc(more, sink, extra, 0)
    assert net.run(source, sink) == total
    slots, found = [0] * n_new, []

    def give(k: int, first: int, rows: int, j: int) -> None:
        if rows:
            found.append((blocks[k][0], blocks[k][1], first, first + rows, j, slots[j]))
            slots[j] += rows

    for k, arc in stay.items():
        give(k, 0, net.used(arc), blocks[k][0])
    wanted = [[j, net.used(into[j])] for j in range(n_new) if net.used(into[j])]
    for k, arc in enumerate(move):
        first, left = (net.used(stay[k]) if k in stay else 0), net.used(arc)
        while left:
            some = min(left, wanted[0][1])
            give(k, first, some, wanted[0][0])
            first, left, wanted[0][1] = first + some, left - some, wanted[0][1] - some
            if not wanted[0][1]:
                wanted.pop(0)
    return found


def edges(rows: DataFrame, low: int, classes: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(o, edge): the size of the row of rank ``low`` by falling size, of each old shard that has more than ``low`` rows.

    classes: for each old shard, (size class, rows) by falling class. Only sizes of the class that holds the rank are counted one by one.
    """
    wanted = []
    for old, parts in classes.items():
        before = 0
        for kind, n in parts:
            if before + n > low:
                wanted.append((old, kind, before))
                break
            before += n
    spark = rows.sparkSession
    wanted_rows = spark.createDataFrame(wanted, "w_old int, w_kind int, w_before long")
    same = (F.col("old_shard") == F.col("w_old")) & (F.col("kind") == F.col("w_kind"))
    counts = rows.join(F.broadcast(wanted_rows), same).groupBy("old_shard", "size", "w_before").agg(F.count("*").alias("n"))  # broadcast: a row for each old shard
    upto = F.col("w_before") + F.sum("n").over(Window.partitionBy("old_shard").orderBy(F.desc("size")))
    return counts.withColumn("upto", upto).where(F.col("upto") > low).groupBy(F.col("old_shard").alias("o")).agg(F.max("size").alias("edge"))


OWN = "reshard own "
#: Files that a shard is written to at most, so that a large one isn't one task's work.
FILES = 8


def reshard(rows: DataFrame, n_new: int, key: list[str]) -> DataFrame:
    """rows, with shard, slot and moved, from old_shard (int) and size (long); key names columns that together tell every row apart, also in a rerun.

    Null keys are a value like any other; a null size counts as 0, a null old_shard as a shard that goes (-1). Columns of
    any other names are kept; shard, slot and moved of the input are replaced. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot", "moved")]
    size, old = F.coalesce(F.col("size").cast("long"), F.lit(0)), F.coalesce(F.col("old_shard").cast("int"), F.lit(-1))
    own = {c: f"{OWN}{k}" for k, c in enumerate(names)}
    rows = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], size.alias("size"), old.alias("old_shard"), F.xxhash64(*[F.col(f"`{c}`") for c in key]).alias("mix"))
    rows = rows.withColumn("kind", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int"))
    classes: dict[int, list[tuple[int, int]]] = {}
    for o, kind, n in rows.groupBy("old_shard", "kind").agg(F.count("*")).collect():  # at most 63 for each old shard
        classes.setdefault(o, []).append((kind, n))
    total = sum(n for parts in classes.values() for _, n in parts)
    found = edges(rows, total // n_new, {o: sorted(parts, reverse=True) for o, parts in classes.items()})
    cut = rows.join(F.broadcast(found), F.col("old_shard") == F.col("o"), "left")  # a row for each old shard: bounded
    block = F.when(F.col("edge").isNull() | (F.col("size") > F.col("edge")), 2).when(F.col("size") == F.col("edge"), 1).otherwise(0)
    cut = cut.withColumn("block", block).drop("o", "edge", "kind")
    blocks = [tuple(map(int, r)) for r in cut.groupBy("old_shard", "block").agg(F.count("*"), F.sum("size")).collect()]  # at most three for each old shard
    plan = transfers(blocks, n_new) if blocks else []
    many = lambda n: max(1, math.ceil(n / max(256, math.isqrt(n))))
    parts = spark.createDataFrame([(o, c, many(n)) for o, c, n, _ in blocks], "old_shard int, block int, n_sub long")
    steps = spark.createDataFrame(plan, "old_shard int, block int, first long, end long, shard int, slot0 long")
    at = ["old_shard", "block"]
    cut = cut.join(F.broadcast(parts), at).withColumn("sub", F.pmod("mix", "n_sub")).drop("n_sub")
    counts = cut.groupBy(*at, "sub").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*at).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy(*at, "sub").orderBy("mix", *[own[c] for c in key])) - 1)
    ranked = ranked.join(small(offsets, sum(many(n) for _, _, n, _ in blocks)), [*at, "sub"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(steps), at).where("rank >= first and rank < end")  # some intervals for each block: bounded
    slot = F.col("slot0") + F.col("rank") - F.col("first")
    return placed.select(*[F.col(n).alias(c) for c, n in own.items()], "shard", slot.alias("slot"), (F.col("old_shard") != F.col("shard")).alias("moved"))


def write_layout(rows: DataFrame, folder: str, held: list[tuple[str, int]] | None = None, version: int = 1) -> None:
    """Write rows (shard and any other columns) as a new generation of the layout in folder, and the manifest: held names what other generations still hold."""
    spark = rows.sparkSession
    generation = f"generation-{version:06d}-{uuid.uuid4().hex}"
    plain = [F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    rows.repartition("shard", F.pmod(F.xxhash64(*plain), F.lit(FILES))).write.partitionBy("shard").parquet(f"{folder}/{generation}")
    schema = spark.read.parquet(f"{folder}/{generation}").select("shard").distinct()
    listed = [*(held or []), *((generation, r[0]) for r in schema.collect())]  # a row for each shard
    spark.createDataFrame(listed, "generation string, shard int").coalesce(1).write.parquet(f"{folder}/manifest/version={version}")


def manifest(spark: SparkSession, folder: str) -> tuple[int, list[tuple[str, int]]]:
    """The newest whole manifest: its version and (generation, shard). One that was broken off has no rows."""
    found = spark.read.schema("generation string, shard int, version int").parquet(f"{folder}/manifest").collect()  # a row for each shard and version
    version = max(r["version"] for r in found)
    return version, sorted((r["generation"], r["shard"]) for r in found if r["version"] == version)


def read_layout(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the layout in folder, with shard, and with where they stand (file_path, row_index) as columns ``at_file`` and ``at_row``."""
    out = None
    _, listed = manifest(spark, folder)
    for generation in sorted({g for g, _ in listed}):
        part = spark.read.parquet(f"{folder}/{generation}").where(F.col("shard").isin([s for g, s in listed if g == generation]))
        part = part.select("*", F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
        out = part if out is None else out.unionByName(part)
    return out


def rewrite_affected(spark: SparkSession, folder: str, n_new: int, size: str = "octet_length(text) + 16") -> list[int]:
    """Reshard the layout in folder into n_new shards, writing those alone that gain or lose rows; their numbers are returned.

    Whole rows with all their columns are kept, repeated ones each: a row is known by its file and place there, and the plan
    is joined with the rows by both. Shards that keep all their rows stay as they are; a shard that loses all of them leaves
    the manifest. Old generations are never deleted here. size: an SQL expression; where it's null, 16. The numbers come to the
    driver: as many as shards at most. A layout without rows can't be written, so none is read. Columns called at_file
    and at_row must not be in the files.
    """
    rows = read_layout(spark, folder)
    brief = rows.select("at_file", "at_row", F.col("shard").alias("old_shard"), F.coalesce(F.expr(size).cast("long"), F.lit(16)).alias("size"))
    placed = materialize(reshard(materialize(brief, "reshard-sizes"), n_new, ["at_file", "at_row"]), "reshard-placed")
    moved = placed.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    hit = {r[0] for r in moved.collect()}
    if not hit:
        return []
    version, listed = manifest(spark, folder)
    plan = placed.where(F.col("shard").isin(sorted(hit))).select(F.col("at_file").alias("f"), F.col("at_row").alias("r"), F.col("shard").alias("to"))
    old = rows.where(F.col("shard").isin(sorted(hit)))  # whatever comes into a new shard came out of one that changes too
    whole = old.join(plan, (F.col("at_file") == F.col("f")) & (F.col("at_row") == F.col("r"))).drop("at_file", "at_row", "f", "r", "shard").withColumnRenamed("to", "shard")
    write_layout(whole, folder, [(g, s) for g, s in listed if s not in hit], version + 1)
    return sorted(hit)


def sized(docs: DataFrame, n_old: int) -> DataFrame:
    """doc_id, size and CRC of each document, with the shard it has in a layout that is dealt by source."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(n_old)).cast("int").alias("old_shard"),
    )


def reshard_documents(docs: DataFrame, n_old: int = 24, n_new: int = 40) -> DataFrame:
    """Shards 0 to n_new - 1 of even row counts, from a layout of n_old shards by source.

    A null text has no bytes; a null source is dealt as an empty one. Repeated rows each get a slot: a row number,
    written with the sizes and so the same in every later step, tells them apart.
    """
    return reshard(materialize(sized(docs, n_old).withColumn("row", F.monotonically_increasing_id()), "reshard-rows"), n_new, ["row"]).drop("row")
