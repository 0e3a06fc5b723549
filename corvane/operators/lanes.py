"""Placing edges in drawings: lanes, crossings, packing of spans."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.store import materialize


def ranked_lanes(edges: DataFrame, gap: list[str], order: list[Column]) -> DataFrame:
    """Adds lane, from 0 in each gap. Rows are dealt out by ranges and numbered within them, so a gap with many edges is in many tasks."""
    dealt = materialize(edges.repartitionByRange(*gap, *order).withColumn("part", F.spark_partition_id()), "lanes")
    held = dealt.groupBy(*gap, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*gap).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*[F.col(c).alias(f"gap_{k}") for k, c in enumerate(gap)], F.col("part").alias("gap_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = dealt.withColumn("lane", F.row_number().over(Window.partitionBy(*gap, "part").orderBy(*order)) - 1)
    meets = F.col("part") == F.col("gap_part")
    for k, c in enumerate(gap):
        meets &= F.col(c).eqNullSafe(F.col(f"gap_{k}"))
    return own.join(held, meets).select(*edges.columns, (F.col("lane") + F.col("before")).cast("int").alias("lane"))


def crossings(placed: DataFrame) -> DataFrame:
    """(gap, n): edges over each gap between neighbouring columns."""
    low, high = F.least("src_layer", "dst_layer"), F.greatest("src_layer", "dst_layer")
    gaps = placed.where("src_layer <> dst_layer").select(F.explode(F.sequence(low, high - 1)).alias("gap"))
    return gaps.groupBy("gap").agg(F.count("*").alias("n"))


def first_fit(spans: Iterable[tuple[float, float]], clearance: float = 0.0) -> list[int]:
    """The first lane in which each span, in the order given, keeps clear of those before it. Sequential by its nature."""
    ends: list[list[tuple[float, float]]] = []
    found = []
    for low, high in spans:
        low, high = min(low, high), max(low, high)
        for lane, taken in enumerate(ends):
            if all(high + clearance <= a or b + clearance <= low for a, b in taken):
                break
        else:
            lane = len(ends)
            ends.append([])
        ends[lane].append((low, high))
        found.append(lane)
    return found


def treemap(sizes: list[tuple[str, float]], x: float, y: float, w: float, h: float) -> list[tuple[str, float, float, float, float]]:
    """Rectangles with areas in proportion, by halving the list at the first prefix that holds half of it, along the longer side."""
    sizes = [s for s in sizes if s[1] > 0]
    if not sizes:
        return []
    if len(sizes) == 1:
        return [(sizes[0][0], x, y, w, h)]
    total, run, cut = sum(s for _, s in sizes), 0.0, 0
    while cut < len(sizes) - 1 and run < total / 2:
        run += sizes[cut][1]
        cut += 1
    share = run / total
    if w >= h:
        return treemap(sizes[:cut], x, y, w * share, h) + treemap(sizes[cut:], x + w * share, y, w * (1 - share), h)
    return treemap(sizes[:cut], x, y, w, h * share) + treemap(sizes[cut:], x, y + h * share, w, h * (1 - share))


def kahn_levels(edges: Iterable[tuple[str, str, int]], nodes: Iterable[str]) -> dict[str, int]:
    """Levels from sources down; a cycle is broken at the node with the fewest incoming edges, then the strongest outgoing weight, then the name.

    Degrees are kept up as nodes leave, so each edge is met once.
    """
    left = set(nodes)
    ahead: dict[str, dict[str, int]] = {n: {} for n in left}
    n_in, out = dict.fromkeys(left, 0), dict.fromkeys(left, 0)
    back: dict[str, list[str]] = {n: [] for n in left}
    for (s, d), w in {(s, d): w for s, d, w in edges if s != d and s in left and d in left}.items():
        ahead[s][d] = w
        back[d].append(s)
        n_in[d] += 1
        out[s] += w
    level: dict[str, int] = {}
    depth = 0
    ready = [n for n in left if not n_in[n]]
    while left:
        if not ready:
            ready = [min(left, key=lambda n: (n_in[n], -out[n], n))]
        following = set()
        for n in ready:
            level[n] = depth
            left.discard(n)
        for n in ready:
            for d in ahead[n]:
                n_in[d] -= 1
                if d in left:
                    following.add(d)
            for s in back[n]:
                out[s] -= ahead[s][n]
        ready = [n for n in following if not n_in[n]]
        depth += 1
    return level


def topological(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[str]:
    """Nodes so that edges go forward where they can; ties and cycles by the number of incoming edges, then by name. A heap holds the degrees."""
    left = set(nodes)
    ahead: dict[str, list[str]] = {n: [] for n in left}
    n_in = dict.fromkeys(left, 0)
    for s, d in set(edges):
        if s != d and s in left and d in left:
            ahead[s].append(d)
            n_in[d] += 1
    heap = [(k, n) for n, k in n_in.items()]
    heapq.heapify(heap)
    found = []
    while heap:
        k, n = heapq.heappop(heap)
        if n not in left or k != n_in[n]:
            continue
        left.discard(n)
        found.append(n)
        for d in ahead[n]:
            if d in left:
                n_in[d] -= 1
                heapq.heappush(heap, (n_in[d], d))
    return found
