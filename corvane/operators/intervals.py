"""Points in intervals, by equality joins alone: which intervals hold a point, the innermost of them, points that none holds.

An interval of whole numbers is cut into blocks of a tree of BASE-fold levels: as many blocks of the highest level as fit, smaller
ones at both ends, some 2 * BASE for each level at most. A point lies in one block of each level. So a point and an interval that
holds it have exactly one block in common, and the join is on (key, level, block): a key with very many intervals or points,
a long file, is spread over its blocks, and no pair is tested in vain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of blocks of 1, 16, 256, ... places; longer intervals take more blocks of the highest level.
BASE, LEVELS = 16, 6


def _at(level: int) -> Callable[[Column], Column]:
    return lambda block: F.struct(F.lit(level).alias("level"), block.alias("block"))


def _blocks(first: Column, last: Column) -> Column:
    """Disjoint blocks (level, block) that make up first to last; none if last is less."""
    none = F.array().cast("array<long>")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    cut = lambda w: (F.ceil(first / F.lit(w)).cast("long"), F.floor((last + 1) / F.lit(w)).cast("long"))
    parts = []
    for level in range(LEVELS):
        low, high = cut(BASE**level)
        if level < LEVELS - 1:
            up, down = cut(BASE ** (level + 1))
            own = F.when(up < down, F.concat(span(low, up * BASE), span(down * BASE, high))).otherwise(span(low, high))
        else:
            own = span(low, high)
        parts.append(F.transform(own, _at(level)))
    return F.concat(*parts)


def with_blocks(intervals: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """intervals, a row for each of their blocks: adds __level and __block."""
    return intervals.withColumn("__b", F.explode(_blocks(F.col(first).cast("long"), F.col(last).cast("long")))).select(*intervals.columns, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))


def at_levels(points: DataFrame, at: str) -> DataFrame:
    """points, a row for each level: adds __level and the __block that holds them there."""
    whole = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(at) / F.lit(BASE**k)).cast("long").alias("block")) for k in range(LEVELS)])
    return points.withColumn("__b", F.explode(whole)).select(*points.columns, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))


def stabbed(points: DataFrame, intervals: DataFrame, by: list[str], at: str = "line", first: str = "first", last: str = "last") -> DataFrame:
    """Every point with every interval of the same ``by`` that holds it, once each; other columns of the two must differ. Null places are in none."""
    return at_levels(points, at).join(with_blocks(intervals, first, last), [*by, "__level", "__block"]).drop("__level", "__block")


def innermost(points: DataFrame, intervals: DataFrame, by: list[str], key: list[str], at: str = "line", first: str = "first", last: str = "last") -> DataFrame:
    """Each point, told apart by ``key``, with the interval that holds it and begins last; of those the one that ends first. Points that none holds are left out."""
    kept = [c for c in intervals.columns if c not in by]
    hit = stabbed(points, intervals, by, at, first, last)
    best = hit.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct(F.col(first), -F.col(last))).alias("__best"))
    return best.select(*key, "__best.*")


def outside(points: DataFrame, intervals: DataFrame, by: list[str], at: str = "line", first: str = "first", last: str = "last") -> DataFrame:
    """The rows of points that no interval of the same ``by`` holds."""
    where = points.select(*by, at).distinct()
    spans = with_blocks(intervals.select(*by, first, last), first, last).select(*by, "__level", "__block").distinct()
    held = at_levels(where, at).join(spans, [*by, "__level", "__block"], "left_semi").select(*by, at).distinct()
    return points.join(held, [*by, at], "left_anti").select(*points.columns)
