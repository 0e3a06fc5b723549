"""Totals, frequencies, duplicates of literals, ratios, size limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import is_trivial_number

#: Lines over which a file, class, function or method is too long.
SIZE_LIMITS = {"file": 900, "class": 800, "function": 700, "method": 500}


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.when(whole == 0, F.lit(1)).otherwise(whole))


def frequencies(rows: DataFrame, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def merged_frequencies(rows: DataFrame, column: str) -> DataFrame:
    """Sum of frequency maps, key by key."""
    return rows.select(F.explode(column).alias("value", "n")).groupBy("value").agg(F.sum("n").alias("n"))


def duplicated(freq: DataFrame, numeric: bool = False) -> DataFrame:
    """total and duplicated occurrences (of values that occur twice or more); numbers that are -1, 0 or 1 aren't held against anyone."""
    counted = F.col("n") >= 2
    if numeric:
        counted = counted & ~is_trivial_number(F.col("value"))
    return freq.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.sum(F.when(counted, F.col("n"))), F.lit(0)).cast("long").alias("duplicated"))


def with_limits(artifacts: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """artifacts: kind, loc. Adds limit and over, the share by which loc exceeds it. The limits are a handful of rows."""
    pairs = list((limits or SIZE_LIMITS).items())
    table = artifacts.sparkSession.createDataFrame(pairs, "kind string, `limit` long")
    over = F.greatest(F.lit(0.0), (F.col("loc") - F.col("limit")).cast("double") / F.col("limit"))
    return artifacts.join(F.broadcast(table), "kind").withColumn("over", over)


def size_score(limited: DataFrame) -> DataFrame:
    """1 less the mean excess over all artifacts, within 0 and 1; 1 without artifacts."""
    mean = F.coalesce(F.sum("over") / F.when(F.count("*") > 0, F.count("*")), F.lit(0.0))
    return limited.agg(F.count("*").alias("n"), F.count_if(F.col("loc") > F.col("limit")).alias("violations"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean)).alias("score"))


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in a stated order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def top_with_rest(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank, and how many more there are."""
    own = Window.partitionBy(*key)
    ranked = rows.withColumns({"rank": F.row_number().over(own.orderBy(*order)), "more": F.greatest(F.count("*").over(own) - k, F.lit(0))})
    return ranked.where(F.col("rank") <= k)


def budgeted(rows: DataFrame, key: list[str], order: list[Column], size: str, budget: Column) -> DataFrame:
    """What each row gets of its key's budget, in order, until it's spent."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(size), budget - before)))


def rolled_up(files: DataFrame, path: str, size: str) -> DataFrame:
    """(folder, files, total) for every folder on the way to a file."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = files.where(F.instr(path, "/") > 0).select(F.explode(prefixes).alias("folder"), F.col(size).alias("size"))
    return below.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("total"))
