"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash. Words are summed by source and the hash's first digit (1024 buckets). The bucket in which
a source's running sum crosses its budget is its boundary bucket; only that one is refined, by the next digit, until
the hash's last. What stands below the threshold is taken, the row at the threshold in part, what stands above is not.
Thresholds are nested: a larger budget keeps all that a smaller one takes. Rows are filtered by comparing their hash
with their source's threshold; they are never sorted, and a hot source has at most 1024 sums for each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

BITS, LEVELS = 10, 6
WORD = r"[^\x20\x09-\x0D]+"


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size) -> also target.

    Sources are ordered by code point, null last, and weighted in turn. They share ``percent`` of all words by weight,
    none over ``most`` times its own; what is over is shared out again by weight. The water level of that process is
    found directly: with the sources in the order in which they fill up, it is the first level at which the next one
    doesn't fill. One row for each source: these windows are over sources, never over documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("fills_at", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns({"total": F.sum("source_size").over(every) * percent / 100.0, "filled": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "emptier": F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))})
    w = w.withColumn("level", (F.col("total") - F.col("filled")) / F.col("emptier"))
    w = w.withColumn("water", F.first(F.when(F.col("level") < F.col("fills_at"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("water").isNull() | (F.col("fills_at") <= F.col("water")), F.col("cap")).otherwise(F.col("weight") * F.col("water"))
    return w.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, n_sources: int, goal: DataFrame, most: int = 2) -> DataFrame:
    """rows: source, size and a 60-bit hash h >= 0; goal: source, source_size, target. Adds to goal what taken() reads.

    rounds is how often the target holds the whole source, prefix the hash at which the rest of the budget runs out,
    left what the rows of that hash still get, and cell what they hold.
    """
    state = goal.withColumns({
        "rounds": F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"),
        "prefix": F.lit(0).cast("long"),
    }).withColumn("left", F.floor(F.col("target") + 0.5).cast("long") - F.col("rounds") * F.col("source_size")).withColumn("cell", F.col("source_size"))
    state = materialize(state, "mix-goal")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        known = state.select(F.col("source").alias("s"), "prefix", F.col("left").alias("budget"))
        digit = F.shiftrightunsigned("h", shift).cast("long")
        cells = rows.join(small(known, n_sources), F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("h", shift + BITS) == F.col("prefix"))).groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
        run = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("digit")))
        edge = run.where("upto > budget").groupBy("source").agg(F.min(F.struct("digit", (F.col("budget") - F.col("upto") + F.col("words")).alias("left"), "words")).alias("edge"))
        full = F.col("edge").isNull()  # the budget holds the whole cell: no threshold below its end
        state = state.join(small(edge.withColumnRenamed("source", "s"), n_sources), F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "rounds",
            F.when(full, F.shiftleft(F.col("prefix") + 1, BITS) - 1).otherwise(F.col("edge.digit")).alias("prefix"),
            F.when(full, F.lit(0)).otherwise(F.col("edge.left")).cast("long").alias("left"),
            F.when(full, F.lit(0)).otherwise(F.col("edge.words")).cast("long").alias("cell"),
        )
        state = materialize(state, "mix-state")
    return state


def taken(rows: DataFrame, n_sources: int, state: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows.

    taken is size times the rounds, and once more for hashes below the source's threshold; rows at the threshold share
    what is left, so a source's words are within one for each such row of its target.
    """
    known = state.withColumnRenamed("source", "s")
    more = F.when(F.col("h") < F.col("prefix"), F.col("size")).when((F.col("h") == F.col("prefix")) & (F.col("cell") > 0), F.floor(F.col("size").cast("double") * F.col("left") / F.col("cell"))).otherwise(0)
    return rows.join(small(known, n_sources), F.col("source").eqNullSafe(F.col("s"))).withColumn("taken", (F.col("size") * F.col("rounds") + more).cast("long")).drop("s", "rounds", "prefix", "left", "cell")


def measured(docs: DataFrame) -> DataFrame:
    """docs with size in words and hash h; a null text has no words."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")).cast("binary"))
    return docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "h": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")})


def planned(rows: DataFrame) -> tuple[int, DataFrame]:
    """Number of sources and thresholds for rows of source, size and h."""
    totals = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    n_sources = totals.count()
    return n_sources, thresholds(rows, n_sources, targets(totals))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h, source_size, target and taken for each row of docs.

    A null source is a source of its own, the last; a source without words gets nothing; rows that share a doc_id
    share a hash, and where the threshold falls on it they are taken in equal parts. An empty table gives an empty one.
    """
    rows = materialize(measured(docs.select("doc_id", "source", "text")).drop("text"), "mix-rows")
    return taken(rows, *planned(rows))


def draw_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: each row, whole, as often as the mix takes it.

    No text is cut: rows at a source's threshold, which mix_documents takes in part, are drawn once more if the source is
    owed half of their words or more, so a source's words are within that one document (with rows that share its hash) of
    its target. Rows without words are drawn once, null and empty texts alike; very long texts are whole; an empty table gives
    an empty one; columns of any names are kept. Only sizes and hashes are written to find the thresholds; the texts stay
    where they are and are filtered in place.
    """
    rows = materialize(measured(docs.select("doc_id", "source", "text")).drop("text"), "mix-rows")
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}  # whatever else the columns are called
    n_sources, state = planned(rows)
    known = state.withColumnRenamed("source", "s")
    whole = measured(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "doc_id", "source", "text"))
    more = (F.col("h") < F.col("prefix")) | ((F.col("h") == F.col("prefix")) & (F.col("left") > 0) & (F.col("left") * 2 >= F.col("cell")))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("rounds") + more.cast("long")).cast("int")
    drawn = whole.join(small(known, n_sources), F.col("source").eqNullSafe(F.col("s"))).withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return drawn.select(*[F.col(n).alias(c) for c, n in names.items()])
