"""Near-duplicates by bounded edit distance: of short code-like strings, and of whole texts as words.

Equal items are one class, known by its least id. Results are the members of the classes and the links between classes;
copies are never exploded to pairs, and what pairs add up to follows from the classes' sizes (weights).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.store import materialize


def most_edits(n: Column, threshold: float) -> Column:
    return F.floor((F.lit(1.0) - F.lit(threshold)) * n).cast("int")


def similar_codes(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """items: id, signature, code (a character for each token) -> members (id, class), links (a, b, similarity) of classes with 1 - distance / longer >= threshold, a < b.

    Only equal signatures meet, and equal codes are one class. A code that k edits turn into another leaves one of any k + 1
    pieces of the longer one whole, at most k places away. So pieces of the longer are joined by equality with the shorter's
    substrings of that length, and only classes that share one are measured; no class meets all others.
    """
    whole = items.where("code is not null and signature is not null").select("id", "signature", "code").distinct()
    classes = whole.groupBy("signature", "code").agg(F.min("id").alias("rep")).withColumn("n", F.length("code"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "similar-classes")
    members = whole.join(classes.select("signature", "code", "rep"), ["signature", "code"]).select("id", F.col("rep").alias("class"))
    some = classes.where("n > 0")
    piece = lambda n: F.floor(n / (most_edits(n, threshold) + 1)).cast("int")
    k = most_edits(F.col("n"), threshold)
    pieces = some.withColumn("size", piece(F.col("n"))).select("signature", "size", F.col("cid").alias("long"), F.col("n").alias("n_long"), k.alias("k"), F.explode(F.transform(F.sequence(F.lit(0), k), lambda i: F.struct((i * F.col("size")).alias("at"), F.substr("code", i * F.col("size") + 1, F.col("size")).alias("gram")))).alias("p"))
    sizes = F.array_distinct(F.transform(F.sequence(F.col("n"), F.floor(F.col("n") / F.lit(threshold)).cast("int") + 1), piece))
    parts = some.withColumn("size", F.explode(sizes)).where("size between 1 and n")
    parts = parts.select("signature", "size", F.col("cid").alias("short"), F.col("n").alias("n_short"), F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda i: F.struct(i.alias("at"), F.substr("code", i + 1, F.col("size")).alias("gram")))).alias("q"))
    pieces, parts = pieces.select("signature", "size", "p.gram", "long", "n_long", "k", F.col("p.at").alias("at_long")), parts.select("signature", "size", "q.gram", "short", "n_short", F.col("q.at").alias("at_short"))
    close = (F.abs(F.col("at_long") - F.col("at_short")) <= F.col("k")) & (F.col("n_short") <= F.col("n_long")) & (F.col("n_short") >= F.col("n_long") * F.lit(threshold)) & (F.col("long") != F.col("short"))
    met = pieces.join(parts, ["signature", "size", "gram"]).where(close).select(F.least("long", "short").alias("x"), F.greatest("long", "short").alias("y")).distinct()
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("code").alias(f"code_{c}"), F.col("rep").alias(f"rep_{c}"), F.col("n").alias(f"n_{c}"))
    near = met.join(side("x"), "x").join(side("y"), "y")
    longer = F.greatest("n_x", "n_y")
    near = near.withColumn("distance", F.call_function("levenshtein", "code_x", "code_y", most_edits(longer, threshold))).where("distance >= 0")
    return members, near.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"), (1 - F.col("distance") / longer.cast("double")).alias("similarity"))


def weights(members: DataFrame, links: DataFrame, size: str = "loc") -> DataFrame:
    """members: class and ``size``, a row for each; links: a, b, similarity -> (class, pairs, impact): what all pairs of members add up to.

    A pair's impact is its similarity times the lesser of both sizes; it counts for its class, that of a link for class a. Members are
    counted by size first, so a class of very many is a row for each size that it has.
    """
    held = materialize(members.groupBy("class", F.col(size).alias("size")).agg(F.count("*").alias("n")), "similar-sizes")
    one = lambda k: held.select(F.col("class").alias(f"class_{k}"), F.col("size").alias(f"size_{k}"), F.col("n").alias(f"n_{k}"))
    inside = one("x").join(one("y"), (F.col("class_x") == F.col("class_y")) & (F.col("size_x") <= F.col("size_y")))
    number = F.when(F.col("size_x") == F.col("size_y"), F.col("n_x") * (F.col("n_x") - 1) / 2).otherwise(F.col("n_x") * F.col("n_y")).cast("long")
    same = inside.select(F.col("class_x").alias("class"), number.alias("pairs"), (number * F.col("size_x").cast("double")).alias("impact"))
    met = links.join(one("x"), F.col("a") == F.col("class_x")).join(one("y"), F.col("b") == F.col("class_y"))
    number = F.col("n_x") * F.col("n_y")
    apart = met.select(F.col("a").alias("class"), number.alias("pairs"), (number * F.least("size_x", "size_y") * F.col("similarity")).alias("impact"))
    return same.unionByName(apart).groupBy("class").agg(F.sum("pairs").alias("pairs"), F.sum("impact").alias("impact")).where("pairs > 0")


def listed(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, similarity): each link, and each member with its class; so all that is alike is listed once, and copies of one item in proportion to their number."""
    same = members.where(F.col("id") != F.col("class")).select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return links.select("a", "b", "similarity").unionByName(same)


#: Words in a row that count as one gram of a text, and places of the table that tells common grams from rare ones.
GRAM, PLACES = 2, 1 << 18
#: Places of a bag, a text's words counted by hash up to 255.
BAG = 128
#: Rows of a lookup table that may be broadcast.
BROADCAST_ROWS = 200_000


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """Edit distance of two lists of words, or any number over most where it is more: a column of the table is one long integer."""
    if max(len(a), len(b)) - (Counter(a) & Counter(b)).total() > most:
        return most + 1
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for k, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << k
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, found = every, 0, len(a)
    for k, word in enumerate(b, 1):
        same = at.get(word, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        plus, minus = (down | ~(h | up)) & every, up & h
        found += (plus >> last) - (minus >> last)
        if found - (len(b) - k) > most:
            return most + 1
        plus, minus = (plus << 1 | 1) & every, minus << 1 & every
        up, down = (minus | ~(v | plus)) & every, plus & v
    return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def grams_of(words: np.ndarray, signature: int) -> np.ndarray:
    """Hashes of a text's grams; those of a gram that occurs again differ by its number, so that equal hashes count as often as they occur."""
    if len(words) < GRAM:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - GRAM + 1, signature, np.int64).view(np.uint64)
    for k in range(GRAM):
        total = _mixed(total + words[k : len(words) - GRAM + 1 + k])
    total.sort()
    runs = np.flatnonzero(np.concatenate(([True], total[1:] != total[:-1])))
    number = np.arange(len(total)) - np.repeat(runs, np.diff(np.append(runs, len(total))))
    return _mixed(total + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def similar_texts(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """items: id, signature, text -> members (id, class), links (a, b, similarity) of classes with a < b, over whole texts as lower-cased words: distance <= most_edits(longer).

    Only equal signatures meet, and equal texts are one class. An edit changes at most GRAM grams, so two texts that are k edits
    apart share all but GRAM * k grams of each; with all grams in one order, the first GRAM * k + 1 of both have one in common.
    The order goes from rare to common by a table of counts of fixed size, so common passages are never joined on while
    a text has enough else. What shares one is held against the bound that the places in both orders leave, then measured.
    """
    spark = items.sparkSession
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    code = items.where("text is not null").select("id", "signature", plain.alias("code")).withColumn("digest", F.unhex(F.md5(F.concat_ws("\n", F.coalesce("signature", F.lit("")), "code").cast("binary")))).where("signature is not null")
    members = materialize(code.select("id", "digest"), "similar-members")
    least = members.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    again = materialize(members.join(least, "digest").where("id > least").select("id", "digest"), "similar-copies")  # by both, as ids may repeat
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    key = F.xxhash64("digest").alias("key")  # equal keys of different texts only bring further texts to be measured
    hashed = lambda df: df.select(key, F.xxhash64("signature").alias("s"), F.transform(F.split("code", " "), lambda w: F.xxhash64(w)).alias("words"))
    filled = code.where("code <> ''")
    words = hashed(filled.join(small(again), ["id", "digest"], "left_anti"))

    def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        column = batch.column(2)
        values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        for row, signature in enumerate(batch.column(1).to_pylist()):
            yield row, int(at[row + 1] - at[row]), grams_of(values[at[row] : at[row + 1]], signature)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PLACES, np.int64)
        for batch in batches:
            for _, _, grams in texts(batch):
                np.add.at(n, (grams % np.uint64(PLACES)).astype(np.int64), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["place", "n"])

    # The order may be any, so the counts of an eighth of the documents will do; nothing else rests on them.
    totals = hashed(filled.where("pmod(xxhash64(id), 8) = 0")).mapInArrow(counted, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    common = np.zeros(PLACES, np.int64)
    common[totals["place"].to_numpy(np.int64)] = totals["n"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(common)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for batch in batches:
            rows, sizes, keys, places = [], [], [], []
            for row, n, grams in texts(batch):
                most = math.floor((1.0 - threshold) * (math.floor(n / threshold) + 1))
                if not most:
                    continue  # only equal texts are near enough
                ranked = grams[np.lexsort((grams, order[(grams % np.uint64(PLACES)).astype(np.int64)]))][: GRAM * most + 1]
                rows.append(np.full(len(ranked), row))
                sizes.append(np.full(len(ranked), n, np.int32))
                keys.append(ranked.view(np.int64))
                places.append(np.arange(len(ranked), dtype=np.int32))
            if rows:
                own = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(np.concatenate(c)) for c in (sizes, keys, places))], names=["key", "n", "gram", "place"])

    first = words.mapInArrow(firsts, "key long, n int, gram long, place int")
    first = materialize(first, "similar-grams")  # read on both sides of a join whose large partitions the engine may split
    side = lambda k: first.select("gram", F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("place").alias(f"at_{k}"))
    longer, shorter = F.greatest("n_x", "n_y"), F.least("n_x", "n_y")
    met = side("x").join(side("y"), "gram").where((F.col("x") < F.col("y")) & (longer - shorter <= most_edits(longer, threshold)))
    met = met.groupBy("x", "y", "n_x", "n_y").agg(F.count("*").alias("shared"), F.max("at_x").alias("at_x"), F.max("at_y").alias("at_y"))
    rest = F.least(F.col("n_x") - GRAM - F.col("at_x"), F.col("n_y") - GRAM - F.col("at_y"))
    pairs = materialize(met.where(F.col("shared") + rest >= longer - GRAM + 1 - GRAM * most_edits(longer, threshold)).select("x", "y", most_edits(longer, threshold).alias("most")), "similar-pairs")

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            bags = [np.minimum(np.bincount(values[i:j], minlength=BAG), 255).astype(np.uint8).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bags, pa.binary())], names=["key", "digest", "signature", "bag"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An edit takes at most one word out of a bag and puts one in."""
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16) for i in (3, 4))
                out, into = np.maximum(a - b, 0).sum(1), np.maximum(b - a, 0).sum(1)
                yield batch.select([0, 1]).filter(pa.array(np.maximum(out, into) <= batch.column(2).to_numpy()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, similar = [], []
            for row, (p, q) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = p.as_py().split(" "), q.as_py().split(" ")
                n = max(len(a), len(b))
                most = math.floor((1.0 - threshold) * n)
                if (d := word_distance(a, b, most)) <= most:
                    keep.append(row)
                    similar.append(1 - d / n)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(similar, pa.float64())], names=["x", "y", "similarity"])

    wanted = materialize(pairs.select(F.col("x").alias("key")).union(pairs.select("y")).distinct(), "similar-wanted")
    found = filled.select("id", key, "digest", "signature", "code").join(small(wanted), "key", "left_semi").join(small(again), ["id", "digest"], "left_anti")
    found = materialize(found.dropDuplicates(["digest"]).select("key", "digest", "signature", "code"), "similar-texts")
    bags = materialize(found.select("key", "digest", "signature", F.transform(F.split("code", " "), lambda w: F.pmod(F.xxhash64(w), F.lit(BAG)).cast("int")).alias("at")).mapInArrow(bagged, "key long, digest binary, signature string, bag binary"), "similar-bags")
    held_bags = small(bags)
    bag = lambda k: held_bags.select(F.col("key").alias(f"key_{k}"), F.col("digest").alias(k), F.col("signature").alias(f"s_{k}"), F.col("bag").alias(f"bag_{k}"))
    both = pairs.toDF("key_x", "key_y", "most").join(bag("x"), "key_x").join(bag("y"), "key_y").where("s_x = s_y")
    both = materialize(both.select("x", "y", "most", "bag_x", "bag_y").mapInArrow(likely, "x binary, y binary"), "similar-likely")
    text = lambda k: found.select(F.col("digest").alias(k), F.col("code").alias(f"text_{k}"))
    near = materialize(both.join(text("x"), "x").join(text("y"), "y").select("x", "y", "text_x", "text_y").mapInArrow(measured, "x binary, y binary, similarity double"), "similar-near")
    reps = materialize(members.groupBy("digest").agg(F.min("id").alias("rep")), "similar-reps")
    rep = lambda k: reps.select(F.col("digest").alias(k), F.col("rep").alias(f"rep_{k}"))
    links = near.join(rep("x"), "x").join(rep("y"), "y").select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"), "similarity")
    return members.join(reps, "digest").select("id", F.col("rep").alias("class")), links
