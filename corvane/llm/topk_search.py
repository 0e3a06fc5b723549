"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length into buckets of some thousand rows. A bucket's largest length and a query's best k so far
give a local threshold on the cosine. Over 1, the bucket is skipped for that query. If it's high, coordinates prune: a
vector that reaches it must have, in each of the query's largest coordinates, a value in a range that follows from the
threshold. If it's low, length prunes: only the bucket's longer vectors can reach it. What is left is verified by integer
products, exactly.

Queries stay on the executors: they are dealt to groups of bounded size, and a group meets a bucket in one task. First
all groups meet the bucket of the longest vectors, which gives thresholds. Then groups are made anew by local threshold,
so that high ones stand together, and a bucket goes only to groups that it can still give something. Only a number for
each group and bucket comes to the driver to tell which meet. A task gives k rows a query at most, merged by a ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize
from .vectors import finite, groups_by_length

BUCKET_ROWS = 8192
GROUP_ROWS = 2048
COORDINATES = 3
#: Local cosine threshold from which coordinates prune better than length does.
BY_COORDINATE = 0.7
EXACT = 2.0**53


def integers(vectors: DataFrame, scale: float) -> DataFrame:
    """uid, vec_id, norm and floor(scale * x) of each component, as packed doubles, which hold integers exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in groups_by_length(batch.column(2)):
                v = np.floor(x * scale)
                large = np.abs(v).max(1, initial=0)
                norm = large * np.sqrt(((v / np.maximum(large, 1)[:, None]) ** 2).sum(1))
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(norm, pa.float64()), pa.array([r.tobytes() for r in v], pa.binary())], names=["uid", "vec_id", "norm", "packed"])

    return lean(vectors).select("uid", "vec_id", "embedding").mapInArrow(run, "uid long, vec_id long, norm double, packed binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices: a by b. Exact, in Python's integers where doubles aren't enough."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(a).dot(whole(b).T), -(2**63), 2**63 - 1).astype(np.int64)


def survivors(v: np.ndarray, norm: np.ndarray, q: np.ndarray, q_norm: float, at_least: float) -> np.ndarray:
    """Rows of a block, sorted by falling length, that may score at_least or more with q."""
    if not len(v) or q_norm == 0 or at_least <= -q_norm * norm[0]:
        return np.arange(len(v))
    slack = 1e-9 * (abs(at_least) + q_norm * norm[0])
    goal = at_least - slack
    if goal <= 0:
        return np.arange(len(v))
    if goal > q_norm * norm[0]:
        return np.arange(0)
    rows = np.arange(int(np.searchsorted(-norm, -goal / q_norm, "right")))  # length pruning
    cosine = goal / (q_norm * norm[0])
    if cosine >= BY_COORDINATE and len(rows):
        u = q / q_norm
        for f in np.argsort(-np.abs(u), kind="stable")[:COORDINATES]:
            x = v[rows, f] / norm[rows]
            reach = u[f] * x + math.sqrt(max(0.0, 1 - u[f] ** 2)) * np.sqrt(np.maximum(0, 1 - x * x))
            rows = rows[reach * q_norm * norm[rows] >= goal - slack]
    return rows


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


LAST = 2**63 - 1
FOUND = "query_uid long, query_id long, vec_id long, uid long, score long"


def _search(k: int):
    """The k best of a bucket for each query of a group that doesn't skip it."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        ids = pa.array([], pa.int64())
        if asked.num_rows and rows.num_rows:
            uid, vec_id = rows["uid"].to_numpy(), rows["vec_id"].combine_chunks().fill_null(LAST).to_numpy()
            norm, packed = rows["norm"].to_numpy(), rows["packed"].to_pylist()
            order = np.lexsort((uid, vec_id, -norm))
            q_uid, q_norm, known = (asked[c].to_numpy() for c in ("uid", "norm", "known"))
            q_packed = asked["packed"].to_pylist()
            places: list[np.ndarray] = []
            sizes, q_sizes = np.array([len(packed[i]) for i in order]), np.array([len(p) for p in q_packed])
            for size in np.unique(sizes):
                part, mine = order[sizes == size], np.flatnonzero(q_sizes == size)
                v = np.frombuffer(b"".join(packed[i] for i in part), np.float64).reshape(len(part), -1)
                for first in range(0, len(mine), 256):
                    some = mine[first : first + 256]
                    q = np.frombuffer(b"".join(q_packed[i] for i in some), np.float64).reshape(len(some), -1)
                    left = [survivors(v, norm[part], q[n], float(q_norm[i]), float(known[i])) for n, i in enumerate(some)]
                    shared = sum(map(len, left)) * 2 > len(v) * len(some)
                    every = products(v, q) if shared else None
                    for n, (i, own) in enumerate(zip(some, left, strict=True)):
                        own = own[uid[part][own] != q_uid[i]]
                        scores = every[own, n] if shared else products(v[own], q[n : n + 1])[:, 0]
                        top = best(vec_id[part][own], scores, k)
                        places.append(part[own][top])
                        found[0].append(np.full(len(top), i))
                        found[1].append(scores[top])
            at = np.concatenate(places) if places else np.zeros(0, np.int64)
            asking, scores = np.concatenate(found[0]), np.concatenate(found[1])
            return pa.table([asked["uid"].take(asking), asked["vec_id"].take(asking), rows["vec_id"].take(at), rows["uid"].take(at), pa.array(scores, pa.int64())], names=["query_uid", "query_id", "vec_id", "uid", "score"])
        return pa.table([ids] * 5, names=["query_uid", "query_id", "vec_id", "uid", "score"])

    return run


def _meet(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """asked: queries with grp and the buckets they meet as array ``with``; rows: vectors with bucket and the groups they meet as array ``with``."""
    left = asked.select("grp", F.explode("with").alias("bucket"), "uid", "vec_id", "packed", "norm", "known").groupBy("grp", "bucket")
    right = rows.select("bucket", F.explode("with").alias("grp"), "uid", "vec_id", "packed", "norm").groupBy("grp", "bucket")
    return left.cogroup(right).applyInArrow(_search(k), FOUND)


def _ranged(rows: DataFrame, name: str, n: int, *order: str | Column) -> DataFrame:
    """rows, written, with a number from 0 to n - 1 by ranges of order: the engine may cut more ranges than asked for, neighbours of which then share a number."""
    cut = materialize(rows.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), f"topk-{name}")
    made = max(n, (cut.agg(F.max(name)).first()[0] or 0) + 1)
    return cut.withColumn(name, F.floor(F.col(name) * n / F.lit(made)).cast("int"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows for each query row of vectors (vec_id, embedding).

    Vectors that are null or hold null or non-finite components take no part; a zero vector scores 0; only vectors of the
    same length meet; repeated rows are candidates for each other, and each is a query; a null vec_id stays null, as a
    candidate after all others of its score; scores beyond 64 bits stop at their bounds; an empty table, or none that is a
    query, gives an empty one; other columns are dropped.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("uid", F.monotonically_increasing_id()).where(finite("embedding"))
    packed = materialize(integers(rows, scale), "topk-vectors")
    n_buckets = max(1, math.ceil(packed.count() / BUCKET_ROWS))
    binned = _ranged(packed, "bucket", n_buckets, F.desc("norm"), "uid")
    asked = materialize(packed.where(is_query), "topk-queries")
    n_groups = max(1, math.ceil(asked.count() / GROUP_ROWS))

    groups = F.sequence(F.lit(0), F.lit(n_groups - 1))
    dealt = asked.withColumns({"grp": F.pmod(F.xxhash64("uid"), F.lit(n_groups)).cast("int"), "with": F.array(F.lit(0)), "known": F.lit(-math.inf)})
    first = materialize(_meet(dealt, binned.where("bucket = 0").withColumn("with", groups), k), "topk-first")
    known = first.groupBy("query_uid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("score")).where(F.col("n") >= k)
    told = asked.join(known.withColumnRenamed("query_uid", "uid"), "uid", "left").withColumn("known", F.coalesce("score", F.lit(-math.inf))).drop("n", "score")

    need = F.when(F.col("norm") > 0, F.col("known") * (1 - 1e-9) / F.col("norm")).otherwise(F.lit(-math.inf))  # no shorter vector can reach it
    again = _ranged(told.withColumn("need", need), "grp", n_groups, "need", "uid")
    needs = dict(again.groupBy("grp").agg(F.min("need")).collect())  # a number for each GROUP_ROWS queries
    longest = dict(binned.where("bucket > 0").groupBy("bucket").agg(F.max("norm")).collect())  # and for each BUCKET_ROWS vectors
    grps, bins = sorted(needs), sorted(longest)
    falling, rising = -np.array([longest[b] for b in bins]), np.array([needs[g] for g in grps])  # buckets are numbered by falling length, groups by rising need
    buckets_of = spark.createDataFrame([(g, bins[n - 1] if n else 0) for g, n in zip(grps, np.searchsorted(falling, -rising, "right").tolist(), strict=True)], "grp int, last int")
    groups_of = spark.createDataFrame([(b, grps[n - 1] if n else -1) for b, n in zip(bins, np.searchsorted(rising, -falling, "right").tolist(), strict=True)], "bucket int, last int")
    span = lambda first: F.when(F.col("last") >= first, F.sequence(F.lit(first), "last")).otherwise(F.array().cast("array<int>"))
    again, binned = again.join(F.broadcast(buckets_of), "grp").withColumn("with", span(1)), binned.join(F.broadcast(groups_of), "bucket").withColumn("with", span(0))
    rest = _meet(again, binned, k)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
