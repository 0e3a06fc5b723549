"""Quality by hierarchical empirical Bayes over sites.

A classifier of single documents is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, those of least hash): logistic
regression over the text's shape and whether it holds a word of a lexicon that the sample teaches. Its probabilities are
summed by host and by path under it. Each host's mean is shrunk to the global one and each path's to its host's, by
strengths estimated from the spread of hosts around the global mean and of paths around their host's (method of moments),
so a site with few documents has the prior's posterior and one with many its own. The document's own share is left out of
both its host's and its path's sums, and the site's odds against the global ones are added to the document's, as Bayes'
rule has it, with no bound.

Groups are summed with partial sums on every task, so a hot host is never gathered; the posteriors have a row for each path.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import lean, materialize, small

SAMPLE_ROWS = 20_000
#: Lengths in bytes of the beginnings of words that may enter the lexicon besides whole words, so that inflected forms count.
STEMS = (5, 6, 7, 8)
#: Rejected documents that a word must be in, as a number and as a share of all rejected ones in the sample, and the share
#: of the word's documents that must be rejected, to enter the lexicon. Words of a few copies of one text don't.
WORD_DOCS, WORD_SHARE, WORD_PURITY = 8, 0.01, 0.98
FEATURES = 12

UPPER, LOWER, DIGIT, SPACE_BYTES = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"))
MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~`_=+<>\\/{}[]", np.uint8))
STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:?'\"()-", np.uint8))


def stems(words: set[bytes]) -> set[bytes]:
    """Words and their beginnings, marked as such."""
    bare = {w.strip(b".,;:!?'\"()-") for w in words}
    return bare.union(*[{w[:k] + b"*" for w in bare if len(w) > k} for k in STEMS])


def features(text: str, lexicon: frozenset[bytes]) -> list[float]:
    """The text's shape: logs and shares, none over a few units."""
    data = text.encode()
    words = data.lower().split()
    n, size = max(1, len(words)), max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = set(words)
    letters = max(1, int(counts[UPPER].sum() + counts[LOWER].sum()))
    hit = bool(lexicon) and not lexicon.isdisjoint(stems(kinds))
    return [
        math.log1p(len(words)) / 5,
        int(counts[UPPER].sum()) / letters,
        min(1.0, int(counts[MARKS].sum()) / n),
        min(1.0, int(counts[33]) / n),
        min(1.0, int(counts[124]) / n),
        min(1.0, int(counts[DIGIT].sum()) / size),
        min(1.0, int(counts[STOPS].sum()) / n),
        math.log1p(int(counts.sum() - counts[SPACE_BYTES].sum()) / n),
        len(kinds) / n,
        (1 - len(kinds) / n) * math.log1p(n) / 5,
        sum(map(operator.eq, words, words[1:])) / n,
        float(hit),
    ]


@dataclass
class Model:
    lexicon: frozenset[bytes]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def logit(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(((rows - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1], -30, 30)


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method, every row with the same weight, so that doubtful documents go with the majority."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, keep = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep + 1e-9), a.T @ (y - p) - keep * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """labels: doc_id and accept (0 or 1). At most ``rows`` labelled documents are used; without both kinds, all is accepted.

    A doc_id that is labelled more than once counts as rejected if any label says so; of texts that share one, the one of
    least hash is used, so repeated rows don't take the sample over its bound.
    """
    sample = labels.where("doc_id is not null and accept is not null").groupBy("doc_id").agg(F.min(F.col("accept").cast("int")).alias("accept")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = lean(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    own = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"), F.first("accept").alias("accept"))
    known = materialize(own.select("first.text", "accept"), "quality-sample")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, accept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[accept].update(stems(set(text.encode().lower().split())))
        for accept, found in enumerate(seen):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([accept] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["word", "accept", "n"])

    counts = known.mapInArrow(spell, "word binary, accept int, n long").groupBy("word").agg(F.sum(F.when(F.col("accept") == 0, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
    least = max(WORD_DOCS, WORD_SHARE * known.where("accept = 0").count())
    listed = counts.where((F.col("bad") >= least) & (F.col("bad") >= WORD_PURITY * F.col("n")) & (F.octet_length("word") >= 3)).collect()  # a hundred times the words of a document at most
    lexicon = frozenset(bytes(r["word"]) for r in listed)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], names=["x", "accept"])

    found = known.mapInArrow(shape, "x array<double>, accept int").toPandas()  # at most the sample's rows
    y = found["accept"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(frozenset(), np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES), 3.0])
    order = np.lexsort(np.array(found["x"].tolist()).T)
    return Model(lexicon, *regress(np.array(found["x"].tolist())[order], y[order]))


def evidence(rows: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """rows, with logit, the evidence of the column text, added; without text unless it's kept. A null text is scored as an empty one."""
    at = rows.columns.index("text")
    kept = [f for f in rows.schema if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([features(t or "", model.lexicon) for t in batch.column(at).to_pylist()]).reshape(-1, FEATURES)
            columns = [c for k, c in enumerate(batch.columns) if keep_text or k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.logit(made))], names=[*(f.name for f in kept), "logit"])

    return lean(rows).mapInArrow(run, StructType([*kept, StructField("logit", DoubleType())]))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


@dataclass
class Prior:
    """The global mean, and for each level the weight of one document against the prior above it (1 / prior observations)."""

    mean: float
    host: float
    path: float


def weight(spread: float, groups: int, within: float, room: float, mean: float) -> float:
    """Weight of a document, from the weighted squares of group means around their centre: 0 if groups differ no more than by chance.

    spread's expectation is groups * within + room * between, and a Beta prior's variance is mean * (1 - mean) / (observations + 1).
    At least one observation is left to the prior, so that a posterior is never 0 or 1.
    """
    between = (spread - groups * within) / room if room > 1e-9 else 0.0
    return 1 / max(1.0, mean * (1 - mean) / between - 1) if between > 0 else 0.0


def posteriors(scored: DataFrame) -> tuple[DataFrame, Prior]:
    """scored: host, path and p -> (host, path, n, s: documents and sum of the path, hn, hs: of its host) and the priors.

    Sums by path and host with partial sums on every task; a row for each path is written, a handful of totals come to the driver.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("pp").alias("hpp"))
    sites = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "quality-posteriors")
    square = lambda s, n: F.sum(F.col(s) * F.col(s) / F.col(n))
    mean = F.col("hs") / F.col("hn")
    around = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2))
    t = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("pp").alias("pp"), F.count("*").alias("k"), square("s", "n").alias("square"), around.alias("spread"), F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("share")).first()
    u = hosts.agg(F.count("*").alias("k"), square("hs", "hn").alias("square"), F.sum(F.col("hn") * F.col("hn")).alias("nn")).first()
    n = t["n"] or 0
    if not n:
        return sites, Prior(0.5, 0.0, 0.0)
    mean = min(1 - 1e-6, max(1e-6, t["s"] / n))
    in_path = max(0.0, t["pp"] - t["square"]) / max(1, n - t["k"])
    in_host = max(0.0, t["pp"] - u["square"]) / max(1, n - u["k"])
    by_host = weight(u["square"] - t["s"] ** 2 / n, u["k"] - 1, in_host, n - u["nn"] / n, mean)
    by_path = weight(t["spread"], t["k"] - u["k"], in_path, n - t["share"], mean)
    return sites, Prior(mean, by_host, by_path)


def combine(scored: DataFrame, sites: DataFrame, prior: Prior) -> DataFrame:
    """Adds site (the path's posterior without the document's own share), score and accepted to scored (host, path, logit, p)."""
    told = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "hn", "hs")
    joined = scored.join(small(told, sites.count()), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    m = (F.lit(prior.mean) + F.lit(prior.host) * (F.col("hs") - F.col("p"))) / (1 + F.lit(prior.host) * (F.col("hn") - 1))
    site = (m + F.lit(prior.path) * (F.col("s") - F.col("p"))) / (1 + F.lit(prior.path) * (F.col("n") - 1))
    shift = _log_odds(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), site))) - F.lit(math.log(prior.mean / (1 - prior.mean)))
    out = joined.withColumn("site", site).withColumn("score", _sigmoid(F.col("logit") + shift))
    return out.withColumn("accepted", F.col("score") >= 0.5).drop("h", "q", "n", "s", "hn", "hs")


def accepted_labels(labels: DataFrame) -> DataFrame:
    """A labelled row is accepted if its quality is 1 and it isn't toxic; rows without a quality say nothing."""
    return labels.select("doc_id", F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("accept"))


def sites_of_documents() -> list[Column]:
    """Documents have no address: their source is the host, and the language under it the path."""
    return [F.col("source").alias("host"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("path")]


def site_of_url(url: Column, depth: int = 1) -> tuple[Column, Column]:
    """(host, path up to depth parts) of an address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    parts = F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1), "/")
    return host, F.concat_ws("/", host, F.slice(parts, 1, depth))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, host, path, logit, p, site, score and accepted for each row of docs.

    Null and empty texts are scored as any, very long ones whole; a null source is a host of its own, a null language a path
    of its own; repeated rows are scored each; without labels of both kinds all is accepted; an empty table gives an empty
    one; other columns are dropped.
    """
    model = fit(docs, accepted_labels(labels))
    scored = evidence(docs.select("doc_id", "text", *sites_of_documents()), model).withColumn("p", _sigmoid(F.col("logit")))
    scored = materialize(scored, "quality-scores")
    return combine(scored, *posteriors(scored))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score_documents accepts, whole and with all columns. Texts are scored twice rather than moved.

    Repeated rows are each kept or dropped alike; null and empty texts are scored as empty ones, very long ones whole; columns
    of any other names are kept; an empty table gives an empty one.
    """
    model = fit(docs, accepted_labels(labels))
    brief = evidence(docs.select("text", *sites_of_documents()), model).withColumn("p", _sigmoid(F.col("logit")))
    sites, prior = posteriors(brief)
    names = {c: "text" if c == "text" else f"own_{k}" for k, c in enumerate(docs.columns)}  # whatever else the columns are called
    placed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *sites_of_documents())
    whole = evidence(placed, model, keep_text=True).withColumn("p", _sigmoid(F.col("logit")))
    kept = combine(whole, sites, prior).where("accepted")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
