"""Source divergence audit: how far each source's words are from those of the other sources, and which words set it apart.

Sort-based streaming. Each task counts the terms of its own documents by (lang, source, term) first, with the number of those
documents, and hands on what it holds whenever that reaches HELD entries; so a frequent term comes to the shuffle as a row
for each task, not for each document. The rows are dealt by (lang, term) and sorted by (term, lang, source) within a
partition (the term first, as its first bytes tell most rows apart); a scan that holds one run at a time adds up document frequencies and counts, keeps the terms that enough
documents have, and gives a row for each source that has the term. These rows give each group's total and vocabulary.

With those, a count becomes a share p. Dealt and sorted once more, now with shares, each run gives partial sums for the pairs of
sources that both have its term. What only one of two sources has depends on its count alone, so it is summed over the
counts that occur, and what neither has is a constant times the number of terms: runs never list absent sources.

All arithmetic is in whole numbers: shares in decimals of 38 digits, sums of a run in 64 bits (a pair's is below 2 ** 62, as
shares add up to about SCALE), and sums over tasks in decimals again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, small

SCALE = 1_000_000_000
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: Entries that a task combines before it hands them on, and rows of a batch that it hands on.
HELD, BATCH = 1_000_000, 20_000
#: Pairs of a run that are computed at once.
PAIRS = 1 << 20

#: ASCII letters in lower case, all other ASCII a blank; what isn't ASCII stands, byte by byte.
_FOLD = bytes(c if c > 127 else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
#: Above a term's count in a task: the documents that hold it, handed on before they are too many for 64 bits.
_ONE, _DOCUMENTS = 1 << 40, 1 << 22

PARTIAL = "lang string, term string, source string, docs long, n long"
KEPT = "lang string, term string, source string, n long, total long, head boolean"


def partial_runs(docs: DataFrame) -> DataFrame:
    """docs: lang, source, text -> PARTIAL: what each task has of a term in a source of a language."""

    def rows(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            terms, counts = pa.array(list(own), pa.binary()).cast(pa.string()), np.fromiter(own.values(), np.int64, len(own))
            for at in range(0, len(terms), BATCH):
                part, both = terms.slice(at, BATCH), counts[at : at + BATCH]
                named = [pa.repeat(pa.scalar(x, pa.string()), len(part)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([named[0], part, named[1], pa.array(both // _ONE), pa.array(both % _ONE)], names=["lang", "term", "source", "docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = documents = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = held.setdefault((lang, source), {})
                size -= len(own)
                for term, n in Counter(text.as_buffer().to_pybytes().translate(_FOLD).split(b" ")).items():
                    own[term] = own.get(term, 0) + _ONE + n
                own.pop(b"", None)
                size, documents = size + len(own), documents + 1
                if size >= HELD or documents >= _DOCUMENTS:
                    yield from rows(held)
                    held, size, documents = {}, 0, 0
        yield from rows(held)

    return lean(docs).select("lang", "source", "text").mapInArrow(run, PARTIAL)


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a run of equal rows begins."""
    n = len(columns[0])
    change = np.ones(n, bool)
    if n > 1:
        change[1:] = False
        for c in columns:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _after(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if held is None else pa.concat_batches([held.cast(batch.schema), batch])


def kept_runs(parts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """parts: PARTIAL -> KEPT: a row for each source of each run that at least ``least`` documents are in.

    n is the source's count, total the run's; head marks one row of each run. Of an unfinished run the scan holds a row a source.
    """

    def added(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = _starts(batch.column(0), batch.column(1), batch.column(2))
        if len(at) == batch.num_rows:
            return batch
        sums = [pa.array(np.add.reduceat(batch.column(k).to_numpy(), at)) for k in (3, 4)]
        first = pa.array(at)
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(first) for k in range(3)), *sums], names=batch.schema.names)

    def told(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = _starts(batch.column(0), batch.column(1))
        sizes = np.diff(np.append(at, batch.num_rows))
        keep = np.repeat(np.add.reduceat(batch.column(3).to_numpy(), at) >= least, sizes)
        total = np.repeat(np.add.reduceat(batch.column(4).to_numpy(), at), sizes)
        head = np.zeros(batch.num_rows, bool)
        head[at] = True
        out = pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(total), pa.array(head)], names=["lang", "term", "source", "n", "total", "head"])
        yield out.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = added(_after(held, batch))
            last = int(_starts(held.column(0), held.column(1))[-1])  # this run may go on
            if last:
                yield from told(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from told(held)

    return parts.repartition("lang", "term").sortWithinPartitions("term", "lang", "source").mapInArrow(run, KEPT)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shared_terms(rows: DataFrame) -> DataFrame:
    """rows: lang, term, source, p, p0 -> (lang, source, item, value), partial sums over the terms that both sources have.

    value corrects what is summed as if no term were in both: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).
    """

    def sums(batch: pa.RecordBatch, codes: dict[tuple[str, str], int], held: dict[tuple[int, int], int]) -> None:
        named = pc.dictionary_encode(pc.binary_join_element_wise(batch.column(0), batch.column(2), "\x00"))
        own = np.array([codes.setdefault(tuple(x.split("\x00", 1)), len(codes)) for x in named.dictionary.to_pylist()], np.int64)
        code = own[named.indices.to_numpy()]
        p, p0 = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        at = _starts(batch.column(0), batch.column(1))
        sizes = np.diff(np.append(at, batch.num_rows))
        for m in np.unique(sizes[sizes > 1]):
            begins = at[sizes == m]
            some, wide = max(1, PAIRS // int(m * m)), min(int(m), max(1, PAIRS // int(m)))
            for b in range(0, len(begins), some):
                every = begins[b : b + some, None] + np.arange(m)
                for low in range(0, int(m), wide):  # a run of very many sources goes in strips
                    mine = every[:, low : low + wide]
                    pa_, za, pb, zb = p[mine][:, :, None], p0[mine][:, :, None], p[every][:, None], p0[every][:, None]
                    value = _apart(pa_, pb) - _apart(pa_, zb) - _apart(za, pb) + _apart(za, zb)
                    key = (code[mine][:, :, None] << 32) | code[every][:, None]
                    key, value = key.ravel(), value.ravel()
                    order = np.argsort(key, kind="stable")
                    key, value = key[order], value[order]
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    for k, v in zip(key[first].tolist(), np.add.reduceat(value, first).tolist(), strict=True):
                        if k >> 32 != k & 0xFFFFFFFF:
                            held[k] = held.get(k, 0) + v

    def told(codes: dict[tuple[str, str], int], held: dict[int, int]) -> Iterator[pa.RecordBatch]:
        names, keys = list(codes), list(held)
        for at in range(0, len(keys), BATCH):
            part = keys[at : at + BATCH]
            ends = [(names[k >> 32], names[k & 0xFFFFFFFF]) for k in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[0] for a, _ in ends], pa.string()), pa.array([a[1] for a, _ in ends], pa.string()), pa.array([b[1] for _, b in ends], pa.string()), pa.array([held[k] for k in part], pa.int64())],
                names=["lang", "source", "item", "value"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        held: dict[int, int] = {}
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = _after(rest, batch)
            last = int(_starts(rest.column(0), rest.column(1))[-1])
            if last:
                sums(rest.slice(0, last), codes, held)
                rest = rest.slice(last)
            if len(held) >= HELD:
                yield from told(codes, held)
                held = {}
        if rest is not None:
            sums(rest, codes, held)
        yield from told(codes, held)

    dealt = rows.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact; null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1)
    return F.when(terms > 0, 1 + F.call_function("div", top, wide(total + terms)))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); shares are at most SCALE + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each source against each other one of its language, and the terms that set it apart.

    Every row of docs is a document of its own, repeated ones too. Null text, lang and source are ''; a group without terms has
    its pairs all the same, of value 0 where the language keeps no term; ties go to the lesser item by its bytes; very long texts
    are read whole; an empty table gives an empty one; other columns are dropped, whatever their names.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialize(kept_runs(partial_runs(plain), least), "divergence-runs")
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("in_lang"), F.count_if("head").alias("terms"))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("in_source"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = plain.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", zero("in_source"), zero("in_lang"), zero("terms"))
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("in_source"), F.col("terms"))), "divergence-groups")
    many = groups.count()
    known = lambda *renamed: small(groups.withColumnsRenamed(dict(renamed)), many)

    rows = kept.join(known(), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("in_source"), F.col("terms")))
    q = share(F.col("total"), F.col("in_lang"), F.col("terms"))
    telling = rows.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Terms as counts: how many terms a source has this often.
    often = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(known(), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("in_source"), F.col("terms")))
    often = often.select("lang", "source", "m", "p", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    other = small(other, many)
    wide = lambda c: c.cast("decimal(38,0)").alias("value")
    met = often.join(other, "lang").where("source <> item")
    neither = apart(F.col("p0"), F.col("q0"))
    forth = met.select("lang", "source", "item", wide(F.col("m").cast("decimal(18,0)") * (apart(F.col("p"), F.col("q0")) - neither).cast("decimal(19,0)")))
    back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), wide(F.col("m").cast("decimal(18,0)") * (apart(F.col("q0"), F.col("p")) - apart(F.col("q0"), F.col("p0"))).cast("decimal(19,0)")))
    base = groups.select("lang", "source", "terms", "p0").join(other, "lang").where("source <> item")
    base = base.select("lang", "source", "item", wide(F.when(F.col("terms") > 0, F.col("terms").cast("decimal(18,0)") * neither.cast("decimal(19,0)")).otherwise(0)))
    both = shared_terms(rows).select("lang", "source", "item", wide(F.col("value")))
    pairs = base.unionByName(forth).unionByName(back).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(telling)
