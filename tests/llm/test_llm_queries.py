"""The contract queries against DuckDB on the smallest tables, and the pipeline against what its stages promise."""

import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import brute_groups, brute_sites, brute_targets, prose

import corpus_pipeline
from corvane.llm import packing, private_data, quality
from corvane.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns, name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_odd_rows(spark, name):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, columns with clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    long = " ".join(f"w{k}" for k in range(60_000))
    plain = "Some words that nobody minds, written twice over for all to read."
    texts = [None, "", " \n\t", plain, plain, f"{plain} a@b.example", long, long + " end", "x", "漢字 😀"]
    rows = [(k if k != 3 else None, t, None if k % 3 else "en", None if k % 4 else f"s{k}", None if k % 2 else 7, "a", 1, 2.0, "b", "c", 3) for k, t in enumerate(texts)]
    rows += [rows[8], rows[8]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, h int, p double, host string, label string, text_hash int"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = stage(spark, docs, SF)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0
    kept = got.collect()
    if name == "packing":
        assert sum(r["length"] for r in kept if r["doc_id"] == 6) == next(r["doc_tokens"] for r in kept if r["doc_id"] == 6) > 60_000
        assert {r["doc_id"] for r in kept} == {r[0] for r in rows}
        return
    assert got.columns == docs.columns == empty.columns
    assert {r["label"] for r in kept} == {"c"} and {r["size"] for r in kept} == {"a"}
    found = [r["text"] for r in kept]
    if name == "near_duplicates":
        # Eight of the nine shingles of the mailed text are the plain one's, over the threshold.
        assert sorted(t or "" for t in found) == sorted(["", "", " \n\t", plain, long, "x", "漢字 😀"])
    if name == "private_data":
        assert sorted(t or "" for t in found) == sorted((r[1] or "").replace("a@b.example", "[EMAIL]") for r in rows)
        assert all(r["n_chars"] == len(r["text"]) for r in kept if r["text"] is not None) and None in found
    if name == "mixing":
        assert set(found) <= set(texts) and {None, "", " \n\t"} <= set(found)
    if name == "quality":
        assert set(found) <= set(texts)


def brute_pipeline(spark, docs, labels, rows):
    """(doc_id, start, length, crc, tokens) of every piece: each stage by plain loops, with the fitted model and field as given."""
    model = quality.fit(docs, quality.accepted_labels(labels))
    logit = model.logit(np.array([quality.features(r[1] or "", model.lexicon) for r in rows]))
    site_rows = [(r[3], "/".join([r[3] or "", r[2] or ""]), float(1 / (1 + math.exp(-x)))) for r, x in zip(rows, logit, strict=True)]
    mean, _, _, site = brute_sites(site_rows)
    odds = lambda p: math.log(p / (1 - p))
    rows = [r for r, x, s in zip(rows, logit, site, strict=True) if x + odds(s) - odds(mean) >= 0]
    kept = brute_groups(rows, Fraction(80, 100))
    rows = [r for r, k in zip(rows, kept, strict=True) if k[3] or not k[1]]
    field = private_data.train(spark.createDataFrame(rows, docs.schema))
    rows = [(r[0], None if r[1] is None else private_data.masked(r[1], private_data.all_spans(r[1], field)[1]), *r[2:]) for r in rows]
    words = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    target = brute_targets(sizes)
    place = lambda r: int(hashlib.md5(f"{r[0]}|mix".encode()).hexdigest()[:15], 16)
    drawn = []
    for s, size in sizes.items():
        own = sorted((r for r in rows if r[3] == s), key=place)
        rounds = min(2, math.floor(target[s] / size)) if size else 0
        left = math.floor(target[s] + 0.5) - rounds * size
        for r in own:
            n = words(r[1])
            more = n <= left or (left > 0 and 2 * left >= n)
            drawn += [r] * (rounds + more if n else 1)
            left = left - n if n <= left else 0
    library = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for r in drawn:
        ids = np.frombuffer(library.bytes_of(r[1] or "") + packing.END, "<u4")
        for start, length in packing.cuts(len(ids), packing.CAPACITY, packing.GRAIN):
            pieces[r[0], start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)] += 1
    return pieces


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        text = " ".join(f"{w.upper()}!!" for w in prose(i, 30).split()) if bad else prose(i, 20 + i % 90) + "."
        if i % 8 == 3:
            text = rows[-1][1]
        if i % 8 == 4:
            text += f" mail someone{i}@mail.example now"
        rows.append((i, None if i == 77 else "" if i == 78 else text, "en" if i % 3 else "fr", f"s{i % 6}" if i % 11 else None, len(text)))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
        elif i % 4 == 0:
            labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_pipeline(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), known, rows)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert 0 < len(want) < sum(r[1] is not None for r in rows)
    windows = Counter()
    for r in got:
        windows[r["sequence_id"]] += r["length"]
    assert max(windows.values()) <= 2048
