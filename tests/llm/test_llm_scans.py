"""Prefix trie, source divergence and license scan against brute force: nulls, empties, ties, repeats, long rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corvane.llm import license_scan, prefix_trie, source_divergence

CONVERSATIONS = "conv_id long, turn long, role string, text string, place string, size string, k1 string, n string, source string"


def brute_trie(rows, group=5, modulus=9):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) by plain lists of turns."""
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % modulus
        source = c - int(abs(c) % group) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(source, [])[:h]) + tuple(turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(path[:-1] for path in members if path)
    saved = {path: (len(m) - 1) * len(path[-1][1].encode()) if path else 0 for path, m in members.items()}
    leaves, total = Counter(), Counter()
    for path in members:
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            total[path[:d]] += saved[path]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], total[p], sha(ends[p])) for p, m in members.items())


def trie_of(spark, rows):
    made = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], CONVERSATIONS).repartition(3)
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, prefix_trie.prefix_trie(made).collect()))


def conversations():
    r = random.Random(5)
    rows = [(None, 1, "user", "lost"), (0, None, "user", "first of all"), (0, 1, None, None), (0, 2, "user", "ÄÖ 漢字 😀"), (-3, 0, "user", "minus"), (-3, 1, "user", "x" * 200_000)]
    for c in range(1, 60):
        for t in range(r.randint(0, 12)):
            rows.append((c, t, r.choice(["user", "assistant", None, ""]), r.choice(["hi", "ok", "", None, "yes indeed"])))
    rows += [(70, 1, "user", "same"), (70, 1, "user", "same"), (70, 1, "a", "tie"), (70, 1, "user", "tie")]
    rows += [(c, t, "user", f"long {t}") for c in (100, 101, 104) for t in range(60)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations()
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_long_conversations_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    rows = conversations()
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_many_equal_conversations(spark):
    rows = [(5 * c, t, "user", f"t{t}") for c in range(1500) for t in range(2)] + [(5 * c, 2, "user", str(c % 3)) for c in range(1500)]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []


# --- source divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n string, p0 string, item string, m string, in_lang string"


def brute_divergence(rows, least=3, top=200):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: [x.translate(fold) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = terms(text)
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (l, s), c in groups.items() if l == lang}
        every = Counter()
        for c in own.values():
            every.update(c)
        share = lambda c: {t: 1 + (1_000_000_000 * (c[t] + 1)) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in own.items()}, share(every)
        apart = lambda p, q: (p - q) ** 2 // q
        for s, p in shares.items():
            pairs = sorted((-sum(apart(p[t], shares[o][t]) for t in kept), o.encode()) for o in own if o != s)
            told = sorted((-apart(p[t], q[t]), t.encode()) for t in kept if own[s][t] and p[t] > q[t])[:top]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(told, 1)]
    return sorted(out)


def divergence_of(spark, rows, **kw):
    made = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], DOCS).repartition(5)
    return sorted(map(tuple, source_divergence.audit(made, **kw).select("lang", "source", "part", "item", "value", "rank").collect()))


def documents():
    r = random.Random(3)
    words = ["The", "the", "of", "Ünïcode", "unïcode", "漢字", "ab1cd", "x_y", "Éa", "éa", "rare"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for i in range(200):
        n = r.choice([0, 1, 5, 80])
        rows.append((i, " ".join(r.choices(words, [2 ** -(k % 9) * (1 + (i + k) % 3) for k in range(len(words))], k=n)), r.choice(["en", "en", "de", None]), r.choice(["a", "b", "ü", None, "c"])))
    rows += [rows[3], rows[3], (900, None, "fr", "only"), (901, "", "xx", "p"), (902, "12 34 !", "xx", "q"), (903, "the " * 100_000, "en", "a"), (None, "the of", "", "")]
    return rows


def test_divergence_equals_brute_force(spark):
    rows = documents()
    assert divergence_of(spark, rows) == brute_divergence(rows)
    assert divergence_of(spark, rows, least=1, top=4) == brute_divergence(rows, 1, 4)
    assert divergence_of(spark, []) == []


def test_divergence_with_little_memory(spark, monkeypatch):
    """Entries are handed on early, runs end in the midst of batches, pairs go in strips."""
    for name, value in (("HELD", 7), ("BATCH", 3), ("PAIRS", 5)):
        monkeypatch.setattr(source_divergence, name, value)
    rows = documents()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    assert divergence_of(spark, rows) == brute_divergence(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_divergence_is_exact_for_large_counts(spark):
    one = spark.range(1).select(F.lit(9_000_000_000_000_000).alias("n"), F.lit(9_000_000_000_000_007).alias("total"), F.lit(5).cast("long").alias("v"))
    n, total = 9_000_000_000_000_000, 9_000_000_000_000_007
    got = one.select(source_divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 1) // (total + 5)


# --- license scan

LICENSE_DOCS = "doc_id long, text string, key string, low string, words string, label string, n string, block string"


def brute_licenses(rows, templates=license_scan.TEMPLATES, phrases=license_scan.PHRASES, percent=license_scan.PERCENT):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for doc, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
        places = [(i, label) for phrase, label in phrases for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        met = {}
        for label, section in license_scan.sections(templates):
            for k in range(max(0, -(-(len(words) - 32) // 16)) + 1):
                shared = len(set(words[16 * k : 16 * k + 32]) & set(section))
                if 100 * shared >= percent * len(section):
                    met[label] = max(met.get(label, 0), Fraction(shared, len(section)))
        base = sorted({x for _, x in places})
        score = 1.0 if places else float(max(met.values(), default=0))
        out.append((doc, len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base), ",".join(sorted({*base, *met})), score))
    return sorted(map(repr, out))


def licenses_of(spark, rows, *args):
    made = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], LICENSE_DOCS).repartition(3)
    return sorted(map(repr, map(tuple, license_scan.scan(made, *args).collect())))


def test_licenses_equal_brute_force(spark):
    r = random.Random(9)
    noise = lambda n: [r.choice(["lorem", "Ipsum", "the", "of", "x1", "漢字", "license", "2", "copy"]) for _ in range(n)]
    texts = [None, "", " \n\t", "CC BY cc-by CC\nBY by", "general  PUBLIC license; All Rights Reserved.", "cc byx acc by cc b", "İ CC BY Kelvin K"]
    for _, t in license_scan.TEMPLATES:
        words = t.split()
        damaged = [w for w in words if r.random() > 0.06]
        texts += [t, t.upper() + "!", " ".join(noise(r.randint(0, 40)) + damaged + noise(r.randint(0, 40))), "\n".join(noise(17) + words[: len(words) // 2] + noise(30) + words[len(words) // 2 :])]
    texts.append(" ".join(noise(60_000) + ["released", "under", "the", "MIT", "license", "cc", "by"] + noise(60_000)))
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    rows += [rows[8], rows[8], rows[1]]
    assert licenses_of(spark, rows) == brute_licenses(rows)
    assert licenses_of(spark, []) == []


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_licenses_by_other_templates(spark, percent):
    r = random.Random(percent)
    words = [f"w{k}" for k in range(14)]
    templates = [(f"t{k % 4}", " ".join(r.choices(words, k=r.randint(1, 40)))) for k in range(12)]
    rows = [(k, " ".join(r.choices([*words, "z"], k=r.randint(0, 120)))) for k in range(60)]
    phrases = (("w1 w2", "a"), ("w3", "b"), ("w1 w2 w3", "c"))
    assert licenses_of(spark, rows, templates, phrases, percent) == brute_licenses(rows, templates, phrases, percent)
    assert licenses_of(spark, rows, (), phrases, percent) == brute_licenses(rows, (), phrases, percent)


def test_licenses_run_without_python(spark):
    plan = license_scan.scan(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_licenses_read_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    rows = [(k, f"doc {k} released under the MIT license, all rights reserved") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("doc_id", F.udf(told, "string").asNondeterministic()("text").alias("text"))
    got = license_scan.scan(docs)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute_licenses(rows)
    assert seen.value == len(rows)


def test_words_are_the_contracts(spark):
    text = "".join(f"a{chr(c)}B7" for c in [*range(0x250), 0x2028, 0x212A, 0xFFFD, 0x1F600])
    want = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    told = license_scan.words_in(spark.createDataFrame([(1, text)], "doc_id long, text string"), sorted({w.translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)) for w in want}))
    row = told.first()
    assert row["n_words"] == len(want)
    assert [x["word"] for x in row["at"]] == [w.translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)) for w in want]


def test_a_block_is_looked_at_once(spark):
    line = "released under the mit license "
    rows = [(1, line * 400), (2, "x " * 31 + line * 3), (3, line + "x " * 11 + line), (4, "x " * 28 + line), (5, "x " * 45 + line + "x " * 40)]
    assert licenses_of(spark, rows) == brute_licenses(rows)
    told = license_scan.words_in(spark.createDataFrame(rows[:1], "doc_id long, text string"), line.split()).withColumnRenamed("doc_id", "key")
    met = license_scan.met_blocks(told, (("mit", line),), 100)
    assert met.count() == 124  # blocks of 2000 words: one word is the prefix, so a block and its section meet once
