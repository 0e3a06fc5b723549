"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat_format, components, embedding_duplicates, mixing, near_duplicates, packing, private_data, quality, resharding, token_counts, topk_search

WORDS = "the of tion ing erst andou thea reand wh in esh to".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, row string, host string, uid string, bucket string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 9000)
    base = prose(2, 300)
    near = base.split()
    near[150] = "changed"
    texts = [None, "", " \n", "one two", "a b c d e", base, base, " ".join(near), base.upper(), long, long + " tail", prose(3, 60), "mail a.b@c.de or 1.2.3.4", "x" * 3000, "ÄÖ ß 漢字 😀 ok"]
    made = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None if i % 2 else "b", len(t or ""), "clash", "clash", "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*made, made[11], made[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- token counts


def encoder():
    return token_counts.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}, public_tokenizers.PATTERN)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("text", [prose(4, 3000), "a" * 5000, "   \n\n  " * 900, "ab<|endoftext|>" * 600, "漢字 かな x " * 700, "it's we'll " * 800, "1 22 333\t" * 900 + "z" * 3000 + " end"])
@pytest.mark.parametrize("chunk", [64, 700, 4096])
def test_spliced_counts_equal_the_library(text, chunk):
    e = encoder()
    assert token_counts.spliced_count(e.ids, e.sizes, text, chunk, 16) == len(library("byte_bpe_50k.json").encode(text, add_special_tokens=False))


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "x", "ab " + " \n\t" * 340_000 + "<|endoftext|> y", "a　" + "　" * 50_000 + "b" + "\x1c" * 20_000, ("  " * 9000 + "w") * 5])
def test_long_white_space_is_counted_as_the_library_does(text):
    e = encoder()
    assert token_counts.spliced_count(e.ids, e.sizes, text, 1 << 16, 1 << 9) == len(library("byte_bpe_50k.json").encode(text, add_special_tokens=False))


@pytest.mark.parametrize("sizes", [(8, 2), (64, 2), (64, 32), (63, 8)])
def test_too_small_chunks_are_refused(docs, sizes):
    with pytest.raises(ValueError, match="chunk"):
        token_counts.count_tokens(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), {}, public_tokenizers.PATTERN, *sizes)


def test_token_counts(docs, nothing, rows):
    call = lambda d: token_counts.count_tokens(d, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}, public_tokenizers.PATTERN, 2000, 64)
    t = library("byte_bpe_50k.json")
    want = sorted((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False))) for r in rows)
    assert sorted(map(tuple, call(docs).collect())) == want
    assert call(nothing).count() == 0


# --- packing


def test_words_equal_the_library():
    w = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    for text in [prose(5, 500), "It's 123 <|endoftext|> ok", "ÄÖÜ ẞ Σς İ 漢字", "don't!!  x_y ab'rE", "", "ñé ç <| a"]:
        assert w.ids(text) == w.bytes_of(text)
    own = [(t[:-4], i) for t, i in w.core.get_vocab(with_added_tokens=False).items() if t.endswith("</w>") and len(t) > 4]
    letters = packing.byte_letters()
    for t, i in own:
        try:
            s = bytes(letters[c] for c in t).decode()
        except UnicodeDecodeError:
            continue
        if s == s.lower() and w.find(s) == [s]:
            assert w[s] == w.bytes_of(s) == i.to_bytes(4, "little")


def test_difference_keeps_capacity_and_evens_out():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 513, 900)
    found = packing.windows(lengths, 2048)
    loads = np.bincount(found, weights=lengths)
    assert loads.max() <= 2048 and loads.sum() == lengths.sum()
    assert len(loads) <= 1.06 * lengths.sum() / 2048 + 1
    assert list(packing.windows(np.array([5]), 8)) == [0] and len(packing.windows(np.zeros(0, int), 8)) == 0
    assert len(set(packing.windows(np.array([8, 8, 8]), 8))) == 3
    # By hand: 8, 7, 6, 5, 4 in two windows by largest differences gives 16 and 14.
    assert sorted(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_packing(docs, nothing, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(docs, path, bucket_rows=5).toPandas()
    t = library("word_bpe_49k.json")
    pieces = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        data = np.array(ids, "<u4").tobytes()
        own = found[(found.doc_id == r[0])]
        for p in own[own.doc_tokens == len(ids)].itertuples():
            pieces[r[0]] += p.length
            assert p.ids_crc32 == zlib.crc32(data[4 * p.start : 4 * (p.start + p.length)])
    many = Counter(r[0] for r in rows)
    assert all(pieces[r[0]] == many[r[0]] * len(t.encode(r[1] or "", add_special_tokens=False).ids) * many[r[0]] + many[r[0]] ** 2 for r in rows)
    for _, s in found.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 2048 and list(s.offset) == [0, *s.length.cumsum()[:-1]]
    assert packing.pack(nothing, path).count() == 0


# --- mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]] if free else []
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)


def test_mixing(docs, nothing, rows):
    found = mixing.mix_documents(docs).toPandas()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = brute_targets(sizes)
    for s, own in found.groupby(found.source.map(lambda x: x if isinstance(x, str) else "null")):
        name = None if s == "null" else s
        assert own["size"].sum() == sizes[name] == own.source_size.iloc[0]
        assert own.target.iloc[0] == pytest.approx(want[name])
        assert abs(own.taken.sum() - want[name]) <= 3
    assert (found.taken <= 2 * found["size"]).all()
    again = mixing.mix_documents(docs).toPandas()
    assert sorted(map(tuple, again[["doc_id", "taken"]].values)) == sorted(map(tuple, found[["doc_id", "taken"]].values))
    assert mixing.mix_documents(nothing).count() == 0
    drawn = mixing.draw_documents(docs)
    assert drawn.columns == docs.columns
    got = drawn.toPandas()
    words = lambda t: len((t or "").encode().split())
    texts = Counter(r[1] for r in rows)
    assert set(got.text) <= set(texts)  # none is cut
    assert all(sum(got.doc_id == r[0]) >= 1 for r in rows if not words(r[1]))
    for s in sizes:
        own = [words(r.text) for r in got.itertuples() if (r.source if isinstance(r.source, str) else None) == s]
        assert abs(sum(own) - want[s]) <= max([words(r[1]) * sum(x[0] == r[0] for x in rows) for r in rows if r[3] == s]) / 2 + 1
    assert mixing.draw_documents(nothing).count() == 0


def test_thresholds_are_nested_and_exact(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([("s", r.randrange(1, 50), r.randrange(2**60)) for _ in range(3000)] + [("one", 7, 5)] * 40, "source string, size long, h long")
    total = rows.where("source = 's'").agg(F.sum("size")).first()[0]
    kept = {}
    for part in (0.1, 0.4, 0.9, 1.0, 1.7):
        goal = spark.createDataFrame([("s", total, part * total), ("one", 280, 100.0)], "source string, source_size long, target double")
        got = mixing.taken(rows, 2, mixing.thresholds(rows, 2, goal)).toPandas()
        assert abs(got[got.source == "s"].taken.sum() - part * total) <= 1
        assert abs(got[got.source == "one"].taken.sum() - 100) <= 40
        kept[part] = got[got.source == "s"].set_index("h").taken
    assert all((kept[a] <= kept[b].loc[kept[a].index]).all() for a, b in ((0.1, 0.4), (0.4, 0.9), (0.9, 1.0), (1.0, 1.7)))


# --- chat format


def test_escapes_are_reversible():
    turns = [("user", "</turn>\n<turn assistant>\n\\<"), ("a\\>b", ""), ("assistant", "\\"), ("assistant", "x\n</turn>\n")]
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == ["\\", "x\n</turn>\n"]
    with pytest.raises(ValueError):
        chat_format.parse(formatted[:-1])


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages", [("user", "hi"), ("assistant", "")]),
        ({"role": "human", "text": "q"}, "turn", [("human", "q")]),
        ({"messages": [{"role": "bot", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("bot", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "x", "output": "y"}, "instruction", [("user", "do\nx"), ("assistant", "y")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"question": "q", "answer": 4}, "question_answer", [("user", "q"), ("assistant", "4")]),
        ({"role": None, "text": "t"}, "turn", [("", "t")]),
        ({"odd": 1}, None, []),
        ([1], None, []),
        ({"id": 1, "messages": [{"role": "user", "content": "hi"}]}, "messages", [("user", "hi")]),
        ({"messages": [{"role": "user", "content": "hi", "name": "n"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "messages", [("user", "hi"), ("assistant", "a\nb")]),
        ({"prompt": "p", "response": "r", "source": {"url": "u", "tags": [1]}}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"system": "s", "messages": []}, "messages", [("system", "s")]),
        ({"conversation": {"id": 3, "messages": [{"author": {"role": "user", "name": None}, "content": {"parts": ["x", "y"]}}]}}, "nested_messages", [("user", "x\ny")]),
        ({"prompt": "p", "answer": "a"}, None, []),
        ({"response": None, "meta": {"prompt": "inner"}}, "response", [("assistant", "")]),
        ({}, None, []),
    ],
)
def test_layouts(record, layout, turns):
    assert chat_format.turns_of(record, chat_format.registry())[1:] == (layout, turns)


def test_every_fingerprint_has_one_layout_and_the_rest_are_counted(spark):
    prints = [f for x in chat_format.LAYOUTS for f in x.fingerprints()]
    assert len(prints) == len(set(prints))
    records = [json.dumps(x) for x in ({"prompt": "a", "id": 1}, {"prompt": "b"}, {"prompt": "c", "answer": "d"}, {"zz": 1})] + ["{", None]
    df = spark.createDataFrame([(k, p, "own") for k, p in enumerate(records)], "id long, payload string, layout string")
    made = chat_format.canonical_turns(df, "payload")
    assert made.columns == ["id", "payload", "fingerprint", "layout", "turns"]
    assert sorted((r["layout"] or "", r["records"]) for r in chat_format.layouts_seen(made).collect()) == [("", 1), ("", 1), ("", 2), ("prompt", 2)]
    assert sorted(r["id"] for r in chat_format.unmatched(made).collect()) == [2, 3, 4, 5]


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b<>\\"), (1, 0, "user", None), (1, 2, "assistant", "c"), (2, None, "user", "x"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, None, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("payload"))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(chat_format.canonical_turns(records, "payload"))).collect()}
    assert got[1]["n_turns"] == 3 and got[2]["n_turns"] == 3 and got[None]["n_turns"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\nb<>\\\nassistant\nc\n".encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("b<>\\c".encode()).hexdigest() and got[1]["loss_chars"] == 5
    broken = spark.createDataFrame([(1, 0, "{"), (1, 1, None), (1, 2, json.dumps({"zz": 1}))], "conv_id long, turn long, payload string")
    assert [r["turns"] for r in chat_format.canonical_turns(broken, "payload").collect()] == [[], [], []]
    assert chat_format.format_conversations(chat_format.canonical_turns(broken.limit(0), "payload")).count() == 0


# --- near duplicates


def brute_groups(rows, threshold):
    sets = {}
    for k, r in enumerate(rows):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").encode().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and i * threshold.denominator >= threshold.numerator * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[find(k)].append(r[0])
    return [(r[0], len(sets[k]), min(least[find(k)]), min(least[find(k)]) == r[0]) for k, r in enumerate(rows)]


def test_near_duplicates(docs, nothing, rows):
    t = Fraction(85, 100)
    assert sorted(map(tuple, near_duplicates.group_documents(docs, t).collect())) == sorted(brute_groups(rows, t))
    assert near_duplicates.group_documents(nothing, t).count() == 0
    kept = near_duplicates.keep_first(docs, t).toPandas()
    assert sorted(kept.doc_id) == sorted({r[0] for r in brute_groups(rows, t) if r[3]})


def test_chains_and_crowds_of_near_copies(spark):
    r = random.Random(9)
    base = prose(20, 120).split()
    rows, now = [], list(base)
    for i in range(260):  # a chain that drifts, and a crowd around its start
        words = list(now if i % 2 else base)
        for _ in range(1 if i % 2 else r.randrange(4)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        if i % 2:
            now = words
        rows.append((1000 - i, " ".join(words)))
    t = Fraction(80, 100)
    got = near_duplicates.group_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), t).collect()
    assert sorted(map(tuple, got)) == sorted(brute_groups(rows, t))


def test_sketches_estimate_and_merge():
    r = np.random.default_rng(5)
    s = near_duplicates.Sketcher(256)
    for j in (0.2, 0.5, 0.85, 0.95):
        a = near_duplicates.finish(r.integers(0, 2**63, 4000).astype(np.uint64))
        n = len(a)
        shared = round(2 * n * j / (1 + j) / 2)
        b = np.concatenate([a[:shared], near_duplicates.finish(r.integers(0, 2**63, n - shared).astype(np.uint64))])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = s.sketch(a), s.sketch(b)
        m, l = (x > y).sum(), (x < y).sum()
        got = near_duplicates.likeliest(np.array([m]), np.array([l]), np.array([len(x) - m - l]), np.array([n * 1.0]), np.array([len(b) * 1.0]))[0]
        assert abs(got - true) < 0.12
        assert (np.maximum(x, y) == s.sketch(np.concatenate([a, b]))).all()


def test_cells_give_links_enough_to_connect():
    r = random.Random(2)
    sets = []
    for g in range(6):
        core = [r.randrange(2**60) for _ in range(80)]
        for _ in range(8):
            some = [x if r.random() > 0.05 else r.randrange(2**60) for x in core]
            sets.append(np.unique(np.array(some, np.uint64)))
    t = Fraction(85, 100)
    links = near_duplicates.cell_links(sets, list(range(len(sets))), t)
    close = lambda a, b: (i := len(np.intersect1d(a, b))) * 100 >= 85 * (len(a) + len(b) - i)
    assert all(close(sets[a], sets[b]) for a, b in links)
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a in range(len(sets)) for b in range(a) if close(sets[a], sets[b]))


def test_bands_follow_the_threshold():
    assert near_duplicates.registers_for(Fraction(85, 100)) == 256
    assert near_duplicates.registers_for(Fraction(80, 100)) > 400
    r = np.random.default_rng(1)
    n, k = 400, near_duplicates.registers_for(Fraction(80, 100))
    s = near_duplicates.Sketcher(k)
    missed = 0
    for _ in range(150):
        a = near_duplicates.finish(r.integers(0, 2**63, 2 * n).astype(np.uint64))
        shared = math.ceil(2 * n * 0.8 / 1.8)
        x, y = (s.sketch(v).view("<i8") for v in (a[:n], np.concatenate([a[:shared], a[n : 2 * n - shared]])))
        missed += not (x == y).any()
    assert missed == 0


def test_boilerplate_below_the_threshold_makes_no_pairs(spark, monkeypatch):
    """Texts of four fifths boilerplate share many cells; links among some of them are still found, also over blocks."""
    r = random.Random(12)
    base = prose(77, 400)
    rows = [(i, f"{base} " + " ".join(f"u{i}x{k}" for k in range(60 if i % 9 else 3 + i % 4))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    t = Fraction(85, 100)
    want = sorted(brute_groups(rows, t))
    assert sorted(map(tuple, near_duplicates.group_documents(df, t).collect())) == want
    monkeypatch.setattr(near_duplicates, "CELL_BYTES", 20_000)
    mixed = [(i, " ".join(w if r.random() > 0.03 else f"w{r.randrange(10**6)}" for w in base.split()) if i % 3 else f"{base} {prose(500 + i, 90)}") for i in range(150)]
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_duplicates.group_documents(df, t).collect())) == sorted(brute_groups(mixed, t))


def test_rows_that_share_an_id_are_kept_by_their_texts(spark):
    a, b, c = prose(31, 40), prose(32, 40), prose(33, 40)
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (2, b, 4), (3, b, 5), (None, c, 6), (None, c, 7), (4, None, 8), (4, "", 9), (None, a, 10)]
    kept = near_duplicates.keep_first(spark.createDataFrame(rows, "doc_id long, text string, label long"), Fraction(80, 100))
    assert kept.columns == ["doc_id", "text", "label"]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == sorted([(1, a), (2, b), (0, c), (4, ""), (4, "")])


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- vectors


def vector_rows():
    r = np.random.default_rng(1)
    out = []
    centers = r.standard_normal((6, 16))
    for i in range(180):
        v = centers[i % 6] + r.standard_normal(16) * (0.02 if i % 3 == 0 else 0.12 if i % 3 == 1 else 1.5)
        out.append((i * 5, [float(np.float32(x)) for x in v]))
    out += [(900, None), (905, []), (910, [0.0] * 16), (915, [float("nan")] + [1.0] * 15), (920, [None] + [1.0] * 15), (925, [float("inf")] * 16), (930, [1.0, 2.0]), (935, [2.0, 4.0]), (940, out[0][1]), (0, out[0][1]), (945, [1e-30] * 16), (950, [3e38] * 16)]
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_linked_vectors(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, uid string").repartition(3)
    f32 = [[None if x is None else float(np.float32(x)) for x in v] if v is not None else None for _, v in rows]
    good = [k for k, v in enumerate(f32) if usable(v) and any(v)]
    unit = {k: np.array(f32[k]) / np.linalg.norm(f32[k]) for k in good}
    n, root = Counter(), list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    want = sorted((rows[k][0], n[k], min(least[find(k)]), rows[k][0] == min(least[find(k)])) for k in range(len(rows)))
    assert sorted(map(tuple, embedding_duplicates.link_vectors(df).collect())) == want
    assert embedding_duplicates.link_vectors(df.limit(0)).count() == 0
    loose = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [2.0, 4.0]), (None, [9.0, -1.0])], "vec_id long, embedding array<double>")
    found = sorted(map(repr, map(tuple, embedding_duplicates.link_vectors(loose).collect())))
    assert found == sorted(map(repr, [(None, 2, 5, False), (None, 2, 5, False), (5, 2, 5, True), (None, 0, None, True)]))


def test_binary_codes_are_unbiased():
    r = np.random.default_rng(0)
    d, est = 64, []
    x = r.standard_normal(d)
    x /= np.linalg.norm(x)
    z = r.standard_normal(d)
    z -= z @ x * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z)
    for seed in range(400):
        m = embedding_duplicates.rotations(d, 1, seed)
        a, b = x @ m, y @ m
        s = np.where(a >= 0, 1, -1) / 8
        est.append((s @ b) / (s @ a))
    assert abs(np.mean(est) - 0.9) < 4 * np.std(est) / 20
    p = embedding_duplicates.plan(1000, 64)
    assert p[1] > 1 and embedding_duplicates.plan(10**9, 64)[0] > p[0]


@pytest.mark.parametrize(("d", "n"), [(16, 70_000), (64, 1000), (64, 70_000), (64, 10**7), (384, 70_000), (768, 70_000)])
def test_pairs_at_the_threshold_share_a_cell(d, n):
    """Plans of two to four rotations a table."""
    r = np.random.default_rng(d)
    per, tables, _ = embedding_duplicates.plan(n, d)
    x, y = r.standard_normal((2, 500, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    made = {}
    a, b = (embedding_duplicates.cells(v, tables, per, 1, made) for v in (x, y))
    assert (a == b).any(1).mean() >= 0.99


def test_dense_groups_are_counted_in_blocks(spark, monkeypatch):
    """A cone of vectors at cosines around the threshold, with copies: links are counted exactly over blocks of a cell."""
    monkeypatch.setattr(embedding_duplicates, "CELL_ROWS", 16)
    r = np.random.default_rng(6)
    v = np.ones(24) + r.standard_normal((160, 24)) * 0.34
    v = np.concatenate([v, v[:30], v[:5]]).astype(np.float32)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9) & ~np.eye(len(v), dtype=bool)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(len(v))], "vec_id long, embedding array<float>").repartition(4)
    got = {x["vec_id"]: x for x in embedding_duplicates.link_vectors(df).collect()}
    assert 0.2 < links.mean() < 0.95
    found, true = np.array([got[i]["n_links"] for i in range(len(v))]), links.sum(1)
    assert (found <= true).all() and found.sum() >= 0.998 * true.sum()  # pairs just at the threshold are missed with a chance of MISS
    label = np.arange(len(v))
    for _ in range(len(v)):
        label = np.minimum(label, np.where(links, label[None, :], len(v)).min(1))
    assert [got[i]["component_id"] for i in range(len(v))] == label.tolist()


def test_top_k(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, norm string").repartition(3)
    ints = [[int(np.floor(1024 * float(np.float32(x)))) for x in v] if usable(v) and max(map(abs, v), default=0) < 1e30 else None for _, v in rows]
    got = defaultdict(list)
    big = {950, 945}
    for r in topk_search.top_k(df.where(~F.col("vec_id").isin(*big)), F.col("vec_id") % 20 == 0, 7).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i % 20 or ints[a] is None or i in big:
            continue
        s = sorted((-sum(x * y for x, y in zip(ints[a], ints[b], strict=True)), rows[b][0]) for b in range(len(rows)) if b != a and ints[b] is not None and len(ints[b]) == len(ints[a]) and rows[b][0] not in big)
        want[i] += [(k + 1, v, -x) for k, (x, v) in enumerate(s[:7])]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET_ROWS", 60)
    monkeypatch.setattr(topk_search, "GROUP_ROWS", 9)
    r = np.random.default_rng(8)
    v = r.standard_normal((700, 6)) * np.exp(1.5 * r.standard_normal((700, 1)))
    ids = [2**53 + 1 + i for i in range(700)]
    rows = [(None if i == 300 else ids[i], [float(x) for x in v[i]]) for i in range(700)] + [(ids[5], [float(x) for x in v[5]])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 20 == 0, 6).collect()
    m = np.floor(1024 * np.array([x for _, x in rows])).astype(np.int64)
    want = []
    for a, (i, _) in enumerate(rows):
        if i is not None and i % 20 == 0:
            best = sorted((-int(m[a] @ m[b]), rows[b][0] is None, rows[b][0]) for b in range(len(rows)) if b != a)[:6]
            want += [(i, k + 1, x, -s) for k, (s, _, x) in enumerate(best)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pruning_never_drops_a_hit():
    r = np.random.default_rng(3)
    v = np.floor(r.standard_normal((400, 12)) * np.exp(r.standard_normal((400, 1))) * 300)
    norm = np.linalg.norm(v, axis=1)
    v, norm = v[np.argsort(-norm)], np.sort(norm)[::-1]
    for q in v[::37]:
        for goal in (-1e5, 0.0, 1e4, 1e5, float(v[0] @ q), 0.95 * norm[0] * np.linalg.norm(q)):
            left = set(topk_search.survivors(v, norm, q, float(np.linalg.norm(q)), goal).tolist())
            assert left >= set(np.flatnonzero(v @ q >= goal).tolist())


# --- resharding


def fewest_bytes(shards, n_new):
    """By brute force over which shards get a row more: each keeps its largest rows."""
    from itertools import combinations

    low, extra = divmod(sum(map(len, shards.values())), n_new)
    kept = lambda j, more: sum(sorted(shards.get(j, ()), reverse=True)[: low + more])
    return sum(map(sum, shards.values())) - max(sum(kept(j, j in some) for j in range(n_new)) for some in combinations(range(n_new), extra))


@pytest.mark.parametrize("seed", range(6))
def test_flow_moves_the_fewest_bytes(spark, seed):
    r = random.Random(seed)
    n_old, n_new = r.choice([(3, 5), (6, 4), (2, 7), (5, 5), (7, 3), (4, 6)])
    shards = {j: [r.randrange(1, 40) if seed % 2 else r.choice([3, 7, 7, 7, 60]) for _ in range(r.randrange(0, 25))] for j in range(n_old)}
    rows = [(k, j, s, "x", 5) for k, (j, s) in enumerate((j, s) for j, own in shards.items() for s in own)]
    df = spark.createDataFrame(rows, "row long, old_shard int, size long, block string, rank int").repartition(3)
    got = resharding.reshard(df, n_new, ["row"]).toPandas()
    assert list(got.columns) == ["row", "old_shard", "size", "block", "rank", "shard", "slot", "moved"] and set(got.block) <= {"x"}
    n = Counter(got.shard)
    assert max(n[j] for j in range(n_new)) - min(n[j] for j in range(n_new)) <= 1 and len(got) == len(rows)
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    assert got[got.moved]["size"].sum() == fewest_bytes(shards, n_new)


def test_flow_is_exact_with_many_blocks():
    """Three blocks of each of 48 shards, whose means need a common denominator of many digits."""
    r = random.Random(4)
    shards = {j: [r.randrange(1, 5000) for _ in range(r.randrange(20, 60))] for j in range(48)}
    shards[0] += [9] * ((2 - sum(map(len, shards.values()))) % 48)
    low = sum(map(len, shards.values())) // 48
    blocks = []
    for j, own in shards.items():
        own = sorted(own, reverse=True)
        edge = own[low] if len(own) > low else None
        parts = defaultdict(list)
        for s in own:
            parts[2 if edge is None or s > edge else 1 if s == edge else 0].append(s)
        blocks += [(j, c, len(v), sum(v)) for c, v in parts.items()]
    assert len(blocks) > 64
    stays = defaultdict(int)
    for old, block, first, end, new, _ in resharding.transfers(blocks, 48):
        if old == new:
            stays[old, block] += end - first
    held = {(j, c): (n, size) for j, c, n, size in blocks}
    moved = sum((n - stays[k]) * Fraction(size, n) for k, (n, size) in held.items())
    assert moved == fewest_bytes(shards, 48)


def test_resharding(spark, docs, nothing, rows):
    got = resharding.reshard_documents(docs, 6, 4).toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows)
    n = got.groupby("shard").size()
    assert len(n) == 4 and n.max() - n.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    size = {r[0]: len((r[1] or "").encode()) + 16 for r in rows}
    assert all(size[r.doc_id] == r.size_ for r in got.rename(columns={"size": "size_"}).itertuples())
    assert all(r.text_crc32 == zlib.crc32((dict((x[0], x[1]) for x in rows)[r.doc_id] or "").encode()) for r in got.itertuples())
    assert resharding.reshard_documents(nothing).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, 0, 9)], "row long, old_shard int, size long")
    assert resharding.reshard(odd, 2, ["row"]).count() == 3


def test_rewriting_leaves_the_other_shards_alone(spark, docs, rows, tmp_path):
    out = str(tmp_path / "layout")
    first = [*[(0, f"a{i}", None if i == 1 else "x" * i) for i in range(4)], *[(1, f"b{i}", "same") for i in range(8)], *[(2, "c", "cc")] * 4]
    resharding.write_layout(spark.createDataFrame(first, "shard int, name string, text string"), out)
    before = {f for f, s in ((r["at_file"], r["shard"]) for r in resharding.read_layout(spark, out).collect()) if s == 0}
    assert resharding.rewrite_affected(spark, out, 4) == [1, 3]
    after = resharding.read_layout(spark, out).collect()
    assert sorted(map(repr, ((r["name"], r["text"]) for r in after))) == sorted(map(repr, (r[1:] for r in first)))
    assert Counter(r["shard"] for r in after) == {0: 4, 1: 4, 2: 4, 3: 4}
    assert {r["at_file"] for r in after if r["shard"] == 0} == before
    assert resharding.rewrite_affected(spark, out, 4) == []
    assert set(resharding.rewrite_affected(spark, out, 2)) == {0, 1, 2, 3}
    left = resharding.read_layout(spark, out)
    assert sorted(r["name"] for r in left.collect()) == sorted(r[1] for r in first)
    assert Counter(r["shard"] for r in left.collect()) == {0: 8, 1: 8}


# --- quality


def test_quality(spark, docs, nothing):
    r = random.Random(7)
    made, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(f"{w.upper()}!!" for w in prose(i, 30).split()) if bad else prose(i, 40) + (" idiot" if i % 10 == 1 else "") + "."
        made.append((i, text, "en", "hot" if i % 3 else f"s{i % 7}", len(text)))
        if r.random() < 0.7:
            labels.append((i, 0 if bad else 1, 1 if i % 10 == 1 else 0))
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["accepted"] for x in quality.score_documents(df, known).collect()}
    want = {i: i % 4 != 0 and i % 10 != 1 for i in range(400)}
    assert np.mean([got[i] == want[i] for i in want]) > 0.97
    kept = quality.keep_accepted(df, known)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i in got if got[i])
    assert quality.score_documents(docs, known.limit(0)).where("accepted").count() == docs.count()
    assert quality.keep_accepted(docs, known).columns == docs.columns
    assert quality.score_documents(nothing, known).count() == 0
    assert quality.keep_accepted(nothing, known).count() == 0


def test_evidence_equals_a_plain_sum_of_features(spark):
    """p of a fixed model, from each feature's definition by plain counting."""
    r = np.random.default_rng(3)
    model = quality.Model(frozenset([b"bad", b"terri*"]), r.normal(size=quality.FEATURES), r.uniform(0.5, 2, quality.FEATURES), r.normal(size=quality.FEATURES + 1))
    texts = [None, "", "BAD, BAD news! 12 | x", "terrible Terribly fine; (ok) ok", "ÄÖ 漢字 #tag a_b {x} 😀", prose(8, 400), "a " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["logit"] for x in quality.evidence(df, model).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        words = data.lower().split()
        n, size, kinds = max(1, len(words)), max(1, len(data)), set(words)
        count = lambda those: sum(b in those for b in data)  # noqa: B023, E731
        upper, letters = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
        bare = {w.strip(b".,;:!?'\"()-") for w in kinds}
        hit = b"bad" in bare or any(len(w) > 5 and w.startswith(b"terri") for w in bare)
        x = [
            math.log(len(words) + 1) / 5, upper / max(1, letters), min(1, count(b"#$%&*@^~`_=+<>\\/{}[]") / n), min(1, count(b"!") / n), min(1, count(b"|") / n), min(1, count(b"0123456789") / size),
            min(1, count(b".,;:?'\"()-") / n), math.log(1 + (len(data) - count(b" \t\n\r\x0b\x0c")) / n), len(kinds) / n, (1 - len(kinds) / n) * math.log(n + 1) / 5, sum(a == b for a, b in zip(words, words[1:])) / n, hit,
        ]
        want = sum(w * (v - m) / s for v, m, s, w in zip(x, model.mean, model.spread, model.weights)) + model.weights[-1]
        assert got[i] == pytest.approx(max(-30, min(30, want))), (i, t)


def brute_sites(rows):
    """The priors and each row's site posterior, straight from their definitions."""
    p = np.array([r[2] for r in rows])
    host, path = [r[0] for r in rows], [(r[0], r[1]) for r in rows]
    mean = p.mean()
    of = lambda keys: {k: p[[i for i, x in enumerate(keys) if x == k]] for k in set(keys)}
    hosts, paths = of(host), of(path)
    within = lambda groups: sum(((v - v.mean()) ** 2).sum() for v in groups.values()) / max(1, len(p) - len(groups))

    def weight(between):
        return 1 / max(1.0, mean * (1 - mean) / between - 1) if between > 0 else 0.0

    spread = sum(len(v) * (v.mean() - mean) ** 2 for v in hosts.values())
    by_host = weight((spread - (len(hosts) - 1) * within(hosts)) / (len(p) - sum(len(v) ** 2 for v in hosts.values()) / len(p)))
    spread = sum(len(v) * (v.mean() - hosts[k[0]].mean()) ** 2 for k, v in paths.items())
    by_path = weight((spread - (len(paths) - len(hosts)) * within(paths)) / (len(p) - sum(len(v) ** 2 / len(hosts[k[0]]) for k, v in paths.items())))
    found = []
    for i, x in enumerate(p):
        h, q = (np.array([p[j] for j in range(len(p)) if j != i and keys[j] == keys[i]]) for keys in (host, path))
        m = (mean + by_host * h.sum()) / (1 + by_host * len(h))
        found.append((m + by_path * q.sum()) / (1 + by_path * len(q)))
    return mean, by_host, by_path, found


@pytest.mark.parametrize("seed", range(3))
def test_site_posteriors_equal_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    rows = []
    for h in range(8):
        level = r.uniform(0.2, 0.9)
        for q in range(int(r.integers(1, 5))):
            own = np.clip(level + r.normal(0, 0.15 if seed else 0), 0.05, 0.95)
            rows += [(None if h == 7 else f"h{h}", f"q{q}" if q else None, float(np.clip(own + r.normal(0, 0.1), 0.01, 0.99))) for _ in range(int(r.integers(1, 40)))]
    made = [(i, *x, float(np.log(x[2] / (1 - x[2])))) for i, x in enumerate(rows)]
    scored = spark.createDataFrame(made, "doc_id long, host string, path string, p double, logit double").repartition(3)
    sites, prior = quality.posteriors(scored)
    mean, by_host, by_path, want = brute_sites(rows)
    assert np.allclose([prior.mean, prior.host, prior.path], [mean, by_host, by_path])
    got = {x["doc_id"]: x for x in quality.combine(scored, sites, prior).collect()}
    assert np.allclose([got[i]["site"] for i in range(len(rows))], want)
    odds = lambda x: np.log(np.array(x) / (1 - np.array(x)))
    total = odds([x[2] for x in rows]) + odds(want) - odds(mean)
    assert np.allclose([got[i]["score"] for i in range(len(rows))], 1 / (1 + np.exp(-total)))
    assert [got[i]["accepted"] for i in range(len(rows))] == [bool(t >= 0) for t in total]


def test_sparse_sites_shrink(spark):
    rows = [("big", "big/a", 0.1)] * 200 + [("big", "big/b", 0.9)] * 200 + [("new", "new/a", 0.0), ("other", "other/a", 0.95)] + [("third", "third/a", 0.5)] * 50
    sites, prior = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    found = {}
    for r in sites.collect():
        m = (prior.mean + prior.host * r["hs"]) / (1 + prior.host * r["hn"])
        found[r["path"]] = (m + prior.path * r["s"]) / (1 + prior.path * r["n"])
    assert found["big/a"] < 0.25 and found["big/b"] > 0.75  # many documents: their own mean
    assert 0 < found["new/a"] < prior.mean  # one document: between its own and the prior


def test_repeated_ids_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(50)] + [(2, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1), (None, 1)], "doc_id long, accept int")
    assert quality.fit(docs, labels, 2).weights.shape == (quality.FEATURES + 1,)


# --- private data


def plain_base(text):
    """The contract's patterns as they stand."""
    import re

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(11)
    parts = ["a@b.co", "a.b%+-@c-d.e.f", "@x.y", "a@b", "a@b@c.de", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.4", "4539578763621486", "4539 5787 6362 1486", "1234567890123456", "+1 (017) 555-7713", "+12", "+1 2 3 4 5 6 7 8 9 0", "++49-(30).123456789", " ", "  ", "-", ".", "x", "é", "\n", "😀", "0", "00000000000000"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        assert private_data.base_spans(text) == plain_base(text), repr(text)
    for text in ("9" * 50_000, "a" * 200_000 + "@", "1." * 50_000, "+1" + " " * 100_000, "a@" * 20_000):
        private_data.base_spans(text)


def test_private_data(spark, docs, nothing, rows):
    card, other = "4539578763621486", "4485275742308327"
    made = [(i, f"see {card} and {prose(i, 5)}") for i in range(30)] + [(100, f"{prose(1, 5)} {card} {other} then {card} {prose(2, 4)}"), (101, "order 1234567890123456 of 2024"), (102, f"twice {card} {other} x")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    field = private_data.train(df)
    got = {r["doc_id"]: r for r in private_data.find(df, field).collect()}
    text = dict(made)[100]
    spans = [tuple(map(int, s.split(":")[1:])) for s in got[100]["spans"].split(",")]
    assert [text[a:b] for a, b in spans] == [card, other, card]  # the pair in one run of digits too
    assert got[100]["n_card"] == 1 and got[101]["spans"] == "" and got[5]["n_card"] == 1
    assert got[5]["base_sha256"] == hashlib.sha256(got[5]["spans"].encode()).hexdigest()
    every = {r["doc_id"]: r for r in private_data.find(docs, private_data.train(docs)).collect()}
    assert len(every) == len({r[0] for r in rows}) and every[0]["spans"] == "" and every[12]["n_email"] == every[12]["n_ip"] == 1
    assert private_data.find(nothing, private_data.train(nothing)).count() == 0
    masked = private_data.mask_documents(docs)
    assert masked.columns == docs.columns
    assert [r["text"] for r in masked.where("doc_id = 12").collect()] == ["mail [EMAIL] or [IP]"]


def test_masking_millions_of_numbers_in_little_memory():
    """A text of 40 MB, all numbers, in a process of its own: its memory is the text's and some 150 bytes a token."""
    import subprocess
    import sys

    run = """
import random, resource
import numpy as np
from corvane.llm import private_data as P
text = " ".join(map(str, random.Random(1).choices(range(1_000_000, 9_999_999), k=5_000_000))) + " a@b.cd 4539578763621486"
field = P.Field(np.log(np.full((P.SHAPES, P.LABELS), 0.2)), np.eye(P.LABELS) * 0.3, 1.5)
base, every = P.all_spans(text, field)
masked = P.masked(text, every)
assert len(base) == 2 and masked.endswith("[EMAIL] [CARD]"), (len(base), masked[-60:])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    done = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, timeout=900, check=True)
    assert int(done.stdout) < 1_000_000  # kB


def test_sets_of_equal_tokens():
    assert private_data.sets(np.array([7, 0, 5, 7, 0, 9, 5, 7], np.uint64)).tolist() == [1, -1, 0, 1, -1, -1, 0, 1]
    assert private_data.sets(np.zeros(0, np.uint64)).tolist() == []


def test_messages_agree_with_exact_marginals():
    """On a tree, loopy messages are exact."""
    n = np.arange(3)
    tokens = private_data.Tokens(n, n + 1, n * 2, n.astype(np.uint16), np.array([1, 0, 0], np.int8), np.array([0, -1, 0], np.int32), np.full(3, -1, np.int32))
    r = np.random.default_rng(0)
    field = private_data.Field(np.log(r.dirichlet(np.ones(5), private_data.SHAPES)), np.zeros((5, 5)), 1.5)
    p = np.exp(field.own[[0, 1, 2]])
    p[0, 1] *= np.exp(private_data.CLAMP)
    tie = np.exp(np.eye(5) * 1.5)
    joint = np.einsum("a,b,ha,hb->ab", p[0], p[2], tie, tie)
    want = joint.sum(0) / joint.sum()
    assert np.allclose(field.marginals(tokens)[2], want, atol=1e-2)
