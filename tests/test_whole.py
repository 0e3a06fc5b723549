"""Queries and operators over the whole of their inputs, against brute force or SQL without a cut."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, lanes, similarity
from corvane.plans.graph_plans import EDGES_SQL
from corvane.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall(), key=repr)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, prev = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
    return row[-1]


def test_near_duplicates_compares_whole_texts(spark, tmp_path):
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [[r.choice(vocabulary) for _ in range(r.choice([3, 9, 12, 40, 90, 130]))] for _ in range(30)]
    header = [f"h{k}" for k in range(60)]
    texts += [header + [r.choice(vocabulary) for _ in range(60)] for _ in range(4)]  # one opening of over 200 characters, other bodies
    for t in texts[:30]:
        for share in (0.05, 0.1, 0.15):
            copy = list(t)
            for _ in range(int(share * len(t))):
                k = r.randrange(len(copy))
                copy[k : k + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
            texts.append(copy)
    texts += [["changed", "opening", *texts[5]], texts[0], [], []]
    rows = [(i, " ".join(t).replace(" ", "\n", 1).title(), "en" if i % 7 else "fr", "src0", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            n = max(len(a), len(b))
            if bool(i % 7) == bool(j % 7) and (d := edits(a, b)) <= int((1.0 - 0.9) * n):
                want[j, i] = round(1 - d / n, 6) if n else 1.0
    got = QUERIES["near_duplicates"](spark, str(tmp_path)).collect()
    of = {i: i for i in range(len(texts))} | {x["b"]: x["a"] for x in got if x["similarity"] == 1.0}
    linked = {(x["a"], x["b"]): x["similarity"] for x in got if x["similarity"] < 1.0}
    found = {(i, j): 1.0 if of[i] == of[j] else linked.get((min(of[i], of[j]), max(of[i], of[j]))) for j in of for i in range(j)}
    assert {k: v for k, v in found.items() if v is not None} == want
    assert len(want) > 20


def test_many_copies_are_one_class(spark):
    """20,000 copies, in two layouts, and a near copy: 200 million pairs, of which none is made."""
    body = [f"word{k}" for k in range(40)]
    copies = spark.range(20_000).select(F.col("id"), F.lit("s").alias("signature"), F.when(F.col("id") % 4 == 0, "\n".join(body)).otherwise(" ".join(body)).alias("text"), F.when(F.col("id") % 4 == 0, 40).otherwise(1).alias("loc"))
    near = spark.createDataFrame([(20_000, "s", " ".join([*body[:-1], "other"]), 7)], "id long, signature string, text string, loc int")
    items = copies.unionByName(near)
    members, links = similarity.similar_texts(items.drop("loc"), 0.9)
    assert [tuple(r) for r in links.collect()] == [(0, 20_000, 1 - 1 / 40)]
    assert members.where("class = 0").count() == 20_000
    got = similarity.weights(members.join(items.select("id", "loc"), "id"), links).collect()
    inner = 40 * (5000 * 4999 // 2) + (15_000 * 14_999 // 2) + 5000 * 15_000
    assert len(got) == 1 and got[0]["pairs"] == 20_000 * 19_999 // 2 + 20_000
    assert got[0]["impact"] == pytest.approx(inner + (5000 * 7 + 15_000) * (1 - 1 / 40))


def test_word_distance():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        d, most = edits(a, b), r.randrange(8)
        assert similarity.word_distance(a, b, most) == d if d <= most else similarity.word_distance(a, b, most) > most


def test_suffix_match_knows_all_pages(spark):
    want = rows_of("""WITH u AS (SELECT DISTINCT split_part(url, '://', 2) AS path FROM pages), k AS (SELECT DISTINCT regexp_extract(url, '[^/]+$') AS path FROM pages WHERE regexp_matches(url, '[^/]+$'))
    SELECT u.path, max_by(k.path, length(k.path)) AS match FROM u LEFT JOIN k ON u.path = k.path OR ends_with(u.path, '/' || k.path) GROUP BY u.path""", "pages")
    assert sorted(map(tuple, QUERIES["suffix_match"](spark, SF).select("path", "match").collect()), key=repr) == want


def test_peer_lists_and_lanes_of_all_edges(spark):
    want = rows_of(f"""WITH {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS l, count(*) AS c FROM e GROUP BY 1), i AS (SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS l, count(*) AS c FROM e GROUP BY 1)
    SELECT node, coalesce(o.l, ''), coalesce(i.l, ''), (coalesce(o.c, 0) + coalesce(i.c, 0))::BIGINT FROM n LEFT JOIN o USING (node) LEFT JOIN i USING (node)""", "lineitem", "orders", "customer", "supplier", "nation")
    got = QUERIES["peer_lists"](spark, SF).select("node", "outgoing", "incoming", "peers").collect()
    assert sorted(map(tuple, got), key=repr) == want
    want = rows_of(f"WITH {EDGES_SQL} SELECT src, dst, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1)::INT FROM edges", "lineitem", "orders", "customer", "supplier", "nation")
    assert sorted(map(tuple, QUERIES["lane_rank"](spark, SF).collect()), key=repr) == want


def test_hot_nodes_are_in_parts(spark):
    edges = spark.range(5000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("src"), F.lit("hot").alias("dst"))
    parts = graph.peer_pieces(edges.union(edges), 100).where("node = 'hot'").collect()
    assert len(parts) == 50 and max(len(p["incoming"]) for p in parts) < 200 and {p["peers"] for p in parts} == {5000}
    assert sorted(x for p in parts for x in p["incoming"]) == sorted(f"c{k}" for k in range(5000))
    ranked = sorted((r["lane"], r["src"]) for r in lanes.ranked_lanes(edges, ["dst"], [F.col("src")]).collect())
    assert ranked == list(enumerate(sorted(f"c{k}" for k in range(5000))))


def test_all_event_transitions(spark):
    edges = "WITH RECURSIVE pairs AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), edges AS (SELECT DISTINCT src, dst FROM pairs WHERE dst IS NOT NULL)"
    want = rows_of(f"{edges}, r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM r JOIN edges ON src = b) SELECT src, dst FROM edges WHERE (dst, src) IN (SELECT (a, b) FROM r)", "events")
    assert len(want) > 3
    assert sorted(map(tuple, QUERIES["cycle_edges"](spark, SF).select("src", "dst").collect()), key=repr) == want


def test_copies_lower_the_score(spark, tmp_path):
    body = "\n".join(f"line {k} of a text" for k in range(10))
    texts = [("copied", body), ("copied", body), ("copied", body + " more"), ("alone", body), ("alone", "something else"), (None, body), (None, body)]
    rows = [(i, t, "en", s, len(t)) for i, (s, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    areas = {(r["project"], r["area"]): r for r in QUERIES["area_scores"](spark, str(tmp_path)).collect()}
    assert {p: areas[p, "duplicate_code"]["issues"] for p in ("copied", "alone", None)} == {"copied": 3, "alone": 0, None: 1}
    impact = 10 * (1 + 2 * (1 - 1 / 51))
    assert areas["copied", "duplicate_code"]["score"] == round(max(0, 1 - 2.5 * impact / 30), 6) == 0
    assert areas["alone", "duplicate_code"]["score"] == 1
    assert {a for (p, a), r in areas.items() if p == "copied" and not r["enabled"]} >= {"layers", "localization"}
    scores = {r["project"]: r for r in QUERIES["compliance_score"](spark, str(tmp_path)).collect()}
    assert scores["copied"]["focus"] == "duplicate_code" and scores["copied"]["score"] < scores["alone"]["score"]


def test_secrets_of_all_types(spark, tmp_path):
    lines = {
        "aws_access_key": "AKIA" + "A1" * 8,
        "generic_secret": 'password = "longenough1"',
        "bearer_token": "Bearer " + "ab1." * 5,
        "private_key": "-----BEGIN RSA " + "PRIVATE KEY-----",
        "email_pii": "someone@mail.example",
        "stripe_key": "sk_" + "live_" + "a1" * 10,
        "github_pat": "ghp_" + "b2" * 12,
        "high_entropy": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789",
    }
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate([*lines.values(), "plain"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["secrets_by_type"](spark, str(tmp_path)).collect())) == sorted((k, 1, 1) for k in lines)
