"""Queries over nested intervals and trees of folders: scopes, the reach of directives, warnings by artifact, order of folders, packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import folders, intervals, overlay, packages, syntax
from corvane.plans.report_plans import BLOCKS_SQL, ISSUES_SQL, blocks, line_issues
from corvane.plans.text_plans import files, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH c AS (SELECT c_custkey AS k, 'lib/n' || c_nationkey || '/f' || c_custkey || '.dart' AS path FROM customer)
SELECT path, 1::INT AS line, 'idle' || k AS name FROM c UNION ALL SELECT path, 2, 'a' FROM c WHERE k % 3 <> 0 UNION ALL SELECT path, 4, 'a' FROM c WHERE k % 2 <> 0
UNION ALL SELECT path, 6 + (k % 2 = 0)::INT + (k % 3 = 0)::INT, 'item' FROM c WHERE k % 5 = 0""")
def unused_locals(spark, sf_dir) -> DataFrame:
    """A function for each customer: a parameter that nothing uses, a variable that an inner one of its name hides, uses inside texts, a loop."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    some = lambda when, text: F.when(when, F.lit(text)).otherwise("")
    content = F.concat(
        F.lit("void f"), k.cast("string"), F.lit("(int used, int idle"), k.cast("string"), F.lit(") {\n  var a = used;\n  {\n    int a = "), n.cast("string"), F.lit(";\n"),
        some(k % 2 == 0, "    print(a);\n"), F.lit("  }\n"), some(k % 3 == 0, "  print('value ${a + 1} it''s');\n"), some(k % 5 == 0, "  for (final item in [1, 2]) { /* item } */ }\n"), F.lit("}\n"),
    )
    path = F.concat(F.lit("lib/n"), n.cast("string"), F.lit("/f"), k.cast("string"), F.lit(".dart"))
    return syntax.unused_variables(table(spark, sf_dir, "customer").select(path.alias("path"), content.alias("content")))


@query("""WITH d AS (SELECT doc_id::VARCHAR AS path, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM documents),
line AS (SELECT path, unnest(range(1, n + 1)) AS line, unnest(l) AS t FROM d),
mark AS (SELECT path, line FROM line WHERE t LIKE 'T%'), issue AS (SELECT path, line FROM line WHERE regexp_matches(t, '[0-9]')),
block AS (SELECT path, k * s + 1 AS first, least(k * s + s, n) AS last FROM (SELECT path, n, s, unnest(range(0, (n - 1) // s + 1)) AS k FROM d, (VALUES (5), (15)) v(s)))
SELECT i.path, i.line::INT AS line FROM issue i WHERE NOT EXISTS (SELECT 1 FROM mark m WHERE m.path = i.path AND m.line = i.line)
AND NOT EXISTS (SELECT 1 FROM mark m JOIN block b ON b.path = m.path AND b.first = m.line WHERE b.path = i.path AND i.line BETWEEN b.first AND b.last)""")
def directive_reach(spark, sf_dir):
    """Lines with digits as issues, lines that begin with T as directives: one is good for its line and for whatever block of 5 or 15 lines begins there, with all in it."""
    d = files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), T.lines(F.col("text")).alias("l"))
    line = d.select("path", F.posexplode("l").alias("at", "t")).select("path", (F.col("at") + 1).alias("line"), "t")
    marks = line.where(F.col("t").startswith("T")).select("path", F.col("line").alias("first"))
    block = d.select("path", F.size("l").alias("n"), F.explode(F.array(F.lit(5), F.lit(15))).alias("s"))
    block = block.select("path", "n", "s", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("s")).cast("int"))).alias("k"))
    block = block.select("path", (F.col("k") * F.col("s") + 1).alias("first"), F.least((F.col("k") + 1) * F.col("s"), F.col("n")).alias("last"))
    reach = marks.select("path", "first", F.col("first").alias("last")).unionByName(block.join(marks, ["path", "first"], "left_semi"))
    return intervals.outside(line.where(F.col("t").rlike("[0-9]")).select("path", "line"), reach, ["path"])


def artifacts(spark, sf_dir) -> DataFrame:
    """Documents as files; blocks of report_plans as callables and classes. The callable of every fourth block belongs to the class around it."""
    b = blocks(spark, sf_dir)
    owner = F.when((F.col("kind") == "function") & (F.col("ordinal") % 4 == 0), F.concat(F.lit("class"), F.floor(F.col("ordinal") / 2).cast("string")))
    inner = b.select("path", "kind", F.concat_ws("/", "path", "name").alias("id"), "name", owner.alias("owner"), "first", "last", "ordinal")
    whole = files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"))
    none = lambda kind: F.lit(None).cast(kind)
    return whole.select("path", F.lit("file").alias("kind"), F.col("path").alias("id"), F.col("path").alias("name"), none("string").alias("owner"), F.lit(1).alias("first"), none("int").alias("last"), F.lit(-1).alias("ordinal")).unionByName(inner.withColumn("last", F.col("last").cast("int")))


def all_warnings(spark, sf_dir) -> DataFrame:
    """Issues of all scopes: lines with licenses and tokens; for some documents dead files, classes and functions, with and without owner, and cycles."""
    at_lines = line_issues(spark, sf_dir).select("issue_id", "path", F.lit("Secrets").alias("type"), F.lit("line").alias("scope"), "line", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("owner"), F.lit(False).alias("hard"))
    d = files(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("path"))
    entry = lambda every, kind, scope, name=None, owner=None, hard=False: d.where(F.col("doc_id") % every == 0).select(F.concat_ws("/", F.lit(scope), F.lit(str(every)), "path").alias("issue_id"), "path", F.lit(kind).alias("type"), F.lit(scope).alias("scope"), F.lit(None).cast("int").alias("line"), F.lit(name).cast("string").alias("name"), F.lit(owner).cast("string").alias("owner"), F.lit(hard).alias("hard"))
    rest = [
        entry(13, "Layers", "file", hard=True), entry(17, "Layers", "file"), entry(19, "Dead Code", "dead_file"), entry(11, "Dead Code", "dead_class", "class0"), entry(7, "Dead Code", "dead_function", "function0"),
        entry(5, "Dead Code", "dead_function", "function2", "class1"), entry(9, "Dead Code", "dead_function", "function0", "class0"), entry(23, "Dead Code", "dead_function", "function0", "class7"), entry(29, "Dead Code", "dead_function", "lost", "class9"),
    ]
    for r in rest:
        at_lines = at_lines.unionByName(r)
    return at_lines


@query(f"""WITH {BLOCKS_SQL}, {ISSUES_SQL}, f AS (SELECT path, name, CASE WHEN substr(name, 9)::INT % 4 = 0 THEN 'class' || substr(name, 9)::INT // 2 END AS owner, first, last, substr(name, 9)::INT AS ordinal FROM blocks WHERE kind = 'function'),
c AS (SELECT path, name, first, last, substr(name, 6)::INT AS ordinal FROM blocks WHERE kind = 'class'),
hit AS (SELECT i.path, i.line, min_by(f.name, f.ordinal) AS call, min_by(struct_pack(o := f.owner), f.ordinal).o AS owner FROM issues i LEFT JOIN f ON f.path = i.path AND i.line BETWEEN f.first AND f.last GROUP BY i.path, i.line),
hit2 AS (SELECT h.*, (SELECT min_by(c.name, c.ordinal) FROM c WHERE c.path = h.path AND h.line BETWEEN c.first AND c.last) AS cls FROM hit h),
g AS (SELECT doc_id::VARCHAR AS path, e.* FROM documents, (VALUES (7, 'function0', NULL), (5, 'function2', 'class1'), (9, 'function0', 'class0'), (23, 'function0', 'class7'), (29, 'lost', 'class9')) e(every, name, owner) WHERE doc_id % every = 0),
gone AS (SELECT g.path, g.owner, g.every, min_by(f.name, f.ordinal) AS call, min_by(struct_pack(o := f.owner), f.ordinal).o AS of FROM g LEFT JOIN f ON f.path = g.path AND f.name = g.name AND (g.owner IS NULL OR g.owner IS NOT DISTINCT FROM f.owner) GROUP BY g.path, g.owner, g.every),
x AS (SELECT 'file' AS level, path, path AS key, 'Secrets' AS type, false AS dead, false AS hard FROM hit
UNION ALL SELECT 'callable', path, path || '/' || call, 'Secrets', false, false FROM hit WHERE call IS NOT NULL
UNION ALL SELECT 'class', path, CASE WHEN call IS NOT NULL THEN owner ELSE cls END, 'Secrets', false, false FROM hit2
UNION ALL SELECT 'file', doc_id::VARCHAR, doc_id::VARCHAR, 'Layers', false, true FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT 'file', doc_id::VARCHAR, doc_id::VARCHAR, 'Layers', false, false FROM documents WHERE doc_id % 17 = 0
UNION ALL SELECT 'file', doc_id::VARCHAR, doc_id::VARCHAR, 'Dead Code', true, true FROM documents WHERE doc_id % 19 = 0
UNION ALL SELECT 'file', doc_id::VARCHAR, doc_id::VARCHAR, 'Dead Code', false, true FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'class', doc_id::VARCHAR, 'class0', 'Dead Code', true, true FROM documents WHERE doc_id % 11 = 0
UNION ALL SELECT 'file', path, path, 'Dead Code', false, true FROM gone UNION ALL SELECT 'callable', path, path || '/' || call, 'Dead Code', true, true FROM gone WHERE call IS NOT NULL
UNION ALL SELECT 'class', path, CASE WHEN call IS NOT NULL THEN of ELSE owner END, 'Dead Code', false, true FROM gone),
t AS (SELECT level, path, key, type, count(*) AS n, bool_or(dead) AS dead, bool_or(hard) AS hard FROM x WHERE key IS NOT NULL GROUP BY ALL)
SELECT level, path, key, sum(n)::BIGINT AS warnings, bool_or(dead) AS dead, bool_or(hard) AS hard, string_agg(type || ':' || n, ', ' ORDER BY type) AS types FROM t GROUP BY level, path, key""")
def warning_index(spark, sf_dir):
    """Warnings of every file, class and callable of all documents, with what is dead and what is an error."""
    found = overlay.warning_index(all_warnings(spark, sf_dir), artifacts(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return found.select("level", "path", "key", "warnings", "dead", "hard", F.array_join(entries, ", ").alias("types"))


TREE_SQL = """o AS (SELECT r_name || '/' || n_name || '/C' || c_custkey AS src, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT r_name || '/' || n_name AS dst, s_suppkey AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


@query(f"""WITH {TREE_SQL}, e AS (SELECT src, dst, count(*) AS n FROM lineitem JOIN o ON o.k = l_orderkey JOIN s ON s.k = l_suppkey GROUP BY src, dst),
f AS (SELECT DISTINCT unnest([split_part(src, '/', 1), split_part(src, '/', 1) || '/' || split_part(src, '/', 2), src]) AS folder FROM o),
z AS (SELECT a.folder, count(*) AS size FROM f a JOIN f b ON b.folder = a.folder OR starts_with(b.folder, a.folder || '/') GROUP BY a.folder),
p AS (SELECT f.folder, len(string_split(f.folder, '/')) AS depth, row_number() OVER (ORDER BY string_split(f.folder, '/')) AS pre, size FROM f JOIN z ON z.folder = f.folder)
SELECT p.folder, depth::BIGINT AS depth, pre::BIGINT AS pre, (pre + size - depth)::BIGINT AS post, size::BIGINT AS size, coalesce((SELECT sum(n) FROM e WHERE dst = p.folder), 0)::BIGINT AS incoming, coalesce((SELECT sum(n) FROM e WHERE src = p.folder), 0)::BIGINT AS outgoing FROM p""")
def folder_order(spark, sf_dir):
    """Regions, nations and customers as folders, in the order of a depth-first walk, with what points to them (suppliers' nations) and from them (customers)."""
    t = lambda n: table(spark, sf_dir, n)
    at = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("place"))
    customer = t("customer").join(at, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.col("place"), F.lit("/C"), F.col("c_custkey").cast("string")).alias("src"))
    orders = t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), "src")
    supplier = t("supplier").join(at, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("s"), F.col("place").alias("dst"))
    edges = t("lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("k")).join(supplier, F.col("l_suppkey") == F.col("s")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    tree = folders.hierarchy(orders.select(F.concat(F.col("src"), F.lit("/o")).alias("path")))
    return folders.depth_first(tree).join(folders.folder_metrics(tree, edges), "folder")


@query("""WITH u AS (SELECT page_id, regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS path FROM pages),
m AS (SELECT DISTINCT split_part(path, '/', 1) AS folder FROM u WHERE page_id % 4 = 0 UNION SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') FROM u WHERE page_id % 3 = 0 AND contains(path, '/'))
SELECT path, (SELECT max_by(folder, length(folder)) FROM m WHERE starts_with(u.path, m.folder || '/')) AS manifest FROM (SELECT DISTINCT path FROM u) u""")
def nearest_manifest(spark, sf_dir):
    """Every address with the deepest folder above it that is a package: some hosts, and some folders within hosts."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.split("url", "://")[1], "[?#].*$", "").alias("path"))
    hosts = p.where("page_id % 4 = 0").select(F.split("path", "/")[0].alias("folder"))
    inner = p.where(F.col("path").contains("/") & (F.col("page_id") % 3 == 0)).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    return packages.nearest(p, hosts.unionByName(inner))
