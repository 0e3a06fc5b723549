"""Queries over graphs drawn from the star schema, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.plans.text_plans import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line -> order, part, supplier; order -> customer; customer, supplier -> nation; nation -> region. A node's folder is its letter."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda letter, *keys: F.concat_ws("", F.lit(f"{letter}/"), F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    line = node("L", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = t("lineitem").select(line.alias("src"), F.explode(F.array(node("O", "l_orderkey"), node("P", "l_partkey"), node("S", "l_suppkey"))).alias("dst"))
    rest = (
        t("orders").select(node("O", "o_orderkey").alias("src"), node("C", "o_custkey").alias("dst")),
        t("customer").select(node("C", "c_custkey").alias("src"), node("N", "c_nationkey").alias("dst")),
        t("supplier").select(node("S", "s_suppkey").alias("src"), node("N", "s_nationkey").alias("dst")),
        t("nation").select(node("N", "n_nationkey").alias("src"), node("R", "n_regionkey").alias("dst")),
    )
    for r in rest:
        lines = lines.union(r)
    return lines


EDGES_SQL = """edges AS (
SELECT 'L/' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS src, unnest(['O/' || l_orderkey, 'P/' || l_partkey, 'S/' || l_suppkey]) AS dst FROM lineitem
UNION ALL SELECT 'O/' || o_orderkey, 'C/' || o_custkey FROM orders UNION ALL SELECT 'C/' || c_custkey, 'N/' || c_nationkey FROM customer
UNION ALL SELECT 'S/' || s_suppkey, 'N/' || s_nationkey FROM supplier UNION ALL SELECT 'N/' || n_nationkey, 'R/' || n_regionkey FROM nation)"""
NODES_SQL = "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"
ENTRY_SQL = "entries AS (SELECT 'O/' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')"
REACH_SQL = "reach AS (SELECT node FROM entries UNION SELECT dst FROM reach JOIN edges ON src = node)"
LAYERS_SQL = "steps AS (SELECT node, 1 AS d FROM nodes UNION SELECT dst, d + 1 FROM steps JOIN (SELECT DISTINCT src, dst FROM edges) e ON src = node), layers AS (SELECT node, max(d)::INT AS layer FROM steps GROUP BY node)"


def entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O/"), F.col("o_orderkey").cast("string")).alias("node"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {ENTRY_SQL}, {REACH_SQL} SELECT substr(node, 1, 1) AS folder, count(*)::BIGINT AS n, min(node) AS first FROM reach GROUP BY 1")
def reachable(spark, sf_dir):
    r = G.reachable(entity_edges(spark, sf_dir), entries(spark, sf_dir))
    return r.groupBy(F.substring("node", 1, 1).alias("folder")).agg(F.count("*").alias("n"), F.min("node").alias("first"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {ENTRY_SQL}, {REACH_SQL} SELECT node FROM (SELECT 'C/' || c_custkey AS node FROM customer) c WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.node = c.node)")
def dead_nodes(spark, sf_dir):
    """Customers that no entry order reaches; with no entry at all, none is called dead."""
    start = entries(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("C/"), F.col("c_custkey").cast("string")).alias("node"))
    if not start.limit(1).count():
        return customers.where("false")
    return customers.join(G.reachable(entity_edges(spark, sf_dir), start), "node", "left_anti")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09 AND l_quantity > 45)")
def dead_symbols(spark, sf_dir):
    from corvane.operators.deadcode import unused_symbols

    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.09D and l_quantity > 45").select(F.col("l_partkey").alias("name"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), "p_name")
    return unused_symbols(parts, used).select(F.col("name").alias("p_partkey"), "p_name")


@query(f"WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, {LAYERS_SQL} SELECT layer, substr(node, 1, 1) AS folder, count(*)::BIGINT AS n, (SELECT max(layer) + 1 FROM layers)::BIGINT AS layer_count FROM layers GROUP BY layer, substr(node, 1, 1)")
def layers(spark, sf_dir):
    assigned = G.layers(entity_edges(spark, sf_dir))
    return assigned.groupBy("layer", F.substring("node", 1, 1).alias("folder")).agg(F.count("*").alias("n")).join(G.layer_count(assigned))


@query(f"WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, {LAYERS_SQL}, f AS (SELECT right(node, 1) AS folder, max(layer) AS layer FROM layers GROUP BY 1) SELECT right(src, 1) || '/' || replace(src, '/', '.') AS src, right(dst, 1) || '/' || replace(dst, '/', '.') AS dst, 'wrongFolderLayer' AS type FROM edges JOIN f a ON a.folder = right(src, 1) JOIN f b ON b.folder = right(dst, 1) WHERE a.layer > b.layer")
def layer_violations(spark, sf_dir):
    """Nodes in folders by the last digit of their keys, which the layers of files don't follow."""
    e = entity_edges(spark, sf_dir)
    moved = lambda c: F.concat(F.right(c, F.lit(1)), F.lit("/"), F.replace(c, F.lit("/"), F.lit(".")))
    assigned = G.layers(e).select(moved(F.col("node")).alias("node"), "layer")
    return G.violations(e.select(moved(F.col("src")).alias("src"), moved(F.col("dst")).alias("dst")), assigned)


@query(f"WITH {EDGES_SQL} SELECT substr(src, 1, 1) AS src, substr(dst, 1, 1) AS dst, count(*)::BIGINT AS weight FROM edges WHERE substr(src, 1, 1) <> substr(dst, 1, 1) GROUP BY 1, 2")
def folder_graph(spark, sf_dir):
    return G.folder_weights(entity_edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL}, {NODES_SQL}, o AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1) SELECT node, coalesce(i.n, 0)::BIGINT AS n_in, coalesce(o.n, 0)::BIGINT AS n_out FROM nodes LEFT JOIN i USING (node) LEFT JOIN o USING (node)")
def node_degree(spark, sf_dir):
    e = entity_edges(spark, sf_dir)
    return G.degrees(e, G.nodes_of(e))


def event_edges(spark, sf_dir) -> DataFrame:
    """All pairs of event types that follow each other for a user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst is not null")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


EVENTS_SQL = "pairs AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), edges AS (SELECT src, dst, count(*) AS n FROM pairs WHERE dst IS NOT NULL GROUP BY 1, 2)"
SCC_SQL = f"WITH RECURSIVE {EVENTS_SQL}, nodes AS (SELECT DISTINCT event_type AS node FROM events), r AS (SELECT node AS a, node AS b FROM nodes UNION SELECT a, dst FROM r JOIN edges ON src = b), scc AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query(f"{SCC_SQL} SELECT node, component, (count(*) OVER (PARTITION BY component))::BIGINT AS size FROM scc")
def scc(spark, sf_dir):
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("node")).distinct()
    parts = G.components_of_cycles(event_edges(spark, sf_dir))
    every = types.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return every.join(every.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


@query(f"WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), r AS (SELECT node AS a, node AS b FROM nodes UNION SELECT a, dst FROM r JOIN e ON src = b), c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), z AS (SELECT component, count(*) AS size FROM c GROUP BY component) SELECT size::BIGINT AS size, count(*)::BIGINT AS components, min(component) AS first FROM z GROUP BY size")
def component_sizes(spark, sf_dir):
    """Strongly connected components of all entities by their size: entities point one way, so each is one of its own."""
    parts = G.components_of_cycles(entity_edges(spark, sf_dir))
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"), F.min("component").alias("first"))


@query(f"{SCC_SQL} SELECT e.src, e.dst, a.component FROM edges e JOIN scc a ON a.node = e.src JOIN scc b ON b.node = e.dst WHERE a.component = b.component")
def cycle_edges(spark, sf_dir):
    return G.cycle_edges(event_edges(spark, sf_dir))


@query(None)
def dfs_cycles(spark, sf_dir):
    """Back edges of the depth-first walk, which depend on the recorded order."""
    e = event_edges(spark, sf_dir)
    return G.back_edges(e.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("n"), "src", "dst"))))


@query("""WITH RECURSIVE up AS (SELECT conv_id, turn, turn AS anc FROM conversations UNION ALL SELECT u.conv_id, u.turn, c.turn FROM up u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.anc - 1),
r AS (SELECT conv_id, turn, min(anc) AS root FROM up GROUP BY conv_id, turn)
SELECT c.role AS root_role, count(*)::BIGINT AS n FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.root GROUP BY 1""")
def inheritance(spark, sf_dir):
    """Turns as classes whose parent is the turn before; what the last ancestors are."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    node = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    nodes = c.select(node(F.col("turn")).alias("node"), node(F.col("turn") - 1).alias("parent"), "role")
    real = nodes.select("node", "parent").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")
    roots = G.roots_of(real)
    named = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"))
    return named.join(nodes.select(F.col("node").alias("root"), F.col("role").alias("root_role")), "root").groupBy("root_role").agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), b AS (SELECT src AS node, dst AS peer, true AS o FROM e UNION ALL SELECT dst, src, false FROM e), z AS (SELECT node, count(*) AS peers FROM b GROUP BY node),
p AS (SELECT b.*, z.peers, ('0x' || substr(md5(peer), 1, 8))::BIGINT % CASE WHEN z.peers > 1000 THEN ceil(z.peers / 1000.0)::BIGINT ELSE 1 END AS piece FROM b JOIN z ON z.node = b.node)
SELECT node, coalesce(string_agg(peer, ',' ORDER BY peer) FILTER (o), '') AS outgoing, coalesce(string_agg(peer, ',' ORDER BY peer) FILTER (NOT o), '') AS incoming, any_value(peers)::BIGINT AS peers FROM p GROUP BY node, piece""")
def peer_lists(spark, sf_dir):
    """All nodes' peers; a node of over a thousand has several rows, each with a part of its lists and with all its peers counted."""
    p = G.peer_pieces(entity_edges(spark, sf_dir))
    return p.select("node", F.array_join("outgoing", ",").alias("outgoing"), F.array_join("incoming", ",").alias("incoming"), "peers")


@query("""WITH d AS (SELECT DISTINCT s_name AS a, n_name AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
roots AS (SELECT s_name AS p FROM supplier WHERE s_acctbal > 5000), l1 AS (SELECT DISTINCT b AS p FROM d JOIN roots ON a = p WHERE b NOT IN (SELECT p FROM roots)),
l2 AS (SELECT DISTINCT b AS p FROM d JOIN l1 ON a = p WHERE b NOT IN (SELECT p FROM roots) AND b NOT IN (SELECT p FROM l1))
SELECT 0::INT AS level, p AS package, (SELECT count(*) FROM d WHERE d.b = p)::BIGINT AS used_by FROM roots UNION ALL SELECT 1, p, (SELECT count(*) FROM d WHERE d.b = p) FROM l1 UNION ALL SELECT 2, p, (SELECT count(*) FROM d WHERE d.b = p) FROM l2""")
def package_levels(spark, sf_dir):
    from corvane.operators.packages import levels, usage

    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    deps = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("package"), F.col("n_name").alias("needs")).union(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")).distinct()
    roots = s.where("s_acctbal > 5000").select(F.col("s_name").alias("package"))
    return levels(deps, roots).join(usage(deps), "package", "left").select("level", "package", F.coalesce("used_by", F.lit(0)).alias("used_by"))


@query(f"WITH {EDGES_SQL}, e AS (SELECT DISTINCT substr(src, 1, 1) AS s, substr(dst, 1, 1) AS d FROM edges) SELECT row_number() OVER (ORDER BY s, d)::INT AS line, '  ' || lower(s) || ' --> ' || lower(d) AS text FROM e WHERE s <> d")
def graph_mermaid(spark, sf_dir):
    from corvane.sources.graph_text import mermaid_edges

    e = G.folder_edges(entity_edges(spark, sf_dir))
    return mermaid_edges(e.select(F.lower("src").alias("src"), F.lower("dst").alias("dst"))).select("line", "text")


@query(f"WITH {EDGES_SQL}, e AS (SELECT src, dst FROM edges) SELECT src, dst, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1)::INT AS lane FROM e")
def lane_rank(spark, sf_dir):
    """Lanes of all edges at their targets."""
    from corvane.operators.lanes import ranked_lanes

    return ranked_lanes(entity_edges(spark, sf_dir), ["dst"], [F.col("src")]).select("src", "dst", "lane")


@query(f"WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, {LAYERS_SQL}, x AS (SELECT a.layer AS lo, b.layer AS hi FROM edges JOIN layers a ON a.node = src JOIN layers b ON b.node = dst) SELECT gap::INT AS gap, count(*)::BIGINT AS n FROM (SELECT unnest(range(least(lo, hi), greatest(lo, hi))) AS gap FROM x) GROUP BY gap")
def gap_crossings(spark, sf_dir):
    from corvane.operators.lanes import crossings

    e = entity_edges(spark, sf_dir)
    return crossings(G.placed_edges(e, G.layers(e)))
