"""Queries over source files that are written from the star schema: every customer is a Dart file, every nation a translation key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import localization as L
from corvane.operators import metrics as M
from corvane.plans import project as P
from corvane.plans.text_plans import table
from corvane.sources import inventory, translations
from corvane.sources import tree as tree_source
from corvane.sources.store import materialize

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of a file for each customer k of nation n. What is there depends on k: a leading directive (k % 10 = 0),
    documentation (k % 3 > 0), a directive on a line (k % 7 = 0), members in order (k % 2 = 0), a main function (k % 50 = 0)."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    line = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit("\n"))
    zeta = F.concat(F.lit("  void zeta() {\n    print('Order words "), n.cast("string"), F.lit(" ${a + 1}');\n  }\n"))
    alpha = F.concat(F.lit("  void alpha() {\n    show('Label "), F.col("c_mktsegment"), F.lit("', 7);"), F.when(k % 7 == 0, " // ignore: tool_magic_numbers").otherwise(""), F.lit("\n  }\n"))
    content = F.concat(
        F.when(k % 10 == 0, "// ignore: tool_layers\n").otherwise(""),
        line("import '../n", n.cast("string"), "/shared.dart';"),
        line("import 'package:demo/src/c", (k + 1).cast("string"), ".dart';"),
        F.lit("import 'dart:io';\n\n"),
        F.when(k % 3 > 0, F.concat(F.lit("/// Customer "), k.cast("string"), F.lit(".\n"))).otherwise(""),
        line("class C", k.cast("string"), " extends StatelessWidget {"),
        F.lit("  final int width = 42;\n"),
        line("  final steps = ", k.cast("string"), ";"),
        F.when(k % 2 == 0, F.concat(alpha, zeta)).otherwise(F.concat(zeta, alpha)),
        F.lit("}\n"),
        F.when(k % 50 == 0, "void main() {}\n").otherwise(""),
    )
    path = F.concat(F.lit("lib/src/n"), n.cast("string"), F.lit("/c"), k.cast("string"), F.lit(".dart"))
    return table(spark, sf_dir, "customer").select(path.alias("path"), content.alias("content"))


def facts(spark, sf_dir) -> DataFrame:
    return materialize(tree_source.extract(sources(spark, sf_dir)), "source-facts")


#: Line of the class, and what stands above it: a directive, three imports, a blank line, a line of documentation.
C_SQL = """c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg, 'lib/src/n' || c_nationkey || '/c' || c_custkey || '.dart' AS path,
5 + (c_custkey % 10 = 0)::INT + (c_custkey % 3 > 0)::INT AS line FROM customer)"""


@query(f"WITH {C_SQL} SELECT n AS nation, count(*)::BIGINT AS files, sum(13 + (k % 10 = 0)::INT + (k % 3 > 0)::INT + (k % 50 = 0)::INT)::BIGINT AS loc, sum((k % 10 = 0)::INT + (k % 3 > 0)::INT + (k % 7 = 0)::INT)::BIGINT AS comment_lines, count(*) FILTER (k % 50 = 0)::BIGINT AS mains FROM c GROUP BY n")
def source_facts(spark, sf_dir):
    """What one pass over each file finds, by nation."""
    f = facts(spark, sf_dir).withColumn("nation", F.regexp_extract("path", "/n([0-9]+)/", 1).cast("int"))
    return f.groupBy("nation").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("comment_lines").alias("comment_lines"), F.count_if("has_main").alias("mains"))


@query(f"""WITH {C_SQL}, a AS (SELECT 'file' AS kind, 13 + (k % 10 = 0)::INT + (k % 3 > 0)::INT + (k % 50 = 0)::INT AS loc FROM c UNION ALL SELECT 'class', 10 FROM c UNION ALL SELECT 'method', 3 FROM c UNION ALL SELECT 'method', 3 FROM c UNION ALL SELECT 'function', 1 FROM c WHERE k % 50 = 0)
SELECT kind, count(*)::BIGINT AS n, sum(loc)::BIGINT AS loc, count(*) FILTER (loc > CASE kind WHEN 'file' THEN 14 WHEN 'class' THEN 9 ELSE 5 END)::BIGINT AS over_limit FROM a GROUP BY kind""")
def source_artifacts(spark, sf_dir):
    """Files and what they declare, with their sizes held against limits."""
    limited = M.with_limits(P.artifacts_of(facts(spark, sf_dir)), {"file": 14, "class": 9, "method": 5, "function": 5})
    return limited.groupBy("kind").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"), F.count_if(F.col("loc") > F.col("limit")).alias("over_limit"))


@query(f"""WITH {C_SQL}, v AS (SELECT 'string' AS kind, 'Order words ' || n || ' ${{a + 1}}' AS value FROM c UNION ALL SELECT 'string', 'Label ' || seg FROM c UNION ALL SELECT 'number', '42' FROM c UNION ALL SELECT 'number', k::VARCHAR FROM c UNION ALL SELECT 'number', '7' FROM c)
SELECT kind, value, count(*)::BIGINT AS n FROM v GROUP BY kind, value""")
def source_literals(spark, sf_dir):
    return inventory.literals(facts(spark, sf_dir))


@query(f"""WITH {C_SQL}, d AS (SELECT 'tool_layers' AS token, path, 1 AS line FROM c WHERE k % 10 = 0 UNION ALL SELECT 'tool_magic_numbers', path, line + CASE WHEN k % 2 = 0 THEN 4 ELSE 7 END FROM c WHERE k % 7 = 0)
SELECT token, (count(*) OVER (PARTITION BY token))::BIGINT AS total, (row_number() OVER (PARTITION BY token ORDER BY path, line))::BIGINT AS place, path, line::INT AS line FROM d""")
def source_ignores(spark, sf_dir):
    """Two directives over all customers: each with its place among those of its token."""
    return inventory.ignores(facts(spark, sf_dir))


@query(f"WITH {C_SQL}, d AS (SELECT path, (k % 10 = 0)::INT + (k % 7 = 0)::INT AS n FROM c) SELECT path, n::BIGINT AS n, (SELECT max(length(path)) FROM d WHERE n > 0)::BIGINT AS width FROM d WHERE n > 0")
def source_directives(spark, sf_dir):
    """Directives by file, with the width that a listing of the files needs."""
    found = inventory.directive_counts(facts(spark, sf_dir))
    return found.join(inventory.display_width(found, "path"))  # one row


@query(f"WITH {C_SQL} SELECT path AS src, 'lib/src/n' || n || '/shared.dart' AS dst FROM c UNION ALL SELECT path, 'lib/src/c' || (k + 1) || '.dart' FROM c")
def source_edges(spark, sf_dir):
    """Imports as edges between files, addresses resolved."""
    return tree_source.import_edges(facts(spark, sf_dir), "demo")


@query(f"WITH {C_SQL} SELECT path, line + CASE WHEN k % 2 = 0 THEN 4 ELSE 7 END AS line, 'Label ' || seg AS value, 'widgets' AS focus FROM c UNION ALL SELECT path, line + CASE WHEN k % 2 = 0 THEN 7 ELSE 4 END, 'Order words ' || n || ' ', 'print' FROM c")
def source_strings(spark, sf_dir):
    """Strings for people: in widgets what is neither printed nor technical, in scripts what is printed."""
    f = facts(spark, sf_dir)
    found = [P.hardcoded(f, f, focus, True).withColumn("focus", F.lit(focus)) for focus in ("widgets", "print")]
    return found[0].unionByName(found[1])


@query(f"WITH {C_SQL} SELECT path, line + 2 AS line, k::VARCHAR AS value FROM c WHERE k > 1 UNION ALL SELECT path, line + CASE WHEN k % 2 = 0 THEN 4 ELSE 7 END, '7' FROM c WHERE k % 7 > 0")
def source_numbers(spark, sf_dir):
    """Numbers that are neither named, trivial nor excused."""
    f = facts(spark, sf_dir)
    return P.magic_numbers(f, f)


@query(f"WITH {C_SQL} SELECT path, line, 'C' || k AS owner_name FROM c")
def source_sorting(spark, sf_dir):
    """Widget classes out of order: all, as width stands before steps, and half of them for their methods too."""
    return P.unsorted_members(facts(spark, sf_dir))


@query(f"WITH {C_SQL} SELECT path, line, 'undocumented_class' AS kind, 'C' || k AS name FROM c WHERE k % 3 = 0 UNION ALL SELECT path, line + CASE WHEN k % 2 = 0 THEN 6 ELSE 3 END, 'undocumented_function', 'C' || k || '.zeta' FROM c UNION ALL SELECT path, line + CASE WHEN k % 2 = 0 THEN 3 ELSE 6 END, 'undocumented_function', 'C' || k || '.alpha' FROM c")
def source_documentation(spark, sf_dir):
    f = facts(spark, sf_dir)
    return P.undocumented(f, f).select("path", "line", "kind", "name")


@query(f"""WITH {C_SQL}, p AS (SELECT *, '  void alpha() {{' || chr(10) || '    show(''Label ' || seg || ''', 7);' || CASE WHEN k % 7 = 0 THEN ' // ignore: tool_magic_numbers' ELSE '' END || chr(10) || '  }}' || chr(10) AS alpha,
  '  void zeta() {{' || chr(10) || '    print(''Order words ' || n || ' ${{a + 1}}'');' || chr(10) || '  }}' || chr(10) AS zeta FROM c)
SELECT path, md5(CASE WHEN k % 10 = 0 THEN '// ignore: tool_layers' || chr(10) ELSE '' END || 'import ''dart:io'';' || chr(10) || chr(10) || 'import ''package:demo/src/c' || (k + 1) || '.dart'';' || chr(10) || 'import ''package:demo/src/n' || n || '/shared.dart'';' || chr(10) || chr(10)
  || CASE WHEN k % 3 > 0 THEN '/// Customer ' || k || '.' || chr(10) ELSE '' END || 'class C' || k || ' extends StatelessWidget {{' || chr(10) || '  final steps = ' || k || ';' || chr(10) || '  final int width = 42;' || chr(10) || alpha || zeta || '}}' || chr(10)
  || CASE WHEN k % 50 = 0 THEN 'void main() {{}}' || chr(10) ELSE '' END) AS digest FROM p""")
def source_fixes(spark, sf_dir):
    """Files with sorted imports and members, by their digests."""
    return inventory.fixes(sources(spark, sf_dir), "demo").select("path", F.md5(F.col("new_content").cast("binary")).alias("digest"))


def translation_entries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Entries of a base file with a key for each nation and of a file for each region, and what the sources read: nations with a customer of the building segment."""
    n = table(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    pair = lambda name, value: F.concat(F.lit('  "'), name, F.lit('": "'), value, F.lit('"'))
    key = F.concat(F.lit("key"), k.cast("string"))
    base = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), pair(key, F.concat(F.lit("Name {x} "), k.cast("string"))).alias("t")))), lambda x: x["t"]), ",\n").alias("t"))  # 25 nations
    # A region's file lacks nations of other regions, leaves the first of its own untranslated and changes a placeholder of every third.
    value = F.when(k % 5 == 0, F.concat(F.lit("Name {x} "), k.cast("string"))).when(k % 3 == 0, F.concat(F.lit("Nom {y} "), k.cast("string"))).otherwise(F.concat(F.lit("Nom {x} "), k.cast("string")))
    own = n.groupBy(r.alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), pair(key, value).alias("t")))), lambda x: x["t"]), ",\n").alias("t"))
    content = F.concat(F.lit("{\n"), F.col("t"), F.lit("\n}"))
    code = F.element_at(F.array(*map(F.lit, ("fr", "de", "es", "it", "pt"))), (F.col("r") % 5 + 1).cast("int"))
    arb = base.select(F.lit("lib/l10n/app_en.arb").alias("path"), content.alias("content")).unionByName(own.select(F.concat(F.lit("lib/l10n/app_"), code, F.lit(".arb")), content).toDF("path", "content"))
    users = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_nationkey < 20")
    text = users.select(F.concat(F.lit("lib/u"), F.col("c_custkey").cast("string"), F.lit(".dart")).alias("path"), F.concat(F.lit("void f(c) { show(c.l10n.key"), F.col("c_nationkey").cast("string"), F.lit("); }")).alias("content"))
    return translations.entries(translations.translation_files(arb)), translations.reads(text)


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, (row_number() OVER (ORDER BY n_nationkey) + 1)::INT AS line, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1)::INT AS own FROM nation),
f AS (SELECT DISTINCT r, ['fr', 'de', 'es', 'it', 'pt'][r % 5 + 1] AS locale FROM n),
x AS (SELECT f.locale, CASE WHEN n.r = f.r THEN 'lib/l10n/app_' || f.locale || '.arb' ELSE 'lib/l10n/app_en.arb' END AS path, CASE WHEN n.r = f.r THEN n.own ELSE n.line END AS line, 'key' || k AS key,
  CASE WHEN n.r <> f.r THEN 'missing' WHEN k % 5 = 0 THEN 'unchanged' WHEN k % 3 = 0 THEN 'placeholder_mismatch' END AS problem FROM n CROSS JOIN f)
SELECT * FROM x WHERE problem IS NOT NULL UNION ALL SELECT 'en', 'lib/l10n/app_en.arb', line, 'key' || k, 'unused_key' FROM n WHERE k NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 20)""")
def translation_details(spark, sf_dir):
    """Everything wrong in the translations, with its place."""
    entries, reads = translation_entries(spark, sf_dir)
    entries = materialize(entries, "translation-entries")
    return L.details(entries, reads, L.base_file(entries))[0]


@query("""WITH u AS (SELECT DISTINCT lang FROM documents), l AS (SELECT 'app_' || lang || '.arb' AS name, lang AS locale FROM u UNION ALL SELECT lang || '_BR.arb', lang || '_BR' FROM u UNION ALL SELECT 'messages_' || upper(lang) || '-x-y.arb', lang || '_x_y' FROM u UNION ALL SELECT 'other_' || lang || '.arb', NULL FROM u)
SELECT name, locale, CASE split_part(locale, '_', 1) WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE upper(split_part(locale, '_', 1)) END AS language FROM l""")
def locale_names(spark, sf_dir):
    """Locales and languages told from file names."""
    lang = F.col("lang")
    names = F.array(F.concat(F.lit("app_"), lang, F.lit(".arb")), F.concat(lang, F.lit("_BR.arb")), F.concat(F.lit("messages_"), F.upper(lang), F.lit("-x-y.arb")), F.concat(F.lit("other_"), lang, F.lit(".arb")))
    n = table(spark, sf_dir, "documents").select("lang").distinct().select(F.explode(names).alias("name"))
    return n.select("name", T.locale_of(F.col("name")).alias("locale")).withColumn("language", T.language_name(F.col("locale")))


@query(f"WITH {C_SQL} SELECT 'file' AS of, path AS name, 10 + (k % 50 = 0)::INT AS loc FROM c UNION ALL SELECT 'class', 'C' || k, 10 FROM c")
def source_sizes(spark, sf_dir):
    """Files by the sum of their groups, and classes as groups."""
    from corvane.operators.folders import file_groups, file_sizes

    artifacts = materialize(P.artifacts_of(facts(spark, sf_dir)), "source-artifacts")
    groups = file_groups(artifacts)
    sizes = file_sizes(artifacts.where("kind = 'file'").select("path", "loc"), groups)
    return sizes.select(F.lit("file").alias("of"), F.col("path").alias("name"), "loc").unionByName(groups.where("owner <> ''").select(F.lit("class").alias("of"), F.col("owner").alias("name"), "loc"))


@query("""WITH RECURSIVE d AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'StatelessWidget' WHEN 1 THEN 'StatefulWidget' WHEN 2 THEN 'C' || (s_suppkey - 1) END AS parent, 'C' || s_suppkey AS name FROM supplier),
up AS (SELECT name, parent AS top FROM d WHERE parent IS NOT NULL UNION ALL SELECT up.name, d.parent FROM up JOIN d ON d.name = up.top WHERE d.parent IS NOT NULL),
l AS (SELECT d.name, (SELECT any_value(top) FROM up WHERE up.name = d.name AND up.top IN ('StatelessWidget', 'StatefulWidget')) AS top FROM d)
SELECT CASE top WHEN 'StatelessWidget' THEN 'stateless' WHEN 'StatefulWidget' THEN 'stateful' ELSE 'other' END AS kind, count(*)::BIGINT AS n FROM l GROUP BY 1""")
def widget_totals(spark, sf_dir):
    """Suppliers as classes, some of which extend the one before: what widget each is in the end."""
    from corvane.operators.graph import widget_totals as totals

    k = F.col("s_suppkey")
    parent = F.when(k % 4 == 0, "StatelessWidget").when(k % 4 == 1, "StatefulWidget").when(k % 4 == 2, F.concat(F.lit("C"), (k - 1).cast("string")))
    return totals(table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), k.cast("string")).alias("name"), parent.alias("parent")))


def placed_files(spark, sf_dir) -> DataFrame:
    """Documents as files below app, source and language; every tenth directly below its source."""
    tenth = F.col("doc_id") % 10 == 0
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("app"), "source", F.when(~tenth, F.col("lang")), F.col("doc_id").cast("string")).alias("path"))


PLACED_SQL = "f AS (SELECT doc_id, 'app/' || source AS top, CASE WHEN doc_id % 10 > 0 THEN lang END AS lang, 'app/' || source || CASE WHEN doc_id % 10 > 0 THEN '/' || lang ELSE '' END AS folder FROM documents)"


@query(f"WITH {PLACED_SQL} SELECT DISTINCT folder, parent, depth FROM (SELECT folder, top AS parent, 3 AS depth FROM f WHERE lang IS NOT NULL UNION ALL SELECT top, 'app', 2 FROM f UNION ALL SELECT 'app', NULL, 1)")
def folder_tree(spark, sf_dir):
    from corvane.operators.folders import hierarchy

    return hierarchy(placed_files(spark, sf_dir))


@query(f"WITH {PLACED_SQL}, m AS (SELECT DISTINCT top FROM f WHERE lang IS NOT NULL) SELECT f.folder || '/' || doc_id AS path, f.folder || CASE WHEN m.top IS NOT NULL THEN '/...' ELSE '' END AS \"group\" FROM f LEFT JOIN m ON m.top = f.folder")
def loose_files(spark, sf_dir):
    """Files by folder; those beside folders are in a group of their own."""
    from corvane.operators.folders import with_loose_files

    return with_loose_files(placed_files(spark, sf_dir))


@query(f"""WITH {PLACED_SQL}, e AS (SELECT a.top AS top_a, b.top AS top_b, a.folder AS af, b.folder AS bf FROM f a JOIN f b ON b.doc_id = a.doc_id + 1),
x AS (SELECT CASE WHEN top_a <> top_b THEN top_a ELSE af END AS src, CASE WHEN top_a <> top_b THEN top_b ELSE bf END AS dst FROM e) SELECT DISTINCT src, dst FROM x WHERE src <> dst""")
def sibling_folders(spark, sf_dir):
    """Edges from each document to the next, between the folders just below the deepest one that both share."""
    from corvane.operators.folders import sibling_edges

    f = placed_files(spark, sf_dir)
    after = f.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("dst"))
    return sibling_edges(f.join(after, "doc_id").select(F.col("path").alias("src"), "dst"))


@query("SELECT CASE WHEN min(source) = max(source) THEN 'app/' || min(source) ELSE 'app' END AS root FROM documents WHERE lang = 'en'")
def shared_root(spark, sf_dir):
    """The deepest folder of all documents in English."""
    from corvane.operators.folders import shared_root as root

    return root(placed_files(spark, sf_dir).join(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id"))


@query("SELECT doc_id, (length(substr(text, 1, strpos(text, 'ing') - 1)) - length(replace(substr(text, 1, strpos(text, 'ing') - 1), chr(10), '')) + 1)::BIGINT AS line FROM documents WHERE strpos(text, 'ing') > 0")
def line_offsets(spark, sf_dir):
    """Lines of offsets: where each document first says ing."""
    d = table(spark, sf_dir, "documents").withColumn("at", F.instr("text", "ing")).where("at > 0")
    return d.select("doc_id", T.line_of(F.col("text"), F.col("at") - 1).alias("line"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN 'lib/' || p_name || '.dart' END AS target FROM part")
def message_targets(spark, sf_dir):
    """Paths read back out of messages about layers."""
    p = table(spark, sf_dir, "part")
    said = F.concat(F.lit('File "a/b.dart" is below what it imports: "lib/'), F.col("p_name"), F.lit('.dart" (layer 3)'))
    return p.select(F.col("p_partkey").alias("id"), T.target_of(F.when(F.col("p_partkey") % 3 > 0, said).otherwise("no path here")).alias("target"))
