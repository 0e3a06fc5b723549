"""Queries over locale matrices, overlays, budgets, scores and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import localization as L
from corvane.operators import metrics as M
from corvane.operators import overlay as O
from corvane.operators import score as S
from corvane.operators.lanes import ranked_lanes
from corvane.operators.similarity import similar_texts, weights
from corvane.plans.text_plans import NON_BLANK_SQL, files, table
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


def locale_entries(spark, sf_dir) -> DataFrame:
    """Users as keys, kinds of events as locales, the first event's properties as values."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("key"), F.concat_ws("-", "event_type", F.pmod(F.dayofmonth("ts"), F.lit(6)).cast("string")).alias("locale")).agg(F.min_by("props", "event_id").alias("value"))


LOCALES_SQL = "entries AS (SELECT user_id::VARCHAR AS key, event_type || '-' || (day(ts) % 6)::VARCHAR AS locale, min_by(props, event_id) AS value FROM events GROUP BY 1, 2)"
CELLS_SQL = f"""{LOCALES_SQL}, cells AS (SELECT k.key, l.locale, CASE WHEN t.value IS NULL THEN 'missing' WHEN NOT regexp_matches(t.value, '\\S') THEN 'empty' WHEN t.value = k.value THEN 'unchanged' END AS problem
FROM (SELECT key, value FROM entries WHERE locale = 'click-0') k CROSS JOIN (SELECT DISTINCT locale FROM entries WHERE locale <> 'click-0') l LEFT JOIN entries t ON t.key = k.key AND t.locale = l.locale)"""


@query(f"WITH {CELLS_SQL} SELECT locale, count(*)::BIGINT AS total, count(*) FILTER (problem IS NOT NULL)::BIGINT AS missing, count(problem)::BIGINT AS problems, round(100.0::DOUBLE * (count(*) - count(problem)) / count(*), 1) AS coverage FROM cells GROUP BY locale")
def locale_coverage(spark, sf_dir):
    return L.coverage(L.matrix(locale_entries(spark, sf_dir), "click-0"))


@query(f"WITH {LOCALES_SQL} SELECT DISTINCT key FROM entries WHERE locale = 'click-0' AND key NOT IN (SELECT user_id::VARCHAR FROM events WHERE event_type = 'purchase' AND value > 50)")
def locale_unused(spark, sf_dir):
    keys = locale_entries(spark, sf_dir).where("locale = 'click-0'")
    used = table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 50").select(F.col("user_id").cast("string").alias("key"))
    return L.unused(keys, used, bool(used.limit(1).count()))


@query(f"WITH {CELLS_SQL}, n AS (SELECT locale, problem, count(*) AS n, CASE problem WHEN 'missing' THEN 1 WHEN 'empty' THEN 2 ELSE 3 END AS o FROM cells WHERE problem IS NOT NULL GROUP BY ALL) SELECT locale, string_agg(n::VARCHAR || ' ' || problem, ', ' ORDER BY o) AS summary FROM n GROUP BY locale")
def locale_summary(spark, sf_dir):
    return L.problem_summary(L.problem_counts(L.matrix(locale_entries(spark, sf_dir), "click-0")))


@query(f"""WITH {LOCALES_SQL}, s AS (SELECT locale, count(DISTINCT key) AS n FROM entries GROUP BY locale), b AS (SELECT locale AS base, n AS total FROM s WHERE locale = (SELECT min(locale) FROM s)),
p AS (SELECT locale, upper(split_part(locale, '-', 1)) || ' (' || locale || ')' AS label, total, total - n AS missing FROM s, b WHERE locale <> base AND n < total)
SELECT 0::INT AS part, '' AS locale, 0::BIGINT AS item, '[!] ' || format('{{:,}}', (SELECT count(*) FROM p)) || ' localization issues detected' AS text UNION ALL SELECT 1, '', 0, '  [✓] Localization Summary:'
UNION ALL SELECT 2, '', 0, '    - Base language: ' || upper(split_part(base, '-', 1)) || ' (' || base || ')' FROM b UNION ALL SELECT 3, '', 0, '    - Total translation keys: ' || format('{{:,}}', total) FROM b
UNION ALL SELECT 4, '', 0, '    - Supported languages: ' || (SELECT count(*) FROM s) UNION ALL SELECT 5, '', 0, '    - Problem locales: ' || (SELECT count(*) FROM p) UNION ALL SELECT 6, '', 0, '  [!] Localization Problems:'
UNION ALL SELECT 7, locale, 0, '    - ' || rpad(label, (SELECT max(length(label)) FROM p)::INT, ' ') || ': ' || floor(100.0::DOUBLE * (total - missing) / total)::BIGINT || '% coverage (' || missing || ' missing)' FROM p""")
def locale_report(spark, sf_dir):
    """The report on locales by a scan alone: what each has fewer than the base."""
    stats = L.scan_stats(locale_entries(spark, sf_dir))
    problems = L.scan_problems(stats).withColumn("summary", F.concat(F.col("missing").cast("string"), F.lit(" missing")))
    none = spark.createDataFrame([], "locale string, path string, line long, key string, problem string")
    return L.report_lines(stats, problems, none)


@query("""WITH t AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, list_distinct(regexp_extract_all(html, 'href="/([a-zA-Z][a-zA-Z0-9_]*)"', 1)) AS names FROM pages),
b AS (SELECT host, min(page_id) AS base FROM t GROUP BY host)
SELECT t.host, t.page_id, len(list_filter(t.names, lambda x: NOT list_contains(p.names, x)))::BIGINT AS added, len(list_filter(p.names, lambda x: NOT list_contains(t.names, x)))::BIGINT AS lost FROM t JOIN b ON t.host = b.host JOIN t p ON p.page_id = b.base WHERE t.page_id <> b.base AND (added > 0 OR lost > 0)""")
def placeholder_diff(spark, sf_dir):
    """Pages whose links' names, as the placeholders of a text, differ from those of their host's first page. A host's first page is found with one aggregation."""
    named = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)
    text = F.array_join(F.transform(named, lambda x: F.concat(F.lit("{"), x, F.lit("}"))), " ")
    t = table(spark, sf_dir, "pages").select("page_id", F.split(F.split("url", "://")[1], "/")[0].alias("host"), T.placeholders(text).alias("names"))
    base = t.groupBy("host").agg(F.min_by(F.struct("page_id", "names"), "page_id").alias("b"))
    both = t.join(base, "host").where(F.col("page_id") != F.col("b.page_id"))
    out = both.select("host", "page_id", "names", "b", F.size(F.array_except("names", "b.names")).cast("long").alias("added"), F.size(F.array_except("b.names", "names")).cast("long").alias("lost"))
    return out.where(T.differing(F.col("names"), F.col("b.names"))).select("host", "page_id", "added", "lost")


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS key FROM documents), k AS (SELECT * FROM l WHERE length(key) > 0), f AS (SELECT doc_id, key, min(line) AS first_line FROM k GROUP BY ALL)
SELECT k.doc_id, k.line::BIGINT AS line, f.first_line::BIGINT AS first_line FROM k JOIN f ON k.doc_id = f.doc_id AND k.key = f.key WHERE k.line > f.first_line""")
def duplicate_keys(spark, sf_dir):
    """Lines that repeat an earlier line of their document."""
    l = files(spark, sf_dir).select(F.col("doc_id").alias("file"), F.posexplode(T.lines(F.col("text"))).alias("at", "key")).where(F.length("key") > 0)
    return L.repeated_keys(l.select("file", "key", (F.col("at") + 1).cast("long").alias("line"))).select(F.col("file").alias("doc_id"), "line", "first_line")


@query("SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE upper(lang) END AS language, lang = 'en' AS is_base, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def base_locale(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    base = L.base_locale(d.select(F.col("lang").alias("locale"))).withColumnRenamed("locale", "base")
    return d.join(base).select("lang", T.language_name(T.locale_of(F.concat(F.lit("app_"), F.col("lang"), F.lit(".arb")))).alias("language"), (F.col("lang") == F.col("base")).alias("is_base"), "n")


BLOCK = 10


def blocks(spark, sf_dir) -> DataFrame:
    """Blocks of ten lines as callables, pairs of blocks as classes."""
    d = files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.size(T.lines(F.col("text"))).alias("n"))
    part = lambda kind, size: d.select("path", F.lit(kind).alias("kind"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("k"), "n").select("path", "kind", F.concat(F.lit(kind), F.col("k").cast("string")).alias("name"), (F.col("k") * size + 1).alias("first"), F.least(F.col("k") * size + size, F.col("n")).alias("last"), F.col("k").alias("ordinal"))
    return part("function", BLOCK).where("ordinal % 2 = 0").unionByName(part("class", 2 * BLOCK))


BLOCKS_SQL = """d AS (SELECT doc_id::VARCHAR AS path, len(string_split(text, chr(10))) AS n FROM documents),
blocks AS (SELECT path, 'function' AS kind, 'function' || k AS name, k * 10 + 1 AS first, least(k * 10 + 10, n) AS last FROM (SELECT path, n, unnest(range(0, (n - 1) // 10 + 1)) AS k FROM d) WHERE k % 2 = 0
UNION ALL SELECT path, 'class', 'class' || k, k * 20 + 1, least(k * 20 + 20, n) FROM (SELECT path, n, unnest(range(0, (n - 1) // 20 + 1)) AS k FROM d))"""
ISSUES_SQL = "issues AS (SELECT path, line FROM (SELECT doc_id::VARCHAR AS path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE regexp_matches(t, 'Licensed|token = '))"


def line_issues(spark, sf_dir) -> DataFrame:
    l = files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.posexplode(T.lines(F.col("text"))).alias("at", "t")).where(F.col("t").rlike("Licensed|token = "))
    return l.select(F.concat_ws(":", "path", (F.col("at") + 1).cast("string")).alias("issue_id"), "path", (F.col("at") + 1).alias("line"))


@query(f"WITH {BLOCKS_SQL}, {ISSUES_SQL} SELECT i.path, i.line::INT AS line, coalesce(f.kind, c.kind) AS kind, coalesce(f.name, c.name) AS name FROM issues i LEFT JOIN blocks f ON f.path = i.path AND f.kind = 'function' AND i.line BETWEEN f.first AND f.last LEFT JOIN blocks c ON c.path = i.path AND c.kind = 'class' AND i.line BETWEEN c.first AND c.last")
def interval_overlay(spark, sf_dir):
    return O.enclosing(line_issues(spark, sf_dir), blocks(spark, sf_dir)).select("path", "line", "kind", "name")


@query(f"WITH {BLOCKS_SQL} SELECT kind, count(*)::BIGINT AS n FROM blocks a WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.path = a.path AND b.first <= a.first AND b.last >= a.last AND (b.last - b.first > a.last - a.first OR (b.last = a.last AND b.first = a.first AND (length(b.name) > length(a.name) OR (length(b.name) = length(a.name) AND b.name < a.name))))) GROUP BY kind")
def nested_intervals(spark, sf_dir):
    return O.outermost(blocks(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT split_part(url, '://', 2) AS path FROM pages), k AS (SELECT DISTINCT regexp_extract(url, '[^/]+$') AS path FROM pages WHERE regexp_matches(url, '[^/]+$'))
SELECT u.path, max_by(k.path, length(k.path)) AS match FROM u LEFT JOIN k ON u.path = k.path OR ends_with(u.path, '/' || k.path) GROUP BY u.path""")
def suffix_match(spark, sf_dir):
    """Every address against the last parts of all pages."""
    p = table(spark, sf_dir, "pages")
    wanted = p.select(F.split("url", "://")[1].alias("path"))
    known = p.select(F.regexp_extract("url", "([^/]+)$", 1).alias("path")).where("path <> ''")
    return O.resolve_paths(wanted, known)


ALL_ISSUES_SQL = f"""x AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS t FROM documents),
all_issues AS (SELECT source || '/' || lang || '/' || doc_id AS path, source || '/' || lang AS folder, CASE WHEN regexp_matches(t, 'token = ') THEN 'secret' ELSE 'licence' END AS type FROM x WHERE regexp_matches(t, 'Licensed|token = '))"""


def all_issues(spark, sf_dir) -> DataFrame:
    l = files(spark, sf_dir).select("path", F.explode(T.lines(F.col("text"))).alias("t")).where(F.col("t").rlike("Licensed|token = "))
    return l.select("path", F.when(F.col("t").contains("token = "), "secret").otherwise("licence").alias("type")).withColumn("severity", F.when(F.col("type") == "secret", "error").otherwise("warning"))


@query(f"WITH {ALL_ISSUES_SQL} SELECT path, CASE WHEN bool_or(type = 'secret') THEN 'error' ELSE 'warning' END AS severity FROM all_issues GROUP BY path")
def severity(spark, sf_dir):
    return O.severities(all_issues(spark, sf_dir), "path")


@query(f"WITH {ALL_ISSUES_SQL} SELECT path, folder, type, count(*)::BIGINT AS n FROM all_issues GROUP BY GROUPING SETS ((path, type), (folder, type))")
def warnings_rollup(spark, sf_dir):
    return O.warnings_by(all_issues(spark, sf_dir))


@query("""WITH f AS (SELECT source || '/' || lang || '/' || doc_id AS path, n_chars FROM documents), p AS (SELECT split_part(path, '/', 1) AS a, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS b, n_chars FROM f)
SELECT folder, count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS total FROM (SELECT a AS folder, n_chars FROM p UNION ALL SELECT b, n_chars FROM p) GROUP BY folder""")
def folder_rollup(spark, sf_dir):
    return M.rolled_up(files(spark, sf_dir), "path", "n_chars")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, l_quantity AS q, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lineitem)
SELECT k AS l_orderkey, ln AS l_linenumber, p AS l_partkey, s AS l_suppkey, greatest(0, least(q, 80 - b))::DOUBLE AS granted FROM l""")
def loc_budget(spark, sf_dir):
    """Lines of an order share 80 units, the largest first."""
    got = M.budgeted(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], "l_quantity", F.lit(80.0))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("granted").cast("double").alias("granted"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, greatest(count(*) OVER (PARTITION BY o_custkey) - 3, 0) AS more FROM orders)
SELECT o_custkey, o_orderkey, rank::INT AS rank, more::BIGINT AS more FROM r WHERE rank <= 3""")
def topk_with_rest(spark, sf_dir):
    return M.top_with_rest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank", F.col("more").cast("long").alias("more"))


PAGES_SQL = "p AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, url FROM pages)"


@query(f"WITH {PAGES_SQL}, g AS (SELECT *, CASE WHEN starts_with(url, 'https://www.') THEN 1 WHEN starts_with(url, 'https://') THEN 2 WHEN starts_with(url, 'http://www.') THEN 3 ELSE 4 END AS grp FROM p) SELECT page_id, host, (row_number() OVER (PARTITION BY host ORDER BY grp, url, page_id))::INT AS place FROM g")
def import_order(spark, sf_dir):
    """Addresses in the order of imports: by group, then by name."""
    u = F.col("url")
    group = F.when(u.startswith("https://www."), 1).when(u.startswith("https://"), 2).when(u.startswith("http://www."), 3).otherwise(4)
    p = table(spark, sf_dir, "pages").select("page_id", F.split(F.split("url", "://")[1], "/")[0].alias("host"), "url", group.alias("grp"))
    return ranked_lanes(p, ["host"], [F.col("grp"), F.col("url"), F.col("page_id")]).select("page_id", "host", (F.col("lane") + 1).alias("place"))


@query(f"WITH {PAGES_SQL}, o AS (SELECT host, string_agg(url, ' ' ORDER BY page_id) AS is_now, string_agg(url, ' ' ORDER BY url, page_id) AS sorted FROM p GROUP BY host) SELECT host, is_now <> sorted AS unsorted FROM o")
def member_order(spark, sf_dir):
    """Hosts whose pages aren't in the order of their names: two orders of one list, compared."""
    from corvane.operators.sorting import out_of_order

    p = table(spark, sf_dir, "pages").select(F.split(F.split("url", "://")[1], "/")[0].alias("owner"), F.col("page_id").alias("ordinal"), F.col("url").alias("name"))
    return out_of_order(p).select(F.col("owner").alias("host"), "unsorted")


@query(f"WITH {PAGES_SQL} SELECT host, min(url) AS low, max(url) AS high, count(*)::BIGINT AS n, (len(list_filter(range(1, 400), lambda i: substr(min(url), 1, i) = substr(max(url), 1, i) AND i <= length(min(url)) AND i <= length(max(url)))))::BIGINT AS shared FROM p GROUP BY host")
def common_root(spark, sf_dir):
    """The shared beginning of all paths of a group is that of the least and the greatest."""
    p = table(spark, sf_dir, "pages").select(F.split(F.split("url", "://")[1], "/")[0].alias("host"), "url")
    ends = p.groupBy("host").agg(F.min("url").alias("low"), F.max("url").alias("high"), F.count("*").alias("n"))
    return ends.withColumn("shared", T.common_prefix_size(F.split("low", ""), F.split("high", "")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, replace(format('{:,}', floor(l_extendedprice)::BIGINT), ' ', '') AS grouped, floor(l_discount::DOUBLE / 0.1::DOUBLE * 100)::BIGINT AS share, l_orderkey || '.' || l_linenumber AS name,
replace(replace(replace('<' || l_returnflag || '&' || l_linestatus || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM lineitem""")
def format_scalars(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    raw = F.concat(F.lit("<"), F.col("l_returnflag"), F.lit("&"), F.col("l_linestatus"), F.lit(">"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.grouped(F.floor("l_extendedprice")).alias("grouped"), T.percent_floor(F.col("l_discount") / F.lit(0.1)).alias("share"), T.qualified_name(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"), T.xml_escaped(raw).alias("escaped"))


@query("SELECT count(*) FILTER (n <= 1)::BIGINT AS compliant, count(*)::BIGINT AS total, round(1 - (count(*) FILTER (n > 1))::DOUBLE / count(*), 6) AS score FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)")
def one_entity_per_group(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"))
    t = g.agg(F.count_if(F.col("n") <= 1).alias("compliant"), F.count("*").alias("total"), F.count_if(F.col("n") > 1).alias("bad"))
    return t.select("compliant", "total", F.round(S.fraction_score(F.col("bad"), F.col("total")), 6).alias("score"))


#: Documents have no dependencies and no translations, so these areas have no input.
WITHOUT_INPUT = ("layers", "localization")


def duplicate_impact(spark, sf_dir) -> DataFrame:
    """(project, duplicates, impact): pairs of near copies among a source's documents, and the sum of their lines times their similarity, from classes alone."""
    d = files(spark, sf_dir).select(F.struct("doc_id", "source", T.non_blank_count(F.col("text")).alias("loc")).alias("id"), F.coalesce(F.concat(F.lit("/"), F.col("source")), F.lit("")).alias("signature"), "text")
    members, links = similar_texts(d.where("id.loc > 0"), 0.9)
    sums = weights(members.withColumn("loc", F.col("id.loc")), links)
    return materialize(sums.groupBy(F.col("class.source").alias("project")).agg(F.sum("pairs").alias("duplicates"), F.sum("impact").alias("impact")), "duplicate-impact")


def project_inputs(spark, sf_dir, copies: DataFrame | None = None) -> DataFrame:
    """The documents of a source as a project: what the score needs of it, in one aggregation, and its near copies; without copies, that area has no input either."""
    text = F.col("text")
    d = files(spark, sf_dir).select("source", "lang", T.non_blank_count(text).alias("loc"), F.size(F.filter(T.lines(text), lambda x: x.contains("Licensed"))).alias("lic"), F.regexp_count("text", F.lit("token = ")).alias("tok"), F.regexp_count("text", F.lit("@[a-z0-9]+[.]example")).alias("mail"), F.regexp_count("text", F.lit("[0-9]{4,}")).alias("num"))
    a = d.groupBy(F.col("source").alias("project")).agg(
        F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum(F.greatest(F.lit(0.0), (F.col("loc") - 30).cast("double") / 30)).alias("over"), F.sum("tok").alias("tok"), F.sum("mail").alias("mail"), F.sum("num").alias("num"), F.sum("lic").alias("lic"),
        F.count_if(F.col("lang") == "es").alias("es"), F.count_if(F.col("loc") > 20).alias("long"), F.count_if(F.col("lang") == "de").alias("de"), F.count_if(F.col("lang") == "fr").alias("fr"),
    )
    off = WITHOUT_INPUT if copies is not None else (*WITHOUT_INPUT, "duplicate_code")
    if copies is None:
        a = a.withColumns({"duplicates": F.lit(0), "impact": F.lit(0.0)})
    else:
        a = a.join(copies.withColumnRenamed("project", "p"), F.col("project").eqNullSafe(F.col("p")), "left").drop("p")
    issues = {"code_size": "long", "one_class_per_file": "es", "hardcoded_strings": "mail", "magic_numbers": "num", "source_sorting": "de", "layers": "0", "secrets": "tok", "dead_code": "fr", "duplicate_code": "coalesce(duplicates, 0)", "documentation": "lic", "localization": "0"}
    out = a.withColumns({f"{k}_issues": F.expr(v).cast("long") for k, v in issues.items()} | {f"{k}_enabled": F.lit(k not in off) for k in issues})
    return out.withColumns({"size_score": S.clamp01(1 - F.col("over") / F.col("files")), "one_class_total": F.col("files"), "edges": F.col("files"), "duplicate_impact": F.coalesce("impact", F.lit(0.0)), "localization_on": F.col("es") > 0, "directives": F.col("lic"), "excludes": F.lit(0), "disabled": F.lit(0)})


AREAS_SQL = f"""d AS (SELECT source, lang, {NON_BLANK_SQL} AS loc, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'Licensed'))) AS lic, len(regexp_extract_all(text, 'token = ')) AS tok, len(regexp_extract_all(text, '@[a-z0-9]+[.]example')) AS mail, len(regexp_extract_all(text, '[0-9]{{4,}}')) AS num FROM documents),
a AS (SELECT source AS project, count(*) AS files, sum(loc) AS loc, sum(greatest(0.0::DOUBLE, (loc - 30)::DOUBLE / 30)) AS over_, sum(tok) AS tok, sum(mail) AS mail, sum(num) AS num, sum(lic) AS lic, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (loc > 20) AS long_, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr FROM d GROUP BY source),
areas AS (SELECT project, 0 AS ordinal, 'code_size' AS area, true AS enabled, long_ AS issues, greatest(0, least(1, 1 - over_ / files)) AS score FROM a
UNION ALL SELECT project, 1, 'one_class_per_file', true, es, greatest(0, 1 - es::DOUBLE / files) FROM a
UNION ALL SELECT project, 2, 'hardcoded_strings', es > 0, mail, CASE WHEN es > 0 THEN greatest(0, 1 - mail::DOUBLE / greatest(3.0::DOUBLE, 0.8::DOUBLE * files)) ELSE 1 END FROM a
UNION ALL SELECT project, 3, 'magic_numbers', true, num, greatest(0, 1 - num::DOUBLE / greatest(4.0::DOUBLE, 2.5::DOUBLE * files + loc::DOUBLE / 450)) FROM a
UNION ALL SELECT project, 4, 'source_sorting', true, de, greatest(0, 1 - de::DOUBLE / greatest(2.0::DOUBLE, 0.75::DOUBLE * files)) FROM a
UNION ALL SELECT project, 5, 'layers', false, 0, 1 FROM a
UNION ALL SELECT project, 6, 'secrets', true, tok, greatest(0, 1 - tok::DOUBLE / 1.5::DOUBLE) FROM a
UNION ALL SELECT project, 7, 'dead_code', true, fr, greatest(0, 1 - fr::DOUBLE / greatest(3.0::DOUBLE, 0.8::DOUBLE * files)) FROM a
UNION ALL SELECT project, 8, 'duplicate_code', false, 0, 1 FROM a
UNION ALL SELECT project, 9, 'documentation', true, lic, greatest(0, 1 - lic::DOUBLE / greatest(2.0::DOUBLE, 0.6::DOUBLE * files)) FROM a
UNION ALL SELECT project, 10, 'localization', false, 0, 1 FROM a)"""


@query(f"WITH {AREAS_SQL} SELECT project, ordinal::INT AS ordinal, area, enabled, issues::BIGINT AS issues, round(score::DOUBLE, 6) AS score FROM areas")
def area_budgets(spark, sf_dir):
    """Every source's areas but for near copies, which SQL can't measure: the eight that documents alone have input for."""
    return S.areas(project_inputs(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"""WITH {AREAS_SQL}, pt AS (SELECT project, round(greatest(0, least(25, 25 * 0.45::DOUBLE * greatest(0, (lic - greatest(3.0::DOUBLE, 0.12::DOUBLE * files + loc::DOUBLE / 2500)) / greatest(3.0::DOUBLE, 0.12::DOUBLE * files + loc::DOUBLE / 2500)))))::BIGINT AS points, lic FROM a),
m AS (SELECT project, avg(score::DOUBLE) FILTER (enabled) AS mean, min(score::DOUBLE) FILTER (enabled) AS least FROM areas GROUP BY project),
s AS (SELECT project, round(greatest(0, least(100, 100 * mean - points)))::BIGINT AS raw, points, least FROM m JOIN pt USING (project)),
e AS (SELECT project, ordinal, area, issues, 1 - score::DOUBLE AS impact FROM areas WHERE enabled UNION ALL SELECT project, 11, 'suppression_hygiene', lic, points / 25.0::DOUBLE FROM pt WHERE points > 0),
f AS (SELECT project, area, row_number() OVER (PARTITION BY project ORDER BY impact DESC, issues DESC, ordinal) AS n FROM e WHERE impact > 0)
SELECT s.project, CASE WHEN raw = 100 AND (least < 1 OR points > 0) THEN 99 ELSE raw END::BIGINT AS score, points, coalesce(f.area, 'none') AS focus FROM s LEFT JOIN f ON f.project = s.project AND f.n = 1""")
def budget_score(spark, sf_dir):
    """The overall score over those areas, with what to look at first."""
    inputs = project_inputs(spark, sf_dir)
    return S.overall(S.areas(inputs), S.suppression_points(inputs)).select("project", "score", "points", "focus")


@query(None)
def area_scores(spark, sf_dir):
    """All nine areas that documents have input for, near copies by whole texts among them."""
    return S.areas(project_inputs(spark, sf_dir, duplicate_impact(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query(None)
def compliance_score(spark, sf_dir):
    """The flagship: every source of documents scored in the nine of eleven areas that documents have input for, with what to look at first."""
    inputs = project_inputs(spark, sf_dir, duplicate_impact(spark, sf_dir))
    return S.overall(S.areas(inputs), S.suppression_points(inputs)).select("project", "score", "points", "focus")


@query("""SELECT o_orderkey, regexp_replace(regexp_replace(format('{:.2f}', o_totalprice::DOUBLE), '0+$', ''), '[.]$', '') AS compact, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE (o_orderkey % 3)::VARCHAR END AS dashed,
CASE WHEN o_orderkey % 100 >= 95 THEN 'excellent' WHEN o_orderkey % 100 >= 85 THEN 'good' WHEN o_orderkey % 100 >= 70 THEN 'fair' ELSE 'poor' END AS band,
CASE WHEN o_custkey % 7 = 0 THEN '-' ELSE round((o_orderkey % 50) * 100.0::DOUBLE / (o_custkey % 7))::BIGINT::VARCHAR || '%' END AS share, 'order|' || o_orderpriority || '|' || o_orderstatus || '|' || o_orderdate::DATE || '|' || o_custkey AS id, o_orderkey AS line, o_custkey || '.dart:' || o_orderkey AS place FROM orders""")
def format_labels(spark, sf_dir):
    """Numbers, bands, identities and locations as reports write them."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    file = F.concat(F.col("o_custkey").cast("string"), F.lit(".dart:"))
    twice = F.concat(file, key, F.lit(":"), file, key, F.lit("::"))
    return o.select(
        "o_orderkey", T.compact_decimal(F.col("o_totalprice")).alias("compact"), T.dash_if_zero(F.col("o_orderkey") % 3).alias("dashed"), T.score_band(F.col("o_orderkey") % 100).alias("band"),
        T.ratio_or_dash(F.col("o_orderkey") % 50, F.col("o_custkey") % 7).alias("share"), T.stable_id(F.lit("order"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.to_date("o_orderdate").cast("string"), F.col("o_custkey")).alias("id"),
        T.location_line(twice).alias("line"), T.clean_location(twice).alias("place"),
    )
