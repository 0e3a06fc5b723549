"""Queries over documents, pages and events as a corpus of files: scans, sizes, literals, directives, secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import metrics as M
from corvane.operators import secrets as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text", "lang", "source", "n_chars")


FILES_SQL = "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id::VARCHAR AS path, text, lang, source, n_chars FROM documents)"
BLANKS = "chr(9), chr(10), chr(11), chr(12), chr(13), chr(32)"
NON_BLANK_SQL = "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')))::BIGINT"

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def tree(spark, sf_dir) -> DataFrame:
    """Documents as a scanned tree: four sources are a hidden folder, a build folder and a test folder, English ones sources, every fiftieth the source of a locale; folders are rows too."""
    from corvane.sources.tree import classified

    top = F.when(F.col("source") == "src2", ".cache").when(F.col("source") == "src0", "build").when(F.col("source") == "src1", "test").otherwise(F.col("source"))
    name = F.concat(F.when(F.col("doc_id") % 50 == 0, "app_localizations_").otherwise(""), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".dart").otherwise(".arb"))
    f = table(spark, sf_dir, "documents").select(F.concat_ws("/", top, "lang").alias("folder"), name.alias("name"))
    folders = f.select(F.explode(F.array("folder", F.substring_index("folder", "/", 1))).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return classified(f.select(F.concat_ws("/", "folder", "name").alias("path"), F.lit(False).alias("is_dir")).unionByName(folders), ["**/fr/*7.arb"])


TREE_SQL = """f AS (SELECT CASE source WHEN 'src2' THEN '.cache' WHEN 'src0' THEN 'build' WHEN 'src1' THEN 'test' ELSE source END AS top, lang, CASE WHEN doc_id % 50 = 0 THEN 'app_localizations_' ELSE '' END || doc_id || CASE lang WHEN 'en' THEN '.dart' ELSE '.arb' END AS name FROM documents),
t AS (SELECT top, false AS is_dir, lang = 'en' AS is_dart, false AS is_root, CASE WHEN top = '.cache' THEN 'hidden' WHEN top IN ('build', 'test') THEN 'default' WHEN lang = 'fr' AND ends_with(name, '7.arb') THEN 'glob' WHEN lang = 'en' AND starts_with(name, 'app_localizations_') THEN 'generated' END AS reason FROM f
UNION ALL SELECT top, true, false, root AND top = 'test', CASE WHEN top = '.cache' THEN 'hidden' WHEN top IN ('build', 'test') THEN 'default' END FROM (SELECT DISTINCT top, lang AS part, false AS root FROM f UNION ALL SELECT DISTINCT top, '', true FROM f))"""


@query(f"""WITH {TREE_SQL} SELECT count(*) FILTER (reason IS NULL AND is_dart)::BIGINT AS dart_files, count(*) FILTER (is_dir AND (reason IS NULL OR reason = 'generated'))::BIGINT AS folders, count(*) FILTER (NOT is_dir AND (reason IS NULL OR reason = 'generated'))::BIGINT AS files,
count(*) FILTER (reason IS NOT NULL AND is_dart)::BIGINT AS excluded_dart, count(*) FILTER (reason <> 'generated' AND is_dir)::BIGINT AS excluded_folders, count(*) FILTER (reason <> 'generated' AND NOT is_dir)::BIGINT AS excluded_files,
count(*) FILTER (is_root)::BIGINT AS test_folders, count(*) FILTER (top = 'test' AND NOT is_dir)::BIGINT AS test_files, count(*) FILTER (top = 'test' AND is_dart)::BIGINT AS test_dart_files, count(*) FILTER (is_dart AND reason = 'glob')::BIGINT AS custom_excluded_dart FROM t""")
def scan_counters(spark, sf_dir):
    """All counters of a scan in one aggregation."""
    from corvane.sources.tree import counters

    return counters(tree(spark, sf_dir))


@query(f"WITH {TREE_SQL} SELECT reason, CASE WHEN is_dir THEN 'folder' WHEN is_dart THEN 'dart' ELSE 'other' END AS kind, count(*)::BIGINT AS n FROM t WHERE reason IS NOT NULL GROUP BY ALL")
def excluded_split(spark, sf_dir):
    """What a scan leaves out, by the first reason and by kind."""
    from corvane.sources.tree import excluded

    return excluded(tree(spark, sf_dir)).groupBy("reason", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {NON_BLANK_SQL} AS loc, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents")
def nonblank_loc(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", T.non_blank_count(F.col("text")).alias("loc"), F.size(T.lines(F.col("text"))).cast("long").alias("lines"))


@query(f"""WITH f AS (SELECT lang, {NON_BLANK_SQL} AS loc, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'Licensed under')))::BIGINT AS comments, length(text) AS chars FROM documents)
SELECT count(*)::BIGINT AS files, sum(loc)::BIGINT AS loc, sum(comments)::BIGINT AS comments, round(sum(comments)::DOUBLE / sum(loc), 6) AS comment_ratio, sum(chars)::BIGINT AS chars FROM f""")
def project_totals(spark, sf_dir):
    f = files(spark, sf_dir).select(T.non_blank_count(F.col("text")).alias("loc"), F.size(F.filter(T.lines(F.col("text")), lambda x: x.contains("Licensed under"))).cast("long").alias("comments"), F.length("text").cast("long").alias("chars"))
    total = f.agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("comments").alias("comments"), F.sum("chars").alias("chars"))
    return total.withColumn("comment_ratio", F.round(M.ratio(F.col("comments"), F.col("loc")), 6)).select("files", "loc", "comments", "comment_ratio", "chars")


@query("""WITH l AS (SELECT unnest(regexp_extract_all(props, '[0-9]+')) AS value FROM events)
SELECT value, value::DOUBLE AS number, count(*)::BIGINT AS n FROM l GROUP BY value ORDER BY n DESC, number, value""")
def literal_inventory(spark, sf_dir):
    lexemes = table(spark, sf_dir, "events").select(F.explode(F.regexp_extract_all("props", F.lit("([0-9]+)"), 1)).alias("value"))
    freq = M.frequencies(lexemes, "value")
    return freq.select("value", T.number_value(F.col("value")).alias("number"), "n").orderBy(F.desc("n"), F.asc_nulls_last("number"), "value")


@query("""WITH s AS (SELECT props AS value, count(*) AS n FROM events GROUP BY props), l AS (SELECT unnest(regexp_extract_all(props, '[0-9]+')) AS value FROM events), m AS (SELECT value, count(*) AS n FROM l GROUP BY value)
SELECT (SELECT sum(n) FROM s)::BIGINT AS strings, (SELECT coalesce(sum(n) FILTER (n >= 2), 0) FROM s)::BIGINT AS repeated_strings, (SELECT sum(n) FROM m)::BIGINT AS numbers, (SELECT coalesce(sum(n) FILTER (n >= 2 AND value::DOUBLE NOT IN (0, 1)), 0) FROM m)::BIGINT AS repeated_numbers""")
def duplicated_literals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    strings = M.duplicated(M.frequencies(e, "props")).toDF("strings", "repeated_strings")
    lexemes = e.select(F.explode(F.regexp_extract_all("props", F.lit("([0-9]+)"), 1)).alias("value"))
    numbers = M.duplicated(M.frequencies(lexemes, "value"), numeric=True).toDF("numbers", "repeated_numbers")
    return strings.join(numbers)  # a row each


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT doc_id, count(DISTINCT line)::BIGINT AS comment_lines, min(line)::BIGINT AS first_line FROM l WHERE regexp_matches(t, 'Licensed|License|licence') GROUP BY doc_id""")
def comment_lines(spark, sf_dir):
    """Distinct licence lines of each document, with the first."""
    l = files(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "t")).where(F.col("t").rlike("Licensed|License|licence"))
    return l.groupBy("doc_id").agg(F.countDistinct("at").alias("comment_lines"), (F.min("at") + 1).cast("long").alias("first_line"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT doc_id, line::BIGINT AS line, regexp_extract(t, '(token) = "', 1) AS token, length(t)::BIGINT AS raw_length FROM l WHERE regexp_matches(t, 'token = "') ORDER BY doc_id, line""")
def directive_inventory(spark, sf_dir):
    l = files(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "t")).where(F.col("t").contains('token = "'))
    return l.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.regexp_extract("t", '(token) = "', 1).alias("token"), F.length("t").cast("long").alias("raw_length")).orderBy("doc_id", "line")


@query("""WITH p(domain, on_bad, on_toxic) AS (VALUES ('metrics', true, true), ('strings', false, true), ('numbers', false, false), ('sorting', false, true), ('layers', true, true))
SELECT domain, count(*) FILTER ((quality = 1 OR on_bad) AND (toxic = 0 OR on_toxic))::BIGINT AS analysed, count(*) FILTER (NOT ((quality = 1 OR on_bad) AND (toxic = 0 OR on_toxic)))::BIGINT AS skipped FROM labels, p GROUP BY domain""")
def policy_matrix(spark, sf_dir):
    """Which domain looks at which class of file: classes are counted first, then met with the policy's few rows."""
    policy = spark.createDataFrame([("metrics", True, True), ("strings", False, True), ("numbers", False, False), ("sorting", False, True), ("layers", True, True)], "domain string, on_bad boolean, on_toxic boolean")
    classes = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    seen = ((F.col("quality") == 1) | F.col("on_bad")) & ((F.col("toxic") == 0) | F.col("on_toxic"))
    return classes.join(F.broadcast(policy)).groupBy("domain").agg(F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("analysed"), F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("skipped"))


@query(f"""WITH a AS (SELECT CASE lang WHEN 'en' THEN 'file' WHEN 'fr' THEN 'class' WHEN 'de' THEN 'function' ELSE 'method' END AS kind, {NON_BLANK_SQL} AS loc FROM documents),
l AS (SELECT *, CASE kind WHEN 'file' THEN 30 WHEN 'class' THEN 25 WHEN 'function' THEN 20 ELSE 15 END AS lim FROM a)
SELECT count(*)::BIGINT AS n, count(*) FILTER (loc > lim)::BIGINT AS violations, round(greatest(0, least(1, 1 - sum(greatest(0, (loc - lim)::DOUBLE / lim)) / count(*))), 6)::DOUBLE AS score FROM l""")
def code_size_score(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "file").when(F.col("lang") == "fr", "class").when(F.col("lang") == "de", "function").otherwise("method")
    artifacts = files(spark, sf_dir).select(kind.alias("kind"), T.non_blank_count(F.col("text")).alias("loc"))
    return M.size_score(M.with_limits(artifacts, {"file": 30, "class": 25, "function": 20, "method": 15})).withColumn("score", F.round("score", 6))


def is_technical_sql(column: str) -> str:
    """The fixed patterns as SQL."""
    return f"CASE WHEN regexp_matches({column}, '{T.TECHNICAL_MARK}') THEN regexp_matches({column}, '{'|'.join(T.TECHNICAL)}') ELSE regexp_matches({column}, '{T.LOWER_CAMEL}') END"


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS token FROM documents UNION ALL SELECT url FROM pages)
SELECT CASE WHEN {is_technical_sql("token")} THEN 'technical' WHEN NOT regexp_matches(token, '[A-Za-z0-9]') THEN 'marks' ELSE 'words' END AS kind, count(*)::BIGINT AS n FROM t GROUP BY ALL""")
def technical_strings(spark, sf_dir):
    """Words and addresses as strings of sources: technical ones, marks alone, and words for people."""
    tokens = files(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"([^ \t\n\x0B\f\r]+)"), 1)).alias("token"))
    t = F.col("token")
    kind = F.when(T.is_technical(t), "technical").when(~T.is_meaningful(t), "marks").otherwise("words")
    return tokens.union(table(spark, sf_dir, "pages").select("url")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '[a-z-]+="[^"]*"')) AS x FROM pages), v AS (SELECT page_id, regexp_extract(x, '^([a-z-]+)=', 1) AS name, trim(regexp_extract(x, '="([^"]*)"', 1)) AS value FROM a)
SELECT name, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS kinds FROM v WHERE regexp_matches(value, '[A-Za-z0-9]') AND name NOT IN ('lang', 'charset') AND NOT ({is_technical_sql("value")}) GROUP BY name""")
def hardcoded_filters(spark, sf_dir):
    """Attribute values as string literals, less those that the exclusions drop."""
    a = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('([a-z-]+="[^"]*")'), 1)).alias("x"))
    v = a.select(F.regexp_extract("x", "^([a-z-]+)=", 1).alias("name"), F.trim(F.regexp_extract("x", '="([^"]*)"', 1)).alias("value"))
    kept = v.where(T.is_meaningful(F.col("value")) & ~F.col("name").isin("lang", "charset") & ~T.is_technical(F.col("value")))
    return kept.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("value").alias("kinds"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
h AS (SELECT doc_id, line, t, unnest([
  CASE WHEN regexp_matches(t, '\\bAKIA[0-9A-Z]{16}\\b') THEN 'aws_access_key' END,
  CASE WHEN regexp_matches(t, '(?i)(api_?key|secret|token|password|passwd)[A-Za-z0-9_]*["'']?\\s*[:=]\\s*["''][^"'']{8,}["'']') THEN 'generic_secret' END,
  CASE WHEN regexp_matches(t, '(?i)\\bbearer\\s+[A-Za-z0-9._~+/-]{16,}=*') THEN 'bearer_token' END,
  CASE WHEN regexp_matches(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private_key' END,
  CASE WHEN regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') THEN 'email_pii' END,
  CASE WHEN regexp_matches(t, '\\bsk_live_[0-9A-Za-z]{16,}') THEN 'stripe_key' END,
  CASE WHEN regexp_matches(t, '\\bghp_[0-9A-Za-z]{20,}') THEN 'github_pat' END]) AS secret_type FROM l),
named AS (SELECT * FROM h WHERE secret_type IS NOT NULL),
blob AS (SELECT doc_id, line, regexp_extract(t, '[A-Za-z0-9+/=_-]{32,}') AS b FROM l WHERE regexp_matches(t, '[A-Za-z0-9+/=_-]{32,}') AND (doc_id, line) NOT IN (SELECT (doc_id, line) FROM named)),
letters AS (SELECT doc_id, line, b, unnest(string_split(b, '')) AS ch FROM blob), counted AS (SELECT doc_id, line, b, count(*)::DOUBLE / length(b) AS p FROM letters GROUP BY doc_id, line, b, ch),
loose AS (SELECT doc_id, line, 'high_entropy' AS secret_type FROM counted GROUP BY doc_id, line HAVING -sum(p * log2(p)) >= 4.5)
SELECT secret_type, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS files FROM (SELECT doc_id, secret_type FROM named UNION ALL SELECT doc_id, secret_type FROM loose) GROUP BY secret_type""")
def secrets_by_type(spark, sf_dir):
    """All eight types."""
    found = X.secrets(files(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    return found.groupBy("secret_type").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query("""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([^"]+)"', 1)) AS value FROM documents), c AS (SELECT doc_id, value, unnest(string_split(value, '')) AS ch FROM v),
n AS (SELECT doc_id, value, ch, count(*) AS k, (sum(count(*)) OVER (PARTITION BY doc_id, value))::DOUBLE AS total FROM c GROUP BY doc_id, value, ch)
SELECT doc_id, value, round(-sum(k / total * log2(k / total)), 6) AS entropy FROM n GROUP BY doc_id, value""")
def secrets_entropy(spark, sf_dir):
    v = files(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([^"]+)"'), 1)).alias("value")).distinct()
    return v.select("doc_id", "value", F.round(X.entropy(F.col("value")), 6).alias("entropy"))


@query(None)
def near_duplicates(spark, sf_dir):
    """Documents of a language whose whole texts, as words, are nearly the same: each pair of different texts by their least documents, and each copy with the least of its text."""
    from corvane.operators.similarity import listed, similar_texts

    docs = files(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("signature"), "text")
    return listed(*similar_texts(docs, 0.9)).withColumn("similarity", F.round("similarity", 6))
