"""Translation matrices: base keys by locale, problems, coverage, unused keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import grouped, language_name, translation_problem
from corvane.operators.lanes import ranked_lanes

#: Problems in the order of reports.
PROBLEMS = ("missing", "empty", "unchanged", "placeholder_mismatch", "duplicate_key", "unused_key")


def base_locale(locales: DataFrame) -> DataFrame:
    """The first of the locales named en or en_*, else the first of all, in code point order."""
    english = F.col("locale").rlike("^en([_-].*)?$")
    return locales.agg(F.coalesce(F.min(F.when(english, F.col("locale"))), F.min("locale")).alias("locale"))


def matrix(entries: DataFrame, base: str) -> DataFrame:
    """entries: key, locale, value -> (key, locale, problem) for each base key and other locale; keys that start with @ describe others.

    Every key is needed for every locale, so the cells are the result itself; the list of locales is counted and small.
    """
    real = entries.where(~F.col("key").startswith("@"))
    keys = real.where(F.col("locale") == base).groupBy("key").agg(F.min("value").alias("base_value"))
    locales = real.select("locale").where(F.col("locale") != base).distinct()
    cells = keys.join(locales.agg(F.sort_array(F.collect_set("locale")).alias("locales"))).select("key", "base_value", F.explode("locales").alias("locale"))
    values = real.groupBy("key", "locale").agg(F.min("value").alias("value"))
    return cells.join(values, ["key", "locale"], "left").select("key", "locale", translation_problem(F.col("base_value"), F.col("value")).alias("problem"))


def coverage(cells: DataFrame) -> DataFrame:
    """Per locale: total, missing (duplicates and unused keys don't count), problems, and the share covered in percent to one decimal."""
    bad = F.col("problem").isNotNull() & ~F.col("problem").isin("duplicate_key", "unused_key")
    out = cells.groupBy("locale").agg(F.count("*").alias("total"), F.count_if(bad).alias("missing"), F.count("problem").alias("problems"))
    share = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (F.col("total") - F.col("missing")) / F.col("total"))), 1)
    return out.withColumn("coverage", share)


def problem_counts(cells: DataFrame) -> DataFrame:
    return cells.where("problem is not null").groupBy("locale", "problem").agg(F.count("*").alias("n"))


def problem_summary(counts: DataFrame, shown: int = 3) -> DataFrame:
    """One line per locale: the first problems in report order, and how many more kinds there are."""
    ordinal = F.array_position(F.array(*map(F.lit, PROBLEMS)), F.col("problem"))
    listed = counts.groupBy("locale").agg(F.array_sort(F.collect_list(F.struct(ordinal.alias("o"), F.concat_ws(" ", F.col("n").cast("string"), "problem").alias("t")))).alias("l"))
    text = F.array_join(F.slice(F.transform("l", lambda x: x["t"]), 1, shown), ", ")
    more = F.size("l") - shown
    return listed.select("locale", F.when(more > 0, F.concat(text, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(text).alias("summary"))


def unused(keys: DataFrame, used: DataFrame, has_access: bool) -> DataFrame:
    """Base keys that no source uses; none can be told where the sources show no access at all."""
    left = keys.select("key").distinct().join(used.select("key").distinct(), "key", "left_anti")
    return left if has_access else left.where("false")


def repeated_keys(lines: DataFrame) -> DataFrame:
    """lines: file, key, line -> all but each key's first line, with that first line."""
    first = lines.groupBy("file", "key").agg(F.min("line").alias("first_line"))
    return lines.join(first, ["file", "key"]).where("line > first_line")


def base_file(entries: DataFrame) -> str | None:
    """The first path, in code point order, of a file in English; else the first of all."""
    english = F.substring_index("locale", "_", 1) == "en"
    row = entries.agg(F.min(F.when(english, F.col("path"))).alias("english"), F.min("path").alias("any")).first()
    return row["english"] or row["any"]


DETAIL = ("locale", "path", "line", "key", "problem")


def details(entries: DataFrame, reads: DataFrame, base: str) -> tuple[DataFrame, int]:
    """(locale, path, line, key, problem) of everything wrong, and how many base keys are to be translated.

    entries: path, locale, key, value, kept, declared, lines; reads: key, what sources use; base: the base file's path. A key that a file
    repeats has its repetitions as its only problem there; a missing one stands where the base file declares it. Base keys
    that no source reads count only where the base is English and sources read any. Without keys to translate,
    repetitions are all there is. Files whose names tell no locale have no rows.
    """
    real = entries.where(F.col("key").isNotNull())
    own = real.where(F.col("path") == base)
    keys = own.where(F.col("declared") & ~F.col("kept")).select("key", F.col("value").alias("base_value"), F.coalesce(F.get("lines", 0), F.lit(1)).alias("base_line"))
    n_keys = keys.count()
    named = real.where("locale is not null")
    repeated = named.select("locale", "path", F.explode(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).alias("line"), "key", F.lit("duplicate_key").alias("problem"))
    if not n_keys:
        return repeated.select(*DETAIL), 0
    # Each key is needed in each file, so these cells are the result's own size; files are listed once for all keys.
    files = entries.where("locale is not null").where(F.col("path") != base).select("path", "locale").distinct()
    listed = files.agg(F.collect_list(F.struct("path", "locale")).alias("files"))  # one row, an element for each translation file
    cells = keys.join(listed).select("key", "base_value", "base_line", F.explode("files").alias("f")).select("key", "base_value", "base_line", "f.path", "f.locale")
    held = named.select("path", "key", "value", "kept", "lines")
    cells = cells.join(held, ["path", "key"], "left").where(~F.coalesce("kept", F.lit(False)))
    problem = translation_problem(F.col("base_value"), F.col("value"))
    single = cells.where(F.coalesce(F.size("lines"), F.lit(0)) <= 1).withColumn("problem", problem).where("problem is not null")
    lost = F.col("problem") == "missing"
    line = F.when(lost, F.col("base_line")).otherwise(F.coalesce(F.get("lines", 0), F.lit(1)))
    wrong = single.select("locale", F.when(lost, F.lit(base)).otherwise(F.col("path")).alias("path"), line.alias("line"), "key", "problem")
    mine = repeated.join(keys.select("key"), "key", "left_semi").where(F.col("path") != base).select(*DETAIL)
    of_base = repeated.where(F.col("path") == base).select(*DETAIL)
    found = wrong.unionByName(mine).unionByName(of_base)
    language = entries.where(F.col("path") == base).select("locale").first()["locale"]
    if language and language.split("_")[0] == "en" and reads.limit(1).count():
        idle = unused(keys, reads, True).join(keys.select("key", "base_line"), "key")
        found = found.unionByName(idle.select(F.lit(language).alias("locale"), F.lit(base).alias("path"), F.col("base_line").alias("line"), "key", F.lit("unused_key").alias("problem")))
    return found, n_keys


def by_locale(found: DataFrame, locales: DataFrame, n_keys: int, every: bool = False) -> DataFrame:
    """Per locale: total, missing (repetitions and unused keys don't count, unless every problem does), problems and coverage in percent to one decimal."""
    bad = F.lit(True) if every else ~F.col("problem").isin("duplicate_key", "unused_key")
    counts = found.groupBy("locale").agg(F.count_if(bad).alias("missing"), F.count("*").alias("problems"))
    out = locales.select("locale").where("locale is not null").distinct().join(counts, "locale", "left")
    missing = F.coalesce("missing", F.lit(0))
    share = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (F.lit(n_keys) - missing) / F.lit(max(1, n_keys)))), 1)
    return out.select("locale", F.lit(n_keys).cast("long").alias("total"), missing.alias("missing"), F.coalesce("problems", F.lit(0)).alias("problems"), share.alias("coverage"))


def scan_stats(entries: DataFrame) -> DataFrame:
    """entries: locale, key -> (locale, n): how many keys each locale has, but those that describe others (@); what a quick look at the files tells."""
    return entries.where(F.col("locale").isNotNull()).groupBy("locale").agg(F.count_distinct(F.when(~F.col("key").startswith("@"), F.col("key"))).alias("n"))


def scan_problems(stats: DataFrame) -> DataFrame:
    """stats: locale, n -> (locale, total, missing): locales with fewer keys than the base one, all of which count as missing; none without a base that has keys."""
    base = stats.join(base_locale(stats), "locale", "left_semi").select(F.col("locale").alias("base"), F.col("n").alias("total")).where("total > 0")  # one row at most
    return stats.join(base).where("locale <> base and n < total").select("locale", "total", (F.col("total") - F.col("n")).alias("missing"))


def report_lines(stats: DataFrame, problems: DataFrame, found: DataFrame, shown: int | None = 10) -> DataFrame:
    """(part, locale, item, text): the report on translations, to be read in the order of its first three columns.

    stats: locale, n (scan_stats); problems: locale, total, missing, summary; found: as details, of which each locale shows the first
    ``shown`` (None: all). A locale has one line, padded to the widest name, and one for each detail.
    """
    many = lambda c: grouped(c.cast("long"))
    label = F.concat(language_name(F.col("locale")), F.lit(" ("), F.col("locale"), F.lit(")"))
    base = stats.join(base_locale(stats), "locale", "left_semi").select(label.alias("base"), F.col("n").alias("keys"))
    head = problems.agg(F.count("*").alias("issues")).join(stats.agg(F.count("*").alias("languages"))).join(base, how="left")  # a row each
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    some = F.coalesce("keys", F.lit(0)) > 0
    lines = [
        (0, text("[!] ", many(F.col("issues")), " localization issues detected"), None), (1, F.lit("  [✓] Localization Summary:"), None), (2, text("    - Base language: ", F.coalesce("base", F.lit("Not detected"))), None),
        (3, text("    - Total translation keys: ", many(F.col("keys"))), some), (4, text("    - Supported languages: ", many(F.col("languages"))), some), (5, text("    - Problem locales: ", many(F.col("issues"))), some), (6, F.lit("  [!] Localization Problems:"), some),
    ]
    shape = F.array_compact(F.array(*[F.when(F.lit(True) if when is None else when, F.struct(F.lit(k).alias("part"), t.alias("text"))) for k, t, when in lines]))
    first = head.select(F.explode(shape).alias("l")).select("l.part", F.lit("").alias("locale"), F.lit(0).cast("long").alias("item"), "l.text")
    named = problems.withColumn("label", label)
    named = named.join(named.agg(F.max(F.char_length("label")).alias("width")))  # one row
    covered = F.floor(100 * (F.col("total") - F.col("missing")) / F.greatest(F.col("total"), F.lit(1)))
    wide = F.concat("label", F.repeat(F.lit(" "), (F.col("width") - F.char_length("label")).cast("int")))
    each = named.select(F.lit(7).alias("part"), "locale", F.lit(0).cast("long").alias("item"), text("    - ", wide, ": ", many(F.greatest(covered, F.lit(0))), "% coverage (", F.col("summary"), ")").alias("text"))
    listed = ranked_lanes(found.select("locale", "path", "line", "key", "problem"), ["locale"], [F.col("path"), F.col("line"), F.col("key"), F.array_position(F.array(*map(F.lit, PROBLEMS)), F.col("problem"))])
    listed = listed.join(problems.select("locale"), "locale", "left_semi").withColumn("item", (F.col("lane") + 1).cast("long"))
    kind = F.col("problem")
    said = F.when(kind == "missing", text("missing ", F.col("key"), " in ", F.col("locale"))).when(kind == "unused_key", text("unused key ", F.col("key"), " in app source")).otherwise(text(F.replace(kind, F.lit("_"), F.lit(" ")), " ", F.col("key")))
    one = listed.where(F.lit(True) if shown is None else F.col("item") <= shown).select(F.lit(7).alias("part"), "locale", "item", text("      - ", F.col("path"), ":", F.col("line").cast("string"), ": ", said).alias("text"))
    out = first.unionByName(each).unionByName(one)
    if shown is not None:
        rest = listed.groupBy("locale").agg(F.count("*").alias("n")).where(F.col("n") > shown)
        out = out.unionByName(rest.select(F.lit(7).alias("part"), "locale", (F.lit(shown) + 1).cast("long").alias("item"), text("      ... and ", many(F.col("n") - shown), " more").alias("text")))
    return out


def ordered(found: DataFrame) -> DataFrame:
    """Details in the order of reports: path, line, key, kind of problem."""
    return found.orderBy("locale", "path", "line", "key", F.array_position(F.array(*map(F.lit, PROBLEMS)), F.col("problem")))
