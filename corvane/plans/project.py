"""A source tree analysed: one extraction, then every analysis as a query over its facts."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import deadcode, graph, intervals, localization, metrics, packages, score, secrets, similarity, sorting, syntax
from corvane.sources import globs, translations, tree
from corvane.sources.config import Config, Project, find_pubspec, parse_pubspec
from corvane.sources.store import materialize


@dataclass
class Analysis:
    project: Project
    config: Config
    counters: DataFrame
    facts: DataFrame
    artifacts: DataFrame
    edges: DataFrame
    layers: DataFrame
    cycles: DataFrame
    issues: DataFrame  # domain, type, path, line, subject, severity
    duplicates: DataFrame
    coverage: DataFrame
    translations: DataFrame  # locale, path, line, key, problem
    excluded: DataFrame
    tests: DataFrame
    widgets: DataFrame  # kind, n
    locale_report: DataFrame  # part, locale, item, text
    areas: DataFrame
    result: DataFrame


def artifacts_of(facts: DataFrame) -> DataFrame:
    """Files and what they declare; each declaration once, the first of the same identity."""
    whole = facts.select(F.lit("file").alias("kind"), "path", F.col("path").alias("name"), F.lit(None).cast("string").alias("owner"), "loc", F.lit(1).alias("first"), F.lit(None).cast("int").alias("last"), F.lit(-1).alias("ordinal"))
    inner = facts.select("path", F.explode("artifacts").alias("a")).select(F.when(F.col("a.kind") == "constructor", "method").otherwise(F.col("a.kind")).alias("kind"), "path", "a.name", "a.owner", "a.loc", "a.first", "a.last", "a.ordinal")
    once = metrics.first_of(inner.withColumn("id", T.stable_id(F.col("kind"), F.col("path"), F.col("owner"), F.col("name"), F.col("first"))), ["id"], [F.col("ordinal")]).drop("id")
    return whole.unionByName(once)


def issue(rows: DataFrame, domain: str, kind, line, subject, severity: str = "warning") -> DataFrame:
    return rows.select(F.lit(domain).alias("domain"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), "path", line.cast("long").alias("line"), subject.cast("string").alias("subject"), F.lit(severity).alias("severity"))


def ignored(facts: DataFrame, domain: str) -> DataFrame:
    """Files whose leading comments hold a directive for the domain."""
    return facts.where(F.exists("directives", lambda d: d["leading"] & d["token"].endswith(domain))).select("path")


def open_lines(rows: DataFrame, facts: DataFrame, domain: str) -> DataFrame:
    """rows: path, line. Without those in the reach of a directive for the domain: its own line and all of what begins there."""
    held = facts.select("path", F.explode("directives").alias("d")).where(F.col("d.token").endswith(domain)).select("path", F.col("d.line").alias("first"), F.col("d.last").alias("last"))
    return intervals.outside(rows, held, ["path"])


#: Named arguments of widgets whose strings nobody reads, and endings of files that hold texts.
QUIET = ("semanticsLabel", "excludeSemantics", "restorationId", "heroTag", "key", "debugLabel", "fontFamily", "package", "name", "asset", "tooltip", "textDirection", "locale", "materialType", "clipBehavior", "crossAxisAlignment", "mainAxisAlignment", "textAlign", "textBaseline", "overflow", "softWrap", "textScaleFactor")
TEXT_FILES = r"(?i)(strings|constants|keys)\.dart$"
FOCUS = {"flutter": "widgets", "dart": "print"}


def hardcoded(plain: DataFrame, facts: DataFrame, focus: str, translated: bool) -> DataFrame:
    """(path, line, value) of strings for people. focus: widgets (neither printed nor technical, with any Text('...')), print (printed ones alone) or general."""
    shown = plain.join(ignored(facts, "hardcoded_strings"), "path", "left_anti")
    s = shown.select("path", "excused", F.explode("strings").alias("s")).select("path", "excused", "s.*")
    s = s.withColumn("value", F.col("bare")).where(T.is_meaningful(F.col("value")) & F.col("exempt").isNull())
    if not translated:
        s = s.where(~F.col("path").rlike(TEXT_FILES))
    if focus == "print":
        s = s.where("printed")
    if focus == "widgets":
        quiet = F.coalesce(F.col("property").isin(*QUIET), F.lit(False)) | F.array_contains("excused", F.col("line"))
        s = s.where(~F.col("logged") & ~quiet & ~T.is_technical(F.col("value")) & ~(F.col("output") & (F.length("value") <= 2)))
    found = open_lines(s.select("path", "line", "value"), facts, "hardcoded_strings")
    if focus != "widgets":
        return found
    w = shown.select("path", "excused", F.explode("widget_texts").alias("w")).select("path", "excused", "w.line", "w.value")
    plain_text = T.is_meaningful(T.without_interpolations(F.col("value"))) & ~T.is_technical(F.col("value")) & (F.length("value") > 2)
    w = w.where(plain_text & ~F.array_contains("excused", F.col("line"))).select("path", "line", "value")
    on_line = facts.select(F.col("path").alias("p"), F.explode("listed").alias("d")).where(F.col("d.token").endswith("hardcoded_strings")).select("p", F.col("d.line").alias("l"))
    return w.join(on_line, (F.col("path") == F.col("p")) & (F.col("line") == F.col("l")), "left_anti").union(found).distinct()


def magic_numbers(plain: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, line, value) of numbers that are neither trivial nor named, in an annotation or excused."""
    n = plain.join(ignored(facts, "magic_numbers"), "path", "left_anti").select("path", F.explode("numbers").alias("n")).select("path", "n.line", "n.value", "n.is_const")
    return open_lines(n.where(~F.col("is_const") & ~T.is_trivial_number(F.col("value"))), facts, "magic_numbers").select("path", "line", "value")


def unsorted_members(facts: DataFrame) -> DataFrame:
    """(path, line, owner_name) of widget classes whose members aren't in order."""
    whole = facts.where(~F.col("broken") & ~globs.is_generated(F.col("path")))
    targets = whole.select("path", F.explode("artifacts").alias("a")).where((F.col("a.kind") == "class") & F.col("a.parent").rlike("^(StatelessWidget|StatefulWidget|State)$")).select("path", F.col("a.name").alias("owner_name"), F.col("a.first").alias("line"))
    members = whole.select("path", F.explode("members").alias("m")).select("path", F.col("m.owner").alias("owner_name"), "m.ordinal", "m.kind", "m.name")
    placed = sorting.sorted_members(members.join(targets, ["path", "owner_name"], "left_semi").withColumn("owner", F.concat_ws("#", "path", "owner_name")))
    wrong = placed.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("ordinal"))).where("place <> target").select("path", "owner_name").distinct()
    return wrong.join(targets, ["path", "owner_name"]).select("path", "line", "owner_name")


def undocumented(plain: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, line, name, kind) of public classes and callables without documentation, and of private ones of ten lines or more without any comment."""
    declared = plain.join(ignored(facts, "documentation"), "path", "left_anti").select("path", F.explode("artifacts").alias("a")).where(F.col("a.kind").isin("class", "function", "method") & ~F.col("a.is_override") & ~F.col("a.name").startswith("operator "))
    public = F.col("a.is_public") & ~F.col("a.documented") & ~((F.col("a.kind") == "function") & (F.col("a.name") == "main"))
    private = ~F.col("a.is_public") & (F.col("a.kind") != "class") & F.col("a.is_complex") & ~F.col("a.commented")
    kind = F.when(public & (F.col("a.kind") == "class"), "undocumented_class").when(public, "undocumented_function").when(private, "undocumented_complex_private_function")
    bare = declared.select("path", F.col("a.first").alias("line"), T.qualified_name(F.when(F.col("a.kind") == "method", F.col("a.owner")), F.col("a.name")).alias("name"), kind.alias("kind")).where("kind is not null")
    return open_lines(bare, facts, "documentation")


def project_of(scanned: DataFrame, root: str) -> tuple[Project, DataFrame]:
    """The project of a scanned tree, by the nearest pubspec at or above root, else by the one that all its Dart files share; and the packages in the tree."""
    inside = materialize(tree.packages(scanned.where("reason is null or reason = 'glob'")), "packages")
    pubspec = find_pubspec(root)
    if pubspec:
        return parse_pubspec(open(pubspec, encoding="utf-8").read()), inside
    only = packages.sole(packages.nearest(scanned.where("reason is null and is_dart and not is_test"), inside)).first()["manifest"]
    if only is None:
        return Project(), inside
    text = scanned.where(F.col("path") == (f"{only}/pubspec.yaml" if only else "pubspec.yaml")).select("content").first()["content"]
    return parse_pubspec(text or ""), inside


def analyze(spark: SparkSession, root: str, config: Config | None = None) -> Analysis:
    config = config or Config(root)
    scanned = materialize(tree.classified(tree.read_tree(spark, root), list(config.exclude)), "tree")
    kept = scanned.where("reason is null")
    dart = kept.where("is_dart and not is_test")
    project, inside = project_of(scanned, root)
    facts = materialize(tree.extract(dart), "facts")
    artifacts = materialize(artifacts_of(facts), "artifacts")
    generated = globs.is_generated(F.col("path")) | globs.in_l10n(F.col("path")) | globs.is_generated_localization(F.col("path"))
    plain = facts.where(~F.col("broken") & ~generated)

    # Dependency graph: edges between analysed files; files with a directive keep their node and lose their edges.
    nodes = facts.select(F.col("path").alias("node"))
    every_edge = tree.import_edges(facts, project.name, others=inside)
    edges = materialize(graph.within_nodes(tree.import_edges(facts, project.name, ("import", "export"), inside).join(ignored(facts, "layers").withColumnRenamed("path", "src"), "src", "left_anti"), nodes), "edges")
    folders = graph.folder_edges(edges)
    file_cycles, folder_cycles = materialize(graph.cycle_edges(edges), "cycles"), graph.cycle_edges(folders)
    cyclic = file_cycles.limit(1).count() + folder_cycles.limit(1).count() > 0
    layers = graph.layers(edges, nodes) if not cyclic else nodes.withColumn("layer", F.lit(None).cast("int")).where("false")

    on = lambda a: a in config.enabled
    none = artifacts.limit(0).select(F.lit("").alias("domain"), F.lit("").alias("type"), "path", F.lit(0).cast("long").alias("line"), F.lit("").alias("subject"), F.lit("").alias("severity"))
    found = {}
    limited = metrics.with_limits(artifacts, config.limits)
    over = limited.where("loc > `limit`")
    found["code_size"] = issue(over, "code_size", F.concat(F.col("kind"), F.lit("_size")), F.col("first"), T.qualified_name(F.col("owner"), F.col("name")))
    classes = plain.select("path", F.size(F.filter("artifacts", lambda a: a["kind"] == "class")).alias("n"), F.exists("artifacts", lambda a: (a["kind"] == "class") & (a["parent"] == "StatefulWidget")).alias("stateful"))
    crowded = classes.where(F.when(F.col("stateful"), F.col("n") > 2).otherwise(F.col("n") > 1)).join(ignored(facts, "one_class_per_file"), "path", "left_anti")
    found["one_class_per_file"] = issue(crowded, "one_class_per_file", "several_classes", F.lit(1), F.col("n"))
    arb = materialize(translations.entries(translations.translation_files(kept.where(~F.col("is_dir")))), "translations")
    uses = facts.where(F.exists("imports", lambda i: i["uri"].rlike("gen_l10n|app_localizations|/l10n/"))).limit(1).count() + arb.limit(1).count() + kept.where("path = 'l10n.yaml'").limit(1).count() > 0
    found["hardcoded_strings"] = issue(hardcoded(plain, facts, FOCUS.get(project.kind, "general"), uses), "hardcoded_strings", "hardcoded", F.col("line"), F.col("value"))
    found["magic_numbers"] = issue(magic_numbers(plain, facts), "magic_numbers", "magic_number", F.col("line"), F.col("value"))
    found["source_sorting"] = issue(unsorted_members(facts), "source_sorting", "unsorted_members", F.col("line"), F.col("owner_name"))
    cycle_rows = file_cycles.select(F.col("src").alias("path"), "dst").unionByName(folder_cycles.select(F.col("src").alias("path"), "dst"))
    found["layers"] = issue(cycle_rows, "layers", "cyclicDependency", F.lit(None), F.col("dst"), "error").unionByName(issue(graph.violations(edges, layers).select(F.col("src").alias("path"), "dst"), "layers", "wrongFolderLayer", F.lit(None), F.col("dst")))
    found["secrets"] = issue(secrets.secrets(dart.select("path", "content")), "secrets", F.col("secret_type"), F.col("line"), F.lit("hidden"), "error")

    # Dead code: by reach from the entry points, and by names that nothing uses.
    entries = deadcode.entry_points(facts.select("path", "has_main"), project.name, project.kind == "dart")
    reach_edges = graph.within_nodes(every_edge, nodes)
    dead = deadcode.dead_files(facts.where(~generated).select("path"), reach_edges, entries)
    live = None if not entries.limit(1).count() else facts.select("path").join(dead, "path", "left_anti")
    used = deadcode.used_in(facts.select("path", F.explode("used").alias("name")), live)
    symbols = plain.join(ignored(facts, "dead_code"), "path", "left_anti").select("path", F.explode("artifacts").alias("a")).where(F.col("a.kind") != "constructor").select("path", "a.kind", "a.name", "a.owner", F.col("a.first").alias("line"), "a.is_override", "a.is_preview", (F.col("a.is_abstract") & (F.col("a.kind") == "method")).alias("is_abstract"))
    unused = deadcode.unused_symbols(deadcode.excluded(symbols).where(~F.col("name").startswith("operator ")), used)
    whole = dart.select("path", "content").join(plain.select("path").join(ignored(facts, "dead_code"), "path", "left_anti"), "path", "left_semi")
    locals_ = open_lines(syntax.unused_variables(whole), facts, "dead_code")
    found["dead_code"] = (
        issue(dead, "dead_code", "dead_file", F.lit(None), F.col("path"))
        .unionByName(issue(open_lines(unused, facts, "dead_code"), "dead_code", F.concat(F.lit("dead_"), F.col("kind")), F.col("line"), T.qualified_name(F.col("owner"), F.col("name"))))
        .unionByName(issue(locals_, "dead_code", "unused_variable", F.col("line"), F.col("name")))
    )

    # Near copies: tokens as characters, equal signatures, bounded edit distance.
    snippets = plain.join(ignored(facts, "duplicate_code"), "path", "left_anti").select("path", F.explode("artifacts").alias("a")).where((F.size("a.tokens") >= config.duplicate_min_tokens) & (F.col("a.loc") >= config.duplicate_min_lines))
    symbol_codes = materialize(snippets.select(F.explode("a.tokens").alias("t")).distinct().withColumn("c", F.char(F.row_number().over(Window.orderBy("t")) + 34)), "symbols")
    symbol_codes = F.broadcast(symbol_codes) if symbol_codes.count() <= similarity.BROADCAST_ROWS else symbol_codes  # normalized tokens: mostly some hundred
    coded = snippets.select(F.concat_ws(":", "path", F.format_string("%06d", F.col("a.first")), T.qualified_name(F.col("a.owner"), F.col("a.name"))).alias("id"), F.col("a.signature").alias("signature"), F.col("a.loc").alias("loc"), F.posexplode("a.tokens").alias("k", "t"))
    items = coded.join(symbol_codes, "t").groupBy("id", "signature", "loc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]), "").alias("code"))
    items = materialize(items, "snippets")
    members, links = similarity.similar_codes(items.select("id", "signature", "code"), config.duplicate_similarity)
    members = materialize(members, "snippet-classes")
    links = materialize(links, "snippet-links")
    lines = lambda c: items.select(F.col("id").alias(c), F.col("loc").alias(f"loc_{c}"))
    pairs = similarity.listed(members, links).join(lines("a"), "a").join(lines("b"), "b").select("a", "b", "similarity", F.least("loc_a", "loc_b").alias("lines"))
    duplicates = materialize(in_order(pairs), "duplicates")
    weighed = similarity.weights(members.join(items.select("id", "loc"), "id"), links)
    found["duplicate_code"] = issue(duplicates.select(F.substring_index("a", ":", 1).alias("path"), "a", "b"), "duplicate_code", "duplicate", F.split("a", ":")[1], F.col("b"))
    readme = scanned.where("lower(path) = 'readme.md'").limit(1).count()
    found["documentation"] = issue(undocumented(plain, facts), "documentation", F.col("kind"), F.col("line"), F.col("name"))
    if not readme:
        found["documentation"] = found["documentation"].unionByName(issue(spark.createDataFrame([("README.md",)], "path string"), "documentation", "missing_readme", F.lit(None), F.col("path")))

    # Translations: one issue for each locale with problems, and its details.
    base = localization.base_file(arb)
    details, n_keys = localization.details(arb, translations.reads(dart.select("path", "content")), base or "")
    details = materialize(details, "translation-details")
    own = arb.where(F.col("path") == (base or "")).select("locale")
    coverage = localization.by_locale(details, arb.select("locale").join(own, "locale", "left_anti"), n_keys)
    summary = localization.problem_summary(details.groupBy("locale", "problem").agg(F.count("*").alias("n")))
    stats = localization.scan_stats(arb)
    incomplete = materialize(coverage.join(summary, "locale"), "locale-problems")
    if not incomplete.limit(1).count():  # where the analysis finds nothing, what a scan of the files tells
        incomplete = localization.scan_problems(stats).withColumn("summary", F.concat(F.col("missing").cast("string"), F.lit(" missing")))
    locale_report = localization.report_lines(stats, incomplete, details).where(F.lit(bool(arb.limit(1).count())))
    found["localization"] = issue(summary.select(F.col("locale").alias("path"), "summary"), "localization", "incomplete_locale", F.lit(None), F.col("summary"))

    issues = none
    for a in score.AREAS:
        if on(a):
            issues = issues.unionByName(found[a])
    issues = materialize(issues, "issues")
    tests = tree.extract(tree.tests_of(scanned))
    consumed = tree.import_edges(tests, project.name, others=inside).select(F.col("dst").alias("node")).join(nodes, "node", "left_semi").distinct()
    reach = graph.reachable(reach_edges, consumed).select(F.col("node").alias("path")).join(facts, "path")
    kinds = lambda k: F.coalesce(F.sum(F.size(F.filter("artifacts", lambda a: a["kind"] == k))), F.lit(0)).cast("long")
    test_row = reach.agg(F.count("*").alias("consumed"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), kinds("class").alias("classes"), kinds("method").alias("methods"), kinds("function").alias("functions"))
    test_row = test_row.join(tests.agg(F.coalesce(F.sum("test_cases"), F.lit(0)).alias("test_cases")))  # a row each
    widgets = graph.widget_totals(facts.select(F.explode("artifacts").alias("a")).where("a.kind = 'class'").select("a.name", T.plain_type_name(F.col("a.parent")).alias("parent")))

    counters = tree.counters(scanned)
    total = facts.agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.coalesce(F.sum(F.size("directives")), F.lit(0)).cast("long").alias("directives"))
    counted = issues.agg(*[F.count_if(F.col("domain") == a).alias(f"{a}_issues") for a in score.AREAS if a != "duplicate_code"])
    impact = weighed.agg(F.coalesce(F.sum("impact"), F.lit(0.0)).alias("duplicate_impact"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    impact = impact.select("duplicate_impact", (F.col("pairs") if on("duplicate_code") else F.lit(0)).cast("long").alias("duplicate_code_issues"))
    row = total.join(counted).join(impact).join(metrics.size_score(limited).select(F.col("score").alias("size_score"))).join(edges.agg(F.count("*").alias("edges"))).join(classes.agg(F.count("*").alias("one_class_total")))  # a row each
    row = row.withColumns({f"{a}_enabled": F.lit(on(a)) for a in score.AREAS} | {"project": F.lit(project.name), "localization_on": F.lit(uses), "excludes": F.lit(len(config.exclude)), "disabled": F.lit(sum(not on(a) for a in score.COUNTED_AS_DISABLED))})
    row = materialize(row, "score-input")
    areas = score.areas(row)
    return Analysis(project, config, counters, facts, artifacts, edges, layers, file_cycles, issues, duplicates, coverage, localization.ordered(details), tree.excluded(scanned), test_row, widgets, locale_report, areas, score.overall(areas, score.suppression_points(row)))


def in_order(duplicates: DataFrame) -> DataFrame:
    """a and b are path:line:name. Most alike first, then longest, then by both places: path, line and name of each."""
    part = lambda c, k: F.element_at(F.split(c, ":"), k)
    place = [part(c, k).cast("long") if k == -2 else part(c, k) for c in ("a", "b") for k in (1, -2, -1)]
    return duplicates.orderBy(F.desc("similarity"), F.desc("lines"), *place)


def project_name(root: str) -> str:
    return os.path.basename(os.path.abspath(root))
