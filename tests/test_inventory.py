"""Folders, inventories and fixes."""

from pyspark.sql import functions as F

from corvane.operators import folders, packages
from corvane.sources import inventory, tree


def test_folders(spark):
    files = spark.createDataFrame([("app/lib/a.dart",), ("app/lib/src/b.dart",), ("app/lib/src/deep/c.dart",)], "path string")
    assert folders.shared_root(files).first()[0] == "app/lib"
    assert {(r["folder"], r["parent"], r["depth"]) for r in folders.hierarchy(files).collect()} == {("app", None, 1), ("app/lib", "app", 2), ("app/lib/src", "app/lib", 3), ("app/lib/src/deep", "app/lib/src", 4)}
    assert {r["path"]: r["group"] for r in folders.with_loose_files(files).collect()} == {"app/lib/a.dart": "app/lib/...", "app/lib/src/b.dart": "app/lib/src/...", "app/lib/src/deep/c.dart": "app/lib/src/deep"}
    edges = spark.createDataFrame([("l/a/x/1", "l/b/2"), ("l/a/y/3", "l/b/q/4"), ("l/a/x/1", "l/a/y/3"), ("l/a/x/1", "l/a/x/2")], "src string, dst string")
    assert {(r["src"], r["dst"]) for r in folders.sibling_edges(edges).collect()} == {("l/a", "l/b"), ("l/a/x", "l/a/y")}


def test_file_groups(spark):
    rows = [("f", "class", "A", None, 10), ("f", "method", "m", "A", 30), ("f", "function", "g", None, 5), ("h", "method", "x", "B", 4)]
    groups = folders.file_groups(spark.createDataFrame(rows, "path string, kind string, name string, owner string, loc long"))
    assert {(r["path"], r["owner"]): r["loc"] for r in groups.collect()} == {("f", "A"): 30, ("f", ""): 5, ("h", "B"): 4}
    sizes = folders.file_sizes(spark.createDataFrame([("f", 9), ("n", 7)], "path string, loc long"), groups)
    assert {r["path"]: r["loc"] for r in sizes.collect()} == {"f": 35, "n": 7}


def test_inventories(spark):
    source = "// ignore: tool_secrets\nconst a = 'x'; const b = \"x\"; const c = 0x10; const d = 2; const e = 2;\n"
    facts = tree.extract(spark.createDataFrame([("a.dart", source)], "path string, content string"))
    assert [(r["kind"], r["value"], r["n"]) for r in inventory.literals(facts).collect()] == [("number", "2", 2), ("number", "0x10", 1), ("string", "x", 2)]
    assert [(r["token"], r["total"]) for r in inventory.ignores(facts).collect()] == [("tool_secrets", 1)]
    keys = spark.createDataFrame([("title",), ("other",)], "key string")
    used, access = inventory.used_keys(spark.createDataFrame([("Text(context.l10n.title); l10n.unknown",)], "content string"), keys)
    assert [r["key"] for r in used.collect()] == ["title"] and access.first()[0]
    assert inventory.untranslated_by_design(spark.createDataFrame([("a", "Do not translate"), ("b", "Title"), ("c", "KEEP AS IS"), ("d", "reviewed"), ("e", "unreviewed")], "key string, description string")).count() == 3


def test_fixes(spark):
    source = "import 'b.dart';\nimport 'package:demo/a.dart';\nimport 'dart:io';\nimport 'package:a_b/z.dart';\nimport '../x.dart';\n\nclass A extends StatelessWidget {\n  void z() {}\n  // of a\n  void a() {}\n  void dispose() {}\n  void initState() {}\n  int get n => _n;\n  int n = 1;\n  int m = 1;\n  A();\n}\n"
    fixed = inventory.fixes(spark.createDataFrame([("lib/f.dart", source), ("g", "void main() {}\n")], "path string, content string"), "demo").collect()
    assert len(fixed) == 1
    want = "import 'dart:io';\n\nimport 'package:a_b/z.dart';\nimport 'package:demo/a.dart';\nimport 'package:demo/b.dart';\n\nimport '../x.dart';\n\nclass A extends StatelessWidget {\n  A();\n  int m = 1;\n  int n = 1;\n  int get n => _n;\n  void initState() {}\n  void dispose() {}\n  // of a\n  void a() {}\n  void z() {}\n}\n"
    assert fixed[0]["new_content"] == want
    assert inventory.sorted_members(inventory.sorted_imports(want, "demo", "lib/f.dart")) == want


def test_packages(spark):
    doc = '{"packages": [{"name": "a", "version": "1", "kind": "root", "dependencies": ["b", "c"]}, {"name": "b", "version": "2", "kind": "direct", "dependencies": ["d"]}, {"name": "c", "version": "3", "kind": "direct", "dependencies": []}, {"name": "d", "version": "4", "kind": "transitive"}]}'
    graph = inventory.package_graph(spark.createDataFrame([(doc,)], "content string"))
    deps = graph.where("needs is not null").select("package", "needs")
    assert {(r["level"], r["package"]) for r in packages.levels(deps, spark.createDataFrame([("b",), ("c",)], "package string")).collect()} == {(0, "b"), (0, "c"), (1, "d")}
    assert {r["package"]: r["used_by"] for r in packages.usage(deps).collect()} == {"b": 1, "c": 1, "d": 1}
    locked = spark.createDataFrame([("b", "2.1")], "package string, version string")
    derived = graph.select("package", "version").distinct().withColumn("ordinal", F.lit(0))
    names = spark.createDataFrame([("b",), ("d",), ("zz",)], "package string")
    assert {r["package"]: r["version"] for r in packages.versions(names, locked, derived).collect()} == {"b": "2.1", "d": "4", "zz": "unknown"}
    roots = inventory.package_roots(spark.createDataFrame([('{"packages": [{"name": "a", "rootUri": "file:///x/a"}]}',)], "content string"))
    assert tuple(roots.first()) == ("a", "/x/a")
    flags = inventory.platform_folders(spark.createDataFrame([("android", True), ("lib/web", True), ("ios", False)], "path string, is_dir boolean")).first()
    assert flags["android"] and not flags["web"] and not flags["ios"]


def test_drawings_and_colours(tmp_path, spark):
    from corvane.sources import reports

    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "package string, needs string")
    svg = reports.packages_svg(deps, spark.createDataFrame([("a",)], "package string"))
    assert svg.count("<rect") == 3 and svg.count("<path") == 2
    assert reports.colored("x", "good", {}) == "\x1b[36mx\x1b[0m" and reports.colored("x", "good", {"NO_COLOR": "1"}) == "x" and reports.colored("x", "?", {}) == "x"
    assert reports.output_path(None, "/a", "r.json") == "/a/r.json" and reports.output_path("/b/x.json", "/a", "r.json") == "/b/x.json"
    assert reports.output_path("out/", "/a", "r.json") == "/a/out/r.json" and reports.output_path(str(tmp_path), "/a", "r.json") == f"{tmp_path}/r.json"


def test_test_cases():
    from corvane.sources import dart

    source = "void main() { test('a', () {}); group('g', () { testWidgets('b', (t) async {}); x.test('no'); }); }\nvoid test(int a) {}\n"
    assert dart.facts("a_test.dart", source)["test_cases"] == 2
