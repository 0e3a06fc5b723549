"""Whole source trees, configuration, reports and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.plans.project import analyze
from corvane.sources import dart, reports, tree
from corvane.sources.config import Config, ConfigError, lock_versions, parse_config, parse_pubspec

SOURCE = """import 'dart:io';
import 'package:demo/src/a.dart' if (dart.library.io) 'b.dart';
/// Doc
class A<T> extends StatelessWidget {
  final int x = 3;
  A.named({required this.x}) : assert(x > 1);
  @override
  Widget build(BuildContext context) {
    var unused = 1;
    final used = 'a ${x + "q}".length} b';
    return Text(used);
  }
}
void main() { helper<int>(); /* c
 d */ }
T helper<T>() => throw 1;
"""


def test_facts():
    f = dart.facts("lib/x.dart", SOURCE)
    got = {a["name"]: a for a in f["artifacts"]}
    assert set(got) == {"A", "A.named", "build", "main", "helper"}
    assert (got["A"]["first"], got["A"]["last"], got["A"]["parent"], got["A"]["documented"]) == (4, 13, "StatelessWidget", True)
    assert got["build"]["is_override"] and got["build"]["owner"] == "A" and got["build"]["loc"] == 6
    assert [i["uri"] for i in f["imports"]] == ["dart:io", "package:demo/src/a.dart", "b.dart"]
    assert f["has_main"] and f["comment_lines"] == 3 and "A" not in f["used"] and "helper" in f["used"]
    assert dart.facts("x", "class A {")["broken"] and dart.facts("x", "var s = 'a")["broken"] and not dart.facts("x", "")["broken"]
    assert dart.comment_lines(dart.tokens("/* a\nb */ x // c\n// d")) == 3


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("demo")
    body = "\n".join(f"  total = total + step{i} * {i + 2};" for i in range(12))
    files = {
        "pubspec.yaml": "name: demo\nversion: 1.2.3\ndependencies:\n  http: any\n",
        "README.md": "hi",
        "lib/main.dart": "import 'package:demo/src/a.dart';\nvoid main() { used(); }\n",
        "lib/src/a.dart": "import '../src/b.dart';\n/// Doc\nvoid used() { helper(); }\nclass Dead {}\n",
        "lib/src/b.dart": "import 'a.dart';\nvoid helper() {}\n",
        "lib/src/c.dart": "void lonely() {}\n",
        "lib/src/_private.dart": "",
        "lib/src/d1.dart": f"int first(int a) {{\n  var total = 0;\n{body}\n  return total;\n}}\n",
        "lib/src/d2.dart": f"int second(int b) {{\n  var total = 0;\n{body}\n  return total;\n}}\n",
        "lib/l10n/app_en.arb": json.dumps({"@@locale": "en", "a": "A", "b": "B {x}", "@a": {"description": "d"}}),
        "lib/l10n/app_es.arb": json.dumps({"a": "Uno"}),
        ".hidden/x.dart": "x",
        "build/y.dart": "y",
        "misc_helper.dart": "void misc() {}\n",
        "test/a_test.dart": "import 'package:demo/src/a.dart';\nvoid main() { test('x', () {}); }\n",
    }
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_tree(spark, project):
    scanned = tree.classified(tree.read_tree(spark, str(project)), ["*misc*"])
    assert scanned.where("path = 'lib/src/_private.dart'").count() == 1
    c = tree.counters(scanned).first()
    assert (c["dart_files"], c["excluded_dart"], c["excluded_folders"], c["test_folders"], c["test_files"], c["test_dart_files"], c["custom_excluded_dart"]) == (7, 4, 3, 1, 1, 1, 1)
    assert (c["folders"], c["files"], c["excluded_files"]) == (3, 11, 4)
    assert {(r["path"], r["reason"]) for r in tree.excluded(scanned).where("kind = 'dart'").collect()} == {(".hidden/x.dart", "hidden"), ("build/y.dart", "default"), ("misc_helper.dart", "glob"), ("test/a_test.dart", "default")}


def test_analysis(spark, project):
    a = analyze(spark, str(project), Config(str(project), exclude=("*misc*",)))
    found = {(r["domain"], r["type"], r["path"], r["subject"]) for r in a.issues.collect()}
    assert ("dead_code", "dead_file", "lib/src/c.dart", "lib/src/c.dart") in found
    assert ("dead_code", "dead_class", "lib/src/a.dart", "Dead") in found
    assert not any(t == "dead_function" and s in ("main", "used", "helper") for _, t, _, s in found)
    assert ("layers", "cyclicDependency", "lib/src/a.dart", "lib/src/b.dart") in found and a.layers.count() == 0
    d = a.duplicates.collect()
    assert len(d) == 1 and d[0]["similarity"] == 1.0
    r = a.coverage.first()
    assert (r["locale"], r["total"], r["missing"], r["coverage"]) == ("es", 2, 1, 50.0)
    t = a.tests.first()
    assert (t["consumed"], t["classes"], t["functions"]) == (2, 1, 2)
    doc = json.loads(reports.as_json(a))
    assert 0 <= doc["result"]["score"] < 100 and len(doc["areas"]) == 11 and doc["project"]["version"] == "1.2.3"
    text = reports.text_report(a, 1)
    assert text[0] == "demo 1.2.3" and any("more" in x for x in text)
    assert reports.files_svg(a).startswith("<svg") and reports.treemap_svg(a).count("<rect") >= 5


WIDGET = """import 'dart:io';
@Deprecated('annotated words')
class Page extends StatelessWidget {
  static const String title = 'Const words';
  final int width = 42;
  final steps = 43;
  Widget build(BuildContext context) {
    print('Printed words');
    final m = {'Key words': 'Value words', 'b': 7};
    if (x == 'Compared words') throw StateError('Thrown words');
    final z = list['Index words'];
    foo( // ignore: tool_magic_numbers
      99,
      98);
    return Column(children: [Text('Hello World'), Text('Hi'), Padding(tooltip: 'Quiet words'), Icon('assets/a.png')]);
  }
  String toString() => 'String words';
}
class _Odd {
  void _long() {
    a();
    b();
    c();
    d();
    e();
    f();
    g();
    h();
  }
  // says why
  void _told() {
    a();
    b();
    c();
    d();
    e();
    f();
    g();
    h();
  }
  void open() {}
}
class Sorted extends StatelessWidget {
  int get b => _b;
  int b = 2;
  int a = 2;
  Sorted();
}
"""


def small_tree(tmp_path, files):
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


def test_contexts_of_literals(spark, tmp_path):
    root = small_tree(tmp_path, {"pubspec.yaml": "name: demo\ndependencies:\n  flutter:\n    sdk: flutter\n", "README.md": "x", "lib/page.dart": WIDGET})
    a = analyze(spark, root, Config(root))
    found = {(r["domain"], r["type"], r["line"], r["subject"]) for r in a.issues.collect()}
    assert {(line, s) for d, _, line, s in found if d == "hardcoded_strings"} == {(9, "Value words"), (15, "Hello World")}
    assert {(line, s) for d, _, line, s in found if d == "magic_numbers"} == {(6, "43"), (9, "7"), (45, "2"), (46, "2")}
    documented = {(t, s) for d, t, _, s in found if d == "documentation"}
    assert documented >= {("undocumented_class", "Page"), ("undocumented_complex_private_function", "_Odd._long"), ("undocumented_function", "_Odd.open")}
    assert not any(s == "_Odd._told" for _, s in documented)
    assert {s for d, _, _, s in found if d == "source_sorting"} >= {"Sorted"}
    printed = small_tree(tmp_path / "cli", {"pubspec.yaml": "name: demo\n", "README.md": "x", "bin/a.dart": "void main() { print('Printed words'); log('Logged words'); }\n"})
    told = analyze(spark, printed, Config(printed)).issues.where("domain = 'hardcoded_strings'").collect()
    assert [r["subject"] for r in told] == ["Printed words"]


def test_translations(spark, tmp_path):
    en = """{
  "@@locale": "en",
  "hello": "Hello {name}",
  "@hello": {"description": "greeting"},
  "brand": "Brand",
  "@brand": {"description": "Keep as is, please"},
  "count": "{n, plural, one{# item} other{# items}}",
  "title": "Title",
  "idle": "Idle",
  "title": "Title"
}"""
    es = """{
  "hello": "Hola {nombre}",
  "title": "Title",
  "idle": "",
  "idle": " "
}"""
    files = {
        "pubspec.yaml": "name: demo\n", "l10n.yaml": "arb-dir: lib/texts\n", "README.md": "x", "lib/texts/app_en.arb": en, "lib/texts/app_es.arb": es, "lib/texts/app_pt-BR.arb": "not json", "other/app_fr.arb": "{}",
        "lib/a.dart": "void f(c) { final t = c.l10n; print(t.hello + t.count); show(AppLocalizations.of(c).title); }\n",
    }
    root = small_tree(tmp_path, files)
    a = analyze(spark, root, Config(root))
    got = [tuple(r) for r in a.translations.collect()]
    assert got == [
        ("en", "lib/texts/app_en.arb", 9, "idle", "unused_key"),
        ("en", "lib/texts/app_en.arb", 10, "title", "duplicate_key"),
        ("es", "lib/texts/app_en.arb", 7, "count", "missing"),
        ("es", "lib/texts/app_es.arb", 2, "hello", "placeholder_mismatch"),
        ("es", "lib/texts/app_es.arb", 3, "title", "unchanged"),
        ("es", "lib/texts/app_es.arb", 5, "idle", "duplicate_key"),
    ]
    assert [tuple(r) for r in a.coverage.collect()] == [("es", 4, 3, 4, 25.0)]
    issues = {(r["path"], r["subject"]) for r in a.issues.where("domain = 'localization'").collect()}
    assert issues == {("en", "1 duplicate_key, 1 unused_key"), ("es", "1 missing, 1 unchanged, 1 placeholder_mismatch and 1 more")}


def test_fix_writes_sorted_files(spark, tmp_path):
    from corvane.__main__ import fix

    source = "import 'package:demo/b.dart';\nimport 'dart:io';\n\nclass A extends StatelessWidget {\n  void z() {}\n  void a() {}\n}\n"
    root = small_tree(tmp_path, {"pubspec.yaml": "name: demo\n", "lib/a.dart": source, "lib/b.dart": "void b() {}\n", "lib/l10n/app_en.arb": '{"b": "1", "A": "2", "@@locale": "en"}', "lib/l10n/app_es.arb": "broken"})
    assert fix(spark, Config(root)) == 2
    assert (tmp_path / "lib/a.dart").read_text() == "import 'dart:io';\n\nimport 'package:demo/b.dart';\n\nclass A extends StatelessWidget {\n  void a() {}\n  void z() {}\n}\n"
    assert list(json.loads((tmp_path / "lib/l10n/app_en.arb").read_text())) == ["@@locale", "A", "b"]
    assert (tmp_path / "lib/l10n/app_es.arb").read_text() == "broken" and fix(spark, Config(root)) == 0


def test_sorted_arb_and_exit():
    out = list(json.loads(reports.sorted_arb('{"b": "1", "@b": {}, "@@locale": "en", "a": "2", "@z": {}}')))
    assert out == ["@@locale", "a", "b", "@b", "@z"]
    assert reports.exit_code(97, True) == 3 and reports.exit_code(97, False) == 0


@pytest.mark.parametrize(
    ("data", "where"),
    [({"inputs": {}}, "inputs"), ({"input": {"exclude": [1]}}, "input.exclude[0]"), ({"analyzers": {"default": "some"}}, "analyzers.default"), ({"analyzers": {"disabled": ["nope"]}}, "analyzers.disabled[0]"), ({"analyzers": {"options": {"code_size": {"file": 0}}}}, "analyzers.options.code_size.file"), ({"analyzers": {"options": {"duplicate_code": {"similarity": 2}}}}, "analyzers.options.duplicate_code.similarity")],
)
def test_wrong_configuration_names_its_field(data, where):
    with pytest.raises(ConfigError, match=where.replace("[", r"\[").replace("]", r"\]")):
        parse_config(data)


def test_configuration():
    c = parse_config({"input": {"root": "app", "exclude": ["*a*", "*a*"]}, "analyzers": {"default": "none", "enabled": ["Magic-Numbers", "localization"]}}, "/p")
    assert (c.root, c.exclude, c.enabled) == ("/p/app", ("*a*",), {"magic_numbers", "localization"})
    assert parse_pubspec("name: x\ndependencies: {flutter: {sdk: flutter}}").kind == "flutter" and parse_pubspec(": :").name == "unknown"
    assert lock_versions("packages:\n  b: {version: '2'}\n  a: {version: '1'}") == [("a", "1"), ("b", "2")]


def test_stream_equals_batch(spark, tmp_path):
    from corvane.streaming import changed_sources, issue_rates

    rows = [("a", "x me@example.com\nsk_live_abcdefghijklmnop12"), ("b", "nothing")]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("ts", F.lit("2024-01-01 00:03:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    query = issue_rates(changed_sources(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["type"], r["n"]) for r in spark.table("rates").collect()} == {(r["type"], r["n"]) for r in issue_rates(df).collect()} == {("email_pii", 1), ("stripe_key", 1)}
