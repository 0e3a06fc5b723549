"""Intervals, scopes, warnings by artifact, folder order, packages and the listing of trees against brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import folders, intervals, overlay, packages, syntax
from corvane.sources import tree


@pytest.mark.parametrize("seed", range(2))
def test_stabbing_equals_brute_force(spark, seed):
    r = random.Random(seed)
    top = (60, 3_000_000)[seed]
    spans = [(r.choice("pq"), a := r.randrange(top), a + int(r.random() ** 6 * top), f"s{k}") for k in range(120)] + [("p", 7, 6, "none"), ("p", 0, 0, "first")]
    points = [(r.choice("pq"), r.randrange(top), k) for k in range(300)] + [("p", None, 900), ("z", 5, 901)]
    p = spark.createDataFrame(points, "path string, line long, id int")
    s = spark.createDataFrame(spans, "path string, first long, last long, name string")
    want = sorted((i, n) for path, at, i in points for q, a, b, n in spans if at is not None and q == path and a <= at <= b)
    assert sorted((x["id"], x["name"]) for x in intervals.stabbed(p, s, ["path"]).collect()) == want
    held = {i for i, _ in want}
    assert sorted(x["id"] for x in intervals.outside(p, s, ["path"]).collect()) == sorted(i for *_, i in points if i not in held)
    span = {n: (a, -b) for _, a, b, n in spans}
    inner = {x["id"]: (x["first"], -x["last"]) for x in intervals.innermost(p, s, ["path"], ["id"]).collect()}
    assert inner == {i: max(span[n] for j, n in want if j == i) for i in held}


DART = r"""
import 'a.dart';
/* multi
 line ' */
class A extends B {
  final int field = 1; // 'x
  int other;
  void m(int used, String idle, {int? opt, required int more}) {
    var a = 1;
    final b = '$a and ${more + used.c}';
    int c = 2;
    for (var i = 0; i < 3; i++) { var a = 5; print(i); }
    for (final item in list) {}
    try { f(); } catch (e, st) { print(st); }
    final map = {a: 1, 'k': c};
    list.forEach((x) { var inner = x; });
    call(label: 1, b: 2);
    Map<String, int> typed = {};
    if (a > c) return;
    var hidden = '\'${"nested $c"}';
    _ = 3;
  }
  @override
  void n(int ignored) { }
  int arrow(int y) => y;
  void empty(int z);
}
void main() { const top = 5; var shadow = 1; { var shadow = 2; use(shadow); } }
Future<void> later(int wait) async { later; }
"""


def test_unused_variables(spark):
    rows = [("a.dart", DART), ("b.dart", "void f(int x) { g(x); }"), ("c.dart", None), ("d.dart", ""), ("e.dart", "}) broken ( {"), ("f.dart", "void f() { var s = 'x'; " + "/* long */ '${s}' + \"it's\"; " * 4000 + "}")]
    got = sorted((r["path"], r["line"], r["name"]) for r in syntax.unused_variables(spark.createDataFrame(rows, "path string, content string")).collect())
    names = [(8, "idle"), (8, "opt"), (10, "b"), (12, "a"), (13, "item"), (14, "e"), (15, "map"), (16, "inner"), (18, "typed"), (20, "hidden"), (28, "shadow"), (28, "top"), (29, "wait")]
    assert got == [("a.dart", line, name) for line, name in names]


def test_brackets_are_matched_by_depth(spark):
    code = syntax.with_neighbours(syntax.tokens(spark.createDataFrame([("a", "f(a[1], {b: (c)}) {\n d();\n}\n ) {")], "path string, content string")))
    pairs = sorted((r["open"], r["close"], r["mark"], r["line"], r["last"]) for r in syntax.brackets(code).collect())
    assert pairs == [(1, 14, "(", 1, 1), (3, 5, "[", 1, 1), (7, 13, "{", 1, 1), (10, 12, "(", 1, 1), (15, 20, "{", 1, 3), (17, 18, "(", 2, 2)]


def test_warnings_of_a_hot_path(spark):
    artifacts = [("p", "file", "p", "p", None, 1, None, -1), ("p", "class", "c", "C", None, 1, 50_000, 0), ("p", "method", "m", "run", "C", 10, 20, 1), ("p", "function", "f", "run", None, 15, 90_000, 2)]
    issues = [(f"l{k}", "p", "Magic Numbers", "line", k, None, None, False) for k in range(-1, 60_000)]
    issues += [("d1", "p", "Dead Code", "dead_function", None, "run", None, True), ("d2", "p", "Dead Code", "dead_function", None, "run", "X", True), ("o", "other", "Secrets", "line", 3, None, None, False)]
    a = spark.createDataFrame(artifacts, "path string, kind string, id string, name string, owner string, first int, last int, ordinal int")
    i = spark.createDataFrame(issues, "issue_id string, path string, type string, scope string, line int, name string, owner string, hard boolean")
    got = {(r["level"], r["key"]): (r["warnings"], r["dead"], r["hard"], r["types"]) for r in overlay.warning_index(i, a).collect()}
    assert got[("file", "p")] == (60_003, False, True, {"Magic Numbers": 60_001, "Dead Code": 2})
    assert got[("callable", "m")] == (12, True, True, {"Magic Numbers": 11, "Dead Code": 1})
    assert got[("callable", "f")] == (59_979, False, False, {"Magic Numbers": 59_979})

    assert got[("class", "C")][3]["Magic Numbers"] == 9 + 11 and got[("class", "X")] == (1, False, True, {"Dead Code": 1})
    assert got[("class", "C")][3]["Dead Code"] == 1 and len(got) == 5


def test_folders_in_depth_first_order(spark):
    names = ["b/z/q", "a", "a-b/x", "a/x/y", "a/x", "a/b", "b", "b/z", "a-b", "c"]
    got = {r["folder"]: tuple(r)[1:] for r in folders.depth_first(spark.createDataFrame([(n,) for n in names], "folder string")).collect()}
    order, left = [], []

    def walk(at, depth):
        below = sorted((n for n in names if n.count("/") == depth and (not at or n.startswith(at + "/"))), key=lambda n: n.split("/"))
        for n in below:
            order.append(n)
            walk(n, depth + 1)
            left.append(n)

    walk("", 0)
    size = lambda n: sum(m == n or m.startswith(n + "/") for m in names)
    assert got == {n: (n.count("/") + 1, order.index(n) + 1, left.index(n) + 1, size(n)) for n in names}


def test_nearest_package(spark):
    files = [("lib/a.dart",), ("packages/one/lib/b.dart",), ("packages/one/deep/lib/c.dart",), ("d.dart",)]
    f = spark.createDataFrame(files, "path string")
    m = lambda *names: spark.createDataFrame([(n,) for n in names], "folder string")
    got = {r["path"]: r["manifest"] for r in packages.nearest(f, m("packages/one", "packages/one/deep", "lib/none")).collect()}
    assert got == {"lib/a.dart": None, "packages/one/lib/b.dart": "packages/one", "packages/one/deep/lib/c.dart": "packages/one/deep", "d.dart": None}
    assert packages.sole(packages.nearest(f, m("", "packages/one"))).first()[0] is None
    assert packages.sole(packages.nearest(f, m(""))).first()[0] == ""
    assert packages.sole(packages.nearest(f.where("path like 'packages%'"), m("packages"))).first()[0] == "packages"
    assert packages.sole(packages.nearest(f.limit(0), m(""))).first()[0] is None


def test_packages_of_a_monorepo(spark):
    facts = spark.createDataFrame([("lib/a.dart", [("import", "package:one/x.dart"), ("import", "package:two/y.dart"), ("import", "package:root/z.dart"), ("import", "package:none/q.dart"), ("import", "../b.dart")])], "path string, imports array<struct<kind: string, uri: string>>")
    specs = [("packages/one/pubspec.yaml", "name: one\nversion: 1\n"), ("pubspec.yaml", "name: root\n"), ("deep/two/pubspec.yaml", "# two\nname: 'two'\n"), ("odd/pubspec.yaml", None)]
    found = tree.packages(spark.createDataFrame([*specs, ("lib/a.dart", "")], "path string, content string"))
    assert {(r["folder"], r["name"]) for r in found.collect()} == {("packages/one", "one"), ("", "root"), ("deep/two", "two"), ("odd", None)}
    assert sorted(r["dst"] for r in tree.import_edges(facts, "root", others=found).collect()) == ["b.dart", "deep/two/lib/y.dart", "lib/z.dart", "packages/one/lib/x.dart"]


def test_listing_of_many_files(spark, tmp_path):
    for a in range(100):
        os.makedirs(folder := f"{tmp_path}/f{a % 10}/g{a}")
        for k in range(1000):
            os.close(os.open(f"{folder}/{k}.dart", os.O_CREAT))
    os.symlink(f"{tmp_path}/f1", f"{tmp_path}/link")
    os.symlink(f"{tmp_path}/nowhere", f"{tmp_path}/f2/dangling")
    found = tree.list_tree(spark, str(tmp_path))
    assert found.where("not is_dir").count() == 100_001 and found.where("is_dir").count() == 111
    assert tree.list_tree(spark, str(tmp_path), F.col("path") == "f1").count() == 100_112 - 10_010
