"""A source tree as a table: folders are listed on the executors, level by level, and files are read there.

Spark's own file sources drop names that start with _ or ., and empty files; here all are rows. The folder must be one that
every executor reaches by the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import globs
from .store import materialize

#: Files whose content is read.
TEXTS = (".dart", ".arb", ".yaml", ".json", ".lock")
#: Rows and bytes of contents that are handed on at once.
ROWS, BYTES = 2000, 1 << 22


def listed(folders: DataFrame, root: str) -> DataFrame:
    """folders: path, relative to root -> (path, is_dir, size, enter) of what stands in each; links to folders aren't entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, bool, int, bool]] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(os.path.join(root, folder)) as entries:
                    for e in entries:
                        is_dir = e.is_dir()
                        size = 0 if is_dir or not os.path.exists(e.path) else e.stat().st_size
                        found.append((f"{folder}/{e.name}" if folder else e.name, is_dir, size, is_dir and not e.is_symlink()))
                        if len(found) >= ROWS:
                            yield told(found)
                            found = []
        yield told(found)

    def told(found: list[tuple[str, bool, int, bool]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["path", "is_dir", "size", "enter"])

    return folders.select("path").mapInArrow(run, "path string, is_dir boolean, size long, enter boolean")


def read_contents(files: DataFrame, root: str, texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """files: path, is_dir, size -> also content, of files with these endings; null where it can't be read as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, size = 0, [], 0
            for k, (path, is_dir) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                content = None
                if not is_dir and path.endswith(texts):
                    try:
                        with open(os.path.join(root, path), encoding="utf-8") as f:
                            content = f.read()
                    except (OSError, UnicodeDecodeError):
                        content = None
                held.append(content)
                size += len(content or "")
                if size >= BYTES:
                    yield told(batch.slice(low, len(held)), held)
                    low, held, size = k + 1, [], 0
            if held:
                yield told(batch.slice(low, len(held)), held)

    def told(rows: pa.RecordBatch, held: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.string())], names=[*rows.schema.names, "content"])

    return files.select("path", "is_dir", "size").mapInArrow(run, "path string, is_dir boolean, size long, content string")


def list_tree(spark: SparkSession, root: str, skip: Column | None = None) -> DataFrame:
    """(path, is_dir, size) of all below root. A level's folders are dealt out and listed in tasks, and written; no name comes to the driver.

    skip: a condition on path; a folder that meets it is a row itself, but what it holds is never listed.
    """
    level, parts = spark.range(1).select(F.lit("").alias("path")), []
    while True:
        parts.append(materialize(listed(level, root), "tree-level"))
        level = parts[-1].where("enter" if skip is None else F.col("enter") & ~F.coalesce(skip, F.lit(False))).select("path")
        many = level.count()
        if not many:
            break
        level = level.repartition(min(many, 4 * spark.sparkContext.defaultParallelism), "path")
        if len(parts) > 16:
            parts = [materialize(_union(parts), "tree-levels")]
    return _union(parts).select("path", "is_dir", "size")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_tree(spark: SparkSession, root: str, skip: Column | None = None) -> DataFrame:
    """(path, is_dir, size, content) of all below root, paths relative to it; see list_tree and read_contents."""
    root = os.path.abspath(root)
    whole = list_tree(spark, root, skip)
    return read_contents(whole.repartition(4 * spark.sparkContext.defaultParallelism, "path"), root)


def classified(tree: DataFrame, exclude: list[str]) -> DataFrame:
    """Adds is_dart, reason (hidden, default, glob, generated or null), is_test and is_test_root.

    Globs exclude files alone; sources of single locales are generated. Tests lie in default folders, so they have a reason.
    """
    p, file = F.col("path"), ~F.col("is_dir")
    is_dart = file & p.endswith(".dart")
    reason = F.when(globs.hidden(p), "hidden").when(globs.default_excluded(p), "default").when(file & globs.excluded_by(p, exclude), "glob").when(is_dart & globs.is_locale_source(p), "generated")
    return tree.withColumns({"is_dart": is_dart, "reason": reason, "is_test": globs.is_test(p), "is_test_root": F.col("is_dir") & F.substring_index(p, "/", -1).isin("test", "integration_test")})


def tests_of(scanned: DataFrame) -> DataFrame:
    """Dart files below a test folder that isn't hidden."""
    return scanned.where("is_test and is_dart and reason <> 'hidden'")


def counters(scanned: DataFrame) -> DataFrame:
    """All counters of a scan in one row. Hidden paths count as excluded alone; tests count as such and, by their folder, as excluded."""
    seen = ~F.col("reason").eqNullSafe(F.lit("hidden"))
    file, folder, dart, out = ~F.col("is_dir"), F.col("is_dir"), F.col("is_dart"), F.coalesce(F.col("reason") != "generated", F.lit(False))
    left, test = ~out, seen & F.col("is_test")
    return scanned.agg(
        F.count_if(F.col("reason").isNull() & dart).alias("dart_files"), F.count_if(left & folder).alias("folders"), F.count_if(left & file).alias("files"),
        F.count_if(F.col("reason").isNotNull() & dart).alias("excluded_dart"), F.count_if(out & folder).alias("excluded_folders"), F.count_if(out & file).alias("excluded_files"),
        F.count_if(test & F.col("is_test_root")).alias("test_folders"), F.count_if(test & file).alias("test_files"), F.count_if(test & dart).alias("test_dart_files"),
        F.count_if(dart & (F.col("reason") == "glob")).alias("custom_excluded_dart"),
    )


def excluded(scanned: DataFrame) -> DataFrame:
    kind = F.when(F.col("is_dir"), "folder").when(F.col("is_dart"), "dart").otherwise("other")
    return scanned.where("reason is not null").select("path", kind.alias("kind"), "reason")


FACTS = """path string, loc long, comment_lines long, broken boolean, has_main boolean,
artifacts array<struct<ordinal: int, kind: string, name: string, owner: string, parent: string, first: int, last: int, loc: long, is_override: boolean, is_preview: boolean, is_abstract: boolean, is_public: boolean, documented: boolean, is_complex: boolean, commented: boolean, signature: string, tokens: array<string>>>,
strings array<struct<line: int, value: string, bare: string, exempt: string, printed: boolean, logged: boolean, output: boolean, property: string>>, numbers array<struct<line: int, value: string, is_const: boolean>>, imports array<struct<kind: string, uri: string>>,
used array<string>, directives array<struct<line: int, last: int, token: string, leading: boolean>>,
members array<struct<ordinal: int, kind: string, name: string, owner: string>>,
listed array<struct<line: int, token: string>>, widget_texts array<struct<line: int, value: string>>, excused array<int>, test_cases int"""


def extract(sources: DataFrame) -> DataFrame:
    """sources: path, content -> facts of each file, parsed once for all analyses."""
    import pandas as pd

    from .dart import facts

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([facts(p, c or "") for p, c in zip(batch["path"], batch["content"], strict=True)], columns=[c.strip().split()[0] for c in ("path", "loc", "comment_lines", "broken", "has_main", "artifacts", "strings", "numbers", "imports", "used", "directives", "members", "listed", "widget_texts", "excused", "test_cases")])

    return sources.select("path", "content").mapInPandas(run, FACTS)


def resolve_uri(uri: Column, path: Column, package: Column, lib: Column | None = None) -> Column:
    """Path of an import in this tree: addresses of ``package``, whose sources are in the folder ``lib``, relative ones with .. and plain ones; null for others."""
    inside = F.coalesce(uri.startswith(F.concat(F.lit("package:"), package, F.lit("/"))), F.lit(False))
    own = F.concat(F.lit("lib") if lib is None else lib, F.lit("/"), F.regexp_replace(uri, "^[^/]*/", ""))
    folder = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")
    joined = F.split(F.concat_ws("/", F.when(folder != "", folder), uri), "/")
    fold = F.aggregate(joined, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.when(inside, own).when(uri.rlike("^[a-z]+:"), F.lit(None)).when(uri.endswith(".dart"), F.array_join(fold, "/"))


def packages(tree: DataFrame) -> DataFrame:
    """(folder, name) of every package in the tree: folders with a pubspec, the tree's own is ''; its name is null if it has none."""
    specs = tree.where((F.col("path") == "pubspec.yaml") | F.col("path").endswith("/pubspec.yaml"))
    name = F.regexp_extract(F.coalesce("content", F.lit("")), r"(?m)^name:\s*[\"']?([A-Za-z0-9_]+)", 1)
    return specs.select(F.regexp_replace("path", "/?pubspec[.]yaml$", "").alias("folder"), F.nullif(name, F.lit("")).alias("name"))


def import_edges(fact: DataFrame, package: str, kinds: tuple[str, ...] = ("import", "export", "part"), others: DataFrame | None = None) -> DataFrame:
    """(src, dst) of imports within the tree, one for each directive. package: the tree's own; others: further packages in it (folder, name).

    Of packages that share a name the one of the least folder counts.
    """
    i = fact.select("path", F.explode("imports").alias("i")).where(F.col("i.kind").isin(*kinds)).select("path", F.col("i.uri").alias("uri"))
    if others is None:
        return i.select(F.col("path").alias("src"), resolve_uri(F.col("uri"), F.col("path"), F.lit(package)).alias("dst")).where("dst is not null")
    named = others.where(F.col("name").isNotNull() & (F.col("name") != package)).groupBy("name").agg(F.min("folder").alias("folder"))
    whole = named.unionByName(fact.sparkSession.range(1).select(F.lit(package).alias("name"), F.lit("").alias("folder")))
    whole = materialize(whole.select("name", F.when(F.col("folder") == "", F.lit("lib")).otherwise(F.concat("folder", F.lit("/lib"))).alias("lib")), "packages")
    wanted = i.withColumn("name", F.nullif(F.regexp_extract("uri", "^package:([^/]+)/", 1), F.lit("")))
    whole = F.broadcast(whole) if whole.count() <= PACKAGES else whole
    return wanted.join(whole, "name", "left").select(F.col("path").alias("src"), resolve_uri(F.col("uri"), F.col("path"), F.col("name"), F.col("lib")).alias("dst")).where("dst is not null")


#: Packages of a tree that may be broadcast.
PACKAGES = 100_000
