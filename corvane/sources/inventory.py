"""Inventories of a tree: literals, directives, exclusions; and fixes, as new contents that a caller may write."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import number_value, without_quotes
from corvane.operators.lanes import ranked_lanes
from corvane.operators.sorting import LIFECYCLE

from . import dart


def literals(facts: DataFrame) -> DataFrame:
    """(kind, value, n): strings by count and value; numbers by count, value as a number, and text."""
    s = facts.select(F.explode("strings").alias("s")).select(F.lit("string").alias("kind"), without_quotes(F.col("s.value")).alias("value"))
    n = facts.select(F.explode("numbers").alias("n")).select(F.lit("number").alias("kind"), F.col("n.value").alias("value"))
    counted = s.unionByName(n).groupBy("kind", "value").agg(F.count("*").alias("n"))
    return counted.orderBy("kind", F.desc("n"), F.asc_nulls_last(F.when(F.col("kind") == "number", number_value(F.col("value")))), "value")


def ignores(facts: DataFrame) -> DataFrame:
    """(token, total, place, path, line): every directive, with the number of those of its token and its place among them, from 1, by path and line.

    Places are numbered by ranges, so a token that stands everywhere is in many tasks, and no list of it is made.
    """
    d = facts.select("path", F.explode("listed").alias("d")).select("path", "d.line", "d.token")
    placed = ranked_lanes(d, ["token"], [F.col("path"), F.col("line")]).select("token", (F.col("lane") + 1).cast("long").alias("place"), "path", "line")
    return placed.join(d.groupBy("token").agg(F.count("*").alias("total")), "token").select("token", "total", "place", "path", "line").orderBy("token", "place")


def used_keys(sources: DataFrame, keys: DataFrame, accessors: tuple[str, ...] = ("AppLocalizations.of(context)", "context.l10n", "l10n", "loc", "S.of(context)")) -> tuple[DataFrame, DataFrame]:
    """(used keys, one row: has_access): members that a source reads off an accessor; any such read means access, also of unknown keys."""
    pattern = r"(?:" + "|".join(re.escape(a) for a in accessors) + r")[!?]?\s*\.\s*([A-Za-z_]\w*)"
    read = sources.select(F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("key")).distinct()
    return read.join(keys.select("key").distinct(), "key", "left_semi"), read.agg((F.count("*") > 0).alias("has_access"))


def directive_counts(facts: DataFrame) -> DataFrame:
    """(path, n) of files with directives in comments, keyed by paths without a leading ./, in order of paths."""
    path = F.regexp_replace("path", r"^(\./)+", "")
    return facts.groupBy(path.alias("path")).agg(F.sum(F.size("directives")).alias("n")).where("n > 0").orderBy("path")


def display_width(rows: DataFrame, column: str, least: int = 0) -> DataFrame:
    """One row: the width that a column of a listing needs."""
    return rows.agg(F.greatest(F.coalesce(F.max(F.length(column)), F.lit(0)), F.lit(least)).cast("long").alias("width"))


#: Fixed value: descriptions that say that a key isn't to be translated.
DO_NOT_TRANSLATE = r"(?i)\bdo\s*not\s*translate\b|\bdo\s*not\s*localize\b|\bdo\s*not\s*localise\b|\bkeep\s*as\s*is\b|\bleave\s*unchanged\b|\bignore\b|\breviewed\b"


def untranslated_by_design(descriptions: DataFrame) -> DataFrame:
    """descriptions: key, description. Keys whose description says that they aren't to be translated."""
    return descriptions.where(F.col("description").rlike(DO_NOT_TRANSLATE)).select("key")


def import_key(uri: str) -> tuple:
    """As sorting.import_rank: group, what stands before the first slash, what follows."""
    group = 0 if uri.startswith("dart:") else 1 if uri.startswith("package:") else 2 if ":" in uri else 3
    package, _, rest = uri.partition("/")
    return group, package, rest


def package_uri(uri: str, path: str, package: str) -> str:
    """A relative address that leads into this package's lib folder, as a package address; others as they are."""
    if ":" in uri or not uri or not package:
        return uri
    target = posixpath.normpath(posixpath.join(posixpath.dirname(path), uri))
    return f"package:{package}/{target[4:]}" if target.startswith("lib/") else uri


def sorted_imports(source: str, package: str, path: str = "") -> str:
    """Import lines in groups (the language's, packages, other absolute, relative), a blank line between groups; relative addresses into lib become package ones.

    A section that holds anything but imports of one line each stays as it is.
    """
    lines = source.split("\n")
    at = [k for k, x in enumerate(lines) if re.match(r"\s*import\s+['\"]", x) and x.rstrip().endswith(";")]
    if len(at) < 2 or any(x.strip() and not re.match(r"\s*import\s", x) for x in lines[at[0] : at[-1] + 1]):
        return source
    made = []
    for k in at:
        uri = re.search(r"['\"]([^'\"]+)", lines[k])[1]
        new = package_uri(uri, path, package)
        made.append((import_key(new), lines[k].strip().replace(uri, new, 1)))
    found: list[str] = []
    last = None
    for key, x in sorted(made, key=lambda m: m[0]):
        if last is not None and key[0] != last:
            found.append("")
        found.append(x)
        last = key[0]
    return "\n".join([*lines[: at[0]], *found, *lines[at[-1] + 1 :]])


def sorted_members(source: str) -> str:
    """Members of widget classes in order: others, fields with their accessors, life cycle, public, private. Each member moves with the lines above it that belong to it."""
    try:
        every = dart.tokens(source)
        declared = dart.declarations(every)
    except dart.Broken:
        return source
    lines = source.split("\n")
    for c in reversed([d for d in declared if d.kind == "class" and d.parent in ("StatelessWidget", "StatefulWidget", "State")]):
        own = [d for d in declared if d.owner == c.name and d.first > c.first and d.last < c.last]
        if len({d.first for d in own}) != len(own) or len(own) < 2:
            continue
        starts, chunks = c.first, []
        for d in own:  # comments and blank lines above a member are its own
            chunks.append((d, lines[starts : d.last]))
            starts = d.last
        fields = {d.name for d in own if d.kind == "field"}

        def rank(item: tuple, fields: set[str] = fields) -> tuple:
            d = item[0]
            kind, name = dart.member_kind(d), d.name.split(".")[-1]
            if kind == "other":
                return 0, 0, "", 0
            if kind == "field" or (kind == "accessor" and name in fields):
                return 1, 0, name, int(kind == "accessor")
            if name in LIFECYCLE:
                return 2, LIFECYCLE.index(name), "", 0
            return (4 if name.startswith("_") else 3), 0, name, 0

        body = [x for _, chunk in sorted(chunks, key=rank) for x in chunk]
        lines[c.first : starts] = body
    return "\n".join(lines)


def fixes(sources: DataFrame, package: str) -> DataFrame:
    """(path, new_content) of files that sorting changes; writing them is up to the caller."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            made = [sorted_members(sorted_imports(c or "", package, p)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            out = pd.DataFrame({"path": batch["path"], "new_content": made})
            yield out[[a != (b or "") for a, b in zip(made, batch["content"], strict=True)]]

    return sources.select("path", "content").mapInPandas(run, "path string, new_content string")


def fixed_translations(arb: DataFrame) -> DataFrame:
    """arb: path, content -> (path, new_content) of translation files that sorting changes; those that hold no JSON object stay."""
    import pandas as pd

    from .reports import sorted_arb

    def made(content: str) -> str:
        try:
            return sorted_arb(content) if isinstance(json.loads(content), dict) else content
        except ValueError:
            return content

    def run(batches):
        for batch in batches:
            new = [made(c) for c in batch["content"]]
            out = pd.DataFrame({"path": batch["path"], "new_content": new})
            yield out[[a != b for a, b in zip(new, batch["content"], strict=True)]]

    return arb.select("path", "content").mapInPandas(run, "path string, new_content string")


def package_graph(pub_deps: DataFrame) -> DataFrame:
    """pub_deps: one JSON document in content, as `pub deps --json` gives it -> (package, version, kind, needs)."""
    shape = "struct<packages: array<struct<name: string, version: string, kind: string, dependencies: array<string>>>>"
    p = pub_deps.select(F.explode(F.from_json("content", shape).getField("packages")).alias("p"))
    return p.select(F.col("p.name").alias("package"), "p.version", "p.kind", F.explode_outer("p.dependencies").alias("needs"))


def package_roots(package_config: DataFrame) -> DataFrame:
    """package_config: one JSON document in content -> (package, root)."""
    shape = "struct<packages: array<struct<name: string, rootUri: string>>>"
    p = package_config.select(F.explode(F.from_json("content", shape).getField("packages")).alias("p"))
    return p.select(F.col("p.name").alias("package"), F.regexp_replace("p.rootUri", "^file://", "").alias("root"))


def platform_folders(tree: DataFrame) -> DataFrame:
    """One row of six flags: which platform folders lie at the top of a tree."""
    return tree.agg(*[F.coalesce(F.bool_or(F.col("is_dir") & (F.col("path") == p)), F.lit(False)).alias(p) for p in ("android", "ios", "web", "windows", "macos", "linux")])
