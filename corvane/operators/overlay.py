"""Issues over artifacts: interval joins, suffix matches, severities, warnings by file, class and callable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.intervals import stabbed


def enclosing(issues: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The artifact that holds each issue (path, line): the first callable in artifact order, else the first class.

    issues: issue_id, path, line; artifacts: path, kind, name, first, last, ordinal. A hot path is spread over blocks of lines.
    """
    hit = stabbed(issues.select("issue_id", "path", "line"), artifacts.select("path", "kind", "name", "first", "last", "ordinal"), ["path"])
    rank = F.struct(F.when(F.col("kind") == "class", 1).otherwise(0), "ordinal")
    first = hit.groupBy("issue_id").agg(F.min_by(F.struct("path", "line", "kind", "name"), rank).alias("f"))
    return first.select("issue_id", "f.*")


def warning_index(issues: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(level, path, key, warnings, dead, hard, types): warnings of every file, class and callable that has any.

    issues: issue_id, path, type, scope, line, name, owner, hard. scope: line (at a line), file, dead_file, dead_class (name) or
    dead_function (name, and its owner if it's known). artifacts: path, kind (file, class, else a callable), id, name, owner,
    first, last, ordinal. Issues of files that aren't among the artifacts are left out.

    A line's issue counts for its file, for the first callable in artifact order that holds the line and for that callable's
    class; if no callable holds it, for the first class that does. A dead function counts for its file, for the first callable of
    its name, of its owner where one is given, and for that callable's class; if there's none, for its owner. What is dead itself has
    dead set; all dead code is hard. Classes are known by path and name, callables by id; types is a map from type to number.
    """
    files = artifacts.where("kind = 'file'").select("path").distinct()
    known = issues.join(files, "path", "left_semi").withColumn("hard", F.coalesce("hard", F.lit(False)) | F.col("scope").startswith("dead_"))
    inner = artifacts.where("kind <> 'file'").select("path", F.when(F.col("kind") == "class", "class").otherwise("callable").alias("level"), "id", F.col("name").alias("found"), F.col("owner").alias("of"), "first", "last", "ordinal")
    entry = lambda rows, level, key, dead: rows.select(F.lit(level).alias("level"), "path", key.alias("key"), "type", dead.alias("dead"), "hard")
    no, yes = F.lit(False), F.lit(True)
    best = F.struct("id", "found", "of")

    lines = known.where("scope = 'line'").select("issue_id", "path", "type", "hard", "line")
    hit = stabbed(lines.where("line > 0"), inner, ["path"])
    at = hit.groupBy("issue_id", "path", "type", "hard").agg(F.min_by(best, F.when(F.col("level") == "callable", F.col("ordinal"))).alias("call"), F.min_by(best, F.when(F.col("level") == "class", F.col("ordinal"))).alias("cls"))

    gone = known.where("scope = 'dead_function'").select("issue_id", "path", "type", "hard", "name", F.nullif("owner", F.lit("")).alias("owner"))
    calls = inner.where("level = 'callable'").withColumnRenamed("found", "name")
    named = gone.join(calls, ["path", "name"], "left").where("id is null or owner is null or owner <=> of")
    named = named.groupBy("issue_id").agg(F.min_by(F.struct("id", F.col("name").alias("found"), "of"), "ordinal").alias("call"))
    gone = gone.join(named, "issue_id", "left")  # those whose callables are all another owner's keep their row

    call_class = F.nullif(F.col("call.of"), F.lit(""))
    rows = [
        entry(known, "file", F.col("path"), F.col("scope") == "dead_file"),
        entry(at.where("call.id is not null"), "callable", F.col("call.id"), no),
        entry(at, "class", F.when(F.col("call.id").isNotNull(), call_class).otherwise(F.col("cls.found")), no),
        entry(known.where("scope = 'dead_class'"), "class", F.col("name"), yes),
        entry(gone.where("call.id is not null"), "callable", F.col("call.id"), yes),
        entry(gone, "class", F.when(F.col("call.id").isNotNull(), call_class).otherwise(F.col("owner")), no),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    by_type = every.where("key is not null").groupBy("level", "path", "key", "type").agg(F.count("*").alias("n"), F.max("dead").alias("dead"), F.max("hard").alias("hard"))
    types = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types")  # a handful of types
    return by_type.groupBy("level", "path", "key").agg(F.sum("n").alias("warnings"), F.max("dead").alias("dead"), F.max("hard").alias("hard"), types)


def outermost(artifacts: DataFrame) -> DataFrame:
    """Artifacts that aren't inside another of the same path; of identical intervals, the one with the longer name stays, then the lesser name.

    In order of their beginnings, the wider ones first, an interval is inside another if any before it ends as late. So a
    path's intervals are sorted and read once, with one running maximum; they are never met in pairs.
    """
    key = ["path", "first", "last", "name"]
    order = Window.partitionBy("path").orderBy("first", F.desc("last"), F.desc(F.length("name")), "name").rowsBetween(Window.unboundedPreceding, -1)
    distinct = artifacts.select(*key).distinct()
    outer = distinct.withColumn("before", F.max("last").over(order)).where("before is null or before < last").drop("before")
    return artifacts.join(outer, key, "left_semi")


def resolve_paths(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(path, match): the known path that equals it, with or without ./, else the longest known one that is a suffix of it at a slash.

    Suffixes are made and joined by equality, so no pair is tested in vain.
    """
    bare = F.regexp_replace("path", r"^(\./)+", "")
    parts = F.split(bare, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    tried = wanted.select("path").distinct().select("path", F.posexplode(suffixes).alias("k", "candidate"))
    hit = tried.join(known.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = hit.groupBy("path").agg(F.min_by("candidate", "k").alias("match"))
    return wanted.select("path").distinct().join(best, "path", "left")


def severities(issues: DataFrame, key: str) -> DataFrame:
    """Highest severity for each key: none, warning or error."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    top = issues.groupBy(key).agg(F.max(rank).alias("r"))
    return top.select(key, F.when(F.col("r") == 2, "error").when(F.col("r") == 1, "warning").otherwise("none").alias("severity"))


def warnings_by(issues: DataFrame) -> DataFrame:
    """Counts by (path, type) and by (folder, type) in one pass: grouping sets."""
    view = issues.selectExpr("path", "regexp_extract(path, '^(.+)/[^/]*$', 1) AS folder", "type")
    return view.groupingSets([["path", "type"], ["folder", "type"]], "path", "folder", "type").agg(F.count("*").alias("n"))
