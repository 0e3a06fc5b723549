"""Folder trees from file paths: roots, hierarchy, loose files, dependencies between siblings, sizes by file groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import common_prefix_size, folder
from corvane.operators.lanes import ranked_lanes


def shared_root(files: DataFrame) -> DataFrame:
    """One row: the deepest folder that holds every path, from the least and the greatest of them."""
    ends = files.agg(F.min("path").alias("low"), F.max("path").alias("high"))
    a, b = F.split("low", "/"), F.split("high", "/")
    n = F.least(common_prefix_size(a, b), F.size(a) - 1, F.size(b) - 1).cast("int")
    return ends.select(F.array_join(F.slice(a, 1, n), "/").alias("root"))


def hierarchy(files: DataFrame) -> DataFrame:
    """(folder, parent, depth) of every folder on the way to a file."""
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    every = files.where(F.instr("path", "/") > 0).select(F.explode(upto).alias("folder")).distinct()
    return every.select("folder", folder(F.col("folder")).alias("parent"), F.size(F.split("folder", "/")).alias("depth"))


def with_loose_files(files: DataFrame) -> DataFrame:
    """(path, group): a file's folder; in folders that hold folders too, a group of its own, FOLDER/..."""
    own = files.select("path", F.coalesce(folder(F.col("path")), F.lit("")).alias("folder"))
    parents = hierarchy(files).where("parent is not null").select(F.col("parent").alias("folder")).distinct().withColumn("mixed", F.lit(True))
    return own.join(parents, "folder", "left").select("path", F.when(F.col("mixed"), F.concat("folder", F.lit("/..."))).otherwise(F.col("folder")).alias("group"))


def sibling_edges(edges: DataFrame) -> DataFrame:
    """(src, dst): edges between the folders just below the deepest folder that both files share; each once, none to itself."""
    a, b = F.split("src", "/"), F.split("dst", "/")
    n = F.least(common_prefix_size(a, b), F.size(a) - 1, F.size(b) - 1).cast("int")
    below = lambda parts: F.array_join(F.slice(parts, 1, F.least(n + 1, F.size(parts) - 1)), "/")
    return edges.select(below(a).alias("src"), below(b).alias("dst")).where("src <> dst").distinct()


def depth_first(folders: DataFrame) -> DataFrame:
    """folders: folder, with all folders above each but for the nameless root -> (folder, depth, pre, post, size).

    pre and post are places from 1 in the order in which a depth-first walk comes to a folder and leaves it, children by name; size
    counts the folder and all below it. So the folders below f are those with pre in (f.pre, f.pre + f.size). Names' order is that of
    the lists of their parts, in which the whole is numbered by ranges; post = pre + size - depth follows from the ancestors that
    are still open.
    """
    parts = F.split("folder", "/")
    plain = folders.select("folder").distinct().withColumn("parts", parts)
    upto = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    sizes = plain.select(F.explode(upto).alias("folder")).groupBy("folder").agg(F.count("*").alias("size"))
    numbered = ranked_lanes(plain.withColumn("whole", F.lit(0)), ["whole"], [F.col("parts")])
    told = numbered.join(sizes, "folder").select("folder", F.size("parts").cast("long").alias("depth"), (F.col("lane") + 1).cast("long").alias("pre"), "size")
    return told.select("folder", "depth", "pre", (F.col("pre") + F.col("size") - F.col("depth")).alias("post"), "size")


def folder_metrics(folders: DataFrame, edges: DataFrame) -> DataFrame:
    """(folder, incoming, outgoing): edges (src, dst, n) at each of folders, 0 where there are none."""
    out = edges.groupBy(F.col("src").alias("folder")).agg(F.sum("n").alias("o"))
    into = edges.groupBy(F.col("dst").alias("folder")).agg(F.sum("n").alias("i"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return folders.select("folder").distinct().join(into, "folder", "left").join(out, "folder", "left").select("folder", zero("i", "incoming"), zero("o", "outgoing"))


def weighted(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    return edges.groupBy(a.alias("src"), b.alias("dst")).agg(F.count("*").alias("weight"))


def file_groups(artifacts: DataFrame) -> DataFrame:
    """(path, owner, loc): classes with the lines of their methods where these are more, and what belongs to no class, each file's in one."""
    classes = artifacts.where("kind = 'class'").groupBy("path", F.col("name").alias("owner")).agg(F.max("loc").alias("own"))
    members = artifacts.where("kind in ('method', 'constructor')").groupBy("path", F.coalesce("owner", F.lit("")).alias("owner")).agg(F.sum("loc").alias("inner"))
    loose = artifacts.where("kind = 'function'").groupBy("path").agg(F.sum("loc").alias("own")).select("path", F.lit("").alias("owner"), "own")
    both = classes.unionByName(loose).join(members, ["path", "owner"], "full_outer")
    return both.select("path", "owner", F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("inner", F.lit(0))).alias("loc"))


def file_sizes(files: DataFrame, groups: DataFrame) -> DataFrame:
    """files: path, loc. The sum of a file's groups where there are any, else its own lines."""
    total = groups.groupBy("path").agg(F.sum("loc").alias("grouped"))
    return files.join(total, "path", "left").select("path", F.coalesce(F.when(F.col("grouped") > 0, F.col("grouped")), F.col("loc")).alias("loc"))
