"""Package dependencies: two levels under the roots, versions, use counts; the package that a file belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels(deps: DataFrame, roots: DataFrame) -> DataFrame:
    """deps: package, needs; roots: package -> (level, package): roots at 0, what they need at 1, what those need at 2, each package once."""
    zero = roots.select("package").distinct()
    one = deps.join(zero, "package", "left_semi").select(F.col("needs").alias("package")).distinct().join(zero, "package", "left_anti")
    two = deps.join(one, "package", "left_semi").select(F.col("needs").alias("package")).distinct().join(zero, "package", "left_anti").join(one, "package", "left_anti")
    tag = lambda df, n: df.select(F.lit(n).alias("level"), "package")
    return tag(zero, 0).unionByName(tag(one, 1)).unionByName(tag(two, 2))


def usage(deps: DataFrame) -> DataFrame:
    return deps.groupBy(F.col("needs").alias("package")).agg(F.count("*").alias("used_by"))


def versions(packages: DataFrame, locked: DataFrame, derived: DataFrame) -> DataFrame:
    """The locked version, else the derived one, else unknown."""
    l = locked.groupBy("package").agg(F.first("version").alias("locked"))
    d = derived.groupBy("package").agg(F.min_by("version", "ordinal").alias("derived"))
    return packages.join(l, "package", "left").join(d, "package", "left").select("package", F.coalesce("locked", "derived", F.lit("unknown")).alias("version"))


def unique_derived(derived: DataFrame) -> DataFrame:
    """derived: package, version, ordinal. Each package once, with its first version, in order of names."""
    return derived.groupBy("package").agg(F.min_by("version", "ordinal").alias("version")).orderBy("package")


def platforms(support: DataFrame) -> DataFrame:
    """Union of platform flags, package by package."""
    flags = [c for c in support.columns if c != "package"]
    return support.groupBy("package").agg(*[F.bool_or(c).alias(c) for c in flags])


def nearest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files: path; manifests: folder ('' is the root) -> (path, manifest): the deepest folder above each distinct path that has one, null if none has.

    A path's folders are made and joined by equality, so no pair is tested in vain.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))
    paths = files.select("path").distinct()
    tried = paths.select("path", F.explode(above).alias("a")).select("path", "a.depth", "a.folder")
    held = tried.join(manifests.select("folder").distinct(), "folder").groupBy("path").agg(F.max_by("folder", "depth").alias("manifest"))
    return paths.join(held, "path", "left")


def sole(nearest_ones: DataFrame) -> DataFrame:
    """nearest_ones: path, manifest -> one row (manifest): the tree's package, if every file belongs to one and to the same; else null."""
    t = nearest_ones.agg(F.count("*").alias("n"), F.count("manifest").alias("held"), F.min("manifest").alias("low"), F.max("manifest").alias("high"))
    return t.select(F.when((F.col("n") > 0) & (F.col("held") == F.col("n")) & (F.col("low") == F.col("high")), F.col("low")).alias("manifest"))
