"""Dead files and symbols as anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reachable


def entry_points(files: DataFrame, package: str | None, is_dart: bool) -> DataFrame:
    """files: path, has_main. Those with a main; only where there's none, and for plain packages, the package's own library and what lies directly in lib."""
    mains = files.where("has_main").select(F.col("path").alias("node"))
    if not is_dart or mains.limit(1).count():
        return mains
    return files.where((F.col("path") == f"lib/{package}.dart") | F.col("path").rlike("^lib/[^/]+$")).select(F.col("path").alias("node"))


def dead_files(files: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that no entry point reaches; none where there's no entry point."""
    if not entries.limit(1).count():
        return files.where("false").select("path")
    return files.select("path").join(reachable(edges, entries).select(F.col("node").alias("path")), "path", "left_anti")


def unused_symbols(symbols: DataFrame, used: DataFrame) -> DataFrame:
    """symbols: name and more, used: name. Symbols whose name is used nowhere in the project."""
    return symbols.join(used.select("name").distinct(), "name", "left_anti")


def used_in(used: DataFrame, live: DataFrame | None) -> DataFrame:
    """used: path, name. Restricted to live files, if there are entry points at all."""
    return used if live is None else used.join(live.select("path").distinct(), "path", "left_semi")


def excluded(symbols: DataFrame) -> DataFrame:
    """Overrides, previews and abstract members are never dead, nor is the function main."""
    return symbols.where(~F.col("is_override") & ~F.col("is_preview") & ~F.col("is_abstract") & ~((F.col("kind") == "function") & (F.col("name") == "main")))
