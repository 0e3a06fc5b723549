"""Graphs as text: Mermaid and PlantUML lines, made in the engine and written in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import lib_label, mermaid_id, plantuml_id


def arrow(src_layer: Column, dst_layer: Column, styles: tuple[str, str, str]) -> Column:
    """Downwards, within a layer, upwards."""
    return F.when(src_layer < dst_layer, styles[0]).when(src_layer == dst_layer, styles[1]).otherwise(styles[2])


def mermaid_edges(edges: DataFrame) -> DataFrame:
    """(line, text): one arrow a line, in order of names."""
    order = Window.orderBy("src", "dst")
    return edges.select(F.row_number().over(order).alias("line"), F.concat(F.lit("  "), mermaid_id(F.col("src")), F.lit(" --> "), mermaid_id(F.col("dst"))).alias("text"))


def _document(head: list[str], nodes: DataFrame, arrows: DataFrame, foot: list[str]) -> DataFrame:
    """(section, key, text), to be written in order of section and key."""
    spark = nodes.sparkSession
    own = spark.createDataFrame([(0, f"{k:04d}", t) for k, t in enumerate(head)] + [(3, f"{k:04d}", t) for k, t in enumerate(foot)], "section int, key string, text string")
    return own.unionByName(nodes.select(F.lit(1).alias("section"), "key", "text")).unionByName(arrows.select(F.lit(2).alias("section"), "key", "text")).orderBy("section", "key")


def mermaid(placed: DataFrame, assigned: DataFrame) -> DataFrame:
    """placed: src, dst, src_layer, dst_layer; assigned: node, layer. A graph without layers (a cycle) has a header alone."""
    layer = F.format_string("%06d", F.col("layer").cast("int"))
    nodes = assigned.select(F.concat_ws("/", layer, "node").alias("key"), F.concat(F.lit("  "), mermaid_id(F.col("node")), F.lit('["'), lib_label(F.col("node")), F.lit('"]')).alias("text"))
    style = arrow(F.col("src_layer"), F.col("dst_layer"), ("-->", "-.->", "-.-o"))
    arrows = placed.select(F.concat_ws(">", "src", "dst").alias("key"), F.concat(F.lit("  "), mermaid_id(F.col("src")), F.lit(" "), style, F.lit(" "), mermaid_id(F.col("dst"))).alias("text"))
    return _document(["graph TD"], nodes, arrows, [])


def plantuml(placed: DataFrame, assigned: DataFrame) -> DataFrame:
    layer = F.format_string("%06d", F.col("layer").cast("int"))
    nodes = assigned.select(F.concat_ws("/", layer, "node").alias("key"), F.concat(F.lit('component "'), lib_label(F.col("node")), F.lit('" as '), plantuml_id(F.col("node"))).alias("text"))
    style = arrow(F.col("src_layer"), F.col("dst_layer"), ("-->", "..>", "..o"))
    arrows = placed.select(F.concat_ws(">", "src", "dst").alias("key"), F.concat(plantuml_id(F.col("src")), F.lit(" "), style, F.lit(" "), plantuml_id(F.col("dst"))).alias("text"))
    return _document(["@startuml"], nodes, arrows, ["@enduml"])


def write_lines(document: DataFrame, path: str) -> None:
    """One text file, in order; for graphs that a person looks at."""
    document.orderBy("section", "key").select("text").coalesce(1).write.mode("overwrite").text(path)
