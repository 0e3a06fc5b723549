"""Order of members and imports: where it belongs, and whether it's there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.lanes import ranked_lanes

#: Life-cycle methods in their order.
LIFECYCLE = ("initState", "dispose", "didChangeDependencies", "didUpdateWidget", "build")
#: Import groups in their order: the language's own, packages, other absolute addresses, relative ones.
IMPORT_GROUPS = ("dart", "package", "other", "relative")


def out_of_order(members: DataFrame) -> DataFrame:
    """members: owner, ordinal (each once within an owner), name -> (owner, unsorted): whether the names as they stand differ from the names in order.

    They do if any member's place by ordinal isn't its place by name and ordinal. Both are numbered by ranges, so an owner of very many
    members is in many tasks.
    """
    plain = members.select("owner", "ordinal", "name")
    now = ranked_lanes(plain, ["owner"], [F.col("ordinal")])
    both = ranked_lanes(now.withColumnRenamed("lane", "stands"), ["owner"], [F.col("name"), F.col("ordinal")])
    return both.groupBy("owner").agg(F.max(F.col("stands") != F.col("lane")).alias("unsorted"))


def member_rank(kind: Column, name: Column) -> Column:
    """(group, place, name, part): others as they stand, fields by name, each before its accessors, life cycle in its own order, public, private.

    kind: other, field, accessor (of a field of that name) or method.
    """
    place = F.array_position(F.array(*map(F.lit, LIFECYCLE)), name)
    group = F.when(kind == "other", 0).when(kind.isin("field", "accessor"), 1).when(place > 0, 2).when(~name.startswith("_"), 3).otherwise(4)
    return F.struct(group.alias("group"), F.when(group == 2, place).otherwise(0).alias("place"), F.when(group.isin(1, 3, 4), name).otherwise("").alias("name"), (kind == "accessor").cast("int").alias("part"))


def with_accessors(members: DataFrame) -> DataFrame:
    """members: owner, kind, name, ordinal. Accessors of no field of their name are methods."""
    fields = members.where("kind = 'field'").select("owner", "name", F.lit(True).alias("held")).distinct()
    joined = members.join(fields, ["owner", "name"], "left")
    return joined.withColumn("kind", F.when((F.col("kind") == "accessor") & F.col("held").isNull(), "method").otherwise(F.col("kind"))).drop("held")


def sorted_members(members: DataFrame) -> DataFrame:
    """members: owner, kind, name, ordinal -> also target, their place in order."""
    placed = Window.partitionBy("owner").orderBy(member_rank(F.col("kind"), F.col("name")), "ordinal")
    return with_accessors(members).withColumn("target", F.row_number().over(placed))


def import_rank(uri: Column) -> Column:
    """(group, package, rest): imports are compared by their group, then by what stands before the first slash, then by what follows."""
    group = F.when(uri.startswith("dart:"), 0).when(uri.startswith("package:"), 1).when(uri.contains(":"), 2).otherwise(3)
    return F.struct(group.alias("group"), F.substring_index(uri, "/", 1).alias("package"), F.regexp_replace(uri, "^[^/]*/?", "").alias("rest"))


def same_but_for_space(a: Column, b: Column) -> Column:
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return fold(a) == fold(b)
