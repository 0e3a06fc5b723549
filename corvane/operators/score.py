"""Compliance scoring: eleven areas, suppression, one number, where to look first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Areas in the order that breaks ties.
AREAS = ("code_size", "one_class_per_file", "hardcoded_strings", "magic_numbers", "source_sorting", "layers", "secrets", "dead_code", "duplicate_code", "documentation", "localization")
#: Which enabled flags count as disabled analyzers (localization isn't among them).
COUNTED_AS_DISABLED = tuple(a for a in AREAS if a != "localization")
INVEST = {
    "code_size": "Split the longest files and callables.",
    "one_class_per_file": "Move classes into files of their own.",
    "hardcoded_strings": "Move texts for people into resources.",
    "magic_numbers": "Name the numbers that carry meaning.",
    "source_sorting": "Sort members and imports.",
    "layers": "Break cycles between files and folders.",
    "secrets": "Take secrets out of the sources and rotate them.",
    "dead_code": "Remove what nothing uses.",
    "duplicate_code": "Share what is written twice.",
    "documentation": "Document the public surface.",
    "suppression_hygiene": "Remove suppressions that are no longer needed.",
}


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fraction_score(issues: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(1.0)).otherwise(clamp01(1 - issues.cast("double") / F.when(total <= 0, F.lit(1)).otherwise(total)))


def budget_score(issues: Column, budget: Column) -> Column:
    return F.when(budget <= 0, F.lit(1.0)).otherwise(clamp01(1 - issues.cast("double") / F.when(budget <= 0, F.lit(1.0)).otherwise(budget)))


def over_budget(used: Column, budget: Column) -> Column:
    return F.greatest(F.lit(0.0), (used.cast("double") - budget) / budget)


def areas(inputs: DataFrame) -> DataFrame:
    """inputs: project, files, loc, edges, size_score, one_class_total and, for each area, <area>_enabled and <area>_issues; duplicate_impact -> a row for each area.

    With localization off, hardcoded strings are passive: counted, not scored.
    """
    f, loc = F.greatest(F.col("files"), F.lit(1)).cast("double"), F.greatest(F.col("loc"), F.lit(1)).cast("double")
    top = lambda least, value: F.greatest(F.lit(float(least)), value)
    budgets = {
        "hardcoded_strings": top(3, 0.8 * f),
        "magic_numbers": top(4, 2.5 * f + loc / 450),
        "source_sorting": top(2, 0.75 * f),
        "layers": top(2, 0.2 * F.greatest(F.col("edges"), F.lit(1)).cast("double")),
        "secrets": F.lit(1.5),
        "dead_code": top(3, 0.8 * f),
        "documentation": top(2, 0.6 * f),
        "localization": top(1, 0.3 * f),
    }
    rows = []
    for k, a in enumerate(AREAS):
        issues, enabled = F.col(f"{a}_issues"), F.col(f"{a}_enabled")
        if a == "code_size":
            score = F.col("size_score").cast("double")
        elif a == "one_class_per_file":
            score = fraction_score(issues, F.col("one_class_total"))
        elif a == "duplicate_code":
            score = clamp01(1 - 2.5 * F.col("duplicate_impact") / loc)
        else:
            score = budget_score(issues, budgets[a])
        if a == "hardcoded_strings":
            passive = ~F.col("localization_on")
            enabled, score = enabled & ~passive, F.when(passive, F.lit(1.0)).otherwise(score)
        rows.append(F.struct(F.lit(k).alias("ordinal"), F.lit(a).alias("area"), enabled.alias("enabled"), issues.cast("long").alias("issues"), score.alias("score")))
    return inputs.select("project", F.explode(F.array(*rows)).alias("a")).select("project", "a.*")


def suppression_points(inputs: DataFrame) -> DataFrame:
    """project and points, 0 to 25: directives, custom excludes and disabled analyzers over their budgets, weighted."""
    f, loc = F.greatest(F.col("files"), F.lit(1)).cast("double"), F.greatest(F.col("loc"), F.lit(1)).cast("double")
    ign = over_budget(F.col("directives"), F.greatest(F.lit(3.0), 0.12 * f + loc / 2500))
    exc = over_budget(F.col("excludes"), F.greatest(F.lit(2.0), 0.08 * (f + F.col("excludes"))))
    dis = over_budget(F.col("disabled"), F.lit(1.0))
    raw = 25 * (0.45 * ign + 0.35 * exc + 0.20 * dis)
    return inputs.select("project", F.round(F.greatest(F.lit(0.0), F.least(F.lit(25.0), raw))).cast("long").alias("points"), (F.col("directives") + F.col("excludes") + F.col("disabled")).cast("long").alias("suppressions"))


def overall(scored: DataFrame, points: DataFrame) -> DataFrame:
    """project, score, points, focus and advice. 100 is for those without any deduction."""
    on = F.col("enabled")
    mean = scored.groupBy("project").agg(F.coalesce(F.avg(F.when(on, F.col("score"))), F.lit(1.0)).alias("mean"), F.coalesce(F.min(F.when(on, F.col("score"))), F.lit(1.0)).alias("least"))
    total = mean.join(points, "project").withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.col("mean") - F.col("points")))).cast("long"))
    total = total.withColumn("score", F.when((F.col("score") == 100) & ((F.col("least") < 1) | (F.col("points") > 0)), 99).otherwise(F.col("score")))
    entries = scored.where("enabled").select("project", "ordinal", "area", "issues", (1 - F.col("score")).alias("impact"))
    synthetic = points.where("points > 0").select("project", F.lit(len(AREAS)).alias("ordinal"), F.lit("suppression_hygiene").alias("area"), F.col("suppressions").alias("issues"), (F.col("points") / 25.0).alias("impact"))
    order = Window.partitionBy("project").orderBy(F.desc("impact"), F.desc("issues"), "ordinal")
    first = entries.unionByName(synthetic).where("impact > 0").withColumn("n", F.row_number().over(order)).where("n = 1").select("project", F.col("area").alias("focus"))
    advice = F.create_map(*[F.lit(x) for pair in INVEST.items() for x in pair])
    out = total.join(first, "project", "left").withColumn("focus", F.coalesce("focus", F.lit("none")))
    generic = F.when(F.col("focus") == "none", "Keep it up.").otherwise("Work on the area with the largest deduction.")
    return out.select("project", "score", "points", "focus", F.coalesce(advice[F.col("focus")], generic).alias("advice"))
