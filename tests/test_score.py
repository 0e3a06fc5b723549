"""Scoring fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import score as S


def run(spark, on=S.AREAS, **given):
    base = {"files": 10, "loc": 1000, "edges": 0, "directives": 0, "excludes": 0, "disabled": 0, "duplicate_impact": 0.0, "size_score": 1.0, "one_class_total": 10, "localization_on": True}
    issues = {f"{a}_issues": 0 for a in S.AREAS}
    row = base | issues | {f"{a}_enabled": a in on for a in S.AREAS} | {"project": "p"} | given
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
    areas = S.areas(df)
    return S.overall(areas, S.suppression_points(df)).first(), {r["area"]: r for r in areas.collect()}


def test_clean(spark):
    r, _ = run(spark)
    assert (r["score"], r["points"], r["focus"]) == (100, 0, "none")


def test_focus(spark):
    r, _ = run(spark, magic_numbers_issues=10)
    assert r["score"] < 100 and r["focus"] == "magic_numbers"


def test_penalty_is_capped(spark):
    r, _ = run(spark, directives=20, excludes=8, disabled=2)
    assert (r["points"], r["focus"], r["score"]) == (25, "suppression_hygiene", 75)


def test_passive_strings(spark):
    _, a = run(spark, localization_on=False, hardcoded_strings_issues=1)
    assert not a["hardcoded_strings"]["enabled"] and a["hardcoded_strings"]["issues"] == 1 and a["hardcoded_strings"]["score"] == 1


def test_denominator(spark):
    r, _ = run(spark, on=("magic_numbers", "documentation", "localization"), files=1, loc=10, magic_numbers_issues=1)
    assert r["score"] == 92


def test_whole_document(spark):
    ones = {f"{a}_issues": 1 for a in ("hardcoded_strings", "magic_numbers", "source_sorting", "layers", "secrets", "dead_code")}
    r, _ = run(spark, files=1, loc=10, edges=6, one_class_total=1, one_class_per_file_issues=1, duplicate_impact=0.9 * 12, **ones)
    assert (r["score"], r["points"], r["focus"]) == (58, 0, "one_class_per_file")


def test_hundred_needs_no_deduction(spark):
    r, _ = run(spark, files=1000, loc=100000, magic_numbers_issues=1)
    assert r["score"] == 99


@pytest.mark.parametrize(("issues", "total", "want"), [(0, 0, 1.0), (1, 4, 0.75), (9, 4, 0.0)])
def test_fraction(spark, issues, total, want):
    assert spark.range(1).select(S.fraction_score(F.lit(issues), F.lit(total))).first()[0] == want
