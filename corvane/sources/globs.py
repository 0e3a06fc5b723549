"""Exclusion patterns over paths, as regular expressions that run in the engine."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that are never analysed.
DEFAULT_EXCLUDED = (
    "example",
    "test",
    "integration_test",
    "tool",
    ".dart_tool",
    "build",
    ".git",
    "ios",
    "android",
    "web",
    "macos",
    "windows",
    "linux",
)
#: How names of generated localization sources begin, and those of their main files.
LOCALE_PREFIXES = ("app_localizations_", "app_localization_")
LOCALE_FILES = ("app_localization.dart", "app_localizations.dart")


def regex_of(glob: str) -> str:
    """* stays within a folder, ** doesn't, ? is one character."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = glob[i]
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
            i += 1
    return "^" + "".join(out) + "$"


def variants(glob: str) -> list[str]:
    """**/x/** also stands for x, x/** and **/x."""
    m = re.fullmatch(r"\*\*/([^*]+)/\*\*", glob)
    return [glob, m[1], f"{m[1]}/**", f"**/{m[1]}"] if m else [glob]


def excluded_by(path: Column, globs: list[str]) -> Column:
    """Whether a path, or its last part for patterns without a slash, matches one of the patterns."""
    name = F.substring_index(path, "/", -1)
    tests = [(path if "/" in v else name).rlike(regex_of(v)) for g in globs for v in variants(g)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def default_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, DEFAULT_EXCLUDED)))


def is_test(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(F.lit("test"), F.lit("integration_test")))


def is_generated(path: Column) -> Column:
    return path.endswith(".g.dart")


def is_locale_source(path: Column) -> Column:
    """Generated sources of single locales, which a scan leaves out; the main file stays."""
    name = F.substring_index(path, "/", -1)
    return reduce(lambda a, b: a | b, [name.startswith(x) for x in LOCALE_PREFIXES]) & name.endswith(".dart")


def is_generated_localization(path: Column) -> Column:
    return is_locale_source(path) | F.substring_index(path, "/", -1).isin(*LOCALE_FILES)


def in_l10n(path: Column) -> Column:
    return path.rlike("(^|/)lib/l10n(/|$)")
