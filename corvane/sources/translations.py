"""Translation files of a tree: which ones count, what they hold, and which of their keys the sources read."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

from . import globs
from .inventory import DO_NOT_TRANSLATE

#: A top-level key's line in a translation file, and the folder that is looked at where l10n.yaml names none.
KEY_LINE = r'^  "([^"]+)"\s*:'
DEFAULT_FOLDER = "lib/l10n"
ARB_FOLDER = r"(?m)^arb-dir:[ \t]*(.+)$"

#: Names under which sources hold their translations, and what an access, and a variable for it, look like.
ACCESSORS = ("l10n", "loc", "locale", "localizations", "strings")
ACCESSES = (
    r"\b(?:AppLocalizations|S)\.of\([^)]*\)[!?]?\.([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(|\b)",
    r"\b(?:AppLocalizations|S)\.current\.([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(|\b)",
    r"\b[A-Za-z_][A-Za-z0-9_]*\.l10n\.([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(|\b)",
)
VARIABLES = (
    r"\b(?:AppLocalizations(?:[A-Za-z_][A-Za-z0-9_]*)?|S)\??\s+([A-Za-z_][A-Za-z0-9_]*)\b",
    r"\b(?:final|var|const|[A-Za-z_][A-Za-z0-9_<>,?]*)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:(?:AppLocalizations|S)\.of\([^)]*\)|[A-Za-z_][A-Za-z0-9_]*\.l10n)\b",
)


def translation_files(files: DataFrame) -> DataFrame:
    """files: path, content -> (path, content) of the translation files below the folder that l10n.yaml names, or lib/l10n; of all, if there are none."""
    arb = files.where(F.col("path").endswith(".arb") & F.col("content").isNotNull()).select("path", "content")
    named = files.where("path = 'l10n.yaml'").agg(F.max(F.regexp_extract(F.coalesce("content", F.lit("")), ARB_FOLDER, 1)).alias("folder")).first()["folder"]
    folder = (named or "").strip().strip("'\"").removeprefix("./").rstrip("/") or DEFAULT_FOLDER
    inside = arb.where(F.col("path").startswith(f"{folder}/"))
    return inside if inside.limit(1).count() else arb


ENTRIES = "path string, key string, value string, kept boolean, declared boolean, lines array<int>"


def entries(arb: DataFrame) -> DataFrame:
    """(path, locale, key, value, kept, declared, lines): every key of a readable file, and names on lines like theirs (not declared).

    value is null unless it's a text, kept says that a key's description keeps it from translation, lines are those that declare it.
    One row stands for a file without keys, with a null key. Files that hold no JSON object have no rows.
    """
    import pandas as pd

    def read(path: str, content: str) -> list[tuple]:
        try:
            held = json.loads(content)
        except ValueError:
            return []
        if not isinstance(held, dict):
            return []
        lines: dict[str, list[int]] = {}
        for k, line in enumerate(content.split("\n")):
            if (m := re.match(KEY_LINE, line)) and not m[1].startswith("@"):
                lines.setdefault(m[1], []).append(k + 1)

        def kept(key: str) -> bool:
            told = held.get(f"@{key}")
            told = told.get("description") if isinstance(told, dict) else None
            return isinstance(told, str) and bool(re.search(DO_NOT_TRANSLATE, told))

        keys = [*(k for k in held if not k.startswith("@")), *(k for k in lines if k not in held)]
        rows = [(path, k, held[k] if isinstance(held.get(k), str) else None, kept(k), k in held, lines.get(k, [])) for k in keys]
        return rows or [(path, None, None, False, False, [])]

    def run(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in read(p, c)]
            yield pd.DataFrame(rows, columns=["path", "key", "value", "kept", "declared", "lines"])

    return arb.select("path", "content").mapInPandas(run, ENTRIES).withColumn("locale", T.locale_of(F.col("path")))


def reads(sources: DataFrame) -> DataFrame:
    """sources: path, content -> (key): members that sources below lib read off their translations; generated sources and those in lib/l10n don't count."""
    p, c = F.col("path"), F.col("content")
    own = sources.where(p.startswith("lib/") & p.endswith(".dart") & ~globs.is_generated_localization(p) & ~p.startswith(f"{DEFAULT_FOLDER}/") & c.isNotNull())
    names = F.concat(F.array(*map(F.lit, ACCESSORS)), *[F.regexp_extract_all(c, F.lit(v), 1) for v in VARIABLES])
    member = F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)[!?]?\.(?=([A-Za-z_][A-Za-z0-9_]*))")
    pairs = F.arrays_zip(F.regexp_extract_all(c, member, 1).alias("owner"), F.regexp_extract_all(c, member, 2).alias("key"))
    held = own.select(F.concat(*[F.regexp_extract_all(c, F.lit(a), 1) for a in ACCESSES]).alias("direct"), pairs.alias("pairs"), names.alias("names"))
    off = F.transform(F.filter("pairs", lambda x: F.array_contains("names", x["owner"])), lambda x: x["key"])
    return held.select(F.explode(F.concat("direct", off)).alias("key")).distinct()
