"""Scalar functions over text columns: trimming, numbers, paths, labels, literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() strips blanks alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """Lines of a text, trailing empty ones too; an empty text has one."""
    return F.split(c, "\n", -1)


def non_blank(line: Column) -> Column:
    return line.rlike(r"\S")


def non_blank_count(c: Column) -> Column:
    return F.size(F.filter(lines(c), non_blank)).cast("long")


def non_blank_between(c: Column, first: Column, last: Column) -> Column:
    """Lines that aren't blank from line first to line last, counted from 1."""
    return F.size(F.filter(F.slice(lines(c), first, F.greatest(last - first + 1, F.lit(0))), non_blank)).cast("long")


def comment_line_numbers(c: Column) -> Column:
    """1-based numbers of lines that hold a // comment or a part of a /* */ block, at most once each."""
    marked = F.transform(lines(c), lambda line, i: F.when(line.rlike(r"//|/\*|\*/|^\s*\*"), i + 1))
    return F.filter(marked, lambda x: x.isNotNull())


def number_value(lexeme: Column) -> Column:
    """Value of a number as it's written in source text: with separators, as a decimal, or as signed hex; null if it's none."""
    plain = F.regexp_replace(lexeme, "_", "")
    decimal = plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    hexadecimal = plain.rlike(r"^[+-]?0[xX][0-9a-fA-F]{1,15}$")
    sign = F.when(plain.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    digits = F.regexp_extract(plain, r"0[xX]([0-9a-fA-F]{1,15})$", 1)
    return F.when(decimal, plain.try_cast("double")).when(hexadecimal, sign * F.conv(digits, 16, 10).try_cast("double"))


def is_trivial_number(lexeme: Column) -> Column:
    """-1, 0 and 1, however they're written."""
    return F.coalesce(number_value(lexeme).isin(-1.0, 0.0, 1.0), F.lit(False))


def grouped(c: Column) -> Column:
    """12345 as 12,345."""
    return F.format_number(c, 0)


def without_interpolations(c: Column) -> Column:
    """Text without $name and flat ${...} parts; nested braces are for strip_interpolations()."""
    return F.regexp_replace(F.regexp_replace(c, r"\$\{[^{}]*\}", ""), r"\$[A-Za-z_][A-Za-z0-9_]*", "")


def strip_interpolations(text: str) -> str:
    """Text without $name and ${...} parts, braces counted; a dollar after a backslash stays."""
    out, i = [], 0
    while i < len(text):
        if text[i] != "$" or (i and text[i - 1] == "\\"):
            out.append(text[i])
            i += 1
        elif text[i + 1 : i + 2] == "{":
            depth, i = 1, i + 2
            while i < len(text) and depth:
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                i += 1
        else:
            i += 1
            while i < len(text) and text[i].isascii() and (text[i].isalnum() or text[i] == "_"):
                i += 1
    return "".join(out)


def without_quotes(literal: Column) -> Column:
    """A literal without its raw prefix and its quotes, triple or single."""
    return F.regexp_replace(literal, r"""^r?('{3}|"{3}|'|")([\s\S]*)\1$""", "$2")


def without_type_arguments(name: Column) -> Column:
    return trimmed(F.substring_index(name, "<", 1))


def plain_type_name(name: Column) -> Column:
    """A type name without arguments, nullability and library prefix."""
    return F.substring_index(F.regexp_replace(without_type_arguments(name), r"\?$", ""), ".", -1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """Everything before the last slash; null where there's none, or it's the first character."""
    return F.when(F.locate("/", F.substring(path, 2, 1 << 20)) > 0, F.regexp_extract(path, r"^(.+)/[^/]*$", 1))


def within(path: Column, root: Column) -> Column:
    return (path == root) | path.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))


def normalized_path(path: str) -> str:
    """Slashes alone, . and .. folded."""
    out: list[str] = []
    parts = path.replace("\\", "/").split("/")
    for k, p in enumerate(parts):
        if p == ".." and out and out[-1] not in ("", ".."):
            out.pop()
        elif p not in ("", ".") or (p == "" and k == 0 and len(parts) > 1):
            out.append(p)
    return "/".join(out) or ("/" if path.startswith("/") else ".")


def has_part(path: Column, test) -> Column:
    return F.exists(F.split(path, "/"), test)


#: What stands before the locale in the names of translation files, taken off in this order.
ARB_PREFIXES = ("app_", "messages_", "l10n_")


def locale_of(name: Column) -> Column:
    """Locale in a translation file's name: language in lower case, then what follows, parts joined by _; null if the name begins with no language."""
    stem = F.regexp_replace(file_name(name), r"(?<=.)\.[^.]*$", "")
    for prefix in ARB_PREFIXES:
        stem = F.regexp_replace(stem, f"^{prefix}", "")
    parts = F.filter(F.split(F.replace(stem, F.lit("-"), F.lit("_")), "_"), lambda x: x != "")
    language = F.lower(F.get(parts, 0))
    return F.when(language.rlike("^[a-z]{2,3}$"), F.array_join(F.concat(F.array(language), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))), "_"))


#: English names of languages.
LANGUAGES = {
    "en": "English",
    "es": "Spanish",
    "fr": "French",
    "de": "German",
    "it": "Italian",
    "pt": "Portuguese",
    "ru": "Russian",
    "ja": "Japanese",
    "ko": "Korean",
    "zh": "Chinese",
    "ar": "Arabic",
    "hi": "Hindi",
    "th": "Thai",
    "vi": "Vietnamese",
    "sv": "Swedish",
    "da": "Danish",
    "no": "Norwegian",
    "fi": "Finnish",
    "pl": "Polish",
    "tr": "Turkish",
    "nl": "Dutch",
    "cs": "Czech",
    "hu": "Hungarian",
    "ro": "Romanian",
    "bg": "Bulgarian",
    "hr": "Croatian",
    "sk": "Slovak",
    "sl": "Slovenian",
    "et": "Estonian",
    "lv": "Latvian",
    "lt": "Lithuanian",
    "ga": "Irish",
    "eu": "Basque",
    "ca": "Catalan",
    "gl": "Galician",
    "is": "Icelandic",
    "mk": "Macedonian",
    "sr": "Serbian",
    "bs": "Bosnian",
    "me": "Montenegrin",
    "sq": "Albanian",
    "be": "Belarusian",
    "uk": "Ukrainian",
    "el": "Greek",
    "he": "Hebrew",
    "fa": "Persian",
    "ur": "Urdu",
    "bn": "Bengali",
    "ta": "Tamil",
    "te": "Telugu",
    "ml": "Malayalam",
    "kn": "Kannada",
    "gu": "Gujarati",
    "pa": "Punjabi",
    "mr": "Marathi",
    "ne": "Nepali",
    "si": "Sinhala",
    "my": "Myanmar",
    "km": "Khmer",
    "lo": "Lao",
    "ka": "Georgian",
    "am": "Amharic",
    "sw": "Swahili",
    "zu": "Zulu",
    "af": "Afrikaans",
    "mt": "Maltese",
    "cy": "Welsh",
}


def language_name(locale: Column) -> Column:
    """The language's name; its code in capitals where it's unknown."""
    code = F.get(F.split(F.lower(locale), "[_-]"), 0)
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(names[code], F.upper(code))


#: Fixed value: what a translation's placeholder looks like.
PLACEHOLDER = r"\{([a-zA-Z][a-zA-Z0-9_]*)\}"


def placeholders(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PLACEHOLDER), 1))


def differing(a: Column, b: Column) -> Column:
    """Whether two lists differ as sets."""
    return (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))) > 0


def translation_problem(base: Column, value: Column) -> Column:
    """missing, empty, unchanged or placeholder_mismatch, tested in this order of precedence; null if all is well."""
    return (
        F.when(value.isNull(), "missing")
        .when(~non_blank(value), "empty")
        .when(base.isNull(), "missing")
        .when(base == value, "unchanged")
        .when((F.size(placeholders(base)) > 0) & differing(placeholders(base), placeholders(value)), "placeholder_mismatch")
    )


def clean_location(location: Column) -> Column:
    """file:line without a trailing colon, and with a file or pair given twice reduced to one."""
    once = F.regexp_replace(location, r":+$", "")
    return F.regexp_replace(once, r"^(.+):\1$", "$1")


def location_line(location: Column) -> Column:
    return F.regexp_extract(clean_location(location), r":([0-9]+)(?::[0-9]+)?$", 1).try_cast("long")


def common_prefix_size(a: Column, b: Column) -> Column:
    """How many leading elements two lists share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("long")


def without_shared_folder(path: Column, other: Column) -> Column:
    """path without the folders that it shares with other, if both are absolute."""
    a, b = F.split(path, "/"), F.split(other, "/")
    n = F.least(common_prefix_size(a, b), F.size(a) - 1, F.size(b) - 1)
    return F.when(path.startswith("/") & other.startswith("/"), F.array_join(F.slice(a, (n + 1).cast("int"), F.size(a)), "/")).otherwise(path)


def percent_floor(ratio: Column) -> Column:
    return F.floor(ratio * 100).cast("long")


def compact_decimal(x: Column) -> Column:
    """Two decimals at most, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"0+$", ""), r"\.$", "")


def kilo_lines(n: Column) -> Column:
    return F.concat(F.format_string("%.1f", n.cast("double") / 1000), F.lit(" KLoC"))


def dash_if_zero(n: Column) -> Column:
    return F.when(n == 0, "-").otherwise(n.cast("string"))


def ratio_or_dash(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "-").otherwise(F.concat(F.round(part * 100.0 / whole).cast("long").cast("string"), F.lit("%")))


def xml_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def lib_label(path: Column) -> Column:
    """The path below its lib folder."""
    return F.regexp_replace(path, r"^(.*/)?lib/", "")


def mermaid_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(lib_label(path), r"\.[A-Za-z]+$", ""), r"[^A-Za-z0-9]+", "_")


def plantuml_id(path: Column) -> Column:
    return F.concat(F.lit("comp"), F.lower(F.regexp_replace(F.regexp_replace(lib_label(path), r"\.[A-Za-z]+$", ""), r"[^A-Za-z0-9]+", "")))


def qualified_name(owner: Column, name: Column) -> Column:
    return F.concat_ws(".", owner, name)


def stable_id(kind: Column, path: Column, owner: Column, name: Column, line: Column) -> Column:
    return F.concat_ws("|", kind, path, F.coalesce(owner, F.lit("")), name, line.cast("string"))


def dart_quoted(text: str) -> str:
    """In single quotes, with backslash, quote, dollar and control characters escaped."""
    named = {"\\": "\\\\", "'": "\\'", "$": "\\$", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "'" + "".join(named.get(c, c if c >= " " else f"\\u{{{ord(c):x}}}") for c in text) + "'"


def layer_severity(kind: Column) -> Column:
    return F.when(kind == "cyclicDependency", "error").when(kind.isin("wrongFolderLayer", "wrongLayer"), "warning")


def score_band(score: Column) -> Column:
    return F.when(score >= 95, "excellent").when(score >= 85, "good").when(score >= 70, "fair").otherwise("poor")


def status_icon(enabled: Column, issues: Column) -> Column:
    return F.when(~enabled, "[-]").when(issues == 0, "[ok]").otherwise("[!]")


#: Names that analyzers also go by.
ALIASES = {"codesize": "code_size", "sorting": "source_sorting"}


def analyzer_name(name: str) -> str:
    """Lower case with underscores, aliases resolved."""
    import re

    plain = re.sub(r"\s+", "_", name.strip().lower().replace("-", "_"))
    return ALIASES.get(plain, plain)


def issue_count_icon(score: Column) -> Column:
    return F.when(score >= 95, "green").when(score >= 85, "lime").when(score >= 70, "yellow").otherwise("red")


#: What technical strings look like, if they hold one of the marks, and what they look like without one.
TECHNICAL_MARK = r"[/\\._:?#@0-9-]"
LOWER_CAMEL = r"^[a-z]+(?:[A-Z][a-z0-9]*)+$"
TECHNICAL = (
    r"^\w+://",
    r"^[\w\-\.]+@[\w\-\.]+\.\w+",
    r"^#[0-9A-Fa-f]{3,8}",
    r"^\d+(\.\d+)?[a-zA-Z]*",
    r"^[A-Z][A-Z0-9]*_[A-Z0-9_]*",
    r"^[a-z]+_[a-z_]+",
    LOWER_CAMEL,
    r"^/[\w/\-\.]*",
    r"^[A-Za-z]:\\[\w\\\-. ]*",
    r"^(?:\.{1,2}/)?[\w\-.]+(?:/[\w\-.]+)+$",
    r"^[\w\-.]+(?:/+(?:[\w\-.]+)?)+$",
    r"^(?:\.{1,2}\\)?[\w\-.]+(?:\\[\w\-.]+)+$",
    r"^[\w\-.]+(?:\\+(?:[\w\-.]+)?)+$",
    r"^[?#][^ ]*[=&/][^ ]*$",
    r"^\w+\.\w+",
    r"^[\w\-]+\.[\w]+",
    r"^[a-zA-Z0-9]*[_\-0-9]+[a-zA-Z0-9_\-]*",
)


def is_technical(c: Column) -> Column:
    """Identifiers, paths, addresses and codes rather than words for people; blank texts aren't."""
    plain = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(plain == "", F.lit(False)).when(plain.rlike(TECHNICAL_MARK), plain.rlike("|".join(TECHNICAL))).otherwise(plain.rlike(LOWER_CAMEL))


def is_meaningful(c: Column) -> Column:
    return c.rlike("[A-Za-z0-9]")


def token_classes(code: Column) -> Column:
    """Tokens of a piece of code with literals and names folded to classes; characters of no class vanish."""
    tokens = F.regexp_extract_all(code, F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\d+(?:\.\d+)?|[A-Za-z_]\w*|[-+*/%=<>!&|^~?:;,.(){}\[\]])"""), 1)
    fold = lambda t: F.when(t.rlike("^[\"']"), "<str>").when(t.rlike(r"^\d"), "<num>").when(t.isin(*KEYWORDS), t).when(t.rlike(r"^[A-Za-z_]"), "<id>").otherwise(t)
    return F.transform(tokens, fold)


#: Words that keep their own class.
KEYWORDS = tuple(
    "abstract as assert async await base break case catch class const continue covariant default deferred do dynamic else enum export "
    "extends extension external factory false final finally for function get hide if implements import in interface is late library "
    "mixin new null on operator part required rethrow return sealed set show static super switch sync this throw true try typedef var "
    "void when while with yield".split()
)


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of the character at an offset from 0: line ends before it are counted, none is searched for twice."""
    return (F.regexp_count(F.substr(text, F.lit(1), offset.cast("int")), F.lit("\n")) + 1).cast("long")


def target_of(message: Column) -> Column:
    """The path that a message about a wrong layer ends in, in double quotes; null if it holds none."""
    found = F.regexp_extract(message, r'"([^"]+)"[^"]*$', 1)
    return F.when(found != "", found)


def text_width(c: Column, size: float) -> Column:
    """Estimated width of a text in a font of a size: narrow letters count a third, wide and capital ones more than the rest."""
    narrow, wide = F.regexp_count(c, F.lit(r"[iljtfr.,:;|'!() ]")), F.regexp_count(c, F.lit(r"[A-Z@%&mwMW]"))
    return (F.length(c) * 0.55 - narrow * 0.25 + wide * 0.15) * size


def fitted(c: Column, size: float, width: float) -> Column:
    """The font size at which a text fits a width, at most the size given."""
    return F.least(F.lit(float(size)), F.lit(float(width)) * size / F.greatest(text_width(c, size), F.lit(1e-9)))


def relative_to(path: Column, root: Column) -> Column:
    """path below root, as it is where it isn't; . for root itself."""
    bare = F.regexp_replace(root, "/+$", "")
    return F.when(path == bare, ".").when(path.startswith(F.concat(bare, F.lit("/"))), F.substr(path, F.length(bare) + 2)).otherwise(path)
