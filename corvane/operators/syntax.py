"""Dart sources as tokens in rows: brackets matched by depth, scopes as nested intervals, local variables that nothing uses.

A file's text becomes a row for each token by one pattern, and everything after that is windows over a file's tokens and interval
joins. Nothing here parses: a bracket's partner is the next bracket of its level, a declaration is a name between tokens that
only a declaration has around it, and a name means the innermost declaration whose scope holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.intervals import innermost

#: Code in ${} of a string may hold strings and one more level of braces.
_INNER = r"""\$\{(?:[^{}'"]++|'[^'\n]*+'|"[^"\n]*+"|\{[^{}]*+\})*+\}"""
#: A token with the white space before it: comment, string (raw, in three quotes, plain), number, name or mark.
TOKEN = (
    r"\s*+(?:"
    r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
    r"""|r'''(?:[^']++|'(?!''))*+'''|r\"\"\"(?:[^"]++|"(?!""))*+\"\"\"|r'[^'\n]*+'|r"[^"\n]*+\""""
    rf"""|'''(?:[^'\\$]++|\\[\s\S]|{_INNER}|\$|'(?!''))*+'''|\"\"\"(?:[^"\\$]++|\\[\s\S]|{_INNER}|\$|"(?!""))*+\"\"\""""
    rf"""|'(?:[^'\\$\n]++|\\.|{_INNER}|\$)*+'|"(?:[^"\\$\n]++|\\.|{_INNER}|\$)*+\""""
    r"|0[xX][0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9]+)?"
    r"|[A-Za-z_$][A-Za-z0-9_$]*+"
    r"|=>|==|!=|<=|>=|&&|\|\||\?\?=?|\?\.|\.\.\.?|\+\+|--|\S)"
)
#: Words after which a name isn't being declared, and those before a parenthesis that don't make it a parameter list.
NOT_TYPES = ("return", "await", "throw", "yield", "else", "case", "is", "as", "in", "new", "do", "assert", "import", "export", "part", "library", "get", "set", "operator", "class", "extends", "implements", "with", "on", "enum", "mixin", "extension", "typedef", "continue", "break", "async", "show", "hide")
CONTROL = ("if", "while", "switch", "for", "catch", "assert", "return", "await", "super", "this")
DECLARES = ("var", "final", "const", "late")


def tokens(files: DataFrame) -> DataFrame:
    """files: path, content -> (path, k, text, line) of each token but comments, numbered in order; line is the one it begins on. A null content has none."""
    found = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).alias("k", "raw"))
    bare = F.regexp_replace("raw", r"^\s+", "")
    rows = found.select("path", "k", bare.alias("text"), F.regexp_count("raw", F.lit("\n")).alias("breaks"), F.regexp_count(bare, F.lit("\n")).alias("own"))
    order = Window.partitionBy("path").orderBy("k")
    told = rows.select("path", "k", "text", (F.sum("breaks").over(order) - F.col("own") + 1).cast("int").alias("line"))
    code = told.where(~F.col("text").startswith("//") & ~F.col("text").startswith("/*"))
    return code.withColumn("k", F.row_number().over(order).cast("long") - 1)


def with_neighbours(code: DataFrame) -> DataFrame:
    """tokens with before and after, the texts next to each, depth, the brackets open after it, and head, class and override words since the last ; { or }."""
    order = Window.partitionBy("path").orderBy("k")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    text = F.col("text")
    step = F.when(text.isin("(", "[", "{"), 1).when(text.isin(")", "]", "}"), -1).otherwise(0)
    since = lambda which: F.coalesce(F.max(F.when(which, F.col("k"))).over(past) > F.coalesce(F.max(F.when(text.isin(";", "{", "}"), F.col("k"))).over(past), F.lit(-1)), F.lit(False))
    return code.select(
        "*", F.lag("text").over(order).alias("before"), F.lead("text").over(order).alias("after"), F.sum(step).over(order).cast("int").alias("depth"),
        since(text.isin("class", "mixin", "extension", "enum")).alias("in_class_head"), since(text == "override").alias("overrides"),
    )


def brackets(code: DataFrame) -> DataFrame:
    """code: as with_neighbours -> (path, open, close, mark, line, last, before, after, in_class_head, overrides): each pair; after follows the closing one.

    Of a level's brackets, in order, each opening one is followed by its closing one. Ones that never close are left out.
    """
    opening = F.col("text").isin("(", "[", "{")
    marks = code.where(F.col("text").isin("(", "[", "{", ")", "]", "}")).withColumn("level", F.when(opening, F.col("depth")).otherwise(F.col("depth") + 1))
    order = Window.partitionBy("path", "level").orderBy("k")
    following = lambda c: F.lead(c).over(order)
    paired = marks.select("path", F.col("k").alias("open"), following("k").alias("close"), F.col("text").alias("mark"), following("text").alias("closing"), "line", following("line").alias("last"), "before", following("after").alias("after"), "in_class_head", "overrides")
    fits = F.concat("mark", "closing").isin("()", "[]", "{}")
    return paired.where(fits).drop("closing")


def scopes(pairs: DataFrame) -> DataFrame:
    """pairs: as brackets -> (path, open, close, kind, names, overrides): kind is class, block, for, or list for the parentheses of a catch or a function.

    A list reaches to the end of the block that follows it, and names is the place where it closes itself; lists without a block,
    such as those of => functions, aren't scopes, nor are the braces of literals and of optional parameters.
    """
    is_block = F.col("before").isNull() | F.col("before").isin(")", "{", "}", ";", "else", "try", "finally", "do", "async", "sync", "*")
    braces = pairs.where("mark = '{'").where(F.col("in_class_head") | is_block)
    none = F.lit(None).cast("long")
    blocks = braces.select("path", "open", "close", F.when(F.col("in_class_head"), "class").otherwise("block").alias("kind"), none.alias("names"), F.lit(False).alias("overrides"))
    led = F.coalesce(F.col("before").isin(*CONTROL), F.lit(False)) & ~F.coalesce(F.col("before").isin("for", "catch"), F.lit(False))
    lists = pairs.where((F.col("mark") == "(") & ~led & F.col("after").isin("{", "async"))
    at = F.col("close") + F.when(F.col("after") == "async", 2).otherwise(1)
    lists = lists.select("path", F.col("open").alias("opens"), F.col("close").alias("names"), F.when(F.col("before") == "for", "for").otherwise("list").alias("kind"), "overrides", at.alias("open"))
    whole = lists.join(braces.select("path", "open", "close"), ["path", "open"])
    return blocks.unionByName(whole.select("path", F.col("opens").alias("open"), "close", "kind", "names", "overrides"))


def _is_name(text: Column) -> Column:
    return text.rlike("^[A-Za-z_$]")


def local_variables(code: DataFrame, places: DataFrame) -> DataFrame:
    """code: as with_neighbours; places: as scopes -> (path, k, text, line, open, close): local variables and parameters, with their innermost scope.

    A variable stands after var, final, const, late or a type and before = ; or in; a parameter in its list before , ) = or a closing
    bracket. Fields, _ and this.x are none, nor are parameters of overriding functions, which their signature asks for.
    """
    text, before, after = F.col("text"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    named = _is_name(before) & ~before.isin(*NOT_TYPES, *CONTROL)
    variable = (named & after.isin("=", ";", "in")) | (before.isin(">", "?", "]") & after.isin("=", "in")) | ((before == "?") & (after == ";"))
    parameter = (named | before.isin(">", "?", "(", ",", "{", "[")) & after.isin(",", ")", "=", "}", "]")
    maybe = code.where(_is_name(text) & (text != "_") & ~text.isin(*NOT_TYPES, *DECLARES, "this", "super", "required", "true", "false", "null")).select("path", "k", "text", "line", variable.alias("variable"), parameter.alias("parameter")).where("variable or parameter")
    held = innermost(maybe, places, ["path"], ["path", "k", "text", "line", "variable", "parameter"], "k", "open", "close")
    inside = F.col("k") < F.col("names")
    told = held.where((F.col("kind").isin("block", "for") & F.col("variable")) | ((F.col("kind") == "list") & inside & F.col("parameter") & ~F.col("overrides")))
    return told.select("path", "k", "text", "line", "open", "close")


def names_used(code: DataFrame) -> DataFrame:
    """(path, k, text): names as they stand, but members after a dot and labels of arguments; those in a string's interpolations stand where the string does."""
    text, before, after = F.col("text"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    plain = code.where(_is_name(text) & ~text.rlike("^r['\"]") & ~before.isin(".", "?.", "..", "?..") & ~(before.isin("(", ",") & (after == ":"))).select("path", "k", "text")
    strings = code.where(text.rlike("^['\"]") & F.contains(text, F.lit("$")))
    simple = F.regexp_extract_all("text", F.lit(r"\$([A-Za-z_][A-Za-z0-9_]*)"), 1)
    inner = F.array_join(F.regexp_extract_all("text", F.lit(r"\$\{([^}]*)\}"), 1), " ; ")
    names = F.concat(simple, F.regexp_extract_all(inner, F.lit(r"(?<![.\w$])([A-Za-z_$][\w$]*)"), 1))
    return plain.unionByName(strings.select("path", "k", F.explode(F.array_distinct(names)).alias("text")))


def unused(declared: DataFrame, uses: DataFrame) -> DataFrame:
    """declared: path, k, text, line, open, close; uses: path, k, text -> the rows of declared that no use means.

    A declaration holds from its own place to the end of its scope, so of those that hold a use the one that begins last is in the
    innermost scope. Of one name in one scope the first counts.
    """
    first = declared.groupBy("path", "open", "close", "text").agg(F.min_by(F.struct("k", "line"), "k").alias("f")).select("path", "text", F.col("f.k").alias("k"), F.col("f.line").alias("line"), "open", "close")
    others = uses.join(declared.select("path", "k", "text"), ["path", "k", "text"], "left_anti")
    spans = first.select("path", "text", F.col("k").alias("from"), F.col("close").alias("upto"))
    meant = innermost(others, spans, ["path", "text"], ["path", "k", "text"], "k", "from", "upto").select("path", F.col("from").alias("k")).distinct()
    return first.join(meant, ["path", "k"], "left_anti").select("path", "k", "text", "line", "open", "close")


def unused_variables(files: DataFrame) -> DataFrame:
    """files: path, content -> (path, line, name) of local variables and parameters that nothing uses."""
    from corvane.sources.store import materialize

    code = materialize(with_neighbours(tokens(files)), "syntax-tokens")
    declared = materialize(local_variables(code, materialize(scopes(brackets(code)), "syntax-scopes")), "syntax-locals")
    return unused(declared, names_used(code)).select("path", "line", F.col("text").alias("name"))
