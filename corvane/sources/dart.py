"""A tolerant scanner of Dart sources: tokens, then declarations by bracket depth, then facts for each file.

Exact for comments, literals, directives, imports and lines; near exact for the ranges of declarations; best effort for
the context of a literal. There's no full parser, so a file counts as broken if its brackets or quotes don't close.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from corvane.functions.text import KEYWORDS, strip_interpolations

_SPACE = re.compile(r"\s+")
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+|(?:[0-9][0-9_]*)(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+")
_PUNCT = re.compile(r">>>=|<<=|>>=|\?\?=|\.\.\.\?|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\.\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|~/|<<|.", re.S)
_IGNORE = re.compile(r"//\s*ignore\s*:\s*(.+)$", re.I)
_DOMAIN = re.compile(r"\b[a-z0-9]+_[a-z_]+\b", re.I)
_WIDGET_TEXT = re.compile(r"""\bText\s*\(\s*(['"])(.*?)\1""", re.S)
#: Comments that excuse a hardcoded string on their line and the next.
EXCUSED = re.compile(r"//\s*ignore:\s*avoid_hardcoded_strings_in_widgets|//\s*ignore_for_file:\s*avoid_hardcoded_strings_in_widgets|//\s*(?i:ignore:\s*hardcoded.string)|//\s*(?i:hardcoded.ok)")
#: Calls that print or log, and types that are keys.
PRINTS = ("print", "debugPrint", "debugPrintStack")
LOGS = ("log", "logger", "info", "debug", "warn", "warning", "error", "trace", "fatal", "wtf")
KEYS = ("Key", "ValueKey", "ObjectKey")
WIDGETS = ("StatelessWidget", "StatefulWidget", "State")


@dataclass(slots=True)
class Token:
    kind: str  # comment, string, number, name, mark
    text: str
    line: int
    last: int


class Broken(ValueError):
    pass


def _string_end(source: str, at: int, quote: str, raw: bool) -> int:
    """Where a literal that opens with quote at `at` ends; interpolations may hold literals of their own."""
    i = at + len(quote)
    while i < len(source):
        if source.startswith(quote, i):
            return i + len(quote)
        c = source[i]
        if c == "\\" and not raw:
            i += 2
        elif c == "$" and not raw and source[i + 1 : i + 2] == "{":
            depth, i = 1, i + 2
            while i < len(source) and depth:
                c = source[i]
                if c in "'\"":
                    mark = c * 3 if source.startswith(c * 3, i) else c
                    i = _string_end(source, i, mark, i > 0 and source[i - 1] == "r")
                else:
                    depth += {"{": 1, "}": -1}.get(c, 0)
                    i += 1
        elif c == "\n" and len(quote) == 1:
            raise Broken("literal isn't closed")
        else:
            i += 1
    raise Broken("literal isn't closed")


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    i, line, n = 0, 1, len(source)
    while i < n:
        c = source[i]
        if c.isspace():
            end = _SPACE.match(source, i).end()
            line += source.count("\n", i, end)
            i = end
            continue
        if source.startswith("//", i):
            end = source.find("\n", i)
            end, kind = (n if end < 0 else end), "comment"
        elif source.startswith("/*", i):
            depth, end = 1, i + 2
            while depth and end < n:
                if source.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                elif source.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
            if depth:
                raise Broken("comment isn't closed")
            kind = "comment"
        elif c in "'\"" or (c == "r" and source[i + 1 : i + 2] in ("'", '"')):
            raw = c == "r"
            q = source[i + raw]
            quote = q * 3 if source.startswith(q * 3, i + raw) else q
            end, kind = _string_end(source, i + raw, quote, raw), "string"
        elif m := _IDENT.match(source, i):
            end, kind = m.end(), "name"
        elif c.isdigit() or (c == "." and source[i + 1 : i + 2].isdigit()):
            end, kind = _NUMBER.match(source, i).end(), "number"
        else:
            end, kind = _PUNCT.match(source, i).end(), "mark"
        last = line + source.count("\n", i, end)
        out.append(Token(kind, source[i:end], line, last))
        line, i = last, end
    return out


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _matches(code: list[Token]) -> dict[int, int]:
    """Places of opening brackets to those of their closing ones."""
    stack, found = [], {}
    for i, t in enumerate(code):
        if t.kind == "mark" and t.text in OPEN:
            stack.append(i)
        elif t.kind == "mark" and t.text in CLOSE:
            if not stack or OPEN[code[stack[-1]].text] != t.text:
                raise Broken(f"bracket in line {t.line}")
            found[stack.pop()] = i
    if stack:
        raise Broken(f"bracket in line {code[stack[-1]].line}")
    return found


@dataclass
class Declaration:
    kind: str  # class, function, method, constructor, field, variable
    name: str
    owner: str | None
    first: int
    last: int
    head: list[Token]
    body: list[Token]
    parent: str | None = None
    marks: list[str] = field(default_factory=list)
    documented: bool = False
    arrow: bool = False
    commented: bool = False
    body_lines: tuple[int, int] = (0, -1)


def _plain(source_tokens: list[Token]) -> list[Token]:
    return [t for t in source_tokens if t.kind != "comment"]


def _split(code: list[Token], close: dict[int, int], start: int, stop: int) -> list[tuple[int, int, int]]:
    """(first token, first token of the body or -1, end) of each member between start and stop."""
    found, i = [], start
    while i < stop:
        first, j, body = i, i, -1
        while j < stop:
            t = code[j].text if code[j].kind == "mark" else ""
            if t == ";":
                j += 1
                break
            if t == "{":
                body, before = j, code[j - 1].text if j else ""
                j = close[j] + 1
                if before not in ("=", "=>", "(", ",", "?", ":", "??", "return"):
                    break
            elif t in ("(", "["):
                j = close[j] + 1
            elif t == "=>" and body < 0:
                body = j
                j += 1
            else:
                j += 1
        found.append((first, body, j))
        i = max(j, i + 1)
    return found


def _head_name(head: list[Token]) -> tuple[str, bool]:
    """Name and whether it's callable: the name before the first parenthesis at depth 0, of accessors the name after get."""
    depth = 0
    for k, t in enumerate(head):
        if t.text == "get" and k + 1 < len(head) and head[k + 1].kind == "name" and depth == 0:
            return head[k + 1].text, True
        if t.text == "operator" and k + 1 < len(head):
            return "operator " + head[k + 1].text, True
        if t.text == "<":
            depth += 1
        elif t.text in (">", ">>"):
            depth -= len(t.text)
        elif t.text in ("=", "=>"):
            break
        elif t.text == "(" and k and depth <= 0:
            j = k - 1
            if head[j].text in (">", ">>"):  # type parameters
                level = 0
                while j >= 0:
                    level += head[j].text.count(">") - head[j].text.count("<")
                    if level <= 0:
                        break
                    j -= 1
                j -= 1
            if j >= 0 and head[j].kind == "name" and head[j].text not in ("if", "for", "while", "switch", "assert"):
                name = head[j].text
                if j >= 2 and head[j - 1].text == ".":
                    name = f"{head[j - 2].text}.{name}"
                return name, True
            break
    names = []
    for t in head:
        if t.text in ("=", ";", ","):
            break
        if t.kind == "name":
            names.append(t.text)
    return (names[-1] if names else ""), False


TYPE_WORDS = ("class", "mixin", "enum", "extension")


def declarations(all_tokens: list[Token]) -> list[Declaration]:
    code = _plain(all_tokens)
    close = _matches(code)
    comments = {t.last: t.text for t in all_tokens if t.kind == "comment"}
    after = {id(t) for before, t in zip(all_tokens, all_tokens[1:], strict=False) if before.kind == "comment" and t.kind != "comment"}
    found: list[Declaration] = []

    def add(first: int, body: int, end: int, owner: str | None) -> None:
        k, marks = first, []
        while k < end and code[k].text == "@":
            marks.append(code[k + 1].text if k + 1 < end else "")
            k += 2
            while k + 1 < end and code[k].text == ".":
                k += 2
            if k < end and code[k].text == "(":
                k = close[k] + 1
        head = code[k : body if body >= 0 else end]
        if not head:
            return
        words = [t.text for t in head[:4]]
        documented = comments.get(code[first].line - 1, "").startswith(("///", "/**"))
        own = code[body:end] if body >= 0 else []
        kind = next((w for w in words if w in TYPE_WORDS), None) if owner is None else None
        if kind and body >= 0 and code[body].text == "{":
            at = words.index(kind)
            name = next((t.text for t in head[at + 1 :] if t.kind == "name" and t.text not in ("class", "on", "type")), "")
            parent = next((head[i + 1].text for i, t in enumerate(head[:-1]) if t.text == "extends"), None)
            found.append(Declaration("class", name, None, code[first].line, code[end - 1].last, head, own, parent, marks, documented))
            inner, stop = body + 1, close[body]
            if kind == "enum":  # values come first
                while inner < stop and code[inner].text != ";":
                    inner = close[inner] + 1 if code[inner].text in OPEN else inner + 1
                inner += 1
            for m in _split(code, close, inner, stop):
                add(*m, name)
            return
        name, callable_ = _head_name(head)
        if words[0] in ("import", "export", "part", "library", "typedef"):
            return
        if callable_:
            what = "function" if owner is None else "constructor" if name == owner or name.startswith(f"{owner}.") else "method"
        else:
            what = "variable" if owner is None else "field"
        arrow = body >= 0 and code[body].text == "=>"
        block = (code[body].line, code[end - 1].last) if body >= 0 and not arrow else (0, -1)
        found.append(Declaration(what, name, owner, code[first].line, code[end - 1].last, head, own, None, marks, documented, arrow, id(code[first]) in after, block))

    for m in _split(code, close, 0, len(code)):
        add(*m, None)
    return found


def directives(code: list[Token]) -> list[tuple[str, str]]:
    """(import, export or part, address), conditional addresses too."""
    found, i = [], 0
    while i < len(code):
        if code[i].kind == "name" and code[i].text in ("import", "export", "part") and (i == 0 or code[i - 1].text in (";", "}")):
            word, j = code[i].text, i + 1
            while j < len(code) and code[j].text != ";":
                if code[j].kind == "string":
                    found.append((word, code[j].text.strip("r'\"")))
                j += 1
            i = j
        i += 1
    return found


def comment_lines(all_tokens: list[Token]) -> int:
    return len({n for t in all_tokens if t.kind == "comment" for n in range(t.line, t.last + 1)})


def normalized(body: list[Token]) -> list[str]:
    words = set(KEYWORDS)
    fold = {"string": "<str>", "number": "<num>"}
    return [fold.get(t.kind) or (t.text if t.kind == "mark" or t.text in words else "<id>") for t in body if t.text not in ("@", "#", "$")]


def signature(head: list[Token]) -> str:
    """The parameter list with names folded."""
    text, depth = [], 0
    for t in head:
        if t.text == "(":
            depth += 1
        if depth:
            text.append(t.text if t.kind == "mark" or t.text in ("required", "final", "this", "super") or t.text[:1].isupper() else "_")
        if t.text == ")":
            depth -= 1
            if not depth:
                break
    return " ".join(text)


@dataclass(slots=True)
class Frame:
    """An open bracket: what it opens, and where the statement or argument that is being read began."""

    kind: str  # block, call, annotation, index, list, map, group
    at: int
    name: str = ""
    target: str = ""
    const: bool = False
    label: str = ""
    begins: int = 0


def _frame(code: list[Token], i: int) -> Frame:
    """The frame of the bracket at i, from the tokens before it."""
    t, before = code[i].text, code[i - 1] if i else None
    word = before is not None and before.kind == "name"
    if t == "(":
        j = i - 1
        if before is not None and before.text in (">", ">>"):  # type arguments
            depth = 0
            while j >= 0:
                depth += code[j].text.count(">") - code[j].text.count("<") if code[j].kind == "mark" else 0
                j -= 1
                if depth <= 0:
                    break
        if j < 0 or code[j].kind != "name":
            return Frame("group", i, begins=i + 1)
        name, k = code[j].text, j - 1
        target: list[str] = []
        while k >= 1 and code[k].text in (".", "?.", "!"):
            if code[k].text != "!":
                target.append(code[k - 1].text)
            k -= 2 if code[k].text != "!" else 1
        if k >= 0 and code[k].text == "@":
            return Frame("annotation", i, name, begins=i + 1)
        return Frame("call", i, name, ".".join(reversed(target)), begins=i + 1)
    const = before is not None and (before.text == "const" or (before.text == ">" and any(x.text == "const" for x in code[max(0, i - 6) : i])))
    if t == "[":
        index = before is not None and (before.text in (")", "]", "!") or (word and before.text not in ("return", "in", "const", "await", "yield", "case")))
        return Frame("index" if index else "list", i, const=const, begins=i + 1)
    literal = before is not None and (const or before.text in ("=", "(", ",", ":", "return", "[", "?", "??", "=>", ">"))
    return Frame("map" if literal else "block", i, const=const, begins=i + 1)


def _head(code: list[Token], begins: int, at: int) -> list[str] | None:
    """Words of a variable's declaration, up to its =, if the statement that begins there is one and goes on past at."""
    words, depth = [], 0
    for k in range(begins, at):
        t = code[k].text
        if t == "=" and depth == 0:
            return words
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(t, 0) if code[k].kind == "mark" else 0
        if t in ("=>", ";") and depth == 0:
            return None
        words.append(t)
    return None


def bare_text(literal: str) -> str:
    """What a literal says: without its raw prefix, its quotes and its interpolations."""
    raw = literal[:1] in ("r", "R")
    body = literal[raw:]
    q = 3 if body[:3] in ("'''", '"""') and len(body) >= 6 else 1
    return body[q:-q] if raw else strip_interpolations(body[q:-q])


def literals(code: list[Token], declared: list[Declaration], addresses: set[str]) -> tuple[list[dict], list[dict]]:
    """Strings and numbers with what stands around them: why a literal is exempt, whether it's printed, logged, a widget's output or a named argument."""
    stack = [Frame("block", -1)]
    strings, numbers = [], []
    scopes = [d for d in declared if d.kind in ("method", "function")]
    parents = {d.name: d.parent for d in declared if d.kind == "class"}
    for i, t in enumerate(code):
        if t.kind == "mark":
            if t.text in OPEN:
                stack.append(_frame(code, i))
            elif t.text in CLOSE:
                closed = stack.pop() if len(stack) > 1 else stack[-1]
                if closed.kind == "block" and stack[-1].kind == "block" and t.text == "}":
                    stack[-1].begins = i + 1
            elif t.text == ";":
                stack[-1].begins = i + 1
            elif t.text == ",":
                stack[-1].label = ""
                if stack[-1].kind != "block":
                    stack[-1].begins = i + 1
            elif t.text == ":" and stack[-1].kind == "call" and i - 1 == stack[-1].begins:
                stack[-1].label = code[i - 1].text
            continue
        if t.kind not in ("string", "number"):
            continue
        prev, nxt = (code[i - 1].text if i else ""), (code[i + 1].text if i + 1 < len(code) else "")
        inner = stack[-1]
        heads = [h for f in stack if f.kind == "block" and (h := _head(code, f.begins, i))]
        why = None
        if any(f.kind == "annotation" for f in stack):
            why = "annotation"
        if t.kind == "number":
            for h in heads:
                named = len(h[-1]) > 3
                if named and ("const" in h or ("final" in h and len(h) > 1 and h[-2] in ("int", "double", "num"))):
                    why = why or "const"
            if any(f.const and f.kind in ("list", "map") for f in stack):
                why = why or "const"
            numbers.append({"line": t.line, "value": t.text, "is_const": why is not None})
            continue
        if t.text.strip("r'\"") in addresses and any(x.text in ("import", "export", "part", "library") for x in code[inner.begins : inner.begins + 1]):
            continue
        owner = next((d for d in reversed(scopes) if d.first <= t.line <= d.last), None)
        since = next((f.begins for f in reversed(stack) if f.kind == "block"), 0)
        if inner.kind == "map" and nxt == ":" and prev in ("{", ","):
            why = why or "map key"
        if any("const" in h or "String" in h[-3:-1] for h in heads):
            why = why or "const"
        if any(f.kind == "call" and "AppLocalizations" in f.target for f in stack):
            why = why or "translation"
        if any(f.kind == "call" and f.name == "RegExp" for f in stack):
            why = why or "pattern"
        if any(f.kind == "call" and (f.name in KEYS or f.label == "key") for f in stack):
            why = why or "key"
        if inner.kind == "index" and inner.at == i - 1 and nxt == "]":
            why = why or "index"
        if any(x.text == "throw" for x in code[since:i]):
            why = why or "thrown"
        if owner is not None and owner.name == "toString" and owner.owner is not None:
            why = why or "toString"
        if prev in ("==", "!=") or nxt in ("==", "!="):
            why = why or "compared"
        direct = inner.kind == "call" and (prev in ("(", ",") or (prev == ":" and inner.label) or code[i - 1].kind == "string") and (nxt in (")", ",") or code[i + 1].kind == "string")
        call = inner if direct else Frame("group", -1)
        log = call.name in PRINTS or call.name in LOGS or any(x in call.target.lower() for x in ("logger", "log"))
        widget = owner is not None and (parents.get(owner.owner) in WIDGETS or owner.name == "build" or any("Widget" in x.text for x in owner.head[: max(0, len(owner.head) - 1)] if x.kind == "name" and x.text != owner.name))
        strings.append({
            "line": t.line, "value": t.text, "bare": bare_text(t.text), "exempt": why, "printed": call.name == "print" and not call.target, "logged": bool(call.name) and log and not call.name[:1].isupper(),
            "output": bool(widget) and call.name[:1].isupper(), "property": call.label if direct and prev == ":" else None,
        })
    return strings, numbers


def scopes_of(line: int, code: list[Token], close: dict[int, int], declared: list[Declaration]) -> int:
    """The last line of what begins on a line: a comment there is good for all of it."""
    ends = [line, *(d.last for d in declared if d.first == line), *(code[b].last for a, b in close.items() if code[a].line == line)]
    return max(ends)


def facts(path: str, source: str) -> dict:
    """All facts of one file, from one pass over its text. A broken file has lines and nothing else."""
    lines = source.split("\n")
    row: dict = {"path": path, "loc": sum(bool(x.strip()) for x in lines), "comment_lines": 0, "broken": False, "has_main": False, "artifacts": [], "strings": [], "numbers": [], "imports": [], "used": [], "directives": [], "members": [], "listed": [], "widget_texts": [], "excused": [], "test_cases": 0}
    row["listed"] = [{"line": k + 1, "token": w.lower()} for k, x in enumerate(lines) if (m := _IGNORE.search(x)) for w in _DOMAIN.findall(m[1])]
    marked = [bool(EXCUSED.search(x)) for x in lines]
    row["excused"] = [k + 1 for k in range(len(lines)) if marked[k] or (k and marked[k - 1])]
    for m in _WIDGET_TEXT.finditer(source):
        line = source.count("\n", 0, m.start(2)) + 1
        if not lines[line - 1].lstrip().startswith("//"):
            row["widget_texts"].append({"line": line, "value": m[2]})
    try:
        every = tokens(source)
        code = _plain(every)
        close = _matches(code)
        declared = declarations(every)
    except Broken:
        blank = next((k for k, x in enumerate(lines) if x.strip() and not x.lstrip().startswith("//")), len(lines))
        row["directives"] = [{**d, "last": d["line"], "leading": d["line"] <= blank} for d in row["listed"]]
        return row | {"broken": True}
    begins = next((k for k, t in enumerate(every) if t.kind != "comment"), len(every))
    for k, t in enumerate(every):
        if t.kind == "comment" and (m := re.match(_IGNORE, t.text)):
            row["directives"] += [{"line": t.line, "last": scopes_of(t.line, code, close, declared), "token": w.lower(), "leading": k < begins} for w in _DOMAIN.findall(m[1])]
    row["comment_lines"] = comment_lines(every)
    row["imports"] = [{"kind": k, "uri": u} for k, u in directives(code)]
    row["strings"], row["numbers"] = literals(code, declared, {u for _, u in directives(code)})
    row["test_cases"] = test_cases(code)
    heads: dict[str, int] = {}
    for d in declared:
        if d.kind != "field":
            for name in {d.name.split(".")[-1], d.owner if "." in d.name else None} - {None}:
                heads[name] = heads.get(name, 0) + 1
    count: dict[str, int] = {}
    for t in code:
        if t.kind == "name":
            count[t.text] = count.get(t.text, 0) + 1
        elif t.kind == "string":
            for m in re.finditer(r"\$\{?([A-Za-z_]\w*)((?:\.\w+)*)", t.text):
                for w in [m[1], *m[2].split(".")]:
                    if w:
                        count[w] = count.get(w, 0) + 1
    row["used"] = sorted(w for w, n in count.items() if n > heads.get(w, 0) and w not in KEYWORDS)
    row["has_main"] = any(d.kind == "function" and d.name == "main" for d in declared)
    row["members"] = [{"ordinal": k, "kind": member_kind(d), "name": d.name.split(".")[-1], "owner": d.owner} for k, d in enumerate(declared) if d.owner is not None]
    for k, d in enumerate(declared):
        if d.kind in ("variable", "field"):
            continue
        inside = lines[d.first - 1 : d.last]
        row["artifacts"].append({
            "ordinal": k, "kind": d.kind, "name": d.name, "owner": d.owner, "parent": d.parent, "first": d.first, "last": d.last,
            "loc": sum(bool(x.strip()) for x in inside), "is_override": "override" in d.marks, "is_preview": "Preview" in d.marks,
            "is_abstract": not d.body, "is_public": not d.name.split(".")[-1].startswith("_"), "documented": d.documented,
            "is_complex": sum(bool(x.strip()) for x in lines[max(0, d.body_lines[0] - 1) : max(0, d.body_lines[1])]) >= 10, "commented": d.commented or d.documented,
            "signature": signature(d.head), "tokens": normalized(d.body) if d.kind != "class" and not d.arrow else [],
        })
    return row


def test_cases(code: list[Token]) -> int:
    """Calls of test and testWidgets: names before a parenthesis that are neither members nor declared there."""
    found = 0
    for i, t in enumerate(code[:-1]):
        if t.kind == "name" and t.text in ("test", "testWidgets") and code[i + 1].text == "(":
            before = code[i - 1] if i else None
            found += before is None or not (before.text in (".", "?.", "..") or (before.kind == "name" and before.text not in ("return", "await", "else", "do")))
    return found


def member_kind(d: Declaration) -> str:
    """What a class member is for its place: field, accessor, method, or other, such as a constructor."""
    if d.kind in ("field", "constructor"):
        return "field" if d.kind == "field" else "other"
    words = [t.text for t in d.head]
    opens = words.index("(") if "(" in words else len(words)
    accessor = any(w in ("get", "set") and k + 1 < len(words) and words[k + 1] == d.name for k, w in enumerate(words[:opens]))
    return "accessor" if accessor else "method"
