"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of those of its nested field paths that any mapping reads; what stands below such a path
counts as the path itself, and other fields (ids, sources, scores, names) don't count. Fingerprints select declarative
mappings, which turn prompt, instruction and message layouts into canonical turns (role, text). Records that no mapping
fits are kept, with their fingerprint: ``layouts_seen`` counts them and ``unmatched`` gives them. The template marks each
turn,

    <turn ROLE>
    TEXT</turn>

and escapes backslashes and angle brackets inside roles and texts, so neither can hold a marker and all is read back
exactly. The loss mask is a list of spans of the formatted string: the texts of the assistant's turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
#: Roles as layouts that give a turn's sender (from, value) name them; everywhere else a role stands as it is.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths: a.b for fields, [] for list elements; the layout alone, not the values."""
    if isinstance(value, dict):
        return set().union(*[paths(v, f"{at}.{k}" if at else k) for k, v in value.items()]) if value else {at}
    if isinstance(value, list):
        return set().union(*[paths(v, f"{at}[]") for v in value]) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """turns: (role, path) for each turn in order; or each: (path of a list, role path, text path), after any turns.

    Paths are nested by dots. Several paths for one turn make one text, joined by newlines. optional: paths that may be missing.
    """

    name: str
    turns: tuple[tuple[str, str | tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = field(default=())

    def paths(self) -> set[str]:
        found = {f for _, x in self.turns for f in ((x,) if isinstance(x, str) else x)}
        if self.each:
            rows, role, text = self.each
            found |= {f"{rows}[].{role}", f"{rows}[].{text}"} if rows else {role, text}
        return found

    def fingerprints(self) -> list[str]:
        found = [self.paths() - set(self.optional)]
        for extra in self.optional:
            found += [s | {extra} for s in found]
        if self.each and self.each[0]:  # an empty list has no fields
            found += [(s - {f for f in s if f.startswith(f"{self.each[0]}[].")}) | {f"{self.each[0]}[]"} for s in found]
        return [fingerprint(s) for s in found]


LAYOUTS = (
    Layout("turn", each=("", "role", "text")),
    Layout("messages", (("system", "system"),), each=("messages", "role", "content"), optional=("system",)),
    Layout("nested_messages", each=("conversation.messages", "author.role", "content.parts")),
    Layout("conversations", (("system", "system"),), each=("conversations", "from", "value"), optional=("system",)),
    Layout("prompt", (("user", "prompt"),)),
    Layout("response", (("assistant", "response"),)),
    Layout("prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("prompt_completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("question_answer", (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", (("system", "system"), ("user", ("instruction", "input")), ("assistant", "output")), optional=("system", "input")),
    Layout("instruction_response", (("system", "system"), ("user", ("instruction", "context")), ("assistant", "response")), optional=("system", "context")),
)


class Registry(dict):
    """Layout by fingerprint, and the paths that any of them reads."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        super().__init__((f, x) for x in layouts for f in x.fingerprints())
        self.read = set().union(*[x.paths() for x in layouts]) | {f"{x.each[0]}[]" for x in layouts if x.each and x.each[0]}

    def bearing(self, found: set[str]) -> set[str]:
        """Those paths that a mapping reads; a path below one of them stands for it, an empty list for itself."""
        kept = set()
        for path in found:
            while path:
                if path in self.read and (not path.endswith("[]") or path in found):
                    kept.add(path)
                    break
                cut = max(path.rfind("."), path.rfind("[]"))
                path = path[: max(0, cut)]
        return kept


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> Registry:
    return Registry(layouts)


def _at(value: object, path: str) -> object:
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    """A list of parts is joined by newlines, each its text; any other value that isn't a string stands as JSON."""
    if isinstance(value, list) and value:
        return "\n".join(_text(v["text"]) if isinstance(v, dict) and "text" in v else _text(v) for v in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: object, known: Registry) -> tuple[str | None, str | None, list[tuple[str, str]]]:
    """The record's fingerprint (None if it isn't an object), its layout (None if no mapping has it) and canonical turns; null texts are empty."""
    if not isinstance(record, dict):
        return None, None, []
    print_ = fingerprint(known.bearing(paths(record)))
    layout = known.get(print_)
    if not layout:
        return print_, None, []
    found = []
    for role, names in layout.turns:
        values = [_at(record, n) for n in ((names,) if isinstance(names, str) else names)]
        optional = all(n in layout.optional for n in ((names,) if isinstance(names, str) else names))
        if not (optional and all(v is None for v in values)):
            texts = [_text(v) for v in values]
            found.append((role, "\n".join(t for t in texts if t) if len(texts) > 1 else texts[0]))
    if layout.each:
        rows, role, text = layout.each
        found += [(_text(_at(r, role)), _text(_at(r, text))) for r in ((_at(record, rows) or []) if rows else [record])]
    named = ROLES if layout.each and layout.each[1] == "from" else {}
    return print_, layout.name, [(named.get(r, r), t) for r, t in found]


def canonical_turns(records: DataFrame, payload: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns (array of role and text) to records whose column payload holds a JSON record.

    Every record stays: a null or broken payload, or one that isn't an object, has a null fingerprint, a null layout and no
    turns, one of unknown layout its fingerprint, a null layout and no turns. Texts of any length are whole; repeated rows stay;
    an empty table gives an empty one. Columns called fingerprint, layout or turns are replaced, all others kept.
    """
    kept = [c for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    shape = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    at = kept.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(layouts)
        for batch in batches:
            prints, names, turns = [], [], []
            for value in batch.column(at).to_pylist():
                try:
                    record = json.loads(value) if value else None
                except ValueError:
                    record = None
                print_, name, found = turns_of(record, known)
                prints.append(print_)
                names.append(name)
                turns.append([{"role": r, "text": t} for r, t in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string()), pa.array(names, pa.string()), pa.array(turns, shape)], names=[*kept, "fingerprint", "layout", "turns"])

    added = "fingerprint string, layout string, turns array<struct<role: string, text: string>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*kept).schema)
    return records.select(*kept).mapInArrow(run, f"{schema}, {added}")


def layouts_seen(turns: DataFrame) -> DataFrame:
    """fingerprint, layout and records of each layout in what canonical_turns gives: null layouts need a mapping."""
    return turns.groupBy("fingerprint", "layout").agg(F.count("*").alias("records"))


def unmatched(turns: DataFrame) -> DataFrame:
    """The records that no mapping fits, whole; format_conversations leaves them out, as they have no turns."""
    return turns.where("layout is null")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*+)>\n((?:[^\\<>]|\\.)*+)</turn>\n", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role)}>\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string; ValueError if it isn't one."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn and turns (as canonical_turns gives them) -> conv_id, formatted, loss_spans.

    A conversation's rows go by turn (null first), then role and text, so that ties and repeated rows have one order and
    all stay. It becomes one string and so one row, held by one task, however long; other conversations don't wait for it.
    Rows with a null conv_id are one conversation. Empty texts are turns; records without turns give none. An empty table
    gives an empty one; other columns are dropped, whatever their names.
    """
    listed = turns.select("conv_id", "turn", F.posexplode("turns").alias("k", "t")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63))).alias("turn"), "k", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text")))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render([(r["role"], r["text"]) for r in rows.as_py()]) for rows in batch.column(1)]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in made], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "loss_spans"])

    return listed.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted and loss_spans, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                lost = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
