"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans (kinds below). The field adds spans that the patterns miss, such as a number inside a longer run
of digits whose twin elsewhere was found. Its nodes are the tokens that hold a digit or an @; each has a label, O or a
kind. A node's own potential comes from its shape; neighbours in the text share a transition potential (the chain); tokens
that are equal, or similar once separators, case and trailing digits are left out, share an agreement potential however
far apart they are (the skips). All members of such a set are tied to one node of their own, so messages are linear in
the tokens. Loopy message passing with damping then gives each token's marginal. Tokens and messages are arrays, some 150
bytes for each token however often it recurs, and messages are sent CHUNK edges at a time.

Potentials are trained here, on the whole table: the patterns' labels are counted by shape, by transition and by agreement,
in tables of fixed size, with sums on every task; tokens that no pattern took but that could be of a kind by themselves
have no label and aren't counted. Tokens that a pattern has labelled are clamped while inferring.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is none
SHAPES = 4096
ROUNDS, DAMPING, SURE, CLAMP = 8, 0.5, 0.9, 12.0
#: Edges whose messages are computed at once.
CHUNK = 1 << 16
#: Longest card: 19 digits, 18 separators.
CARD_CHARS = 37

_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]+")
_OTHER = re.compile(r"[^0-9]+")
EDGES = ".,;:!?\"'[]<>|{}"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def octet(digits: str) -> bool:
    s = digits.lstrip("0")
    return len(s) < 3 or len(s) == 3 and int(s) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted. Each kind's matches are leftmost and don't overlap; those that fail its test are dropped."""
    if not _TRIGGER.search(text):
        return []
    found = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
        low = domain.end() if domain else at + 1
        at = text.find("@", low)
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > CARD_CHARS:
            continue
        digits = _OTHER.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= _count_digits(m[0]) <= 15]
    return sorted(found)


def _count_digits(text: str) -> int:
    data = text.encode()
    return len(data) - len(data.translate(None, b"0123456789"))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@dataclass
class Tokens:
    """A text's tokens as columns: where they stand, place among all tokens, shape, label by the base spans, and the number of
    the set of equal (key) and of similar (like) ones that each is in, -1 where it's alone."""

    start: np.ndarray
    end: np.ndarray
    place: np.ndarray
    shape: np.ndarray
    label: np.ndarray
    key: np.ndarray
    like: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def sets(hashes: np.ndarray) -> np.ndarray:
    """Numbers from 0 for values that stand more than once; -1 for those that don't, and for 0."""
    out = np.full(len(hashes), -1, np.int32)
    order = np.argsort(hashes, kind="stable")
    value = hashes[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(value)))
    many = (size > 1) & (value[first] != 0)
    number = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
    out[order] = np.repeat(number, size)
    return out


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1


def shape_of(token: str) -> str:
    """Letters as a, digits as their number, the rest as it is; for numbers as long as a card's, whether they pass its test."""
    some = re.sub(r"[^\W\d_]+", "a", token)
    some = re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}" if len(m[0]) < 24 else "9x", some)
    digits = _OTHER.sub("", token)
    return some + ("L" if luhn(digits) else "l") * (13 <= len(digits) <= 19)


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    """The tokens that hold a digit or an @, without marks at their edges.

    Equal: addresses but for case, numbers of six digits or more but for separators, all else as it stands. Similar: addresses but
    for digits before the @, numbers of twelve digits or more with the same first eight (one issuer's). Sets are told by 64-bit hashes.
    """
    start, end, place, shape, label, key, like = (array(c) for c in "qqqHbQQ")
    b = 0
    for at, m in enumerate(_TOKEN.finditer(text)):
        word = m[0]
        if not _TRIGGER.search(word):
            continue
        core = word.strip(EDGES)
        first = m.start() + len(word) - len(word.lstrip(EDGES))
        last = first + len(core)
        while b < len(base) and base[b][2] <= first:
            b += 1
        own = 0
        for s, k, e in islice(base, b, None):  # sorted by their beginnings
            if s >= last:
                break
            if e > first:
                own = k + 1
                break
        plain = core.isascii() and core.isdigit() and len(core) < 13
        digits = core if plain else _OTHER.sub("", core)
        mail = "@" in core
        start.append(first)
        end.append(last)
        place.append(at)
        shape.append(zlib.crc32((f"9{len(core)}" if plain else shape_of(core)).encode("utf-8", "surrogatepass")) % SHAPES)
        label.append(own)
        key.append(_hash(core.lower() if mail else digits if len(digits) >= 6 else core))
        like.append(_hash(re.sub(r"[0-9.]+(?=@)", "", core.lower())) if mail else _hash(digits[:8]) if len(digits) >= 12 else 0)
    whole = lambda a, kind: np.frombuffer(a, kind) if len(a) else np.zeros(0, kind)
    return Tokens(whole(start, np.int64), whole(end, np.int64), whole(place, np.int64), whole(shape, np.uint16), whole(label, np.int8), sets(whole(key, np.uint64)), sets(whole(like, np.uint64)))


@dataclass
class Field:
    """Log potentials: by shape and label, by neighbouring labels, and for agreement."""

    own: np.ndarray
    step: np.ndarray
    agree: float

    @staticmethod
    def trained(shape: Counter, step: Counter, agree: Counter) -> Field:
        own = np.full((SHAPES, LABELS), 0.01)
        own[:, 0] = 0.5
        for (s, label), n in shape.items():
            own[s, label] += n
        move = np.full((LABELS, LABELS), 1.0)
        for (a, b), n in step.items():
            move[a, b] += n
        joint = move / move.sum()
        ratio = np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
        odds = (agree[1] + 1) / (agree[0] + 1)
        return Field(np.log(own / own.sum(1, keepdims=True)), np.clip(ratio, -2, 2), float(np.clip(math.log(odds), 0.5, 3.0)))

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """A row for each token: the probability of each label."""
        n = len(tokens)
        ties = [(np.flatnonzero(ids >= 0), ids[ids >= 0], float(self.agree * weight), int(ids.max(initial=-1)) + 1) for ids, weight in ((tokens.key, 1.0), (tokens.like, 0.5))]
        link = np.flatnonzero(tokens.place[1:] == tokens.place[:-1] + 1)
        # Messages in both directions of each edge, against label 0's, which is left out.
        room = lambda edges: np.zeros((2, len(edges), LABELS - 1), np.float32)
        chain, skip = room(link), [room(members) for members, *_ in ties]
        for r in range(ROUNDS + 1):
            belief = np.empty((n, LABELS), np.float32)
            for low in range(0, n, CHUNK):
                some = slice(low, low + CHUNK)
                belief[some] = self.own[tokens.shape[some]]
                marked = np.flatnonzero(tokens.label[some])
                belief[low + marked, tokens.label[some][marked]] += CLAMP
            for low in range(0, len(link), CHUNK):
                some = slice(low, low + CHUNK)
                belief[link[some] + 1, 1:] += chain[0, some]
                belief[link[some], 1:] += chain[1, some]
            hubs = []
            for (members, hub, _, count), message in zip(ties, skip, strict=True):
                held = np.zeros((count, LABELS), np.float32)
                for low in range(0, len(members), CHUNK):
                    some = slice(low, low + CHUNK)
                    belief[members[some], 1:] += message[1, some]
                    np.add.at(held, (hub[some], slice(1, None)), message[0, some])
                hubs.append(held)
            if r == ROUNDS:
                break
            for low in range(0, len(link), CHUNK):
                some = slice(low, low + CHUNK)
                _exchange(chain[:, some], belief[link[some]], belief[link[some] + 1], self.step)
            for (members, hub, agree, _), message, held in zip(ties, skip, hubs, strict=True):
                table = np.eye(LABELS) * agree
                for low in range(0, len(members), CHUNK):
                    some = slice(low, low + CHUNK)
                    _exchange(message[:, some], belief[members[some]], held[hub[some]], table)
        for low in range(0, n, CHUNK):
            belief[low : low + CHUNK] = _normal(belief[low : low + CHUNK].astype(np.float64))
        return belief


def _exchange(message: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> None:
    """Renew the messages a -> b (message[0]) and b -> a (message[1]) of some edges from both ends' beliefs; table[i, j] for a's i and b's j."""
    sent = []
    for own, back, t in ((a, message[1], table), (b, message[0], table.T)):
        out = own.astype(np.float64)
        out[:, 1:] -= back
        new = np.log(np.exp(out - out.max(1, keepdims=True)) @ np.exp(t))
        sent.append(new[:, 1:] - new[:, :1])
    for k in range(2):
        message[k] = DAMPING * message[k] + (1 - DAMPING) * sent[k]


def _normal(log_p: np.ndarray) -> np.ndarray:
    p = np.exp(log_p - log_p.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def holds(kind: int, value: str) -> bool:
    """Whether a span that the field proposes can be of its kind at all."""
    digits = _OTHER.sub("", value)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", value))
    if kind == 1:
        parts = value.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and octet(p) for p in parts)
    if kind == 2:
        return not _DIGITS.sub("", value).strip(" -") and 14 <= len(digits) <= 19 and luhn(digits)
    return not _DIGITS.sub("", value).strip(" ().+-") and 10 <= len(digits) <= 15 and any(c in value for c in "+(")


def added_spans(text: str, base: list[tuple[int, int, int]], tokens: Tokens, field: Field) -> list[tuple[int, int, int]]:
    """Runs of neighbouring tokens of one kind, surely so by their marginals, that no base span touches."""
    if not len(tokens):
        return []
    p = field.marginals(tokens)
    label = p.argmax(1)
    likely = np.flatnonzero((label > 0) & (tokens.label == 0) & (p.max(1) >= SURE))
    del p
    begins = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    found, i = [], 0
    while i < len(likely):
        k = int(label[likely[i]])
        j = i + 1
        while k == 4 and j < len(likely) and likely[j] == likely[j - 1] + 1 and tokens.place[likely[j]] == tokens.place[likely[j - 1]] + 1 and label[likely[j]] == k:
            j += 1
        start, end = int(tokens.start[likely[i]]), int(tokens.end[likely[j - 1]])
        before = bisect_left(begins, end)  # base spans that begin before this one ends
        if holds(k - 1, text[start:end]) and not (before and reach[before - 1] > start):
            found.append((start, k - 1, end))
        i = j
    return found


COUNTS = "kind int, a int, b int, n long"


def train(docs: DataFrame) -> Field:
    """Count the patterns' labels over all of docs (text). The result has at most SHAPES * LABELS numbers, and a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if text and _TRIGGER.search(text):
                    tokens = tokens_of(text, base_spans(text))
                    label = tokens.label.astype(np.int64)
                    told = label > 0
                    for i in np.flatnonzero(~told).tolist():
                        own = text[tokens.start[i] : tokens.end[i]]
                        told[i] = not any(holds(k, own) for k in range(len(KINDS)))
                    step = np.flatnonzero(told[1:] & told[:-1] & (tokens.place[1:] == tokens.place[:-1] + 1))
                    for kind, pairs in ((0, tokens.shape[told].astype(np.int64) * LABELS + label[told]), (1, label[step] * LABELS + label[step + 1])):
                        for pair, n in zip(*np.unique(pairs, return_counts=True), strict=True):
                            seen[kind, int(pair) // LABELS, int(pair) % LABELS] += int(n)
                    held = tokens.key >= 0
                    groups = np.bincount(tokens.key[held].astype(np.int64) * LABELS + label[held], minlength=LABELS * (int(tokens.key.max(initial=-1)) + 1)).reshape(-1, LABELS)
                    marked = groups[groups[:, 1:].any(1)]
                    seen[2, 1, 0] += int((marked.max(1, initial=0) - 1).sum())
                    seen[2, 0, 0] += int((marked.sum(1) - marked.max(1, initial=0)).sum())
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "a", "b", "n"])

    counts: tuple[Counter, Counter, Counter] = Counter(), Counter(), Counter()
    for kind, a, b, n in lean(docs).select("text").mapInArrow(run, COUNTS).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        counts[kind][a if kind == 2 else (a, b)] += n
    return Field.trained(*counts)


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and added spans) of a text."""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, base
    return base, sorted(base + added_spans(text, base, tokens_of(text, base), field))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for each row of docs.

    A null text is an empty one; very long texts and tokens are read whole; repeated rows each give a row, also with null
    ids; an empty table gives an empty one; other columns are dropped, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            for value in batch.column(1):
                base, every = all_spans(value.as_py() or "", field)
                for k in range(4):
                    n[k].append(sum(s[1] == k for s in base))
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in n), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, by the first's kind."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs, column for column, with personal data in text masked.

    Null texts stay null, empty ones empty; very long ones are masked whole; repeated rows stay, each masked alike; an empty
    table gives an empty one; other columns are kept as they are, whatever their names.
    """
    field = train(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else masked(v, all_spans(v, field)[1]) for v in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return lean(docs).mapInArrow(run, docs.schema)
