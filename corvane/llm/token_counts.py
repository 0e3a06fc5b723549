"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text over ``chunk`` bytes is encoded in chunks that overlap. Each chunk gives the end offset of every token. Two
neighbours are spliced at an offset where both end a token and where the split is proven: a character that isn't
white space followed by ASCII white space. No alternative of the pre-tokenizer's pattern runs on from a character that
isn't white space into white space, so the tokenizer splits there whatever stands further left or right, and what
follows is encoded the same from there as in the whole text. If the overlap holds no such offset, it's widened, and at
last the chunk itself is, up to the end of the text; so the count always equals that of the whole text.

Long runs of white space hold no such offset, and the pattern engine's stack doesn't stand them. They are cut by the pattern's
own rule instead: all of a run but its last character is one piece, or the whole run where the text, or a special string,
follows at once.

Memory is bounded by the text and one chunk's ids. A text is one row and so one task's work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

SPACE = frozenset(b"\t\n\x0b\x0c\r ")
#: Characters from which a run of white space is cut off by itself; texts of fewer go to the engine as they are.
LONG_RUN = 1 << 14
#: Fixed value: the characters that the pattern's \\s stands for (Unicode's White_Space).
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++")


class Encoder:
    """Byte-level BPE of byte_bpe_50k, by the same vocabulary as ranks, which is several times as fast as the .json file."""

    def __init__(self, ranks_path: str, special: dict[str, int], pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("corvane", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        for token, i in special.items():
            self.sizes[i] = len(token.encode())

    def ids(self, text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return self._engine(text)
        found, at = [], 0
        for run in RUN.finditer(text):
            if run.end() - run.start() >= LONG_RUN:
                ends = run.end() == len(text) or any(text.startswith(s, run.end()) for s in self.special)
                cut = run.end() - (not ends)
                found += self._engine(text[at : run.start()])
                found += self.core._core_bpe.encode_single_piece(text[run.start() : cut].encode())
                at = cut
        return found + self._engine(text[at:])

    def _engine(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special=self.special, disallowed_special=())


LEAST_CHUNK = 64
#: Every proven offset stands after the first byte of such a pair.
MAY_BE_PROVEN = re.compile(rb"[!-~\x80-\xff][\t-\r ]")


def proven(data: bytes, at: int) -> bool:
    """Whether every encoding of any text around it splits before data[at]."""
    if not 0 < at < len(data) or data[at] not in SPACE:
        return False
    before = data[at - 1]
    if before < 0x80:
        return 0x20 < before < 0x7F
    last = data[max(0, at - 4) : at].decode(errors="ignore")[-1:]
    return bool(last) and not last.isspace()


def _whole(data: bytes, at: int) -> int:
    """The next start of a character at or before at."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def spliced_count(ids: Callable[[str], list[int]], sizes: np.ndarray, text: str, chunk: int, overlap: int) -> int:
    """Tokens of text, as ids() gives them for the whole of it."""
    data = text.encode()
    if len(data) <= chunk:
        return len(ids(text))

    def ends(a: int, b: int) -> np.ndarray:
        return a + np.cumsum(sizes[np.asarray(ids(data[a:b].decode()), np.int64)])

    total, done, end = 0, 0, _whole(data, chunk)
    held = ends(0, end)
    while end < len(data):
        width = overlap
        while True:
            start = _whole(data, max(done, end - width))
            stop = _whole(data, min(len(data), start + max(chunk, 2 * width)))
            cut = None
            if MAY_BE_PROVEN.search(data, start, min(len(data), end + 1)):
                new = ends(start, stop)
                common = np.intersect1d(held[(held > start) & (held < end)], new, assume_unique=True)
                cut = next((int(p) for p in common[::-1] if proven(data, int(p))), None)
            if cut is not None or start <= done:
                break
            width *= 2
        if cut is None:  # nothing in the whole chunk: make the chunk itself longer
            end = _whole(data, min(len(data), done + 2 * (end - done)))
            held = ends(done, end)
            continue
        total += int(np.searchsorted(held, cut, "right"))
        held, done, end = new[np.searchsorted(new, cut, "right") :], cut, stop
    return total + len(held)


def count_tokens(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, special: dict[str, int], pattern: str, chunk: int = 1 << 16, overlap: int = 1 << 9) -> DataFrame:
    """One row per row of docs: its id, n_bytes (UTF-8) and n_tokens.

    A null or empty text has 0 of both; special strings inside a text count as their one token; texts of any length are
    counted whole, also those of white space alone; repeated rows each give a row, also with null or equal ids; other
    columns are dropped, whatever their names. An empty table gives an empty one. chunk is in bytes, LEAST_CHUNK at least, and four
    overlaps at least, so that every chunk holds whole characters beside its overlap.
    """
    if chunk < LEAST_CHUNK or not 4 <= overlap <= chunk // 4:
        raise ValueError(f"a chunk needs {LEAST_CHUNK} bytes, an overlap 4 to a quarter of the chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, special, pattern)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(spliced_count(encoder.ids, encoder.sizes, text, chunk, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return lean(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
