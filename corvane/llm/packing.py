"""Packing by Karmarkar-Karp multiway differencing.

Documents are dealt to buckets of a few thousand rows by a hash of the row. In a bucket, every piece starts as a
partition of one filled window and otherwise empty ones; the two partitions with the largest spread are merged, the
fullest window of one with the emptiest of the other, so that imbalances cancel, until one partition is left. If its
fullest window is over capacity, the number of windows rises and the differencing is done again.

Texts are tokenized once, and only piece lengths and checksums move: a document's cuts depend on its own length alone.
Whole windows of a long document are cut off first and go to buckets of their own, a few thousand to each, with nothing
to even out; what remains is cut into at most ``grain`` tokens, small enough for the differencing. So a bucket's work has a
bound whatever the input, also if one document holds most of the tokens.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize

CAPACITY, GRAIN, BUCKET_ROWS, SHIFT = 2048, 512, 4096, 24
#: Texts with none of these are encoded by word; the others, by the library as a whole. Up to U+024F, no character composes with its
#: neighbours or lowers by context; U+001C to U+001F are white space to Python alone.
BEYOND_WORDS = re.compile("[^\x00-\x1b\x20-ɏ]|<\\|")
#: Fixed value: the tokenizer's own pattern for words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def difference(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window of each length, 0 to k - 1, by multiway differencing."""
    n = len(lengths)
    parent = np.full(2 * n, -1, np.int64)
    parts = {}
    heap = []
    for i in range(n):
        parts[i] = (lengths[i : i + 1].astype(np.int64), np.array([i], np.int64))
        heap.append((-int(lengths[i]) if k > 1 else 0, i))
    heapq.heapify(heap)
    nodes, name = n, n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        (sa, ga), (sb, gb) = parts.pop(a), parts.pop(b)
        both = len(sa) + len(sb) - k
        if both > 0:  # the smallest of one meet the largest of the other
            x, y = len(sa) - both, len(sb) - both
            new = np.arange(nodes, nodes + both)
            if nodes + both > len(parent):
                parent = np.concatenate([parent, np.full(len(parent) + both, -1, np.int64)])
            parent[ga[x:]], parent[gb[y:][::-1]] = new, new
            nodes += both
            sums = np.concatenate([sa[:x], sb[:y], sa[x:] + sb[y:][::-1]])
            groups = np.concatenate([ga[:x], gb[:y], new])
        else:
            sums, groups = np.concatenate([sa, sb]), np.concatenate([ga, gb])
        if both > 0 or sa[-1] < sb[0]:
            order = np.argsort(-sums, kind="stable")
            sums, groups = sums[order], groups[order]
        parts[name] = (sums, groups)
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), name))
        name += 1
    if not n:
        return np.zeros(0, np.int64)
    window = np.full(nodes, -1, np.int64)
    window[parts[heap[0][1]][1]] = np.arange(len(parts[heap[0][1]][1]))
    for i in range(nodes - 1, -1, -1):
        if window[i] < 0:
            window[i] = window[parent[i]]
    return window[:n]


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """As few evenly filled windows as the differencing finds for these lengths, none over capacity."""
    k = max(1, math.ceil(int(lengths.sum()) / capacity))
    while True:
        found = difference(lengths, k)
        if not len(lengths) or np.bincount(found, weights=lengths).max() <= capacity:
            return found
        k += max(1, k // 200)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it's printable, else the next free one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Words(dict):
    """Ids of each word, and of each run without white space, as little-endian 32-bit bytes; forgets all when it holds too many.

    Words are merged by a faster engine with the library's own vocabulary, the end of a word as a blank, which no word
    holds. It may join two parts to any token of the vocabulary, not just by that token's own merge. That's the same: once
    all merges of lower rank are done between two token boundaries, a token's text has one split left, which is that of
    its own merge as long as the library gives the token for its own text. Tests hold that for the vocabulary and for the words of the test tables.
    """

    def __init__(self, path: str, most: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.runs: dict[str, bytes] = {}
        self.core, self.most, self.find = Tokenizer.from_file(path), most, regex.compile(WORD).findall
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        vocabulary = self.core.get_vocab(with_added_tokens=False)
        ranks = {raw(t[:-4]) + b" " if t.endswith("</w>") and len(t) > 4 else raw(t): i for t, i in vocabulary.items() if not t.startswith("<|")}
        self.merge = tiktoken.Encoding("corvane-words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def bytes_of(self, text: str) -> bytes:
        return np.asarray(self.core.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = array("I", self.merge(word.encode() + b" ")).tobytes()
        return found

    def ids(self, text: str) -> bytes:
        if BEYOND_WORDS.search(text):
            return self.bytes_of(text)
        runs = text.lower().split()  # no word holds white space
        found = list(map(self.runs.get, runs))
        if None in found:
            if len(self.runs) >= 3 * self.most:
                self.runs.clear()
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self.runs[runs[k]] = b"".join(map(self.__getitem__, self.find(runs[k])))
        return b"".join(found)


END = (1).to_bytes(4, "little")
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int64())])


def cuts(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    whole = n // capacity * capacity
    rest = n - whole
    step = max(1, math.ceil(rest / max(1, math.ceil(rest / grain)))) if rest else 1
    return [(s, capacity) for s in range(0, whole, capacity)] + [(s, min(step, n - s)) for s in range(whole, n, step)]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text).

    A null or empty text is its end id alone; very long texts are cut into many pieces, none lost; repeated rows are packed
    each; extra columns are dropped; an empty table gives an empty one. sequence_id is the bucket's number, shifted by SHIFT bits, plus the window's.
    """
    n_buckets = max(1, math.ceil(docs.count() / bucket_rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, row, filled = Words(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = words.ids(value.as_py() or "") + END
                n = len(data) // 4
                row += 1
                bucket = zlib.crc32(b"%d/%d/%d" % (part, row, doc_id or 0)) % n_buckets
                for start, length in cuts(n, capacity, grain):
                    own = bucket
                    if length == capacity:
                        own = n_buckets + (part << 16) + filled // bucket_rows
                        filled += 1
                    for c, v in zip(columns, (doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, own), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PIECE)

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "start", "doc_tokens"], ascending=False, kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        whole = int((lengths == capacity).sum())
        window = np.concatenate([np.arange(whole), whole + windows(lengths[whole:], capacity)])
        order = np.argsort(window, kind="stable")
        rows, window, lengths = rows.iloc[order].reset_index(drop=True), window[order], lengths[order]
        before = np.cumsum(lengths) - lengths
        first = np.searchsorted(window, window, "left")
        return rows.drop(columns="bucket").assign(sequence_id=(np.int64(key[0]) << SHIFT) + window, offset=before - before[first])

    pieces = lean(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long")
    pieces = materialize(pieces, "packing-cuts")  # buckets follow rows' places in a task, which a task that's run again needn't keep
    return pieces.groupBy("bucket").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
