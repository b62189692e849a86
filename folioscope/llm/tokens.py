"""Byte-level BPE encoding of whole corpora (problem 7).

Method: batched numpy merge rounds. A text is cut into words by the vocabulary's pattern. Words
that the task hasn't seen are encoded together: the symbols of all of them lie in one flat array,
every round looks all adjacent pairs up by binary search over the sorted pair keys, takes in each
word the leftmost pair of lowest rank, and merges it. Words without a mergeable pair leave the
array. Encoded words stay in a table of the task, so that a word costs one dictionary look-up
after its first occurrence; the table is emptied when it exceeds ``TABLE_WORDS``, which changes no
result. Words of more than ``LONG_WORD`` bytes, for which a round per merge would be quadratic,
are merged with a heap in the same order.

Defined results: null and empty texts give no ids; the strings of special tokens are ordinary
text; repeated rows are encoded each; ties cannot occur, since ranks are distinct and positions
break them leftmost first.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern of the vocabulary that cuts text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG_WORD = 256
TABLE_WORDS = 400_000
CHUNK_CHARS = 2_000_000
_NONE = np.int64(1 << 40)


class ByteBpe:
    """An encoder over one rank file; lives as long as its task."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.words = regex.compile(PATTERN).findall
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.merged = np.array(merged, dtype=np.int64)[order]
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by rounds over all words at once."""
        out: list[np.ndarray | None] = [None] * len(words)
        for k, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[k] = np.array([r], dtype=np.int32)
            elif len(w) > LONG_WORD:
                out[k] = np.array(self._merge_long(w), dtype=np.int32)
        todo = np.array([k for k, x in enumerate(out) if x is None], dtype=np.int64)
        sizes = np.array([len(words[k]) for k in todo], dtype=np.int64)
        symbols = self.base[np.frombuffer(b"".join(words[k] for k in todo), dtype=np.uint8)]
        while len(todo):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            ranks = np.full(len(symbols), _NONE)
            ranks[:-1] = self._pair_ranks(symbols[:-1], symbols[1:])
            ranks[ends - 1] = _NONE  # no pair across words
            least = np.minimum.reduceat(ranks, starts)
            live = least < _NONE
            for k in np.nonzero(~live)[0]:
                out[todo[k]] = symbols[starts[k] : ends[k]].astype(np.int32)
            hits = np.nonzero((ranks == np.repeat(least, sizes)) & np.repeat(live, sizes))[0]
            word = np.searchsorted(ends, hits, side="right")
            at = hits[np.r_[True, word[1:] != word[:-1]]] if len(hits) else hits  # the leftmost of each word
            symbols[at] = ranks[at]
            keep = np.repeat(live, sizes)
            keep[at + 1] = False
            symbols, todo, sizes = symbols[keep], todo[live], sizes[live] - 1
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] else -1
            if j < 0 or len(part[i]) + len(part[j]) != size:
                continue  # one side has changed since
            part[i], part[j] = part[i] + part[j], b""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
        return [self.ranks[p] for p in part if p]

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if not new:
            return
        ids = self.merge([w.encode() for w in new])
        sizes = np.array([len(x) for x in ids], dtype=np.int32)
        self.index.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids per text, and all ids one after the other (None if only the sizes are wanted)."""
        if len(self.index) > TABLE_WORDS:
            self._clear()
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            if t:
                w = self.words(t)
                counts[k] = len(w)
                words += w
        self._learn(set(words))
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        sizes = self.sizes[at].astype(np.int64)
        total = np.r_[0, np.cumsum(sizes)]
        ends = np.cumsum(counts)
        per_text = total[ends] - total[ends - counts]
        if not ids:
            return per_text, None
        source = np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(total[-1])
        return per_text, self.flat[source]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for k, t in enumerate(texts):
        if chars and chars + len(t or "") > CHUNK_CHARS:
            yield start, k
            start, chars = k, 0
        chars += len(t or "")
    yield start, len(texts)


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>) of every row. ``tokenizers`` is the folder of the rank files on the executors."""
    path = f"{tokenizers}/{vocabulary}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for b in batches:
            bpe = bpe or ByteBpe(path)
            texts = b.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                sizes, ids = bpe.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], names=["id", "ids"])

    out = df.select(df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{text_col}`"].alias("text")).mapInArrow(encode, "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens long) of every row; the ids themselves are not built."""
    path = f"{tokenizers}/{vocabulary}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for b in batches:
            bpe = bpe or ByteBpe(path)
            texts = b.column(1).to_pylist()
            sizes = np.concatenate([bpe.encode(texts[lo:hi], ids=False)[0] for lo, hi in _chunks(texts)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes)], names=["id", "n_tokens"])

    out = df.select(df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{text_col}`"].alias("text")).mapInArrow(count, "id long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
