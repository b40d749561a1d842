"""Removal of repeated word windows with a compressed FM-index for each shard.

The windows of LENGTH words are dealt to shards as in `windows`.  A shard indexes its segments: the
Burrows-Wheeler transform of their words by its runs, whose words are a wavelet tree of packed bits with counted blocks.  The segments of the
documents are then streamed against it by backward search, all in step, word by word from the right: a match grows by
one word, and at LENGTH words it is reported and cut back by one (its interval widened to that of LENGTH - 1
words), so the matching statistics, as far as the threshold, cost one step a word.  For each reported window the
smallest id among the documents in its interval is what its documents are held against.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table, tune
from .windows import WORD_BYTES, Cutter, judged, numbered, shard_count

LENGTH = 13
GRAM = 4


class WaveletTree:
    """Numbers below 2**levels as packed bit vectors, one for each level from the highest bit, with ranks."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels = max(1, int(values.max()).bit_length()) if self.n else 1
        self.words, self.counts, self.zeros = [], [], []
        x = values
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-self.n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])  # stable: zeros before ones
        every = np.arange(int(values.max()) + 2 if self.n else 1)
        self.begin = self._down(every, np.zeros(len(every), np.int64)).astype(np.int32)  # where each value's places start on the last level

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def _down(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            ones = self._ones(i, at)
            at = np.where(value >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before each place."""
        return self._down(value, at) - self.begin[value]


class FMIndex:
    """Segments of words; numbers from `ends` on are words, each smaller one ends its own segment.

    The Burrows-Wheeler transform is kept by its runs: a wavelet tree of the runs' words, where each run starts, and the summed
    lengths of each word's runs.  Segments that share words make long runs, so the index is smaller than the text; the suffix order
    is only needed to build it, and isn't kept.
    """

    def __init__(self, text: np.ndarray, ends: int, order: np.ndarray | None = None):
        order = suffix_order(text) if order is None else order
        symbol = np.where(text < ends, 0, text - ends + 1)
        last = symbol[order - 1]
        self.n = len(last)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbol))])
        self.starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]])[: self.n]).astype(np.int32)
        head = last[self.starts]
        self.head = head.astype(np.min_scalar_type(int(head.max()) if self.n else 0))
        self.tree = WaveletTree(head)
        lengths = np.diff(np.append(self.starts, self.n))
        by = np.argsort(head, kind="stable")
        self.lengths = np.concatenate([[0], np.cumsum(lengths[by])]).astype(np.int32)
        self.runs = np.concatenate([[0], np.cumsum(np.bincount(head, minlength=len(self.first)))]).astype(np.int32)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each word occurs in the transform before each place."""
        run = np.searchsorted(self.starts, at.astype(np.int32)) - 1  # the last run that starts before the place
        inside = np.maximum(run, 0)
        whole = self.tree.rank(symbol, inside)
        first = self.runs[symbol]
        out = self.lengths[first + whole].astype(np.int64) - self.lengths[first]
        return out + np.where((run >= 0) & (self.head[inside] == symbol), at - self.starts[inside], 0)

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one more word on the left."""
        start = self.first[symbol]
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return start + both[: len(low)], start + both[len(low) :]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """By doubling; segments' ends differ, so their sizes bound the rounds."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], text[order][1:] != text[order][:-1]]))
    step = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1) + np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
        order = np.argsort(key)
        s = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        step *= 2
    return order


class Shortest:
    """Classes of the suffix order by their first words: where each starts, and the smallest id in those by LENGTH words."""

    def __init__(self, text: np.ndarray, order: np.ndarray, ends: int, last: np.ndarray, low: np.ndarray):
        padded = np.concatenate([text, np.zeros(LENGTH, text.dtype)])
        same = np.ones(max(len(order) - 1, 0), bool)
        for k in range(LENGTH):
            x = padded[order[1:] + k]
            same &= (padded[order[:-1] + k] == x) & (x >= ends)
            if k == LENGTH - 2:
                self.short = np.append(np.flatnonzero(np.concatenate([[True], ~same])), len(order)).astype(np.int32)
        full = np.flatnonzero(np.concatenate([[True], ~same]))
        self.full, self.least = full.astype(np.int32), np.minimum.reduceat(low[np.searchsorted(last, order)], full)

    def report(self, at: np.ndarray) -> np.ndarray:
        return self.least[np.searchsorted(self.full, at.astype(np.int32), side="right") - 1]

    def cut(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of all that begins with the same LENGTH - 1 words."""
        c = np.searchsorted(self.short, at.astype(np.int32), side="right") - 1
        return self.short[c].astype(np.int64), self.short[c + 1].astype(np.int64)


def solve(token: np.ndarray, begin: np.ndarray, count: np.ndarray, core: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest id that has it, for each window of LENGTH words of each segment."""
    m = len(count)
    word = np.unique(token, return_inverse=True)[1]
    text = np.empty(len(token) + m, np.int64)
    last = np.cumsum(count + 1) - 1
    inside = np.ones(len(text), bool)
    inside[last] = False
    text[inside] = word + m
    text[last] = np.arange(m)
    order = suffix_order(text)
    index, classes = FMIndex(text, m, order), Shortest(text, order, m, last, low)
    del order, text
    # Backward search of all segments in step.
    windows = count - LENGTH + 1
    first = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    by = np.argsort(-count, kind="stable")
    begins, left, size = begin[by], count[by], np.zeros(m, np.int64)
    lo, hi = np.zeros(m, np.int64), np.full(m, index.n, np.int64)
    for t in range(int(count.max()) if m else 0):
        live = int(np.searchsorted(-left, -t))  # the segments with a word left
        place = left[:live] - 1 - t
        lo[:live], hi[:live] = index.back(word[begins[:live] + place] + 1, lo[:live], hi[:live])
        size[:live] += 1
        w = np.flatnonzero(size[:live] == LENGTH)
        if len(w):
            out[first[by[w]] + place[w]] = classes.report(lo[w])
            lo[w], hi[w] = classes.cut(lo[w])
            size[w] = LENGTH - 1
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a space), a row for each of docs.

    Words are the runs of anything but ASCII white space.  A word goes if LENGTH consecutive words cover it that
    also start in a document with a smaller id.  Null texts have no words; texts of fewer words stay whole.  Rows that share an
    id don't remove from each other; each keeps its own row.  Rows with a null id stay as they are and remove
    nothing.  Other columns are left out.  Words are compared by 64-bit hashes.
    """
    rows = numbered(docs, id_col, text_col)
    cutter = Cutter(LENGTH, GRAM, True, shard_count(rows))
    return judged(rows, cutter, solve, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def finish(raw: bytes, gone: np.ndarray | None) -> tuple:
    """(words, words that go, digest of what stays, what stays)."""
    words = WORD_BYTES.findall(raw)
    kept = b" ".join(words) if gone is None else b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + {LENGTH - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - {LENGTH - 2}, 1))) AS i FROM d)),
m AS (SELECT rid, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS dup FROM w),
b AS (SELECT rid, i, ws[i] AS x FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d)),
c AS (SELECT rid, i, x, coalesce(max(dup::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), 0) AS gone FROM b LEFT JOIN m USING (rid, i)),
r AS (SELECT rid, sum(gone)::BIGINT AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (rid)
"""
