"""Removal of repeated byte strings with suffix arrays built by linear grouping.

The windows of LENGTH bytes are dealt to shards as in `windows`.  In a shard the segments are written as letters of WIDE
bytes, aligned at their anchors, and the suffix array of all segments is built in linear time: suffixes are
grouped by their Lyndon prefixes in descending order along previous-smaller pointers, then each
group's order is emitted in one ascending scan, with no recursion and no renaming.  Neighbours that share LETTERS
letters (all of a window but its ragged ends, eight bytes in all) form a group; an exact comparison of
the ends splits groups into equal windows, and the smallest id of each is what its documents are held against.

Letters of seven bytes make the array seven times shorter, and lose nothing: every window has six whole letters, at
the same places in all its occurrences because they share the anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table, tune
from .windows import LETTERS, WIDE, Cutter, judged, numbered, ragged, shard_count

LENGTH = 50
GRAM = 8


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes of numbers; the last must be smaller than all others.

    Phase 1 takes the groups from the highest down.  prev[i] is the nearest place left of i whose group is lower;
    places that are someone's prev move to new groups above the rest of theirs, those with more followers higher.
    A group's places are taken in ascending order; sorting them is all that isn't linear, and most groups have one place.
    When all are done, a group holds the suffixes with one Lyndon prefix.  Phase 2 scans the order upwards and
    puts the suffix before each one, and along its prev pointers all unplaced ones, next in their groups.
    """
    n = len(text)
    count = [0] * (max(text) + 1)
    for c in text:
        count[c] += 1
    start, total = [], 0
    for c in count:
        start.append(total)
        total += c
    fill, order, place, group = start[:], [0] * n, [0] * n, [0] * n
    size = [0] * (n + 1)
    for i, c in enumerate(text):
        f = fill[c]
        order[f], place[i], group[i] = i, f, start[c]
        fill[c] = f + 1
    for c, k in enumerate(count):
        if k:
            size[start[c]] = k
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        i = order[end]
        low = group[i]
        if low == end:  # a suffix by itself, as most are: the general step written out
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            end -= 1
            if p >= 0:
                g = group[p]
                s = size[g] - 1
                if s:
                    size[g] = s
                    e, at = g + s, place[p]
                    if e != at:
                        other = order[e]
                        order[e], order[at] = p, other
                        place[p], place[other] = e, at
                    group[p] = e
                    size[e] = 1
            continue
        followers: dict[int, int] = {}
        for i in sorted(order[low : end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                followers[p] = followers.get(p, 0) + 1
        if followers:
            levels: dict[int, list[int]] = {}
            for p, k in followers.items():
                levels.setdefault(k, []).append(p)
            for k in sorted(levels, reverse=True) if len(levels) > 1 else levels:
                moving = levels[k]
                for p in moving:
                    g = group[p]
                    s = size[g] - 1
                    size[g] = s
                    e, at = g + s, place[p]
                    other = order[e]
                    order[e], order[at] = p, other
                    place[p], place[other] = e, at
                above = [group[p] + size[group[p]] for p in moving]
                for p, s in zip(moving, above, strict=True):
                    group[p] = s
                    size[s] += 1
        end = low - 1
    out, fill = [0] * n, list(range(n))
    out[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    fill[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            done[j] = True
            g = group[j]
            f = fill[g]
            out[f] = j
            fill[g] = f + 1
            j = prev[j]
    return out


def solve(token: np.ndarray, begin: np.ndarray, count: np.ndarray, core: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest id that has it, for each window of LENGTH bytes of each segment."""
    padded = np.concatenate([token, np.zeros(64, np.uint8)])
    lead = core % WIDE
    letters = (count - lead) // WIDE
    first = np.cumsum(letters + 1) - (letters + 1)
    at = np.repeat(begin + lead, letters) + WIDE * ragged(np.zeros(len(letters), np.int64), letters)
    value = np.zeros(len(at), np.uint64)
    for k in range(WIDE):
        value = value << np.uint64(8) | padded[at + k].astype(np.uint64)
    text = np.ones(int((letters + 1).sum()), np.int64)  # 1 ends a segment, 0 the text
    inside = np.ones(len(text), bool)
    inside[first + letters] = False
    text[inside] = np.unique(value, return_inverse=True)[1] + 2
    text[-1] = 0
    order = np.array(suffix_array(text.tolist()), np.int64)
    text = np.concatenate([text, np.zeros(LETTERS, np.int64)])
    same = np.ones(len(order) - 1, bool)
    for k in range(LETTERS):
        x, y = text[order[1:] + k], text[order[:-1] + k]
        same &= (x == y) & (x > 1)
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~same)])
    windows = count - LENGTH + 1
    seg = np.repeat(np.arange(len(count)), windows)
    p = ragged(np.zeros(len(count), np.int64), windows)
    ragged_left = (lead[seg] - p) % WIDE
    own = group[first[seg] + (p + ragged_left - lead[seg]) // WIDE] * 8 + ragged_left
    b = begin[seg] + p
    ends = np.zeros(len(seg), np.uint64)
    for k in range(LENGTH - WIDE * LETTERS):
        ends = ends << np.uint64(8) | padded[b + k + WIDE * LETTERS * (k >= ragged_left)].astype(np.uint64)
    by = np.lexsort((ends, own))
    new = np.concatenate([[True], (own[by][1:] != own[by][:-1]) | (ends[by][1:] != ends[by][:-1])])
    least = np.minimum.reduceat(low[seg][by], np.flatnonzero(new))
    out = np.empty(len(seg), np.int64)
    out[by] = least[np.cumsum(new) - 1]
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay), a row for each of docs.

    A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller id.  Null
    texts are empty; texts shorter than LENGTH stay whole.  Rows that share an id don't remove from each other; each
    keeps its own row.  Rows with a null id stay as they are and remove nothing.  Other columns are left out.
    """
    rows = numbered(docs, id_col, text_col)
    cutter = Cutter(LENGTH, GRAM, False, shard_count(rows))
    return judged(rows, cutter, solve, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def finish(raw: bytes, gone: np.ndarray | None) -> tuple:
    """(bytes, bytes that go, runs that go, digest of what stays, what stays)."""
    if gone is None:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(kept).hexdigest(), kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS g FROM (SELECT *, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0))) AS i FROM d)),
m AS (SELECT rid, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS dup FROM w),
b AS (SELECT rid, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT *, unnest(range(0, length(h) // 2)) AS i FROM d)),
c AS (SELECT rid, i, x, coalesce(max(dup::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), 0) AS gone FROM b LEFT JOIN m USING (rid, i)),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), 0) = 0 AS opens FROM c),
r AS (
  SELECT rid, sum(gone)::BIGINT AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM s GROUP BY rid
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""
