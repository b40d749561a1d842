"""Exact comparison of all windows of L tokens across documents, shard by shard.

Every window has an anchor: the token gram of K tokens in it whose hash is least, the last one of equals.  Equal
windows have equal anchors at equal places, so consecutive windows with one anchor form a segment, and segments are
dealt to shards by the hash of their anchor: each shard can judge its windows for itself, whichever documents
they come from, and a document's windows are split over all shards.

Before the exchange equal segments of one chunk of texts become one.  Those with few occurrences carry them
along; the occurrences of crowded ones (license lines, copies) go to shards picked by chunk, and
meet the judgement of their text there.  So no shard gets more than a few entries a chunk for one text, however often it occurs.
Tokens travel as compressed columns of many segments, which costs the JVM a few rows instead of millions.

A shard returns for each window the smallest id of a document that has it.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import durable, loose, mix64, rolling

#: Bytes of texts that are hashed together, and that travel together, but for single texts that are longer.
CHUNK, FLUSH = 1_000_000, 8_000_000
#: Occurrences of a segment within a chunk that travel with it.
FEW = 4
#: Bytes of texts for each shard, and least number of shards.
SHARD_BYTES, LEAST_SHARDS = 5_000_000, 8
#: Shards that a chunk of texts is dealt to at once; more are dealt in two steps, by groups of shards first.
FAN = 4_096
#: Bytes of segments that the second step deals together.
REFLUSH = 32_000_000
#: Texts of the sample that common grams are counted in, bytes of each at most, and most common grams.
SAMPLE, SAMPLE_BYTES, COMMON = 500, 8_000, 4_096
#: Tokens that a shard solves at a time.
PIECE = 150_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0d]+")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, below the n-th."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, stop) of 64-bit values; equal stretches have equal ones wherever they are."""
    up, down = powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=total[1:])
    return mix64((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of bytes start and stop."""
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all stretches one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - start, size)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: numbers above the least, in the narrowest type, byte plane by byte plane."""
    out = []
    for x in arrays:
        if x.dtype == np.uint8 or not len(x):
            out.append((x, None, x.dtype.str))
            continue
        low = x.min()
        y = x - low
        y = y.astype(np.min_scalar_type(int(y.max())))
        out.append((np.ascontiguousarray(y.view(np.uint8).reshape(len(y), -1).T), low, x.dtype.str))
    return zstandard.compress(pickle.dumps(out, 5), 5)


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for planes, low, kind in pickle.loads(zstandard.decompress(blob)):
        if low is None:
            out.append(planes)
        else:
            y = np.ascontiguousarray(planes.T)
            out.append(y.view(f"u{y.shape[1]}").ravel().astype(kind) + low)
    return out


def anchored(grams: np.ndarray, valid: np.ndarray, width: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) of the runs of windows with one anchor.  valid: where a window starts; common: grams that come last."""
    n = len(valid)
    rank = mix64(grams) >> np.uint64(1)
    if len(common):
        seen = np.zeros(1 << 16, bool)
        seen[_slot(common)] = True
        at = np.flatnonzero(seen[_slot(grams)])
        at = at[np.isin(grams[at], common)]
        rank[at] |= np.uint64(1 << 63)
    low = (rank >> np.uint64(31)) << np.uint64(31) | (np.uint64((1 << 31) - 1) - np.arange(len(grams), dtype=np.uint64))
    size = 1
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    anchor = ((1 << 31) - 1) - (low[:n] & np.uint64((1 << 31) - 1)).astype(np.int64)
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, at
    own = anchor[at]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    return own[first], at[first], at[np.append(first[1:], len(at)) - 1]


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(_BASE)) >> np.uint64(48)


class Cutter:
    """Cuts chunks of texts into segments of bytes or words."""

    def __init__(self, length: int, gram: int, words: bool, shards: int):
        self.length, self.gram, self.words, self.shards = length, gram, words, shards
        self.per = 1 if shards <= FAN else math.isqrt(shards - 1) + 1  # shards of a group
        self.common = np.empty(0, np.uint64)

    def cut(self, ids: np.ndarray, base: np.ndarray, rows: list[bytes]) -> tuple[np.ndarray, ...]:
        """(bytes of the rows, and for each segment its shard, hash, first byte, bytes, anchor's token, id, place in its row)."""
        raw = np.frombuffer(b"\n".join([*rows, b""]), np.uint8)
        sizes = np.array([len(r) for r in rows], np.int64)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        if self.words:
            first, stop = word_bounds(raw)
            token = span_hashes(_BYTE[raw], first, stop)
            row_from = np.searchsorted(first, begin)
            counts = np.append(row_from[1:], len(first)) - row_from
        else:
            token, first, row_from, counts = _BYTE[raw], None, begin, sizes
        windows = np.maximum(counts - self.length + 1, 0)
        none = np.empty(0, np.int64)
        if not windows.sum():
            return raw, none, none.astype(np.uint64), none, none, none, none, none
        valid = np.zeros(len(token) - self.length + 1, bool)
        valid[ragged(row_from, windows)] = True
        grams = rolling(token, self.gram)
        anchor, a, last = anchored(grams, valid, self.length - self.gram + 1, self.common)
        z = last + self.length  # tokens [a, z) hold the windows that start at a ... last
        shard = (mix64(grams[anchor] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(self.shards)).astype(np.int64)
        row = np.searchsorted(row_from, a, side="right") - 1
        start, end = (first[a], stop[z - 1]) if self.words else (a, z)
        self.last_grams = grams[anchor]
        return raw, shard, span_hashes(token, a, z), start, end - start, anchor - a, ids[row], a - row_from[row] + base[row]

    def send(self, parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, bytes]]:
        """(shard, kind, columns) of several cuts; kind 0 has segments, kind 1 the occurrences of crowded ones."""
        at = np.cumsum([0, *(len(p[0]) for p in parts)])
        raw = np.concatenate([p[0] for p in parts])
        shard, same, start, size, core, doc, offset = (np.concatenate([p[i] + (n if i == 3 else 0) for p, n in zip(parts, at, strict=False)]) if i == 3 else np.concatenate([p[i] for p in parts]) for i in range(1, 8))
        if not len(shard):
            return
        order = np.argsort(same, kind="stable")  # equal segments in the order of the texts; they have one shard
        new = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        heads, group = order[new], np.cumsum(new) - 1
        times = np.bincount(group)
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        crowd = times > FEW
        pick = np.uint64(int.from_bytes(hashlib.blake2b(np.sort(doc).tobytes(), digest_size=8).digest(), "little"))
        meet = np.where(crowd, (mix64(same[heads] ^ pick) % np.uint64(self.shards)).astype(np.int64), -1)
        # In the order of the texts, numbers that follow each other are close and compress.
        by = np.argsort(heads)
        by = by[np.argsort(shard[heads[by]].astype(np.int32), kind="stable")]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        own = order[~crowd[group]]
        own = own[np.argsort(rank[group[~crowd[group]]], kind="stable")]
        heads, crowd, least, meet, kept = heads[by], crowd[by], least[by], meet[by], np.where(crowd, 0, times)[by]
        home, far = shard[heads], order[np.isin(group, np.flatnonzero(times > FEW))] if (times > FEW).any() else order[:0]
        per = self.per
        for i, j, columns in dealt(home // per, raw, start[heads], size[heads], core[heads], kept, doc[own], offset[own], least[crowd], meet[crowd]):
            yield (int(home[i]), 0, pack(*columns)) if per == 1 else (int(home[i]) // per, 5, pack(*columns, home[i:j]))
        if len(far):
            goal = (mix64(same[far] ^ pick) % np.uint64(self.shards)).astype(np.int64)
            for s in np.unique(goal // per).tolist():
                own = goal // per == s
                m = far[own]
                yield (s, 1, pack(same[m], doc[m], offset[m])) if per == 1 else (s, 6, pack(same[m], doc[m], offset[m], goal[own]))


def dealt(home: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray, core: np.ndarray, kept: np.ndarray, doc: np.ndarray, offset: np.ndarray, least: np.ndarray, meet: np.ndarray) -> Iterator[tuple[int, int, tuple]]:
    """(first, end, columns) of the segments of each home; segments are in the order of homes, kept is how many of doc and offset each has, and those with none have a least and a meet."""
    to, crowd = np.concatenate([[0], np.cumsum(kept)]), np.concatenate([[0], np.cumsum(kept == 0)])
    edges = np.flatnonzero(np.concatenate([[True], np.diff(home) != 0, [True]]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, many = slice(to[i], to[j]), slice(crowd[i], crowd[j])
        yield i, j, (raw[ragged(start[i:j], size[i:j])], size[i:j], core[i:j], kept[i:j], doc[own], offset[own], least[many], meet[many])


def redealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second step: rows for groups of shards as rows for shards; what is held at once is bounded, however large a group."""
    held: dict[int, list] = {5: [], 6: []}
    total = 0

    def flush():
        if held[5]:
            raw, size, core, kept, doc, offset, least, meet, shard = (np.concatenate([p[i] for p in held[5]]) for i in range(9))
            start, to, crowd = np.cumsum(size) - size, np.cumsum(kept) - kept, np.cumsum(kept == 0) - (kept == 0)
            by = np.argsort(shard, kind="stable")
            own, many = ragged(to[by], kept[by]), crowd[by][kept[by] == 0]
            for i, _, columns in dealt(shard[by], raw, start[by], size[by], core[by], kept[by], doc[own], offset[own], least[many], meet[many]):
                yield int(shard[by[i]]), 0, pack(*columns)
        if held[6]:
            same, doc, offset, goal = (np.concatenate([p[i] for p in held[6]]) for i in range(4))
            for s in np.unique(goal).tolist():
                yield s, 1, pack(same[goal == s], doc[goal == s], offset[goal == s])
        held[5], held[6] = [], []

    for batch in batches:
        for k, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            held[k].append(unpack(b))
            total += sum(x.nbytes for x in held[k][-1])
            if total >= REFLUSH:
                yield from emit(flush())
                total = 0
    yield from emit(flush())


def shard_count(docs: DataFrame) -> int:
    """Grows with the bytes of docs(text), which are counted: a planner's figure may be off by any factor."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    return max(LEAST_SHARDS, int(size) // SHARD_BYTES)


def common_grams(docs: DataFrame, cutter: Cutter) -> np.ndarray:
    """Grams that would anchor too many different segments for one shard, by a sample of SAMPLE texts; at most COMMON of them.

    They anchor a window only if it has no other gram.  The list is one for all tasks, so equal windows still have equal
    anchors, whatever it holds: the sample decides how even the shards are, never what is found.
    """
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("text").limit(SAMPLE).collect()  # SAMPLE * SAMPLE_BYTES at most
    if not rows:
        return np.empty(0, np.uint64)
    zeros = np.zeros(len(rows), np.int64)
    same = cutter.cut(zeros, zeros, [r["text"].encode() for r in rows])[2]
    if not len(same):
        return np.empty(0, np.uint64)
    grams, n = np.unique(cutter.last_grams[np.unique(same, return_index=True)[1]], return_counts=True)
    often = np.flatnonzero(n > max(8, int(n.sum()) // (4 * cutter.shards)))
    return np.sort(grams[often[np.argsort(-n[often], kind="stable")[:COMMON]]])


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bytes]]:
    for batch in batches:
        for i, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.cast(batch.column(2), pa.binary()), strict=True):
            yield i, b, t.as_py() or b""


def emit(rows, most: int = 64) -> Iterator[pa.RecordBatch]:
    """(shard, kind, columns) as Arrow batches."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    s, k, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], ["shard", "kind", "columns"])


def segments(docs: DataFrame, cutter: Cutter) -> DataFrame:
    """(shard, kind, columns) of docs(doc_id, base, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, base, rows, total, parts, held = [], [], [], 0, [], 0

        def cut():
            parts.append(cutter.cut(np.array(ids, np.int64), np.array(base, np.int64), rows))
            ids.clear(), base.clear(), rows.clear()

        for i, b, text in texts_of(batches):
            if rows and total + len(text) > CHUNK:
                cut()
                held, total = held + total, 0
                if held >= FLUSH:
                    yield from emit(cutter.send(parts))
                    parts, held = [], 0
            ids.append(i), base.append(b), rows.append(text)
            total += len(text)
        if rows:
            cut()
        if parts:
            yield from emit(cutter.send(parts))

    return docs.mapInArrow(run, "shard int, kind int, columns binary")


#: Gets the tokens, starts, sizes, anchors and smallest ids of segments; returns the smallest id for each of their windows.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Shard:
    """Judges the segments of one shard."""

    def __init__(self, cutter: Cutter, solve: Solver):
        self.cutter, self.solve = cutter, solve

    def judge(self, blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        """(shard, kind, columns): kind 2 has covered stretches by document, kind 3 judgements for crowded segments."""
        length = self.cutter.length
        parts, at = [], 0
        while blobs:  # part by part: hashes need many times the room of the tokens
            raw, size, core, times, doc, offset, crowd_least, crowd_meet = unpack(blobs.pop())
            token, begin, count, same, marks, owner, anchor = self.hashed(raw, size, core)
            crowd = times == 0
            least, meet = np.empty(len(size), np.int64), np.full(len(size), -1, np.int64)
            least[crowd], meet[crowd] = crowd_least, crowd_meet
            if len(doc):
                least[~crowd] = np.minimum.reduceat(doc, (np.cumsum(times) - times)[~crowd])
            parts.append((token, begin + at, count, core, same, marks, owner, least, meet, times, doc, offset, anchor))
            at += len(token)
        first_of = np.cumsum([0, *(len(p[1]) for p in parts)])
        token, begin, count, core, same, marks = (np.concatenate([p[i] for p in parts]) for i in range(6))
        owner = np.concatenate([p[6] + n for p, n in zip(parts, first_of, strict=False)])
        least, meet, times, doc, offset, anchor = (np.concatenate([p[i] for p in parts]) for i in range(7, 13))
        size = count
        del parts
        # One text, one segment.
        order = np.argsort(same, kind="stable")
        new = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        head = order[new]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        low = np.minimum.reduceat(least[order], np.flatnonzero(new))
        # More than one document: another chunk's, or more than one within a chunk.
        high = np.full(len(head), np.iinfo(np.int64).min)
        np.maximum.at(high, group, least)
        at = np.repeat(np.arange(len(size)), times)
        np.maximum.at(high, group[at], doc)
        many = high > low
        many[group[meet >= 0]] = True
        # Segments that may have a window in two documents: those of several, and those that share what any match must share.
        place = np.full(len(order), -1, np.int64)
        place[head] = np.arange(len(head))
        real = place[owner] >= 0
        m, o = marks[real], place[owner[real]]
        by = np.argsort(m, kind="stable")
        eq = m[by][1:] == m[by][:-1]
        keep = many.copy()
        keep[o[by][1:][eq]] = True
        keep[o[by][:-1][eq]] = True
        if not keep.any():
            return
        b, c = begin[head][keep], count[head][keep]
        windows = c - length + 1
        # Segments with different anchors have no window in common: small pieces stay within the processor's caches.
        piece = (anchor[head][keep] % np.uint64(max(1, int(c.sum()) // PIECE))).astype(np.int64)
        order = np.argsort(piece, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(piece[order]) != 0, [True]]))
        place, found = np.cumsum(windows) - windows, np.empty(int(windows.sum()), np.int64)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            m = order[i:j]
            found[ragged(place[m], windows[m])] = self.solve(token[ragged(b[m], c[m])], np.cumsum(c[m]) - c[m], c[m], core[head][keep][m].astype(np.int64), low[keep][m])
        first = np.full(len(head), -1, np.int64)
        first[keep] = np.cumsum(windows) - windows
        width = np.zeros(len(head), np.int64)
        width[keep] = windows
        # Occurrences that travelled along.
        g = group[at]
        own = width[g] > 0
        yield from stretches(found, first[g[own]], width[g[own]], doc[own], offset[own], length)
        wanted = np.flatnonzero((meet >= 0) & (width[group] > 0))
        for s in np.unique(meet[wanted]).tolist():
            m = wanted[meet[wanted] == s]
            w = width[group[m]]
            yield s, 3, pack(same[m], w, found[ragged(first[group[m]], w)])

    def hashed(self, raw: np.ndarray, size: np.ndarray, core: np.ndarray) -> tuple:
        """(tokens, starts, counts, hashes of the segments, marks, whose they are, hashes of the anchors) of one part.

        A mark is a hash of what a match shares with its twin whatever else it has: the anchor's gram
        for words, for bytes each stretch of six letters at the anchor's alignment.
        """
        if self.cutter.words:
            start = np.cumsum(size + 1) - (size + 1)
            spaced = np.full(len(raw) + len(size), 10, np.uint8)
            spaced[ragged(start, size)] = raw
            a, z = word_bounds(spaced)
            token = span_hashes(_BYTE[spaced], a, z)
            begin = np.searchsorted(a, start)
            count = np.append(begin[1:], len(a)) - begin
            anchor = rolling(token, self.cutter.gram)[begin + core]
            return token, begin, count, span_hashes(token, begin, begin + count), anchor, np.arange(len(size)), mix64(anchor)
        begin, count = np.cumsum(size) - size, size.astype(np.int64)
        value, w = _BYTE[raw], WIDE * LETTERS
        lead = core % WIDE
        n = np.maximum((count - lead - w) // WIDE + 1, 0)
        at = np.repeat(begin + lead, n) + WIDE * ragged(np.zeros(len(n), np.int64), n)
        k, a = len(begin), begin + core
        three = span_hashes(value, np.concatenate([begin, a, at]), np.concatenate([begin + count, a + self.cutter.gram, at + w]))
        return raw, begin, count, three[:k], three[2 * k :], np.repeat(np.arange(len(size)), n), three[k : 2 * k]


#: Letters of the suffix arrays over bytes: so many bytes make a letter, so many letters a comparison.
WIDE, LETTERS = 7, 6


def stretches(found: np.ndarray, first: np.ndarray, width: np.ndarray, doc: np.ndarray, offset: np.ndarray, length: int) -> Iterator[tuple[int, int, bytes]]:
    """Covered stretches (id, first token, tokens) of occurrences: runs of windows that a smaller id has too."""
    for i in range(0, len(first), 20_000):
        f, w, d, o = first[i : i + 20_000], width[i : i + 20_000], doc[i : i + 20_000], offset[i : i + 20_000]
        hit = found[ragged(f, w)] < np.repeat(d, w)
        if not hit.any():
            continue
        of = np.repeat(np.arange(len(f)), w)
        place = ragged(np.zeros(len(f), np.int64), w)
        begins = hit & np.concatenate([[True], ~hit[:-1] | (of[1:] != of[:-1])])
        ends = hit & np.concatenate([~hit[1:] | (of[1:] != of[:-1]), [True]])
        a, z = np.flatnonzero(begins), np.flatnonzero(ends)
        yield -1, 2, pack(d[of[a]], o[of[a]] + place[a], place[z] - place[a] + length)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The rows of a sorted partition, shard by shard."""
    now, rows = None, []
    for batch in batches:
        for s, k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if s != now and rows:
                yield now, rows
                rows = []
            now = s
            rows.append((k, b))
    if rows:
        yield now, rows


Finish = Callable[[bytes, np.ndarray], tuple]


def judged(docs: DataFrame, cutter: Cutter, solve: Solver, finish: Finish, schema: str) -> DataFrame:
    """A row for each of docs(doc_id, base, text): doc_id and what `finish` makes of the text and the stretches in it that go."""
    docs = docs.select("doc_id", "base", "text")
    cutter.common = common_grams(docs.where("doc_id is not null"), cutter)
    shard = Shard(cutter, solve)
    homes = max(LEAST_SHARDS, cutter.shards // 4)
    fields = to_arrow_schema(T._parse_datatype_string(schema))
    tokens = cutter.words

    def home(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where a row is put together: by its id and its number among the rows of that id."""
        return (mix64(doc.view(np.uint64) + mix64((place >> ROW_BITS).astype(np.uint64))) % np.uint64(homes)).astype(np.int64)

    def sent_home(rows):
        """Stretches go to the homes of their documents."""
        for s, k, b in rows:
            if k != 2:
                yield s, k, b
                continue
            doc, begin, width = unpack(b)
            h = home(doc, begin)
            order = np.argsort(h, kind="stable")
            edges = np.searchsorted(h[order], np.arange(homes + 1))
            for i in np.flatnonzero(np.diff(edges)).tolist():
                m = order[edges[i] : edges[i + 1]]
                yield i, 2, pack(doc[m], begin[m], width[m])

    def first(batches):
        for own, rows in by_shard(batches):
            yield from emit((own, 1, b) for k, b in rows if k == 1)
            blobs = [b for k, b in rows if k == 0]
            rows.clear()
            if blobs:
                yield from emit(sent_home(merged(shard.judge(blobs))))

    def second(batches):
        for _, rows in by_shard(batches):
            told = [unpack(b) for k, b in rows if k == 3]
            if not told:
                continue
            same, w, found = (np.concatenate([t[i] for t in told]) for i in range(3))
            start = np.cumsum(w) - w
            keys, at = np.unique(same, return_index=True)

            def met(rows=rows, keys=keys, at=at, start=start, w=w, found=found):
                for k, b in rows:
                    if k == 1:
                        key, doc, offset = unpack(b)
                        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        hit = keys[slot] == key
                        g = at[slot[hit]]
                        yield from stretches(found, start[g], w[g], doc[hit], offset[hit], cutter.length)

            yield from emit(sent_home(merged(met())))

    def homed(batches):
        """The texts themselves, on their way to where their stretches arrive."""
        ids, base, rows, total = [], [], [], 0

        def flush():
            null = np.array([i is None for i in ids])
            doc = np.array([i or 0 for i in ids], np.int64)
            size, b = np.array([len(r) for r in rows], np.int64), np.array(base, np.int64)
            raw = np.frombuffer(b"".join(rows), np.uint8)
            start = np.cumsum(size) - size
            h = np.where(null, np.arange(len(doc)) % homes, home(doc, b))
            for s in np.unique(h).tolist():
                m = np.flatnonzero(h == s)
                yield s, 4, pack(raw[ragged(start[m], size[m])], size[m], doc[m], b[m], null[m].astype(np.uint8))

        for i, b, text in texts_of(batches):
            ids.append(i), base.append(b), rows.append(text)
            total += len(text)
            if total >= FLUSH:
                yield from emit(flush())
                ids, base, rows, total = [], [], [], 0
        if rows:
            yield from emit(flush())

    def last(batches):
        for _, rows in by_shard(batches):
            told = [unpack(b) for k, b in rows if k == 2]
            doc, begin, width = (np.concatenate([t[i] for t in told]) for i in range(3)) if told else (np.empty(0, np.int64),) * 3
            order = np.lexsort((begin, doc))
            doc, begin, width = doc[order], begin[order], width[order]
            for k, b in rows:
                if k != 4:
                    continue
                raw, size, ids, base, null = unpack(b)
                at = np.cumsum(size) - size
                lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
                made = []
                for i in range(len(ids)):
                    text = raw[at[i] : at[i] + size[i]].tobytes()
                    x, z = (lo[i], lo[i]) if null[i] else lo[i] + np.searchsorted(begin[lo[i] : hi[i]], [base[i], base[i] + (1 << ROW_BITS)])
                    mask = stretch_mask(begin[x:z] - base[i], width[x:z], len(WORD_BYTES.findall(text)) if tokens else len(text)) if z > x else None
                    made.append((None if null[i] else int(ids[i]), *finish(text, mask)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), fields, strict=True)], schema=fields)

    blob = "shard int, kind int, columns binary"
    cut = segments(docs.where("doc_id is not null"), cutter)
    if cutter.per > 1:
        cut = cut.repartition("shard").mapInArrow(redealt, blob)
    one = durable(cut.repartition("shard").sortWithinPartitions("shard").mapInArrow(first, blob))
    crowds = one.where("kind in (1, 3)").repartition("shard").sortWithinPartitions("shard").mapInArrow(second, blob)
    home_rows = one.where("kind = 2").unionByName(crowds).unionByName(docs.mapInArrow(homed, blob))
    return home_rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(last, schema)


def merged(rows):
    """Stretches of one shard in one piece; the other rows as they are."""
    told = []
    for s, k, b in rows:
        if k != 2:
            yield s, k, b
            continue
        told.append(unpack(b))
    if told:
        yield -1, 2, pack(*(np.concatenate([t[i] for t in told]) for i in range(3)))


#: Rows of one id are this many bits of places apart: a text has less than 2 GB.
ROW_BITS = 31
#: Parts in which the rows of one id are numbered.
SALTS = 256


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and base: 0, or for ids with several texts the number of the text times 2**ROW_BITS, so that places tell them apart.

    Only digests are numbered, each id's in SALTS parts, so an id may have any number of rows.  Rows with one id and
    text share a number: they have the same stretches.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    again = rows.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).collect()
    if not again:
        return rows.withColumn("base", F.lit(0).cast("long"))
    rows = rows.withColumn("_digest", F.md5(F.coalesce("text", F.lit(""))))
    known = rows.where("doc_id is not null").select("doc_id", "_digest").distinct()
    several = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    known = known.join(loose(several, "doc_id"), "doc_id").withColumn("_salt", F.pmod(F.xxhash64("_digest"), F.lit(SALTS)))
    within = known.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "_salt").orderBy("_digest")))
    parts = known.groupBy("doc_id", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # SALTS rows of an id at most
    parts = parts.select("doc_id", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    base = within.join(loose(parts, "doc_id"), ["doc_id", "_salt"]).select("doc_id", "_digest", ((F.col("_k") + F.col("_from")) * (1 << ROW_BITS)).alias("_base"))
    return rows.join(loose(base, "doc_id", "_digest"), ["doc_id", "_digest"], "left").select("doc_id", "text", F.coalesce("_base", F.lit(0)).cast("long").alias("base"))


def stretch_mask(begin: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    """Which of a row's n tokens are covered."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + width, -1)
    return np.cumsum(edge[:-1]) > 0
