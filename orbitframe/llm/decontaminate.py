"""Benchmark decontamination by the q-gram lemma.

The pieces of a benchmark item are its PIECE characters from every character on (a shorter item is one
piece).  A text region within k edits of a piece of m characters shares at least m + 1 - q * (k + 1)
character q-grams with it, all of them within k diagonals of each other (the q-gram lemma).  So every text
is scanned once: q-gram hashes of the whole text meet a hash table of the benchmark's, hits are counted
in overlapping diagonal bands of each item, the pieces that reach the bound in a band are retained, and
each is verified by a banded alignment.  Pieces too short for a bound are sought by their two ends, one of
which an edit leaves whole.  WORDS words on end of an item are found verbatim, even where they are
shorter than a piece: they are a run of hits on one diagonal.

The benchmark is the query set.  It is read in blocks whose characters are counted first, and each block
of at most BLOCK_CHARS is sent to the executors once, whatever the benchmark's size.  Texts never move.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, loose, map_rows, rolling, table, texts, tune

Q = 10
PIECE = 64
#: Words of an item on end that are a passage, however few their characters.
WORDS = 13
#: Length of the ends by which pieces without a bound are sought.
END = 8
#: Edits allowed in a piece, as a share of its characters.
EDIT_SHARE = 0.0625
#: Bound on the characters of a block of the benchmark that is sent to the executors.
BLOCK_CHARS = 2_000_000
#: Pairs of a place in a text and a place in an item that are held at once.
PAIRS = 4_000_000
_FOLD = np.arange(0x110000, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def code_points(text: str) -> np.ndarray:
    """ASCII letters in lower case and ASCII white space as a space; each keeps its place."""
    return _FOLD[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def budget(m: int) -> int:
    return int(EDIT_SHARE * m)


def bound(m: int) -> int:
    """Shared q-grams that a region within the budget has at least."""
    return m + 1 - Q * (budget(m) + 1)


def passages(c: np.ndarray) -> np.ndarray:
    """For each place, the least end of WORDS whole words on end from there or further on; too large if there are none."""
    out = np.full(len(c) + 1, 1 << 40, np.int64)
    inner = np.concatenate([[False], c != 32, [False]])
    start, stop = np.flatnonzero(inner[1:] & ~inner[:-1]), np.flatnonzero(~inner[1:] & inner[:-1])
    if len(start) >= WORDS:
        out[start[: len(start) - WORDS + 1]] = stop[WORDS - 1 :]
    return np.minimum.accumulate(out[::-1])[::-1]


class Pieces:
    """The q-gram table of a block of items."""

    def __init__(self, items: list[tuple]):
        self.items, self._halves = items, None
        self.item, self.chars = [], []
        for item_id, text in items:
            c = code_points(text or "")
            if len(c) < Q or (c == 32).all():
                continue
            self.item.append(item_id)
            self.chars.append(c)
        lengths = np.array([len(c) for c in self.chars], np.int64)
        self.size = np.minimum(lengths, PIECE)
        self.k = np.array([budget(m) for m in self.size], np.int64)
        self.need = np.array([bound(m) for m in self.size], np.int64)
        self.reach = [passages(c) for c in self.chars]
        self.base = int(lengths.max()) + PIECE if len(lengths) else 0
        long = np.flatnonzero(self.need > 0)
        grams = [rolling(self.chars[i], Q) for i in long]
        counts = np.array([len(g) for g in grams], np.int64)
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        piece = np.repeat(long, counts)
        offset = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.argsort(h, kind="stable")
        self.hashes, self.first, self.times = np.unique(h[order], return_index=True, return_counts=True)
        self.piece, self.offset = piece[order], offset[order]
        self.bits = max(16, int(len(h) * 32).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.hashes)] = True
        self.least = min(int(self.need[long].min()), 2 * WORDS - Q) if len(long) else 0  # the latter for WORDS words of one letter
        self.widest = int((self.size + self.k)[long].max()) if len(long) else 0
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(self.need <= 0).tolist():
            for at in (0, len(self.chars[i]) - END):
                self.ends.setdefault(int(rolling(self.chars[i][at : at + END], END)[0]), []).append((i, at))
        self.end_hashes = np.array(list(self.ends), np.uint64)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def halves(self) -> list[Pieces]:
        """The tables of the first and the second half of the items."""
        if self._halves is None:
            m = len(self.items) // 2
            self._halves = [Pieces(self.items[:m]), Pieces(self.items[m:])]
        return self._halves


def align(pattern: np.ndarray, sizes: np.ndarray, text: np.ndarray, free: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against its own stretch of text, and where the best match ends.

    pattern[c, :sizes[c]] and text[c] are padded with values that equal nothing.  Diagonal j of row i is text
    column i + j.  The text left of the match is free of charge if `free`; what is right of it always is.
    """
    n, m = pattern.shape
    width = text.shape[1] - m + 1
    lanes = np.arange(width)
    row = np.zeros((n, width), np.int32) if free else np.tile(lanes.astype(np.int32), (n, 1))
    best, end = np.full(n, 1 << 30), np.zeros(n, np.int64)
    for i in range(m):
        up = np.full_like(row, 1 << 20)
        up[:, :-1] = row[:, 1:] + 1
        row = np.minimum(row + (text[:, i : i + width] != pattern[:, i : i + 1]), up)
        row = np.minimum.accumulate(row - lanes, axis=1) + lanes
        done = sizes == i + 1
        if done.any():
            at = row[done].argmin(axis=1)
            best[done], end[done] = row[done][np.arange(done.sum()), at], at + i + 1
    return best, end


def search(text: np.ndarray, p: Pieces) -> list[tuple]:
    """(item, start, end, edits) of the regions of one text that match pieces within their budget, or WORDS words of an item."""
    return merged([*_hits(text, p), *verify(text, p, _by_ends(text, p))])


def _by_ends(text: np.ndarray, p: Pieces) -> list[tuple[int, int, int]]:
    """(item, 0, first diagonal) of the items without a bound one of whose ends is in the text."""
    if not p.ends or len(text) < END:
        return []
    h = rolling(text, END)
    return [(i, 0, at - off - int(p.k[i])) for at in np.flatnonzero(np.isin(h, p.end_hashes)).tolist() for i, off in p.ends[int(h[at])]]


def _hits(text: np.ndarray, p: Pieces) -> list[tuple]:
    """The regions that match by q-grams: verbatim ones, and verified pieces that reach their bound."""
    if not len(p.hashes) or len(text) < Q:
        return []
    h = rolling(text, Q)
    hit = p.seen[p._slot(h)]
    if hit.sum() < p.least:
        return []
    # The weakest bound first: no stretch with fewer hits than any piece needs can hold a match.
    total = np.concatenate([[0], np.cumsum(hit)])
    span = min(p.widest, len(h))
    full = total[span:] - total[:-span] >= p.least
    if not full.any():
        return []
    edge = np.zeros(len(h) + 1, np.int32)
    at = np.flatnonzero(full)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + span, -1)
    where = np.flatnonzero(hit & (np.cumsum(edge[:-1]) > 0))
    slot = np.searchsorted(p.hashes, h[where])
    true = (slot < len(p.hashes)) & (p.hashes[np.minimum(slot, len(p.hashes) - 1)] == h[where])
    where, slot = where[true], slot[true]
    return _in_stretch(text, p, where, slot) if len(where) >= p.least else []


def _in_stretch(text: np.ndarray, p: Pieces, where: np.ndarray, slot: np.ndarray) -> list[tuple]:
    """The regions around the hits `where`, whose grams are p.hashes[slot].

    A gram that is common in the block makes many pairs of a place in the text and a place in an item.  Beyond PAIRS
    the hits are halved, with an overlap that holds any piece; a stretch too short for that meets the items half by half.
    So at most PAIRS are held, or the places of one item times twice the width of a piece.
    """
    if not len(where):
        return []
    if int(p.times[slot].sum()) > PAIRS:
        reach = max(p.widest, PIECE) + Q
        if where[-1] - where[0] > 2 * reach:
            middle = (int(where[0]) + int(where[-1])) // 2
            left, right = where < middle + reach, where >= middle
            return _in_stretch(text, p, where[left], slot[left]) + _in_stretch(text, p, where[right], slot[right])
        if len(p.items) > 1:
            out = []
            for half in p.halves():
                own = np.searchsorted(half.hashes, p.hashes[slot])
                true = np.append(half.hashes, np.uint64(0))[own] == p.hashes[slot]
                true &= own < len(half.hashes)
                out += _in_stretch(text, half, where[true], own[true])
            return out
    whole, todo = _regions_of(text, p, where, slot)
    return whole + verify(text, p, todo)


def _regions_of(text: np.ndarray, p: Pieces, where: np.ndarray, slot: np.ndarray) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """Verbatim regions, and the other pieces that reach their bound as (item, start in it, first diagonal less the item's start)."""
    times = p.times[slot]
    pos = np.repeat(where, times)
    entry = np.repeat(p.first[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    item, off = p.piece[entry], p.offset[entry]
    diagonal = pos - off + p.base
    whole, runs = [], {}
    order = np.lexsort((off, diagonal, item))
    i, d, o = item[order], diagonal[order], off[order]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (o[1:] != o[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(o)]]) - 1
    enough = o[last] - o[first] + Q >= np.minimum(p.size[i[first]], 2 * WORDS - 1)
    for f, z in zip(first[enough].tolist(), last[enough].tolist(), strict=True):
        c, a, stop, shift = int(i[f]), int(o[f]), int(o[z]) + Q, int(d[f]) - p.base
        if (stop - a >= p.size[c] or p.reach[c][a] <= stop) and np.array_equal(text[a + shift : stop + shift], p.chars[c][a:stop]):
            whole.append((p.item[c], a + shift, stop + shift, 0))
            runs.setdefault(c, []).append((int(d[f]), a, stop))
    # Bands overlap: band b holds the diagonals [b * step, (b + 2) * step), so each hit counts in two.
    band = diagonal // (p.k[item] + 1)
    key, off = np.concatenate([item * (1 << 40) + band, item * (1 << 40) + band - 1]), np.concatenate([off, off])
    order = np.lexsort((off, key))
    key, off = key[order], off[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (off[1:] != off[:-1])])
    key, off = key[once], off[once]
    keys, at, n = np.unique(key, return_index=True, return_counts=True)
    kept = n >= p.need[keys >> 40]
    todo = []
    for q, f, n in zip(keys[kept].tolist(), at[kept].tolist(), n[kept].tolist(), strict=True):
        c, b = q >> 40, q & ((1 << 40) - 1)
        m, need, step, o = int(p.size[c]), int(p.need[c]), int(p.k[c]) + 1, off[f : f + n]
        a = np.maximum(o[need - 1 :] - (m - Q), 0)
        z = np.minimum(o[: n - need + 1], len(p.chars[c]) - m)
        near = a <= z
        edge = np.zeros(len(p.chars[c]) - m + 2, np.int64)
        np.add.at(edge, a[near], 1)
        np.add.at(edge, z[near] + 1, -1)
        open_ = np.cumsum(edge[:-1]) > 0
        for d, start, stop in runs.get(c, ()):
            if b * step <= d < (b + 2) * step and stop - start >= m:
                open_[start : stop - m + 1] = False
        todo += [(c, s, b * step - p.base + s) for s in np.flatnonzero(open_).tolist()]
    return whole, todo


def verify(text: np.ndarray, p: Pieces, todo: list[tuple[int, int, int]]) -> list[tuple]:
    """Banded alignments of the retained pieces, many at once; forwards for the end, backwards for the start."""
    out = set()
    for at in range(0, len(todo), 512):
        part = todo[at : at + 512]
        size = np.array([p.size[c] for c, _, _ in part])
        k = np.array([p.k[c] for c, _, _ in part])
        m, extra = int(size.max()), 4 * (int(k.max()) + 1)
        pattern, stretch = np.full((len(part), m), 0xFFFFFFFF, np.uint32), np.full((len(part), m + extra), 0xFFFFFFFE, np.uint32)
        left = np.array([low for _, _, low in part]) - (k + 1)
        for i, (c, s, _) in enumerate(part):
            pattern[i, : size[i]] = p.chars[c][s : s + size[i]]
            a, z = max(0, left[i]), min(len(text), left[i] + m + extra)
            if z > a:
                stretch[i, a - left[i] : z - left[i]] = text[a:z]
        best, end = align(pattern, size, stretch, True)
        good = np.flatnonzero(best <= k)
        if not len(good):
            continue
        stop = (left + end)[good]
        pattern, stretch = np.full((len(good), m), 0xFFFFFFFF, np.uint32), np.full((len(good), m + extra), 0xFFFFFFFE, np.uint32)
        for i, g in enumerate(good.tolist()):
            c, s, _ = part[g]
            pattern[i, : size[g]] = p.chars[c][s : s + size[g]][::-1]
            a = max(0, stop[i] - stretch.shape[1])
            stretch[i, : stop[i] - a] = text[a : stop[i]][::-1]
        _, length = align(pattern, size[good], stretch, False)
        out |= {(p.item[part[g][0]], max(0, int(stop[i] - length[i])), int(stop[i]), int(best[g])) for i, g in enumerate(good.tolist())}
    return sorted(out)


def merged(found: list[tuple]) -> list[tuple]:
    """Overlapping regions of one item as one, with the most edits of a piece in it."""
    out: list[list] = []
    for item, a, z, edits in sorted(found):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], z), max(out[-1][3], edits)
        else:
            out.append([item, a, z, edits])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks; sizes are counted before anything is fetched."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null and t != ''")
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-int(size) // BLOCK_CHARS)
    if parts <= 1:
        rows = items.distinct().collect() if parts else []
        if rows:
            yield [tuple(r) for r in rows]
        return
    dealt = items.distinct().withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(2 * parts)))
    for b in range(2 * parts):
        rows = dealt.where(F.col("b") == b).select("i", "t").collect()
        for start, stop in _bounded([len(r["t"]) for r in rows]):
            yield [tuple(r) for r in rows[start:stop]]


def _bounded(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > BLOCK_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def _finder(docs: DataFrame, part: list[tuple]):
    """(a function of texts that returns their regions by the block `part`, the broadcast that it reads)."""
    held = docs.sparkSession.sparkContext.broadcast(part)  # at most BLOCK_CHARS characters, or one item
    cache: list[Pieces] = []

    def find(col: pa.Array) -> list[list[tuple]]:
        if not cache:
            cache.append(Pieces(held.value))
        return [search(code_points(t), cache[0]) for t in texts(col)]

    return find, held


def _regions(rows: DataFrame, part: list[tuple]):
    """(the key of rows(key, text) with the regions of its text, the broadcast that they read)."""
    find, held = _finder(rows, part)
    of = "array<struct<item_id:long,start:long,stop:long,edits:int>>"

    def run(batch: pa.RecordBatch) -> dict:
        return {"regions": [[{"item_id": i, "start": a, "stop": z, "edits": e} for i, a, z, e in x] for x in find(batch.column(1))]}

    return map_rows(rows, list(rows.columns), run, f"{rows.columns[0]} {rows.dtypes[0][1]}, regions {of}"), held


def _key(id_col: str | None, text_col: str) -> Column:
    """A digest of a row's id and text that stays the same whenever the row is made anew."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), text) if id_col else text)


def _by_blocks(docs: DataFrame, first: list[tuple], others: Iterator[list[tuple]], key: Column, text_col: str) -> DataFrame:
    """_key and regions of the rows in which any block finds something; each block is fetched, sent, used and let go before the next."""
    rows = docs.select(key.alias("_key"), F.col(text_col).alias("text"))
    found = None
    for part in itertools.chain([first], others):
        one, held = _regions(rows, part)
        one = durable(one.where(F.size("regions") > 0))
        held.destroy()
        found = one if found is None else found.unionByName(one)
    return found.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("regions")))).alias("regions"))


def screen(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, n_regions and spans (item:start:end:edits, comma-joined; code points), a row for each of docs.

    Null and empty texts are clean.  Found are 60 characters of an item verbatim,
    64 within 4 edits, WORDS words verbatim, and shorter items as a whole within their budget.  Items with fewer than Q characters
    are left out: they are too short to identify; so are null and blank ones.  An empty benchmark leaves every text clean.  Repeated rows give
    repeated rows.  Columns besides these are left out.  A benchmark of several blocks takes a pass over docs for each.
    """
    parts = blocks(benchmark, item_col, item_text) if benchmark is not None else iter(())
    first, second = next(parts, []), next(parts, None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if second is not None:
        found = _by_blocks(rows, first, itertools.chain([second], parts), _key("doc_id", "text"), "text")
        out = rows.select("doc_id", _key("doc_id", "text").alias("_key")).join(loose(found, "_key"), "_key", "left").select("doc_id", F.coalesce("regions", F.array()).alias("regions"))
    else:
        out = _regions(rows, first)[0]
    item = F.transform("regions", lambda r: r["item_id"])
    spans = F.transform("regions", lambda r: F.concat_ws(":", r["item_id"].cast("string"), r["start"].cast("string"), r["stop"].cast("string"), r["edits"].cast("string")))
    return out.select(
        "doc_id",
        (F.size("regions") > 0).alias("contaminated"),
        F.size(F.array_distinct(item)).cast("long").alias("n_items"),
        F.size("regions").cast("long").alias("n_regions"),
        F.concat_ws(",", spans).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in whose texts no benchmark piece or passage is found."""
    parts = blocks(benchmark, item_col, item_text)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return docs
    if second is None:
        find = _finder(docs, first)[0]

        @F.pandas_udf("boolean")
        def leaks(text: pd.Series) -> pd.Series:
            return pd.Series([bool(x) for x in find(pa.array(text, pa.string()))], dtype=bool)

        return docs.where(~leaks(F.col(text_col)))
    found = _by_blocks(docs, first, itertools.chain([second], parts), _key(None, text_col), text_col).select("_key")
    return docs.withColumn("_key", _key(None, text_col)).join(loose(found, "_key"), "_key", "left_anti").drop("_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return screen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
