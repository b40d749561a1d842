"""N-gram Jaccard join: MinHash banding proposes, full n-gram sets decide.

Texts with the same words are one node, so copies are never compared.  Each text's MinHash signature is cut in bands,
as many as the target recall at the threshold needs; a shuffle on the band hashes links each node with the least node of its
bucket (a star, not all pairs), and the components of these stars hold all candidates.  A component that fits a task
is verified there on full n-gram sets.  A larger one is dealt out in blocks, and a task gets two blocks: either two
of the component, or, where that sends fewer sets (in long chains), two of one band bucket, which then counts
the pairs that share no earlier band.  What a task holds is bounded, and it returns sums and a spanning
forest for its nodes instead of pairs.  So no link between different texts is lost, whatever a group's size, and
no pair is ever written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, forget, loose, map_rows, mix64, rolling, table, tune
from .graph import components
from .windows import _BYTE, ragged, span_hashes, word_bounds

WORDS = 5
#: Similarity from which texts are linked, as a fraction.
THRESHOLD = (4, 5)
RECALL, ROWS = 0.999, 6
#: Nodes and n-grams that a block of a large component has about.
BLOCK_NODES, BLOCK_GRAMS = 400, 1_000_000
#: Columns of a piece of the incidence matrix.
COLUMNS = 2_048


def bands_for(similarity: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Least number of bands of so many rows that finds a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def gram_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the n-grams of all texts, how many each has, two hashes of each text's words).

    A text of fewer than WORDS words, but not none, has one n-gram: all its words.
    """
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first, stop = word_bounds(raw)
    token = span_hashes(_BYTE[raw], first, stop)
    begin = np.searchsorted(first, np.cumsum(sizes + 1) - (sizes + 1))
    end = np.append(begin[1:], len(first))
    words = end - begin
    key = span_hashes(token, begin, end)
    check = span_hashes(mix64(token ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin, end)
    grams = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    out = np.empty(int(grams.sum()), np.uint64)
    at = np.cumsum(grams) - grams
    full = words >= WORDS
    rolled = rolling(token, WORDS)
    out[ragged(at[full], grams[full])] = mix64(rolled[ragged(begin[full], grams[full])])
    short = (grams == 1) & ~full
    out[at[short]] = key[short]
    return out, grams, key, check


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mult = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def bands_of(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The band hashes of each set that isn't empty, as a matrix of longs."""
        starts = (np.cumsum(counts) - counts)[counts > 0]
        out = np.zeros((self.bands, len(starts)), np.uint64)
        if len(starts):
            for i in range(self.bands * self.rows):
                least = np.minimum.reduceat(grams * self.mult[i] + self.add[i], starts)
                out[i // self.rows] = mix64(out[i // self.rows] ^ least)
        return mix64(out + np.arange(self.bands, dtype=np.uint64)[:, None]).T.view(np.int64)


def signatures(docs: DataFrame, minhash: MinHash) -> DataFrame:
    """doc_id, node and check (hashes of the words), grams and bands of docs(doc_id, text)."""

    def run(part: pa.RecordBatch) -> dict:
        grams, counts, key, check = gram_sets([x.as_py() or b"" for x in pc.cast(part.column(1), pa.binary())])
        bands = iter(minhash.bands_of(grams, counts))
        return {"node": pa.array(key.view(np.int64)), "check": pa.array(check.view(np.int64)), "grams": pa.array(counts), "bands": [next(bands) if c else [] for c in counts.tolist()]}

    return map_rows(docs, ["doc_id", "text"], run, "doc_id long, node long, check long, grams long, bands array<long>")


def linked(sets: np.ndarray, counts: np.ndarray, side: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, matrix of which are linked) of the sets: all against all, or those of side 0 against those of side 1."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((owner, sets))
    h, o = sets[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    h, o = h[new], o[new]  # each set's n-grams once
    size = np.bincount(o, minlength=len(counts))
    group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
    times = np.bincount(group)
    common = int((times == len(counts)).sum())
    use = (times > 1) & (times < len(counts))
    column = np.cumsum(use) - 1
    kept = use[group]
    c, o = column[group[kept]], o[kept]
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(counts)),) * 2
    shared = np.full((len(a), len(b)), common, np.float64)
    slot = np.empty(len(counts), np.int64)
    slot[b] = np.arange(len(b))
    slot_a = np.empty(len(counts), np.int64)
    slot_a[a] = np.arange(len(a))
    total = int(use.sum())
    edges = np.searchsorted(c, np.arange(0, total + COLUMNS, COLUMNS))
    for i in range(len(edges) - 1):
        s = slice(edges[i], edges[i + 1])
        width = min(COLUMNS, total - i * COLUMNS)
        x = np.zeros((len(counts), width), np.float32)
        x[o[s], c[s] - i * COLUMNS] = 1
        shared += x[a] @ x[b].T if cross else x @ x.T
    up, down = THRESHOLD
    both = size[a][:, None] + size[b][None, :] - shared
    match = (down * shared >= up * both) & (shared > 0)
    if not cross:
        np.fill_diagonal(match, False)
    yield a, b, match


def verify(nodes: np.ndarray, copies: np.ndarray, side: np.ndarray, cross: bool, sets: list[np.ndarray], bands: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links, root): documents linked with each node, and the least node that it reaches over links within the task.

    bands has the earlier bands of each node: pairs that share one of them are counted where that band is.
    """
    counts = np.array([len(x) for x in sets], np.int64)
    links, low = np.zeros(len(nodes), np.int64), nodes.copy()
    for a, b, match in linked(np.concatenate(sets), counts, side, cross):
        if bands is not None and bands.shape[1]:
            i, j = np.nonzero(match)
            for at in range(0, len(i), 65_536):
                x, y = i[at : at + 65_536], j[at : at + 65_536]
                match[x, y] = ~(bands[a[x]] == bands[b[y]]).any(axis=1)
        links[a] += match @ copies[b]
        if cross:
            links[b] += copies[a] @ match
        # Roots by repeated minima over neighbours.
        while True:
            before = low.copy()
            for i, j, m in ((a, b, match), (b, a, match.T)):
                for s in range(0, len(i), 256):
                    rows = i[s : s + 256]
                    best = np.where(m[s : s + 256], low[j][None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
                    low[rows] = np.minimum(low[rows], best)
            if (low == before).all():
                break
    return links, low


def gram_rows(held: DataFrame) -> DataFrame:
    """node, check and set (its n-grams' hashes, each once, as bytes) of held(node, check, text), where the text is the node's own."""

    def run(part: pa.RecordBatch) -> dict:
        grams, counts, key, check = gram_sets([x.as_py() or b"" for x in pc.cast(part.column(2), pa.binary())])
        own = (key.view(np.int64) == np.asarray(part.column(0))) & (check.view(np.int64) == np.asarray(part.column(1)))
        ends = np.cumsum(counts)
        return {"check": part.column(1), "set": [np.unique(grams[z - n : z]).tobytes() if o else None for z, n, o in zip(ends.tolist(), counts.tolist(), own.tolist(), strict=True)]}

    return map_rows(held, ["node", "check", "text"], run, "node long, check long, set binary", 2).where("set is not null").dropDuplicates(["node", "check"])


def verified(members: DataFrame) -> DataFrame:
    """node, links and root of members(place, scope, first, second, block, node, copies, bands, set), a row for each node and task.

    place is 0 where scope is a component, else the number of the band, from 1, whose bucket scope is.
    """

    def groups(batches) -> Iterator[tuple[tuple, list]]:
        now, rows = None, []
        for batch in batches:
            for *key, block, node, copies, bands, grams in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                key = tuple(key)
                if key != now and rows:
                    yield now, rows
                    rows = []
                now = key
                rows.append((block, node, copies, bands, np.frombuffer(grams, np.uint64)))
        if rows:
            yield now, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (place, _, first, second), rows in groups(batches):
            block, nodes, copies = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            earlier = np.array([r[3][: place - 1] for r in rows], np.int64).reshape(len(rows), -1) if place else None
            links, root = verify(nodes, copies, (block != first).astype(np.int64), first != second, [r[4] for r in rows], earlier)
            out += zip(nodes.tolist(), links.tolist(), root.tolist(), strict=True)
            if len(out) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["node", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["node", "links", "root"])

    names = ("place", "scope", "first", "second", "block", "node", "copies", "bands", "set")
    dealt = members.select(*names).repartition(*names[:4]).sortWithinPartitions(*names[:4], "node")
    return dealt.mapInArrow(run, "node long, links long, root long")


def classes(docs: DataFrame, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least id of the documents that links connect) and n_links (documents linked with it), a row for each of docs.

    Linked are texts whose sets of five-word n-grams have a Jaccard similarity of 0.8 or more, copies included.  Texts of one to
    four words have one n-gram, all their words.  Texts without words (null texts too) are linked with each
    other only.  Rows with a null id are left out of the search: class null, no links.  Rows that
    share an id count one by one; if their texts differ, each row has the class of its own text, and two classes can then have one
    class_id.  Other columns are left out.
    """
    return _classed(docs, recall, rows, id_col, text_col).select("doc_id", "class_id", "n_links")


def _blocks() -> Column:
    """Blocks of a group of nodes, by their number and n-grams."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("grams") / BLOCK_GRAMS), F.lit(1)).cast("int")


def _scopes(found: DataFrame, nodes: DataFrame, banded: DataFrame) -> DataFrame:
    """place, scope, node, k: which groups each node is compared in, and in how many blocks these are dealt.

    A component of one block is one group.  A larger one is a group in k blocks if that sends its nodes' sets (each k times) no
    oftener than its band buckets together would, else its buckets are the groups.
    """
    held = found.join(nodes.select("node", "grams"), "node")
    parts = held.groupBy("component").agg(_blocks().alias("k"), F.count(F.lit(1)).alias("n"))
    large = parts.where("k > 1")
    placed = banded.join(held.join(loose(large.select("component"), "component"), "component"), "node")
    buckets = durable(placed.groupBy("component", "place", "band").agg(_blocks().alias("kb"), F.count(F.lit(1)).alias("nb")).where("nb > 1"))
    split = buckets.groupBy("component").agg(F.sum(F.col("nb").cast("double") * F.col("kb")).alias("cost"))
    split = large.join(split, "component").where("cost < cast(n as double) * k").select("component", F.lit(True).alias("split"))
    parts = parts.join(split, "component", "left")
    whole = found.join(loose(parts.where("split is null"), "component"), "component").select(F.lit(0).alias("place"), F.col("component").alias("scope"), "node", "k")
    chosen = buckets.join(split, "component", "left_semi").select("place", "band", F.col("kb").alias("k"))
    return whole.unionByName(banded.join(loose(chosen, "band"), ["place", "band"]).select("place", F.col("band").alias("scope"), "node", "k"))


def _classed(docs: DataFrame, recall: float, rows: int, id_col: str, text_col: str) -> DataFrame:
    """What classes() returns, with the node and check of each row's text and the component (least node) of its class."""
    rows_of = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    minhash = MinHash(bands_for(THRESHOLD[0] / THRESHOLD[1], recall, rows), rows)
    sigs = durable(signatures(rows_of, minhash))
    known = sigs.where("doc_id is not null")
    nodes = durable(known.groupBy("node", "check").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("grams").alias("grams"), F.first("bands").alias("bands")))
    # Stars of the band buckets.
    banded = nodes.select(F.posexplode("bands").alias("place", "band"), "node").withColumn("place", F.col("place") + 1)
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub != other").select("band", "hub")
    stars = banded.join(loose(hubs, "band"), "band").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    found = durable(components(stars))
    # Sets of the nodes that have candidates, and the groups that they are compared in.
    wanted = found.join(nodes, "node").select("node", "check", F.col("rep").alias("doc_id"), "copies", "bands")
    sets = durable(gram_rows(wanted.select("node", "check", "doc_id").join(rows_of, "doc_id").select("node", "check", "text")))
    dealt = _scopes(found, nodes, banded).withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("place", "scope", F.least("block", "_with").alias("first"), F.greatest("block", "_with").alias("second"), "block", "node")
    members = dealt.join(sets.join(wanted.drop("doc_id"), ["node", "check"]), "node").withColumn("bands", F.when(F.col("place") > 0, F.col("bands")))
    told = durable(verified(members))
    forget(sets)
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(told.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = nodes.drop("bands").join(links, "node", "left").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("rep").alias("class_id"))
    info = joined.join(loose(least, "component"), "component").select("node", "check", "component", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    ids = sigs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), "check")
    return ids.join(info, ["node", "check"], "left").select("doc_id", "node", "check", "component", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def node_of(text: Column) -> Column:
    """node and check of a text, as one string."""
    @F.pandas_udf("string")
    def hashed(t: pd.Series) -> pd.Series:
        _, _, key, check = gram_sets([(x or "").encode("utf-8", "replace") for x in t])
        return pd.Series([f"{a}:{b}" for a, b in zip(key.view(np.int64).tolist(), check.view(np.int64).tolist(), strict=True)], dtype=object)

    return hashed(text)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each class: one with the least id of the class; rows with a null id stay.

    So every text of docs stays or is linked, over links, with one that stays.  Rows that share an id and differ in their texts are
    told apart by text: each class keeps its own row of that id, and of several texts of the class under its least id the one
    of the least hash.  Of rows with the same id and words, any one stays.
    """
    found = _classed(docs, RECALL, ROWS, id_col, text_col).where("doc_id = class_id")
    again = docs.select(F.col(id_col).alias("i")).where("i is not null").groupBy("i").count().where("count > 1").limit(1).collect()
    if again:
        kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "node", "check")).alias("_n"))
        kept = kept.select(F.col("_n.doc_id").alias("_kept"), F.concat_ws(":", F.col("_n.node").cast("string"), F.col("_n.check").cast("string")).alias("_text"))
        own = docs.where(F.col(id_col).isNotNull()).withColumn("_own", node_of(F.col(text_col)))
        out = own.join(kept, (own[id_col].cast("long") == kept["_kept"]) & (own["_own"] == kept["_text"]), "left_semi").dropDuplicates([id_col, "_own"]).drop("_own")
    else:
        kept = found.select(F.col("doc_id").alias("_kept")).distinct()
        out = docs.join(kept, docs[id_col].cast("long") == kept["_kept"], "left_semi")
    return out.unionByName(docs.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return classes(table(spark, sf_dir, "documents"))
