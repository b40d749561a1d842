"""Vector tiles: clipping, MVT encoding, content dedup and the PMTiles container."""

from __future__ import annotations

import gzip
import hashlib
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import hilbert_id, tile_fraction

# Extent and buffer of a tile, and the zoom from which footprints are drawn instead of points.
EXTENT, BUFFER, FOOTPRINT_ZOOM = 4096, 64, 6


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def zigzag(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def _field(number: int, body: bytes) -> bytes:
    return uvarint(number << 3 | 2) + uvarint(len(body)) + body


def _commands(kind: int, parts: list[list[tuple[int, int]]]) -> list[int]:
    """Geometry commands: moves, lines and closings, in steps from the point before."""
    out, x, y = [], 0, 0
    for part in parts:
        for i, (px, py) in enumerate(part):
            if i == 0:
                out.append(1 | 1 << 3)
            elif i == 1:
                out.append(2 | (len(part) - 1) << 3)
            out += [zigzag(px - x), zigzag(py - y)]
            x, y = px, py
        if kind == 3:
            out.append(7 | 1 << 3)
    return out


def _value(v) -> bytes:
    if isinstance(v, bool):
        return uvarint(7 << 3) + uvarint(int(v))
    if isinstance(v, int):
        return uvarint(6 << 3) + uvarint(zigzag(v))
    if isinstance(v, float):
        return uvarint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


class Layer:
    """A layer in the making: features are encoded as they come, keys and values are stored once."""

    def __init__(self, name: str):
        self.keys: dict[str, int] = {}
        self.values: dict[tuple, int] = {}
        self.body, self.features = bytearray(_field(1, name.encode())), 0

    def add(self, kind: int, parts: list, props: dict) -> None:
        """A point (1) or polygon (3); properties without a value are left out."""
        tags = [n for k, v in props.items() if v is not None for n in (self.keys.setdefault(k, len(self.keys)), self.values.setdefault((type(v), v), len(self.values)))]
        f = _field(2, b"".join(map(uvarint, tags))) + uvarint(3 << 3) + uvarint(kind) + _field(4, b"".join(map(uvarint, _commands(kind, parts))))
        self.body += _field(2, f)
        self.features += 1

    def encoded(self) -> bytes:
        tables = b"".join(_field(3, k.encode()) for k in self.keys) + b"".join(_field(4, _value(v)) for _, v in self.values)
        return _field(3, bytes(self.body) + tables + uvarint(5 << 3) + uvarint(EXTENT) + uvarint(15 << 3) + uvarint(2))


def encode_layer(name: str, features: list[tuple[int, list, dict]]) -> bytes:
    """A layer of (1 point or 3 polygon, parts, properties)."""
    layer = Layer(name)
    for f in features:
        layer.add(*f)
    return layer.encoded()


def _clip(ring: list[tuple[float, float]], low: float, high: float) -> list[tuple[float, float]]:
    """A ring cut off at the four sides of a square, one after the other."""
    for axis in (0, 1):
        for edge, keep in ((low, 1), (high, -1)):
            out = []
            for i, b in enumerate(ring):
                a = ring[i - 1]
                da, d = (a[axis] - edge) * keep, (b[axis] - edge) * keep
                if (da < 0) != (d < 0):
                    t = da / (da - d)
                    out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
                if d >= 0:
                    out.append(b)
            ring = out
    return ring


def tile_ring(ring: list[tuple[float, float]], zoom: int, x: int, y: int) -> list[tuple[int, int]]:
    """A lon/lat ring in the tile's own whole numbers, clipped with the buffer, wound as MVT wants; [] if little is left."""
    n = 2**zoom
    pts = []
    for lon, lat in ring:
        rad = math.radians(max(-85.05112878, min(85.05112878, lat)))
        pts.append((((lon + 180) / 360 * n - x) * EXTENT, ((1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2 * n - y) * EXTENT))
    whole = []
    for p in _clip(pts, -BUFFER, EXTENT + BUFFER):
        q = (round(p[0]), round(p[1]))
        if not whole or whole[-1] != q:
            whole.append(q)
    if len(whole) > 1 and whole[0] == whole[-1]:
        whole.pop()
    area = sum(whole[i - 1][0] * b[1] - b[0] * whole[i - 1][1] for i, b in enumerate(whole))
    if len(whole) < 3 or area == 0:
        return []
    return whole if area > 0 else whole[::-1]


def tile_ids(acq: DataFrame, zoom: int) -> DataFrame:
    """acq with x, y: a row for each tile that its box touches, or for its centre below FOOTPRINT_ZOOM.

    A box wider than half the globe wraps around the antimeridian: it has a centre, but no footprint.
    """
    if zoom < FOOTPRINT_ZOOM:
        fx, fy = tile_fraction((F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2, zoom)
        lo_x, hi_x, lo_y, hi_y = fx, fx, fy, fy
    else:
        lo_x, hi_y = tile_fraction(F.col("min_lon"), F.col("min_lat"), zoom)
        hi_x, lo_y = tile_fraction(F.col("max_lon"), F.col("max_lat"), zoom)
    top = F.lit(2**zoom - 1)
    cut = lambda c: F.greatest(F.lit(0), F.least(top, F.floor(c).cast("int")))
    rows = acq.where("min_lon is not null" if zoom < FOOTPRINT_ZOOM else "min_lon is not null and max_lon - min_lon <= 180")
    return rows.withColumn("x", F.explode(F.sequence(cut(lo_x), cut(hi_x)))).withColumn("y", F.explode(F.sequence(cut(lo_y), cut(hi_y))))


def encode_tiles(acq: DataFrame, zoom: int, layer: str, properties: list[str]) -> DataFrame:
    """zoom, x, y, tile_id, sha256 and mvt (gzip) for each tile that has a feature.

    Rows come to a task sorted by tile and href, by a sort that spills, and go into the layer one by one: a crowded
    tile, such as the one of zoom 0, costs a worker its encoded bytes, not a frame of all its rows.
    """
    rows = tile_ids(acq, zoom).withColumn("tile_id", hilbert_id(zoom, F.col("x"), F.col("y")))
    cols = ["x", "y", "tile_id", "href", "min_lon", "min_lat", "max_lon", "max_lat", *(["rings"] if "rings" in acq.columns else []), *properties]

    def feature(r: dict) -> tuple[int, list]:
        x, y, w, s, e, n = (r[c] for c in ("x", "y", "min_lon", "min_lat", "max_lon", "max_lat"))
        if zoom < FOOTPRINT_ZOOM:
            return 1, [[tile_point((w + e) / 2, (s + n) / 2, zoom, x, y)]]
        own = r.get("rings")
        own = [[(p["lon"], p["lat"]) for p in ring] for ring in own] if own is not None and len(own) else [[(w, s), (e, s), (e, n), (w, n)]]
        return 3, [t for ring in own if (t := tile_ring(ring, zoom, x, y))]

    def tile(at: tuple[int, int, int], made: Layer) -> pd.DataFrame:
        body = gzip.compress(made.encoded(), mtime=0)
        return pd.DataFrame({"zoom": [zoom], "x": [at[0]], "y": [at[1]], "tile_id": [at[2]], "sha256": [hashlib.sha256(body).hexdigest()], "mvt": [body]})

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = None, Layer(layer)
        for pdf in parts:
            done = []
            for r in pdf.to_dict("records"):
                at = (int(r["x"]), int(r["y"]), int(r["tile_id"]))
                if at != now:
                    if made.features:
                        done.append(tile(now, made))
                    now, made = at, Layer(layer)
                kind, shape = feature(r)
                if shape:
                    made.add(kind, shape, {p: (v.item() if hasattr(v, "item") else v) for p in properties if not (v := r[p]) is None and v == v})
            if done:
                yield pd.concat(done)
        if made.features:
            yield tile(now, made)

    dealt = rows.select(*dict.fromkeys(cols)).repartition("tile_id").sortWithinPartitions("tile_id", "href")
    return dealt.mapInPandas(encode, "zoom int, x int, y int, tile_id long, sha256 string, mvt binary")


def tile_point(lon: float, lat: float, zoom: int, x: int, y: int) -> tuple[int, int]:
    n, rad = 2**zoom, math.radians(max(-85.05112878, min(85.05112878, lat)))
    return round(((lon + 180) / 360 * n - x) * EXTENT), round(((1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2 * n - y) * EXTENT)


def directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """PMTiles directory of (tile id, offset, length, run length), gzipped."""
    out, last = uvarint(len(entries)), 0
    for e in entries:
        out += uvarint(e[0] - last)
        last = e[0]
    out += b"".join(uvarint(e[3]) for e in entries) + b"".join(uvarint(e[2]) for e in entries)
    for i, e in enumerate(entries):
        follows = i and e[1] == entries[i - 1][1] + entries[i - 1][2]
        out += uvarint(0 if follows else e[1] + 1)
    return gzip.compress(out, mtime=0)


def container(tiles: DataFrame, min_zoom: int, max_zoom: int, bounds: tuple[float, float, float, float], metadata: bytes = b"{}", most: int = 512 << 20) -> bytes:
    """A PMTiles v3 archive: one writer for one file.  Sizes are counted before tiles are fetched; above `most` bytes it refuses."""
    size = tiles.agg(F.coalesce(F.sum(F.length("mvt")), F.lit(0)).alias("n")).first()["n"]
    if size > most:
        raise ValueError(f"{size} bytes of tiles are too many for one archive")
    entries, data, at = [], bytearray(), {}
    for r in tiles.orderBy("tile_id").select("tile_id", "sha256", "mvt").toLocalIterator():
        if r["sha256"] not in at:
            at[r["sha256"]] = (len(data), len(r["mvt"]))
            data += r["mvt"]
        entries.append((r["tile_id"], *at[r["sha256"]], 1))
    root, meta = directory(entries), gzip.compress(metadata, mtime=0)
    e7 = lambda v: int(round(v * 1e7))
    w, s, e, n = bounds
    head = struct.pack("<7sB11Q6B4iB2i", b"PMTiles", 3, 127, len(root), 127 + len(root), len(meta), 127 + len(root) + len(meta), 0, 127 + len(root) + len(meta), len(data), len(entries), len(entries), len(at), 1, 2, 2, 1, min_zoom, max_zoom, e7(w), e7(s), e7(e), e7(n), min_zoom, e7((w + e) / 2), e7((s + n) / 2))
    return head + root + meta + bytes(data)
