import gzip
import hashlib
import math
import re

import duckdb
import pytest

from orbitframe.operators import tiles
from orbitframe.queries import ORACLES, QUERIES
from orbitframe.queries.adapters import acquisitions

SF = "/root/testdata/sf0.01"
#: Ids from which no fixed prefix reaches the rows.
FAR = 4_000


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Rows of the test tables with large ids only."""
    d = tmp_path_factory.mktemp("far")
    spark.read.parquet(f"{SF}/events.parquet").where(f"event_id between {FAR} and {FAR + 59}").coalesce(1).write.parquet(f"{d}/events.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").where(f"l_orderkey between {FAR} and {FAR + 59}").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def whole(name, sf_dir):
    """The rows of the query's SQL without its id prefix."""
    con = duckdb.connect()
    for t in set(re.findall(r"FROM (events|lineitem|conversations)\b", ORACLES[name])):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if sf_dir != SF else ''}')")
    sql = re.sub(r" WHERE (event_id < \d+ AND min_lat > -80|event_id < \d+|l_orderkey < \d+)", "", ORACLES[name])
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def same(name, spark, sf_dir):
    columns, want = whole(name, sf_dir)
    plain = lambda rows: sorted((tuple(float(x) if hasattr(x, "as_tuple") else x for x in r) for r in rows), key=str)
    return want and plain(QUERIES[name](spark, sf_dir).select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", ["thumbs_merge", "dem_tiles", "stac_documents", "tile_counts", "baked_places"])
def test_events_are_read_whole(spark, far, name):
    assert same(name, spark, far)


@pytest.mark.parametrize("name", ["provenance_groups", "provenance_conflicts", "chip_noise_summary", "chip_speckle_summary", "chip_clip_summary"])
def test_lines_are_read_whole(spark, far, name):
    assert same(name, spark, far)


def test_vector_tiles_are_whole(spark, far):
    at = {}
    for r in acquisitions(spark, far).orderBy("href").collect():
        w, s, e, n = r["min_lon"], r["min_lat"], r["max_lon"], r["max_lat"]
        ring = [(p["lon"], p["lat"]) for p in r["rings"][0]] if r["rings"] else [(w, s), (e, s), (e, n), (w, n)]
        spots = lambda lon: math.floor((lon + 180) / 360 * 128)
        for x in range(max(0, spots(w)), min(127, spots(e)) + 1):
            for y in range(128):
                # without the buffer a tile that the box doesn't touch has no ring
                if tiles.tile_ring(ring, 7, x, y) and touches(s, n, y):
                    at.setdefault((x, y), []).append((3, [tiles.tile_ring(ring, 7, x, y)], {k: r[k] for k in ("task", "incidence") if r[k] is not None}))
    want = {(7, *k, hashlib.sha256(gzip.compress(tiles.encode_layer("footprints", f), mtime=0)).hexdigest()) for k, f in at.items()}
    assert want and {(r["zoom"], r["x"], r["y"], r["sha256"]) for r in QUERIES["vector_tiles"](spark, far).collect()} == want


def test_wrapped_boxes_keep_their_centre_below_footprints(spark):
    acq = spark.createDataFrame([("a", -179.0, 10.0, 179.0, 12.0)], "href string, min_lon double, min_lat double, max_lon double, max_lat double")
    assert tiles.tile_ids(acq, 2).count() == 1 and tiles.tile_ids(acq, tiles.FOOTPRINT_ZOOM).count() == 0
    assert tiles.encode_tiles(acq, 2, "centres", []).count() == 1


def test_rings_reach_the_sinks(spark, tmp_path):
    """Two rings: a MultiPolygon in GeoJSON and in WKB; a closed one stays as it is."""
    import json
    import struct

    from orbitframe.sources import sinks

    rings = [[(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]
    acq = spark.createDataFrame([("a", 0.0, 0.0, 6.0, 6.0, [[{"lon": x, "lat": y} for x, y in r] for r in rings])], "id string, min_lon double, min_lat double, max_lon double, max_lat double, rings array<array<struct<lon:double,lat:double>>>")
    got = json.loads(sinks.features(acq, ["id"]).first()["value"])["geometry"]
    closed = [[list(p) for p in (r if r[0] == r[-1] else [*r, r[0]])] for r in rings]
    assert got == {"type": "MultiPolygon", "coordinates": [[r] for r in closed]}
    sinks.write_geoparquet(acq, str(tmp_path / "g"))
    raw = bytes(spark.read.parquet(str(tmp_path / "g")).first()["geometry"])
    assert struct.unpack("<BII", raw[:9]) == (1, 6, 2) and len(raw) == 9 + sum(13 + 16 * len(r) for r in closed)


def test_headers_read_ranges_only(spark):
    from orbitframe.errors import UnreadableProduct
    from orbitframe.sources import products

    def open_at(path):
        def read(offset, length):
            raise UnreadableProduct(f"asked for {length} bytes of {path}")

        return read

    row = products.headers(spark.createDataFrame([("p1",)], "path string"), open_at).first()
    assert row["xml"] is None and row["error"].endswith("of p1")


def touches(south, north, y):
    """Whether row y of zoom 7 holds a latitude between the two."""
    row = lambda lat: (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * 128
    return math.floor(row(north)) <= y <= math.floor(row(south))


def test_slugs_are_whole(spark, tmp_path):
    texts = ["a b " * 30 + "end", "x" * 80, "-" * 70 + "late", None, "", "short one"]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r["slug"] for r in QUERIES["slugs"](spark, str(tmp_path)).collect()}
    assert got == {0: "a-b-" * 30 + "end", 1: "x" * 80, 2: "late", 3: "item", 4: "item", 5: "short-one"}
