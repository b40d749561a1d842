import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.errors import PlanError, UnreadableProduct
from orbitframe.functions import cards, codec
from orbitframe.operators import bake, frames, windows
from orbitframe.plans.spec import SearchSpec
from orbitframe.sources import archive

from .test_catalog import SCHEMA, row


def test_frames(spark):
    df = spark.createDataFrame([row("a", day=5), row("b", day=1), row("c", day=None), row("d", day=3)], SCHEMA)
    assert [(r["href"], r["label"]) for r in frames.ordered(df.withColumn("one", F.lit(1)), ["one"]).orderBy("frame").collect()] == [("b", "2024-01-01"), ("d", "2024-01-03"), ("a", "2024-01-05"), ("c", "c")]
    assert [r["href"] for r in frames.change_frames(df).collect()] == ["b", "a"] and frames.timescan_frames(df).count() == 3
    assert {(r["prev_href"], r["href"]) for r in frames.pairs(df, ["task"]).collect()} == {("b", "d"), ("d", "a")}
    with pytest.raises(PlanError):
        frames.change_frames(df.where("href = 'a'"))
    with pytest.raises(PlanError):
        frames.timescan_frames(df.union(spark.createDataFrame([row("e", pols=("HH",))], SCHEMA)))


def test_windows(spark):
    g = windows.Grid(10.0, 20.0, 0.5, 0.5, 8, 6)
    assert g.window((10.6, 18.1, 11.4, 18.9)) == (2, 4, 1, 3) and g.window(None) == (0, 6, 0, 8)
    with pytest.raises(ValueError, match="overlap"):
        g.window((0, 0, 1, 1))
    a = np.arange(48).reshape(6, 8)
    cells = spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(a)], "row int, col int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in windows.read_window(cells, g, (10.6, 18.1, 11.4, 18.9)).collect()}
    assert got == {(0, 0): 17, (0, 1): 18, (1, 0): 25, (1, 1): 26}
    assert windows.read_window(cells, g, None, 3).agg(F.max("row"), F.max("col")).first()[:] == (1, 2)
    assert windows.quicklook(cells, g, 3).agg(F.max("row"), F.max("col")).first()[:] == (1, 2)
    moved = windows.warp(cells, (10.0, 0.5, 0.0, 20.0, 0.0, -0.5), g)
    assert {(r["row"], r["col"]): r["value"] for r in moved.collect()} == {(int(r), int(c)): float(v) for (r, c), v in np.ndenumerate(a)}
    with pytest.raises(PlanError):
        windows.warp(cells, (0, 0, 0, 0, 0, 0), g)


def test_control_points(spark):
    project = lambda r, c, h: (10 + c * 0.01 + h * 1e-5, 20 - r * 0.01)
    heights = lambda lon, lat: np.where(lon > 10.5, np.nan, 100.0)
    s = spark.createDataFrame([("s", 101, 81, 7.0)], "scene_id string, rows int, cols int, height double")
    p = windows.control_points(s, project, heights, steps=11)
    r = {(x["row"], x["col"]): x for x in p.collect()}
    assert len(r) == 121 and r[0, 0]["height"] == 100 and r[0, 80]["height"] == 7.0 and r[0, 0]["lon"] == pytest.approx(10.001)
    w = windows.clip_window(p, (10.2, 19.42, 10.21, 19.43)).first()
    assert (w["row_from"], w["row_to"], w["col_from"], w["col_to"]) == (40, 70, 8, 32)
    assert windows.clip_window(p, (0, 0, 1, 1)).count() == 0


def test_cards(spark):
    df = spark.createDataFrame([row("a", place="Dock", products=("GEC", "SICD")), row("b", box=None)], SCHEMA)
    c = df.select(cards.context().alias("c")).collect()
    assert c[0]["c"]["where"] == "Dock" and "maps" in c[0]["c"]["products"][0]["explanation"] and c[1]["c"]["where"] == "A" and c[1]["c"]["summary"]["centre"] is None
    assert [r["href"] for r in df.where(cards.permitted((0, 0, 1, 1))).collect()] == ["a"]
    doc = json.loads(cards.to_stac(df, "col", "http://x/").first()["value"])
    assert doc["links"][0]["href"] == "http://x/collections/col/items/a" and doc["bbox"] == [0, 0, 1, 1]
    texts = ['```json\n{"summary": " s ", "observations": ["a", " "], "confidence": "High"}\n```', 'so {"summary": "t", "confidence": "sure"} ok', '{"summary": ""}', "none", None]
    r = cards.replies(spark.createDataFrame([(t,) for t in texts], "reply string")).collect()
    assert [x["ok"] for x in r] == [True, True, False, False, False] and r[0]["observations"] == ["a"] and r[0]["confidence"] == "high" and r[1]["confidence"] is None


def test_codec(spark, tmp_path):
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    r = v.select(codec.to_bytes(F.col("v")).alias("b")).select("b", codec.from_bytes(F.col("b")).alias("v")).collect()
    assert bytes(r[0]["b"]) == np.array([1.5, -2], "<f4").tobytes() and r[0]["v"] == [1.5, -2.0] and r[1]["v"] is None
    (tmp_path / "x.bin").write_bytes(b"abc")
    d = codec.file_digests(spark, str(tmp_path)).first()
    assert d["sha256"].startswith("ba7816bf") and d["bytes"] == 3
    c = spark.createDataFrame([([(0, 1, 2.5), (1, 0, 3.0)],)], "c array<struct<i:int,j:int,value:double>>")
    assert c.select(codec.dense(F.col("c"), 2, 2).alias("d")).first()["d"] == [[0.0, 2.5], [3.0, 0.0]]


def test_archive(spark):
    def post(url, body):
        if body.get("token") == 2:
            return {"features": [{"id": "c"}], "links": [{"rel": "next"}]}
        return {"features": [{"id": "a", "links": [{"rel": "self", "href": "h/a"}]}, {"id": "b"}], "links": [{"rel": "next", "href": url, "body": {"token": 2}, "merge": True}]}

    spec = SearchSpec(start="2024-01-01", bbox=(0, 0, 1, 1), limit=9999)
    assert archive.request(spec) == {"limit": 500, "bbox": [0, 0, 1, 1], "datetime": "2024-01-01T00:00:00Z/.."}
    rows = archive.archive(spark, post, "u", spec).collect()
    assert [json.loads(r["doc"])["id"] for r in rows] == ["a", "b", "c"] and rows[0]["href"] == "h/a"


def test_range_reader():
    data = bytes(range(100))
    partial = archive.RangeReader("u", lambda u, a, b: (206, data[a : b + 1], 100))
    whole = archive.RangeReader("u", lambda u, a, b: (200, data, None))
    assert partial(10, 5) == whole(10, 5) == data[10:15] and (partial.bytes_read, partial.size, whole.bytes_read) == (5, 100, 100)
    for status in (404, 410, 500):
        with pytest.raises(UnreadableProduct):
            archive.RangeReader("u", lambda u, a, b, s=status: (s, b"", None))(0, 1)


def test_bake(spark):
    df = spark.createDataFrame([row("a"), row("b", place="Kept"), row("c", box=(50, 50, 51, 51)), row("d", box=None)], SCHEMA)
    got = {r["href"]: r["place"] for r in bake.bake_places(df, lambda lat, lon: f"{lat:.1f},{lon:.1f}").collect()}
    assert got == {"a": "0.5,0.5", "b": "Kept", "c": "50.5,50.5", "d": None}
    made = {r["href"]: (r["png"], r["error"]) for r in bake.bake(df, lambda h: bytes(h, "ascii") if h != "b" else 1 / 0, ["href"], "png", "binary").collect()}
    assert bytes(made["a"][0]) == b"a" and "ZeroDivisionError" in made["b"][1]
    with pytest.raises(Exception, match="ZeroDivision"):
        bake.bake(df, lambda h: 1 / 0, ["href"], "png", "binary", skip_errors=False).collect()
    out, seen = bake.observed(df, placed=F.count("place"))
    out.collect()
    assert seen.get == {"rows": 4, "placed": 1}
