import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from orbitframe.errors import PlanError, ProvenanceMismatch
from orbitframe.operators import catalog, provenance, search, sites
from orbitframe.plans.spec import SearchSpec, SiteSpec
from orbitframe.sources import listing, sinks
from orbitframe.streaming import refresh, watch

SCHEMA = "href string, id string, task string, ts timestamp, acq_date date, min_lon double, min_lat double, max_lon double, max_lat double, products array<string>, polarizations array<string>, incidence double, res_range double, res_azimuth double, place string, rings array<array<struct<lon:double,lat:double>>>"


def row(href, task="A", day=1, box=(0, 0, 1, 1), products=("GEC",), pols=("VV",), inc=30.0, res=0.5, place=None, hour=0):
    ts = None if day is None else datetime(2024, 1, day, hour)
    return (href, href, task, ts, ts and ts.date(), *(map(float, box) if box else (None,) * 4), list(products), None if pols is None else list(pols), inc, res, res, place, None)


@pytest.fixture(scope="module")
def acq(spark):
    rows = [row("a", "Port_A", 15, products=("GEC", "SICD")), row("b", "Site%B", 20, (10, 10, 11, 11)), row("c", "Port_A", 2, (5, 5, 6, 6), pols=("VV", "VH")), row("d", None, 3), row("e", "PortXA", None), row("f", "Port_A", 9, None, inc=None, res=None, pols=None)]
    return spark.createDataFrame(rows, SCHEMA)


def found(acq, **spec):
    return [r["href"] for r in search.search(acq, SearchSpec(**spec)).collect()]


def test_order_and_nulls(acq):
    assert found(acq) == ["e", "c", "f", "a", "b", "d"]
    assert found(acq, start="2024-01-10") == ["e", "a", "b"]  # undated rows pass
    assert found(acq, area="port_a") == ["c", "f", "a"] and found(acq, area="%") == ["b"]
    assert found(acq, bbox=(1, 1, 2, 2)) == ["e", "a", "d"]  # touching counts, no box never does
    assert found(acq, bbox=(1, 1, 5, 5)) == ["e", "c", "a", "d"]
    assert found(acq, polarizations="vh") == ["c"] and "f" not in found(acq, min_incidence=0.0) and "f" not in found(acq, max_resolution=9.0)
    assert found(acq, max_per_task=1) == ["e", "c", "b", "d"] and found(acq, limit=2) == ["e", "c"]
    assert found(acq, intersects={"type": "Polygon", "coordinates": [[[9, 9], [12, 9], [12, 12]]]}) == ["b"]
    assert found(acq, area="port", fuzzy=True) == ["e", "c", "f", "a"]
    assert found(acq.limit(0)) == []


def test_pages_and_lookups(acq):
    p = search.page(acq, SearchSpec(), 4, 2).collect()
    assert [r["href"] for r in p] == ["b", "d"] and not p[0]["has_next"]
    assert search.page(acq, SearchSpec(), 0, 5).first()["has_next"]
    assert [r["href"] for r in search.in_request_order(acq, ["d", "zz", "a"]).collect()] == ["d", "a"]


def test_site_coverage(spark):
    rows = [row("x", "S", 10), row("y", "S", 1, place=" "), row("z", "S", 4, place="Dock", pols=("VV", "VH")), row("w", "S", None, place="never"), row("v", "T", 5)]
    c = {r["task"]: r for r in sites.coverage(spark.createDataFrame(rows, SCHEMA)).collect()}
    s = c["S"]
    assert (s["passes"], s["span_days"], s["min_revisit_days"], s["median_revisit_days"], s["max_revisit_days"]) == (4, 9, 3.0, 4.5, 6.0)
    assert s["label"] == "Dock" and s["hrefs"] == ["y", "z", "x", "w"] and s["comparable_passes"] == 2 and s["comparable_hrefs"] == ["y", "x"]
    assert c["T"]["span_days"] is None and c["T"]["label"] == "T"


def test_comparable_ties_and_gates(spark):
    rows = [row("1", "S", 1, pols=("VV",)), row("2", "S", 2, pols=("HH",)), row("3", "S", 9, pols=("VV", "VH")), row("4", "R", 1), row("5", "R", 2, hour=1), row("6", "R", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["task"]: r["comparable_polarizations"] for r in sites.comparable_groups(df).collect()} == {"S": ["HH"], "R": ["VV"]}
    names = lambda **k: [r["task"] for r in sites.rank_sites(df, None, SiteSpec(**k)).collect()]
    assert names() == ["R", "S"] and names(rank_by="comparable") == ["R"] and names(rank_by="recency") == ["S", "R"] and names(rank_by="cadence") == ["R", "S"]
    assert names(max_revisit_days=25 / 24) == ["R"] and names(max_revisit_days=1.0) == [] and names(top=0) == [] and names(max_span_days=2) == ["R"]
    assert names(min_span_days=8) == ["S"] and names(active_since="2024-01-09") == ["S"] and names(first_before="2023") == []


def test_gaps_cross_months(spark):
    rows = [("S", datetime(2024, 1, 30), "a"), ("S", datetime(2024, 1, 31), "b"), ("S", datetime(2024, 4, 1), "c"), ("S", datetime(2024, 4, 1), "d"), (None, datetime(2024, 4, 2), "e")]
    got = sites.with_gaps(spark.createDataFrame(rows, "task string, ts timestamp, href string"), ["task"]).orderBy("href").collect()
    assert [r["gap"] for r in got] == [None, 1.0, 61.0, 0.0, None]


def test_upsert_keeps_places(spark):
    old = spark.createDataFrame([("a", "x", "Here"), ("b", "y", None)], "href string, task string, place string")
    new = spark.createDataFrame([("a", None, None), ("c", "z", "There"), (None, "q", None)], "href string, task string, place string")
    assert sorted(map(tuple, catalog.upsert(old, new).collect())) == [("a", None, "Here"), ("b", "y", None), ("c", "z", "There")]


def test_refresh_and_read_through(spark):
    old = spark.createDataFrame([row("a", day=10), row("b", day=12)], SCHEMA)
    live = spark.createDataFrame([row("b", day=12, inc=1.0), row("c", day=11), row("d", day=1), row("e", day=None)], SCHEMA)
    new, tally = refresh.refresh(old, live, overlap_days=2)
    assert tally == {"scanned": 3, "added": 2, "refreshed": 1, "start": date(2024, 1, 10)} and sorted(r["href"] for r in new.collect()) == ["a", "b", "c", "e"]
    got = {r["href"]: r["incidence"] for r in refresh.search_live(old, live, SearchSpec(), 2).collect()}
    assert got == {"a": 30.0, "b": 30.0, "c": 30.0, "e": 30.0}


def test_watch_never_repeats(spark, tmp_path):
    store = watch.WatchStore(spark, str(tmp_path / "w"))
    df = lambda *h: spark.createDataFrame([(x, x) for x in h], "href string, id string")
    r = watch.watch(df("a", "b"), "q", store)
    assert r["first_run"] and r["new_count"] == 2
    assert [x["href"] for x in watch.watch(df("b", "c"), "q", store)["new_items"].collect()] == ["c"]
    assert watch.watch(df("a", "b", "c"), "q", store)["new_count"] == 0  # one that left and came back isn't new
    r = watch.watch(df("a"), "q", store, reset=True)
    assert r["new_count"] == 1 and r["total_seen"] == 3
    assert watch.watch(df("a"), "other", store)["first_run"]


def test_watch_stream_equals_batch(spark, tmp_path):
    src, seen = str(tmp_path / "src"), []
    for part in (["a", "b"], ["b", "c"], ["a"]):
        spark.createDataFrame([(x, x) for x in part], "href string, id string").write.mode("append").parquet(src)
        q = watch.start_watch(spark.readStream.schema("href string, id string").parquet(src), "q", str(tmp_path / "cp"), lambda df, _: seen.append(sorted(r["href"] for r in df.collect())))
        q.awaitTermination(60)
    assert [s for s in seen if s] == [["a", "b"], ["c"]]


def test_refresh_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part in ([("a", "x", "P")], [("a", "y", None), ("b", "z", None)]):
        spark.createDataFrame(part, "href string, task string, place string").write.mode("append").parquet(src)
        refresh.refresh_stream(spark.readStream.schema("href string, task string, place string").parquet(src), out, str(tmp_path / "cp"), ["href", "task", "place"]).awaitTermination(60)
    rows = lambda: sorted(map(tuple, refresh.current(spark, out).collect()))
    assert rows() == [("a", "y", "P"), ("b", "z", None)]
    refresh.compact(spark, out)
    assert rows() == [("a", "y", "P"), ("b", "z", None)] and len([p for p in os.listdir(out) if p.startswith("log-")]) == 1
    # A query with a new checkpoint adds to the log; what is there already stays.
    new = str(tmp_path / "new")
    spark.createDataFrame([("b", "w", "Q")], "href string, task string, place string").write.parquet(new)
    refresh.refresh_stream(spark.readStream.schema("href string, task string, place string").parquet(new), out, str(tmp_path / "cp2"), ["href", "task", "place"]).awaitTermination(60)
    assert rows() == [("a", "y", "P"), ("b", "w", "Q")]
    with pytest.raises(PlanError):
        refresh.current(spark, str(tmp_path / "none"))


def test_watch_sources_and_ties(spark, tmp_path):
    """Any source and any store will do; of rows with one key the first by ts and href is reported."""

    class Source:
        def search(self, spec):
            return spark.createDataFrame([("k", datetime(2024, 1, d), f"n{d}") for d in (3, 1, 2)], "href string, ts timestamp, id string")

    store = watch.WatchStore(spark, str(tmp_path / "seen"))
    first = watch.run_watch(Source(), SearchSpec(products="GEC"), store)
    assert first["new_count"] == 1 and [r["id"] for r in first["new_items"].collect()] == ["n1"]
    assert watch.run_watch(Source(), SearchSpec(products="GEC"), store)["new_count"] == 0
    assert watch.run_watch(Source(), SearchSpec(products="CSI"), store)["first_run"]


def test_coverage_lists(spark):
    rows = [row("b", day=2, pols=("VV",), products=("SICD", "GEC")), row("a", day=1, pols=("VV",), products=("GEC",)), row("c", day=3, pols=("HH",), products=("CSI",)), row("d", day=None, pols=("VV",), products=())]
    c = sites.coverage(spark.createDataFrame(rows, SCHEMA)).first()
    assert (c["products"], c["polarizations"], c["hrefs"], c["comparable_hrefs"]) == (["CSI", "GEC", "SICD"], ["HH", "VV"], ["a", "b", "c", "d"], ["a", "b"])


def test_listing(spark):
    pages = {None: b"<R><IsTruncated>true</IsTruncated><NextContinuationToken>t</NextContinuationToken><Contents><Key>k1</Key></Contents></R>", "t": b"<R><IsTruncated>false</IsTruncated><Contents><Key>k2</Key></Contents></R>"}
    assert list(listing.list_all(lambda p, t: pages[t], "x")) == ["k1", "k2"]
    for bad in (b"<R", b'<!DOCTYPE x [<!ENTITY a "b">]><R/>'):
        with pytest.raises(listing.CatalogError):
            listing.parse_listing(bad)
    base = "sar-data/tasks/S/2024-01-05-10/"
    keys = [base + "x.stac.v2.json", base + "x_GEC.tif", "sar-data/tasks/S/2023-01-05-10/y.tif", "sar-data/tasks/S/other/z.tif"]
    d = listing.acquisition_dirs(spark.createDataFrame([(k,) for k in keys], "key string"), start=date(2024, 1, 1)).collect()
    assert len(d) == 1 and d[0]["sidecar"].endswith(".json") and d[0]["files"] == [base + "x_GEC.tif"]
    got = listing.assemble(listing.fetch_sidecars(listing.acquisition_dirs(spark.createDataFrame([(k,) for k in keys[:2]], "key string")), lambda k: "{}")).collect()
    assert got[0]["assets"] == {"x_GEC.tif": base + "x_GEC.tif"}


def test_documents(spark):
    doc = {"id": "i", "bbox": [0, 1, 5, 2, 3, 9], "properties": {"start_datetime": "2024-01-02T03:04:05Z", "sar:polarizations": ["VV"]}, "assets": {"b_CSI.tif": {"href": "b"}, "a.tif": {"href": "a", "type": "image/tiff"}}, "links": [{"rel": "self", "href": "http://h/x"}], "geometry": {"type": "Polygon", "coordinates": [[[0, 1, 7], [3, 1, 7], [3, 2, 7]]]}}
    r = catalog.from_documents(spark.createDataFrame([(json.dumps(doc), None), ("{", "z"), (json.dumps({"id": "n", "geometry": doc["geometry"]}), "h")], "doc string, href string")).collect()
    a = next(x for x in r if x["id"] == "i")
    assert (a["href"], a["min_lon"], a["max_lon"], a["max_lat"], a["products"], a["polarizations"]) == ("http://h/x", 0, 2, 3, ["GEC", "CSI"], ["VV"]) and a["ts"] == datetime(2024, 1, 2, 3, 4, 5)
    b = next(x for x in r if x["id"] == "n")
    assert (b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"]) == (0, 1, 3, 2) and len(b["rings"][0]) == 3 and b["task"] is None


def test_sinks(spark, acq, tmp_path):
    path = str(tmp_path / "cat")
    sinks.write_catalog(acq, path)
    assert sinks.read_catalog(spark, path).count() == 6
    sinks.write_meta(spark, path, {"version": "99"})
    with pytest.raises(sinks.SchemaVersionError):
        sinks.read_catalog(spark, path)
    fc = json.loads(sinks.feature_collection(acq, ["task"]))
    assert len(fc["features"]) == 6 and fc["bbox"] == [0, 0, 11, 11]
    sinks.write_geoparquet(acq, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 5
    with pytest.raises(sinks.PlanError):
        sinks.write_geoparquet(acq.where("href = 'f'"), str(tmp_path / "h"))
    sinks.write_manifest(acq.select("id", "task"), str(tmp_path / "m.jsonl"), acq.limit(0))
    assert spark.read.json(str(tmp_path / "m.jsonl")).count() == 6 and not (tmp_path / "m.skipped.jsonl").exists()


def test_provenance(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("b", 2, "x", "k"), ("c", 3, None, None)], "item_id string, ts int, cal string, spk string")
    g = provenance.groups(df, ["cal", "spk"]).collect()
    assert [(r["cal"], r["spk"], r["n"]) for r in g] == [("x", "none", 1), ("x", "k", 1), ("(unrecorded)", "(unrecorded)", 1)]
    with pytest.raises(ProvenanceMismatch):
        provenance.shared(df, ["cal"])
    assert provenance.shared(df.where("ts < 3"), ["cal"]) == {"cal": "x"}
    t = df.select(provenance.tags({"cal": F.col("cal")}).alias("t")).select("t", provenance.untag(F.col("t")).alias("u")).first()
    assert t["t"] == {"SAR_CAL": "x"} and t["u"] == {"cal": "x"}


def test_exports_and_rollups(spark, tmp_path):
    acq = spark.createDataFrame([("a", "i", bytearray(b"x"), "GEC", 8), ("b", "j", None, None, None)], "href string, id string, thumbnail binary, thumb_asset string, thumb_size int")
    assert [(r["href"], r["id"], bytes(r["png"]), r["asset"], r["size"]) for r in catalog.export_thumbnails(acq).collect()] == [("a", "i", b"x", "GEC", 8)]
    merged = catalog.merge_thumbnails(acq.withColumn("thumbnail", F.lit(None).cast("binary")), catalog.export_thumbnails(acq).drop("id"))
    assert {r["href"]: r["thumbnail"] and bytes(r["thumbnail"]) for r in merged.collect()} == {"a": b"x", "b": None}
    chips = spark.createDataFrame([("i", 1.0), ("j", 2.0), ("i", 3.0)], "item_id string, mean double")
    assert provenance.chip_rollup(chips).first()[:] == (3, ["i", "j"])
    sinks.write_chips(chips, str(tmp_path / "chips"), "item_id")
    assert spark.read.parquet(str(tmp_path / "chips")).where("item_id = 'i'").count() == 2
    cube = spark.createDataFrame([(p, r, c, float(p)) for p in range(2) for r in range(3) for c in range(3)], "pass_idx int, row int, col int, value double")
    sinks.write_cube(cube, str(tmp_path / "cube"))
    back = spark.read.parquet(str(tmp_path / "cube"))
    assert sorted(map(tuple, back.select(*cube.columns).collect())) == sorted(map(tuple, cube.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    """Rows older than the newest less so many days don't reach a stateful operator of a later batch."""
    src, seen = str(tmp_path / "src"), []
    for part in ([("a", 20)], [("b", 1), ("c", 19)]):
        spark.createDataFrame([(k, datetime(2024, 1, d)) for k, d in part], "href string, ts timestamp").write.mode("append").parquet(src)
        late = refresh.late_tolerant(spark.readStream.schema("href string, ts timestamp").parquet(src), "ts", 7).dropDuplicates(["href", "ts"])
        late.writeStream.foreachBatch(lambda df, _: seen.extend(r["href"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(seen) == ["a", "c"]
