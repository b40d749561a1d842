import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.functions import geometry as geo
from orbitframe.functions import radiometry as rad
from orbitframe.functions import special
from orbitframe.operators import cube, raster, tiles, vectors
from orbitframe.schemas import load_schema, schema_names
from orbitframe.sources import products
from orbitframe.streaming import budget
from orbitframe.streaming.jobs import Jobs


def cells(spark, arrays):
    rows = [(p, r, c, float(v)) for p, a in enumerate(arrays) for (r, c), v in np.ndenumerate(np.asarray(a, float))]
    return spark.createDataFrame(rows, "pass_idx int, row int, col int, value double")


def test_special_functions():
    assert special.trigamma(1) == pytest.approx(math.pi**2 / 6, abs=1e-12) and special.trigamma(0.5) == pytest.approx(math.pi**2 / 2, abs=1e-11)
    assert special.incomplete_beta(0.3, 1, 1) == pytest.approx(0.3) and special.incomplete_beta(0.5, 7.5, 7.5) == pytest.approx(0.5)
    assert special.incomplete_beta(0.2, 2, 3) == pytest.approx(0.1808, abs=1e-12)
    t = special.threshold_for(0.05, 4.0)
    assert special.false_alarm(t, 4.0) == pytest.approx(0.05, abs=1e-9) and special.false_alarm(0, 4) == 1.0
    rng = np.random.default_rng(3)
    a, b = rng.gamma(4, size=200_000), rng.gamma(4, size=200_000)
    d = 10 * np.log10(a / b)
    assert special.change_sigma_db(4) == pytest.approx(d.std(), rel=0.02) and special.false_alarm(3, 4) == pytest.approx((abs(d) >= 3).mean(), abs=0.01)


def test_detection_of_nothing(spark):
    r = spark.createDataFrame([(None,), (2000.0,)], "l double").select(*special.detection(F.col("l"), 3.0)).collect()
    assert r[0]["looks"] is None and r[0]["cell_sigma_db"] is None and r[1]["looks"] == 1024.0


def test_change_is_inclusive_and_nulls_skip(spark):
    c = cells(spark, [[[1, 1, 0, 1]], [[10 ** (3 / 20), 1, 1, float("nan")]], [[1, 1, 1, 1]]])
    s = {r["pass_idx"]: r for r in cube.change_steps(c, 3.0).collect()}
    assert s[1]["compared_cells"] == 2 and s[1]["brightened_fraction"] == 0.5 and s[2]["compared_cells"] == 3 and s[2]["dimmed_fraction"] == pytest.approx(1 / 3)
    n = cube.change_net(c).first()
    assert n["compared_cells"] == 3 and n["mean_delta_db"] == 0 and n["changed_fraction"] == n["brightened_fraction"] + n["dimmed_fraction"]
    assert cube.change_net(cells(spark, [[[1, 2]]])).count() == 0


def test_two_band_is_strict(spark):
    p = spark.createDataFrame([(0, 0, 1.0, 10.0), (0, 1, 1.0, 20.0), (1, 0, 0.0, 1.0)], "row int, col int, earlier double, later double")
    b = {(r["block_row"], r["block_col"]): r for r in cube.two_band(p, (2, 2), 2, 20.0).collect()}
    assert b[0, 0]["brightened_fraction"] == 0 and b[0, 1]["brightened_fraction"] == 1 and b[0, 1]["peak"] and b[1, 0]["valid_fraction"] == 0


def test_block_slices(spark):
    got = [r[0] for r in spark.range(10).select(cube.block_index(F.col("id"), 10, 4)).collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]


def brute_box(a, w):
    h, out = w // 2, np.zeros_like(a)
    for i, j in np.ndindex(a.shape):
        b = a[max(0, i - h) : i + h + 1, max(0, j - h) : j + h + 1]
        out[i, j] = np.nanmean(b) if np.isfinite(b).any() else np.nan
    return out


@pytest.mark.parametrize("window", [3, 5])
def test_box_filter_with_holes(spark, window, monkeypatch):
    monkeypatch.setattr(raster, "STRIP", 4)  # strips meet within the scene
    rng = np.random.default_rng(1)
    a = rng.uniform(1, 2, (9, 11))
    a[rng.uniform(size=a.shape) < 0.3] = np.nan
    c = cells(spark, [a])
    for holes in (c, c.where(~F.isnan("value"))):  # invalid cells, and cells that aren't there
        got = {(r["row"], r["col"]): r["filtered"] for r in raster.box_filter(holes, window, ["pass_idx"]).collect()}
        want = brute_box(a, window)
        assert all(got[k] == pytest.approx(want[k]) for k in got if np.isfinite(want[k])) and len(got) == holes.count()
    with pytest.raises(raster.PlanError):
        raster.box_filter(c, 4)


def test_lee_keeps_flat_ground(spark):
    assert {r["filtered"] for r in raster.lee_filter(cells(spark, [np.full((6, 6), 3.0)]), 4).collect()} == {3.0}


def test_looks_of_speckle(spark):
    rng = np.random.default_rng(2)
    c = cells(spark, [np.sqrt(rng.gamma(4, size=(64, 70)) / 4)])
    assert raster.looks(c, ["pass_idx"], 16, (64, 70)).first()["looks"] == pytest.approx(4, rel=0.15)
    assert raster.block_looks(c, ["pass_idx"], 16, (64, 70)).count() == 16


def test_chips_drop_partial_tiles(spark):
    c = cells(spark, [np.arange(1, 31).reshape(5, 6)])
    got = {(r["row_off"], r["col_off"]): r["pixels"] for r in raster.chips(c, (5, 6), 2, None, 0, ["pass_idx"]).collect()}
    assert set(got) == {(i, j) for i in (0, 2) for j in (0, 2, 4)} and got[0, 2] == [3, 4, 9, 10]
    assert raster.chips(c, (5, 6), 3, 1).count() == 12 and raster.chips(c, (5, 6), 7).count() == 0
    assert raster.chips(cells(spark, [[[0, 1], [1, 1]]]), (2, 2), 2, None, 0.8).count() == 0


def test_terrain_and_factors(spark):
    flat = cells(spark, [np.full((4, 4), 5.0)]).withColumnRenamed("value", "z")
    n = raster.terrain_normals(flat, 0.001, 0.001, 10.0).first()
    assert (n["nx"], n["ny"], n["nz"]) == (0, 0, 1)
    one = spark.range(1).select(rad.flatten_cosine(F.lit(0.0), F.lit(0.5)).alias("a"), rad.flatten_cosine(F.lit(None).cast("double"), F.lit(0.5)).alias("b"), rad.polynomial([[1, 2], [3, 4]], F.lit(2.0), F.lit(10.0)).alias("p"), rad.denoised(F.lit(1.0), F.lit(2.0)).alias("d"))
    r = one.first()
    assert (r["a"], r["b"], r["p"], r["d"]) == (10, 1, 1 + 20 + 6 + 80, 1e-12)
    with pytest.raises(Exception, match="scale"):
        spark.range(1).select(rad.calibrated(F.lit(1.0), F.lit(-1.0))).collect()


def test_radar_area_keeps_its_sum(spark):
    f = spark.createDataFrame([(i, float(i % 5), float(i // 5), 1.0) for i in range(25)], "id int, slant double, along double, area double")
    assert {round(r["radar_area"], 9) for r in raster.radar_area(f, 1.0, 1.0).collect()} == {1.0}


def test_noise_profile(spark):
    rng = np.random.default_rng(0)
    base = 10 ** (np.linspace(-1, 1, 24) * 2 / 20)
    a = base[:, None] * rng.uniform(1, 3, (24, 200))
    got = raster.noise_profile(cells(spark, [a]).withColumn("scene_id", F.lit("s")), 24).orderBy("row").collect()
    slope = got[-1]["noise_db"] - got[0]["noise_db"]
    assert len(got) == 24 and slope == pytest.approx(4, abs=0.3)


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 0.0]), ("d", [1.0, 1.0])], "task string, vec array<float>")
    got = [(r["task"], round(r["score"], 6)) for r in vectors.top_k(v, [2.0, 0.0], "task", 3).collect()]
    assert got == [("a", 1.0), ("c", 1.0), ("d", 0.707107)]
    assert [r["task"] for r in vectors.top_k(v, [2.0, 0.0], "task", 9, 0.9, "a").collect()] == ["c"] and vectors.top_k(v, [1.0, 0.0], "task", -1).count() == 0
    with pytest.raises(Exception, match="different sizes"):
        vectors.top_k(v, [1.0], "task").collect()
    done = spark.createDataFrame([("a", "m", 1, [1.0])], "task string, model string, dim int, vec array<float>")
    built = vectors.build(v, done, lambda texts: [[float(ord(t))] for t in texts], "m").collect()
    assert sorted((r["task"], r["vec"]) for r in built) == [("b", [98.0]), ("c", [99.0]), ("d", [100.0])]
    with pytest.raises(vectors.PlanError):
        vectors.build(v, done, len, "other")


def test_hilbert_ids(spark):
    ids = {(r["x"], r["y"]): r["h"] for r in spark.range(16).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y")).select("x", "y", geo.hilbert_id(2, F.col("x"), F.col("y")).alias("h")).collect()}
    assert sorted(ids.values()) == list(range(5, 21)) and ids[0, 0] == 5
    path = sorted(ids, key=ids.get)
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:], strict=False))
    with pytest.raises(geo.PlanError):
        geo.hilbert_id(27, F.lit(0), F.lit(0))


def test_tile_encoding(spark):
    assert tiles.uvarint(300) == b"\xac\x02" and [tiles.zigzag(x) for x in (0, -1, 1, -2)] == [0, 1, 2, 3]
    ring = tiles.tile_ring([(-10, -10), (10, -10), (10, 10), (-10, 10)], 1, 0, 0)
    assert max(max(p) for p in ring) == tiles.EXTENT + tiles.BUFFER and len(ring) == 4
    assert tiles.tile_ring([(100, 10), (110, 10), (110, 20)], 2, 0, 0) == []
    acq = spark.createDataFrame([("a", "T", 1.0, 1.0, 2.0, 2.0), ("b", "U", 1.0, 1.0, 2.0, 2.0), ("c", "V", None, None, None, None)], "href string, task string, min_lon double, min_lat double, max_lon double, max_lat double")
    t = tiles.encode_tiles(acq, 7, "l", ["task"])
    rows = t.collect()
    assert rows and all(b"task" in gzip.decompress(r["mvt"]) for r in rows)
    archive = tiles.container(t, 7, 7, (1, 1, 2, 2))
    assert archive[:7] == b"PMTiles" and archive[7] == 3 and len(archive) > 127


def test_nitf_and_preflight(spark):
    xml = b'<SICD xmlns="urn:x"><Radiometric><SigmaZeroSFPoly/><NoiseLevel><NoiseLevelType>ABSOLUTE</NoiseLevelType></NoiseLevel></Radiometric><SCPCOA><IncidenceAng>31.5</IncidenceAng></SCPCOA></SICD>'
    counts = b"000" + b"000" + b"000" + b"000" + b"001" + b"0010" + f"{len(xml):09d}".encode()
    head = b"NITF02.10" + b" " * (354 - 9)
    total = len(head) + 6 + len(counts)
    body = head + f"{total:06d}".encode() + counts + b"H" * 10 + xml
    f = products.headers(spark.createDataFrame([("a", bytearray(body)), ("b", bytearray(b"no"))], "path string, content binary"))
    r = {x["path"]: x for x in products.preflight(products.parsed(f), calibration="sigma0", noise_subtract=True).collect()}
    assert r["a"]["supported"] and r["a"]["incidence"] == 31.5 and not r["b"]["supported"] and r["b"]["error_scope"] == "product"
    r = products.preflight(products.parsed(f), rtc=True).where("path = 'a'").first()
    assert r["reason"] == "no look geometry" and r["error_scope"] == "measurement"


def test_budget_and_jobs(spark):
    q = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1), ("2024-01-01 00:00:02", "a", 2), ("2024-01-01 00:00:03", "b", 3), ("2024-01-01 00:00:04", "c", 4), ("2024-01-02 00:00:00", "a", 5)], "ts string, client string, seq int").withColumn("ts", F.to_timestamp("ts"))
    assert {r["seq"]: r["granted"] for r in budget.granted(q, 2, 1).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    jobs = Jobs(spark)
    a, b, c = jobs.submit(lambda: 7), jobs.submit(lambda: 1 / 0), jobs.submit(len, cached=3)
    jobs.pool.shutdown()
    assert jobs.get(a)["result"] == 7 and "ZeroDivisionError" in jobs.get(b)["error"] and jobs.get(c)["status"] == "succeeded" and jobs.get("x") is None


def test_schemas():
    assert all(load_schema(n).fieldNames() for n in schema_names())
    with pytest.raises(KeyError):
        load_schema("nope")


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    """Against the built-in percentile: ties, nulls, groups of nulls, null keys, single values, and brackets much smaller than a group."""
    from orbitframe.operators.quantiles import quantiles

    rng = np.random.default_rng(3)
    rows = [("smooth", float(x)) for x in rng.lognormal(0, 2, 4000)] + [("ties", float(x)) for x in rng.integers(-3, 3, 3000)] + [("one", 7.0), ("none", None), ("none", None), (None, 1.0), (None, 2.0)] + [("same", 5.0)] * 500
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs = [0.0, 0.02, 0.5, 0.73, 1.0]
    for by in (["g"], []):
        got = {tuple(r[c] for c in by): (r["n"], r["q"]) for r in quantiles(df, by, F.col("v"), qs, [F.count(F.lit(1)).alias("n")], accuracy).collect()}
        want = {tuple(r[c] for c in by): (r["n"], r["q"]) for r in df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect()}
        assert got.keys() == want.keys()
        for k, (n, q) in want.items():
            assert got[k][0] == n and got[k][1] == (pytest.approx(q, rel=1e-12) if q else [None] * len(qs))
    assert quantiles(df.where("false"), ["g"], F.col("v"), qs).count() == 0
    assert [r["q"] for r in quantiles(df.where("false"), [], F.col("v"), [0.5]).collect()] == [[None]]
    upper = quantiles(df.where("g = 'smooth'"), [], F.col("v"), [0.5], (), accuracy, higher=True).first()["q"][0]
    assert upper == sorted(v for g, v in rows if g == "smooth")[2000]
