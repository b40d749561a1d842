from datetime import date

import pytest

from orbitframe.errors import PlanError
from orbitframe.functions.geometry import parse_geometry, rings_meet
from orbitframe.functions.matching import fuzzy_match
from orbitframe.plans.dates import parse_bound, parse_interval
from orbitframe.plans.spec import SearchSpec, SiteSpec, check_bbox, extract_json, parse_plan, parse_query

TODAY = date(2024, 3, 31)


@pytest.mark.parametrize(
    ("text", "end", "want"),
    [
        ("2024-02-29", False, date(2024, 2, 29)), ("2024", False, date(2024, 1, 1)), ("2024", True, date(2024, 12, 31)), ("2024-2", True, date(2024, 2, 29)), ("today", False, TODAY), ("Yesterday", False, date(2024, 3, 30)),
        ("1 month ago", False, date(2024, 2, 29)), ("a week ago", False, date(2024, 3, 24)), ("an year ago", False, date(2023, 3, 31)), ("3 days ago", True, date(2024, 3, 28)), ("this week", False, date(2024, 3, 25)), ("this week", True, TODAY),
        ("last month", False, date(2024, 2, 1)), ("last month", True, date(2024, 2, 29)), ("last year", True, date(2023, 12, 31)), ("this year", False, date(2024, 1, 1)),
    ],
)
def test_date_expressions(text, end, want):
    assert parse_bound(text, end, TODAY) == want


@pytest.mark.parametrize("text", ["", "soon", "2024-13", "2023-02-30", "last day", "two weeks ago"])
def test_bad_dates(text):
    with pytest.raises(PlanError):
        parse_bound(text)


def test_intervals():
    assert parse_interval("2024-01-02T03:04:05Z/..") == (date(2024, 1, 2), None)
    assert parse_interval("2024-01-02") == (date(2024, 1, 2),) * 2
    assert parse_interval("/2024-01-02") == (None, date(2024, 1, 2))
    with pytest.raises(PlanError):
        parse_interval("a/b/c")


def test_bbox():
    assert check_bbox("1,2,3,4") == (1, 2, 3, 4)
    assert check_bbox([1, 2, 9, 3, 4, 10]) == (1, 2, 3, 4)
    for bad in ([1, 2, 3], [3, 2, 1, 4], [0, 0, 0, 91], ["x", 0, 0, 0]):
        with pytest.raises(PlanError):
            check_bbox(bad)


def test_specs():
    s = SearchSpec(products="gec, sicd", polarizations=["vv"], start="2024-01", end="2024-01").validated()
    assert s.products == ("GEC", "SICD") and s.polarizations == ("VV",) and (s.start, s.end) == (date(2024, 1, 1), date(2024, 1, 31))
    for bad in (dict(products="XYZ"), dict(start="2024-02", end="2024-01"), dict(limit=-1), dict(limit=True), dict(min_incidence=9, max_incidence=1), dict(max_resolution=0)):
        with pytest.raises(PlanError):
            SearchSpec(**bad).validated()
    for bad in (dict(rank_by="size"), dict(max_revisit_days=0), dict(min_span_days=-1)):
        with pytest.raises(PlanError):
            SiteSpec(**bad).validated()


def test_query_extension():
    s = parse_query({"sar:product_type": {"in": ["GEC"]}, "view:incidence_angle": {"gte": 10, "lte": 20}, "task": {"like": "%port%"}}, datetime="2024-01-01/..", limit=5)
    assert s.products == ("GEC",) and (s.min_incidence, s.max_incidence) == (10, 20) and s.area == "port" and s.start == date(2024, 1, 1) and s.limit == 5
    for bad in ({"x": {"eq": 1}}, {"task": {"gte": 1}}):
        with pytest.raises(PlanError):
            parse_query(bad)


def test_plans_from_replies():
    s = parse_plan('Sure:\n```json\n{"area": "port", "start": "last month"}\n```', TODAY)
    assert s.area == "port" and s.start == date(2024, 2, 1)
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}
    assert parse_plan({"aoi": " Dock "}, aois={"dock": square}).rings == [[(0, 0), (1, 0), (1, 1)]]
    for bad in ({"aoi": "x"}, {"sql": "drop"}, {"bbox": [0, 0, 1, 1], "aoi": "dock"}, "none here", "[1]"):
        with pytest.raises(PlanError):
            parse_plan(bad)
    assert extract_json('a {"b": {"c": 1}} d') == {"b": {"c": 1}}


def test_geometries():
    square = lambda x, y: {"type": "Polygon", "coordinates": [[[x, y], [x + 2, y], [x + 2, y + 2], [x, y + 2], [x, y]]]}
    assert len(parse_geometry({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": square(0, 0)}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [square(5, 5)["coordinates"]] * 2}}]})) == 3
    for empty in ({"type": "FeatureCollection", "features": []}, {"type": "GeometryCollection", "geometries": []}, {"type": "MultiPolygon", "coordinates": []}):
        with pytest.raises(PlanError):
            parse_geometry(empty)
        with pytest.raises(PlanError):
            SearchSpec(intersects=empty).validated()
    a = parse_geometry(square(0, 0))
    for x, y, want in ((1, 1, True), (2, 0, True), (2, 2, True), (3, 3, False), (0.5, 0.5, True)):
        assert rings_meet(a, parse_geometry(square(x, y))) is want
    tiny = [[(0.9, 0.9), (1.1, 0.9), (1.0, 1.1)]]
    assert rings_meet(a, tiny) and rings_meet(tiny, a)
    for bad in ({"type": "Point", "coordinates": [0, 0]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}, {"type": "Polygon", "coordinates": [[[True, 0], [1, 1], [2, 2]]]}, "x"):
        with pytest.raises(PlanError):
            parse_geometry(bad)


def test_fuzzy_is_asymmetric():
    assert fuzzy_match("port beta", "Beta-Port, North")
    assert fuzzy_match("ship yrd", "shipyard yard") and fuzzy_match("centerfeld", "Centerfield UT")
    assert not fuzzy_match("beta airport", "Beta Port")
    assert not fuzzy_match("...", "abc") and fuzzy_match("", "abc")
