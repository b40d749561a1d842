"""What a caller asks for, validated on the driver before any plan is made."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from ..errors import PlanError
from ..functions.geometry import parse_geometry, rings_bbox
from .dates import parse_bound, parse_interval

# Product names in their order, and polarizations in theirs.
PRODUCTS = ("GEC", "CSI", "SIDD", "SICD", "CPHD")
POLARIZATIONS = ("VV", "VH", "HH", "HV")
RANKINGS = ("passes", "comparable", "recency", "span", "cadence")


def check_bbox(value) -> tuple[float, float, float, float]:
    """Four WGS84 numbers, or six whose heights are dropped; west <= east and south <= north."""
    if isinstance(value, str):
        value = [x for x in value.split(",")]
    try:
        v = [float(x) for x in value]
    except (TypeError, ValueError) as e:
        raise PlanError(f"invalid bbox {value!r}") from e
    if len(v) == 6:
        v = [v[0], v[1], v[3], v[4]]
    if len(v) != 4 or not all(map(math.isfinite, v)):
        raise PlanError("a bbox has four or six numbers")
    w, s, e, n = v
    if not (-180 <= w <= e <= 180 and -90 <= s <= n <= 90):
        raise PlanError(f"bbox {v} is outside WGS84 or its sides are swapped")
    return w, s, e, n


def names(value, known: tuple[str, ...], what: str) -> tuple[str, ...]:
    """Upper-cased known names from a list or comma-separated text."""
    if value is None:
        return ()
    parts = value.split(",") if isinstance(value, str) else list(value)
    out = tuple(dict.fromkeys(str(p).strip().upper() for p in parts if str(p).strip()))
    if unknown := [p for p in out if p not in known]:
        raise PlanError(f"unknown {what} {', '.join(unknown)}", hint=f"Known are {', '.join(known)}.")
    return out


def number(value, what: str, least: float | None = None, above: float | None = None) -> float | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise PlanError(f"{what} must be a number")
    if (least is not None and value < least) or (above is not None and value <= above):
        raise PlanError(f"{what} must be {'at least ' + str(least) if least is not None else 'above ' + str(above)}")
    return float(value)


@dataclass(frozen=True)
class SearchSpec:
    """The filter vocabulary.  All filters are ANDed; absent ones don't filter."""

    start: date | str | None = None
    end: date | str | None = None
    area: str | None = None
    fuzzy: bool = False
    bbox: tuple | str | list | None = None
    intersects: Any = None
    products: Any = ()
    polarizations: Any = ()
    min_incidence: float | None = None
    max_incidence: float | None = None
    max_resolution: float | None = None
    ids: tuple[str, ...] = ()
    max_per_task: int | None = None
    limit: int | None = None
    today: date | None = None
    rings: list = field(default_factory=list, compare=False)

    def validated(self) -> SearchSpec:
        start, end = parse_bound(self.start, False, self.today), parse_bound(self.end, True, self.today)
        if start and end and start > end:
            raise PlanError(f"start {start} is after end {end}")
        if self.bbox is not None and self.intersects is not None:
            raise PlanError("bbox and intersects exclude each other")
        rings = parse_geometry(self.intersects) if self.intersects is not None else []
        lo, hi = number(self.min_incidence, "min_incidence"), number(self.max_incidence, "max_incidence")
        if lo is not None and hi is not None and lo > hi:
            raise PlanError("min_incidence is above max_incidence")
        for what in ("max_per_task", "limit"):
            v = getattr(self, what)
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
                raise PlanError(f"{what} must be a whole number, 0 at least")
        return replace(
            self, start=start, end=end, bbox=check_bbox(self.bbox) if self.bbox is not None else None, rings=rings,
            products=names(self.products, PRODUCTS, "product"), polarizations=names(self.polarizations, POLARIZATIONS, "polarization") if not isinstance(self.polarizations, frozenset) else tuple(sorted(self.polarizations)),
            min_incidence=lo, max_incidence=hi, max_resolution=number(self.max_resolution, "max_resolution", above=0), area=(self.area or "").strip() or None, ids=tuple(self.ids or ()),
        )

    def box(self) -> tuple | None:
        """The bounding box that can be pushed down: the given one, or the polygon's."""
        return self.bbox or (rings_bbox(self.rings) if self.rings else None)


@dataclass(frozen=True)
class SiteSpec:
    """How sites are gated and ranked."""

    rank_by: str = "passes"
    min_passes: int = 2
    top: int | None = 20
    active_since: Any = None
    active_before: Any = None
    first_since: Any = None
    first_before: Any = None
    max_revisit_days: float | None = None
    median_revisit_days: float | None = None
    min_span_days: float | None = None
    max_span_days: float | None = None
    today: date | None = None

    def validated(self) -> SiteSpec:
        if self.rank_by not in RANKINGS:
            raise PlanError(f"unknown ranking {self.rank_by!r}", hint=f"Known are {', '.join(RANKINGS)}.")
        days = {k: parse_bound(getattr(self, k), k.endswith("before"), self.today) for k in ("active_since", "active_before", "first_since", "first_before")}
        spans = {k: number(getattr(self, k), k, above=0) for k in ("max_revisit_days", "median_revisit_days")} | {k: number(getattr(self, k), k, least=0) for k in ("min_span_days", "max_span_days")}
        return replace(self, **days, **spans)


#: Operators that a STAC query may use on each property.
QUERY = {
    "sar:product_type": {"eq", "in"},
    "sar:polarizations": {"eq", "in"},
    "view:incidence_angle": {"gte", "lte", "eq"},
    "sar:resolution_range": {"lte"},
    "task": {"eq", "like"},
}


def parse_query(query: dict | str | None, **body) -> SearchSpec:
    """A STAC query extension as a SearchSpec; parameters of the body override it."""
    if isinstance(query, str):
        try:
            query = json.loads(query)
        except ValueError as e:
            raise PlanError("query isn't JSON") from e
    out: dict[str, Any] = {}
    for prop, ops in (query or {}).items():
        if prop not in QUERY or not isinstance(ops, dict):
            raise PlanError(f"unknown query property {prop!r}", hint=f"Known are {', '.join(QUERY)}.")
        for op, value in ops.items():
            if op not in QUERY[prop]:
                raise PlanError(f"{prop} doesn't know {op!r}")
            if prop == "sar:product_type":
                out["products"] = value
            elif prop == "sar:polarizations":
                out["polarizations"] = value
            elif prop == "view:incidence_angle":
                out |= {"min_incidence": value} if op == "gte" else {"max_incidence": value} if op == "lte" else {"min_incidence": value, "max_incidence": value}
            elif prop == "sar:resolution_range":
                out["max_resolution"] = value
            else:
                out["area"] = str(value).strip("%")
    if interval := body.pop("datetime", None):
        out["start"], out["end"] = parse_interval(interval)
    return SearchSpec(**(out | {k: v for k, v in body.items() if v is not None})).validated()


def extract_json(text: str) -> dict:
    """The object in a model's reply: a fenced block, or what is between the outermost braces."""
    m = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.DOTALL)
    body = m[1] if m else text[text.find("{") : text.rfind("}") + 1]
    try:
        out = json.loads(body)
    except ValueError as e:
        raise PlanError("no JSON object in the reply") from e
    if not isinstance(out, dict):
        raise PlanError("the reply isn't a JSON object")
    return out


#: What a planner's reply may hold.
PLAN_KEYS = {"start", "end", "area", "fuzzy", "bbox", "products", "polarizations", "min_incidence", "max_incidence", "max_resolution", "limit", "max_per_task", "aoi", "place"}


def parse_plan(raw: str | dict, today: date | None = None, aois: dict[str, Any] | None = None) -> SearchSpec:
    """A planner's reply as a validated spec.  Nothing unvalidated becomes a filter; place, bbox and aoi exclude each other."""
    plan = extract_json(raw) if isinstance(raw, str) else dict(raw)
    if unknown := set(plan) - PLAN_KEYS:
        raise PlanError(f"unknown parameters {', '.join(sorted(unknown))}")
    if sum(plan.get(k) is not None for k in ("aoi", "place", "bbox")) > 1:
        raise PlanError("place, bbox and aoi exclude each other")
    aoi, place = plan.pop("aoi", None), plan.pop("place", None)
    if place is not None:
        raise PlanError("a place must be geocoded before planning", hint="Join a gazetteer and give a bbox.")
    if aoi is not None:
        known = {k.strip().lower(): v for k, v in (aois or {}).items()}
        if str(aoi).strip().lower() not in known:
            raise PlanError(f"unknown area of interest {aoi!r}")
        plan["intersects"] = known[str(aoi).strip().lower()]
    return SearchSpec(**{k: v for k, v in plan.items() if v is not None}, today=today).validated()
