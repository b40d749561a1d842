"""The registered queries over the test tables, each beside the DuckDB SQL that it must equal.

Dates leave as text in both, so that no comparison depends on how a client shows them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog, cubes, misc, rasters, sites, views

MODULES = (sites, catalog, cubes, rasters, misc, views)
_DATES = ("acq_date", "first", "last", "first_date", "last_date", "day")
_DATED = {
    **{name: ("acq_date",) for name in catalog.REGISTERED if name.startswith(("search", "lookup", "resolve", "frames"))},
    **{name: ("first_date", "last_date") for name in ("catalog_stats", "facets")},
    **{name: ("first", "last") for name in sites.REGISTERED},
    "sites_filtered": ("last",),
    **{name: ("acq_date",) for name in ("upsert_latest", "readthrough_union", "stac_documents", "refresh_overlap", "live_search", "newest_batch")},
    **{name: ("day",) for name in ("daily_budget", "daily_counts")},
}


def _texts(run):
    def wrapped(spark, sf_dir):
        out = run(spark, sf_dir)
        return out.select(*[F.col(f"`{c}`").cast("string").alias(c) if t == "date" else F.col(f"`{c}`") for c, t in out.dtypes])

    return wrapped


def _text_sql(sql: str, columns: tuple[str, ...]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in columns)}) FROM ({sql})" if columns else sql


QUERIES = {name: _texts(run) for m in MODULES for name, (run, _) in m.REGISTERED.items()}
ORACLES = {name: _text_sql(sql, _DATED.get(name, ())) for m in MODULES for name, (_, sql) in m.REGISTERED.items() if sql}
