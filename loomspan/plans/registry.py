"""Names of the engine's queries, and the SQL that each must agree with."""

from __future__ import annotations

from loomspan.plans import catalog


def _load() -> None:
    from loomspan.plans import box_queries, frame_queries, layout_queries, report_queries, series_queries, track_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(catalog.ORACLE)


def flagship(spark, sf_dir: str):
    from loomspan.plans import box_queries

    return box_queries.flagship(spark, sf_dir)
