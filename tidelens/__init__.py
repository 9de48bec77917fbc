"""Coastal hazard analytics as Spark jobs: grids, drift results, forecasts, reports and catalogues."""

from tidelens.session import build_session, configure

__all__ = ["build_session", "configure"]
