"""Registered queries: every operator run over the given tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from ridewave.queries.base import REGISTRY, Query

AREAS = ("ingest", "counting", "profiles", "lags", "scoring", "forecasts", "sessions", "timetable",
         "places", "serving", "network", "intake", "stops", "external", "learned", "streams")


def load() -> dict[str, Query]:
    for area in AREAS:
        import_module(f"ridewave.queries.{area}")
    return REGISTRY
