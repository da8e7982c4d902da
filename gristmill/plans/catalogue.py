"""The engine's own queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from gristmill.plans import evaluation, film, kernels, profiles, rasters, reviewing, rolls, state, statistics, stores, streams, views

_PARTS = (evaluation, statistics, reviewing, state, film, rolls, profiles, kernels, rasters, stores, streams, views)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
