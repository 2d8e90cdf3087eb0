"""The registered queries and their oracle SQL."""

from orograph.plans import grid, journeys, lifecycle, motion, polygons, records, shapes, sites, solids, stores, surfaces, visibility

_PLANS = (visibility, motion, journeys, grid, records, shapes, sites, polygons, surfaces, stores, lifecycle, solids)
QUERIES = {k: f for p in _PLANS for k, f in p.REGISTRY.queries.items()}
ORACLE = {k: s for p in _PLANS for k, s in p.REGISTRY.oracle.items()}
