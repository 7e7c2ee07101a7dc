"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from tickloom.plans import boundary, catalog, depth, encoded, history, raced, races, ticks

PLANS = (ticks, history, races, raced, depth, boundary, catalog, encoded)
