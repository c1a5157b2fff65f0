"""Every registered query of the engine itself, with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from labelkite.plans import fields, labels, layout, lookups, measures, repairs, scans

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (scans, labels, fields, lookups, measures, layout, repairs):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
