"""Registered queries and their SQL, by area. Each area module has QUERIES and ORACLES."""

from . import features, ingest, merging, models, profiling

AREAS = (ingest, profiling, merging, features, models)


def collect(kind: str) -> dict:
    found: dict = {}
    for area in AREAS:
        entries = getattr(area, kind)
        repeated = set(found) & set(entries)
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        found.update(entries)
    return found
