"""Small inline inputs for edge cases."""

from __future__ import annotations

from datetime import datetime, timedelta

POINT_SCHEMA = (
    "uid string, tid string, event_id long, event_timestamp timestamp, lat double, lng double"
)
START = datetime(2024, 1, 1)


def at(seconds: float | None) -> datetime | None:
    return None if seconds is None else START + timedelta(seconds=seconds)


def points(spark, rows):
    """Rows of (uid, tid, event_id, seconds, lat, lng)."""
    data = [(u, t, e, at(s), lat, lng) for u, t, e, s, lat, lng in rows]
    return spark.createDataFrame(data, POINT_SCHEMA)


def rows(df, *columns):
    order = columns or tuple(df.columns)
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
