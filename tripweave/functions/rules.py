"""Rule ladders and lookups: the first rule that holds decides."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Retail brands in order of precedence.
BRANDS = ["REWE", "LIDL", "ALDI", "NETTO", "PENNY", "EDEKA"]

# Place categories that count as retail.
RETAIL_CATEGORIES = [
    "grocery_store",
    "supermarket",
    "convenience_store",
    "discount_store",
    "international_grocery_store",
    "specialty_grocery_store",
    "health_food_store",
    "wholesale_store",
    "department_store",
]

# Segment colours (red, green, blue, alpha) above a speed in km/h, and the rest.
SPEED_COLOURS = [
    (60e0, [255, 0, 0, 200]),
    (30e0, [255, 165, 0, 200]),
    (10e0, [255, 255, 0, 200]),
]
SLOW_COLOUR = [0, 255, 0, 200]

# Cell colours for each band of three minutes, the last one open, and no data.
TIME_BAND_MINUTES = 3
TIME_COLOURS = [
    [34, 139, 34, 200],
    [50, 205, 50, 200],
    [154, 205, 50, 200],
    [255, 255, 0, 200],
    [255, 215, 0, 200],
    [255, 165, 0, 200],
    [255, 69, 0, 200],
    [220, 20, 60, 200],
    [178, 34, 34, 200],
]
NO_TIME_COLOUR = [128, 128, 128, 180]

# Routing profile for a mode name, and the default. None of these names is a
# label made by classify_mode, so classified trips all take the default.
ROUTE_PROFILES = {
    "car": "driving-car",
    "taxi": "driving-car",
    "bus": "driving-car",
    "motorcycle": "driving-car",
    "train": "driving-car",
    "subway": "driving-car",
    "bike": "cycling-electric",
    "walk": "foot-walking",
    "run": "foot-walking",
}
DEFAULT_PROFILE = "driving-car"


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def classify_mode(avg: Column, top: Column, median: Column) -> Column:
    """Transport mode of a trip from its rounded average, maximum and median speed in km/h.

    A trip without any valid speed has no statistics row and so never gets here; comparisons
    with NULL fail, which leaves ``unknown``.
    """

    def between(low: float, high: float) -> Column:
        return (avg >= low) & (avg < high)

    return (
        F.when(avg < 1e0, "stationary")
        .when(between(1e0, 6e0) & (top < 15e0), "walking")
        .when(between(6e0, 12e0) & (top < 20e0), "running")
        .when(between(8e0, 25e0) & (top < 45e0), "cycling")
        .when((avg >= 80e0) | ((avg > 60e0) & (median > 80e0)), "train_airplane")
        .when((avg >= 40e0) & (median >= 60e0), "driving_highway")
        .when(between(15e0, 80e0), "driving_urban")
        .otherwise("unknown")
    )


def speed_band(speed: Column) -> Column:
    """Colour of a segment by its speed; no speed counts as slow."""
    band = F
    for above, colour in SPEED_COLOURS:
        band = band.when(speed > above, _ints(colour))
    return band.otherwise(_ints(SLOW_COLOUR))


def time_band(duration: Column) -> Column:
    """Colour of a cell by its travel time in minutes."""
    step = F.floor(duration / F.lit(float(TIME_BAND_MINUTES)))
    last = len(TIME_COLOURS) - 1
    index = F.greatest(F.lit(0), F.least(F.lit(last), step)).cast("int") + 1
    palette = F.array(*[_ints(c) for c in TIME_COLOURS])
    missing = duration.isNull() | F.isnan(duration)
    return F.when(missing, _ints(NO_TIME_COLOUR)).otherwise(F.element_at(palette, index))


def canonical_brand(name: Column) -> Column:
    """The first brand whose name is part of ``name``, whatever the case; NULL when none is."""
    brand = F
    for label in BRANDS:
        brand = brand.when(name.ilike(f"%{label}%"), label)
    return brand


def route_profile(mode: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain(*ROUTE_PROFILES.items())])
    return F.coalesce(F.try_element_at(table, mode), F.lit(DEFAULT_PROFILE))
