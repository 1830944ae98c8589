"""Time gap and speed between consecutive points, and removal of implausible trips.

Almost every trip is small: its points are shuffled by trip once, and one window does the work.
A trip with more than ``HOT_ROWS`` points is *hot* (see :func:`find_hot_trips`) and is cut into
time slices, so that no task holds all of it. Inside a slice the window looks at the neighbour
row; the neighbour across a slice border comes from a table with one row per slice of a hot
trip, small enough to order by trip. That table also carries values of the whole trip back to
its slices, in joins that need no further shuffle of the points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, is_position
from ..functions.numbers import kmh, seconds_between
from ..session import shared_dir
from .joins import join_lookup, row_salt

HOT_ROWS = 1_000_000
SPEED_LIMIT_KMH = 200e0
TIE = ("event_id",)

# uid and tid made non-NULL, which of them were NULL, and the slice (0 for a trip in one piece).
TRIP = ("_uid", "_tid", "_null")
SLICE = (*TRIP, "_slice")
# A slice number has three parts: of the trip's time, of a burst, and of one moment by its tie.
_PARTS, _SUBS = 2**20, 2**21


def with_trip_key(df: DataFrame) -> DataFrame:
    """Non-NULL trip key columns, so that NULL keys form a group of their own in joins too."""
    bits = F.col("uid").isNull().cast("int") * 2 + F.col("tid").isNull().cast("int")
    return df.withColumns({
        "_uid": F.coalesce(F.col("uid"), F.lit("")),
        "_tid": F.coalesce(F.col("tid"), F.lit("")),
        "_null": bits,
    })


@dataclass(frozen=True)
class HotTrips:
    """Trips with more than ``rows`` points, and how they are cut into slices.

    ``trips`` cuts the span of a trip into equal parts of ``_width`` microseconds from ``_low``,
    four for every ``rows`` points. Where points crowd, a part can still hold too many of them;
    ``bursts`` cuts those parts again in the same way, and ``moments`` what is still too large
    by the tie column, if it is a number. All have at most one row per ``rows`` points.
    """

    rows: int
    trips: DataFrame | None = None
    bursts: DataFrame | None = None
    moments: DataFrame | None = None

    @property
    def any(self) -> bool:
        return self.trips is not None


def _time() -> Column:
    return F.unix_micros("event_timestamp")


def _crowded(
    keyed: DataFrame, keys: Sequence[str], measure: Column, rows: int, most: int
) -> DataFrame | None:
    """Groups of more than ``rows`` points with ``measure`` cut into parts; None if none is."""
    groups = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.min(measure), F.lit(0)).cast("long").alias("_low"),
        F.coalesce(F.max(measure), F.lit(0)).cast("long").alias("_high"),
    )
    parts = F.least(F.ceil(F.col("_n") * 4 / F.lit(rows)), F.lit(most)).cast("long")
    # As doubles: the span of a tie column can exceed a long.
    span = F.col("_high").cast("double") - F.col("_low").cast("double") + 1
    found = (
        groups.filter(F.col("_n") > rows)
        .withColumn("_parts", parts)
        .withColumn("_width", F.greatest(F.lit(1e0), F.ceil(span / F.col("_parts")).cast("double")))
        .select(*keys, "_low", "_width", "_parts")
    )
    # Used several times and to decide the plan: computed once, kept where all hosts read it.
    shared_dir(keyed.sparkSession)
    found = found.checkpoint()
    return None if found.isEmpty() else found


def find_hot_trips(
    points: DataFrame, rows: int = HOT_ROWS, tie: Sequence[str] = TIE
) -> HotTrips:
    """One count per trip, and two further passes only if some trip is hot; runs when called.

    The result holds for any later table of the same trips.
    """
    numeric = ("tinyint", "smallint", "int", "bigint")
    by_tie = [c for c in tie[:1] if c in points.columns and dict(points.dtypes)[c] in numeric]
    keyed = with_trip_key(points).select(*TRIP, "event_timestamp", *by_tie)
    trips = _crowded(keyed, TRIP, _time(), rows, _PARTS)
    if trips is None:
        return HotTrips(rows)
    parted = _cut(keyed, trips, TRIP, _time(), "_part", _PARTS).filter("_hot").drop("_hot")
    bursts = _crowded(parted, (*TRIP, "_part"), _time(), rows, _SUBS)
    parted = _with_sub(parted, bursts)
    keys = (*TRIP, "_part", "_sub")
    moments = _crowded(parted, keys, F.col(by_tie[0]), rows, _SUBS) if by_tie else None
    return HotTrips(rows, trips, bursts, moments)


def _cut(
    keyed: DataFrame, cuts: DataFrame, keys: Sequence[str], measure: Column, name: str, most: int
) -> DataFrame:
    """Add ``name``, the part of each point, and ``_hot``, whether its group is cut at all.

    Parts keep the order of ``measure``; its NULLs are last.
    """
    found = join_lookup(
        keyed, cuts.select(*keys, "_low", "_width"), keys, "left", salt_by=["event_timestamp"]
    )
    offset = measure.cast("double") - F.col("_low").cast("double")
    part = F.least(F.lit(most - 1), F.greatest(F.lit(0), F.floor(offset / F.col("_width"))))
    part = F.when(measure.isNull(), F.lit(most)).otherwise(part)
    hot = F.col("_low").isNotNull()
    return found.withColumns({
        name: F.coalesce(F.when(hot, part), F.lit(0)).cast("long"), "_hot": hot,
    }).drop("_low", "_width")


def _with_sub(parted: DataFrame, bursts: DataFrame | None) -> DataFrame:
    if bursts is None:
        return parted.withColumn("_sub", F.lit(0).cast("long"))
    return _cut(parted, bursts, (*TRIP, "_part"), _time(), "_sub", _SUBS - 1).drop("_hot")


def with_slice_key(points: DataFrame, hot: HotTrips, tie: Sequence[str] = TIE) -> DataFrame:
    """The trip key, ``_slice`` and ``_hot`` of each point, in place of uid and tid."""
    keyed = with_trip_key(points).drop("uid", "tid")
    if not hot.any:
        return keyed.withColumns({"_slice": F.lit(0).cast("long"), "_hot": F.lit(False)})
    keyed = _cut(keyed, hot.trips, TRIP, _time(), "_part", _PARTS).withColumnRenamed("_hot", "_any")
    keyed = _with_sub(keyed, hot.bursts).withColumn("_tie", F.lit(0).cast("long"))
    if hot.moments is not None:
        keys = (*TRIP, "_part", "_sub")
        keyed = _cut(keyed, hot.moments, keys, F.col(tie[0]), "_tie", _SUBS - 1).drop("_hot")
    number = (F.col("_part") * _SUBS + F.col("_sub")) * _SUBS + F.col("_tie")
    return keyed.withColumn("_slice", number).drop("_part", "_sub", "_tie").withColumnRenamed(
        "_any", "_hot"
    )


def restore_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``uid`` and ``tid`` as they were, and ``columns``."""
    return df.withColumns({
        "uid": F.when(F.col("_null") < 2, F.col("_uid")),
        "tid": F.when(F.col("_null") % 2 == 0, F.col("_tid")),
    }).select(*columns)


def time_order(tie: Sequence[str]) -> list[Column]:
    return [F.col("event_timestamp").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie]]


def slice_window(tie: Sequence[str]) -> Window:
    return Window.partitionBy(*SLICE).orderBy(*time_order(tie))


def trip_window() -> Window:
    """All slices of a trip in time order, over a table of one row per slice of a hot trip."""
    return Window.partitionBy(*TRIP).orderBy("_slice")


def edge_rows(keyed: DataFrame, which: str, tie: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The first or last point of every slice of the hot trips as a struct ``edge``.

    A plain aggregate: it combines before the shuffle, so only slices travel, not points.
    """
    # NULL times share a slice; there and elsewhere NULL ties sort last, as in the window.
    order = ["event_timestamp"]
    for c in tie:
        order += [F.col(c).isNull(), F.col(c)]
    pick = F.min_by if which == "first" else F.max_by
    edge = pick(F.struct(*fields), F.struct(*order)).alias("edge")
    return keyed.filter("_hot").groupBy(*SLICE).agg(edge)


def neighbour_columns(
    keyed: DataFrame, shift: Callable, tie: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """``fields`` of the neighbour row in the slice as ``_n_<field>``; ``_n_row`` tells if any.

    Plain columns, not a struct: window arguments that are expressions would be computed, and
    shuffled, next to the columns they are made of.
    """
    order = slice_window(tie)
    near = {f"_n_{f}": shift(F.col(f)).over(order) for f in fields}
    return keyed.withColumns({**near, "_n_row": shift(F.lit(1)).over(order)})


def over_border(
    near: DataFrame, edges: DataFrame, shift: Callable, fields: Sequence[str]
) -> DataFrame:
    """Take the neighbour from the adjoining slice where the own slice has none.

    ``near`` is partitioned and sorted by slice key, so the join moves only ``edges``. Where
    there is no neighbour at all ``_n_row`` stays NULL.
    """
    border = edges.select(*SLICE, shift("edge").over(trip_window()).alias("_border"))
    joined = near.join(border, list(SLICE), "left")
    own = F.col("_n_row").isNotNull()
    taken = {
        f"_n_{f}": F.when(own, F.col(f"_n_{f}")).otherwise(F.col(f"_border.{f}")) for f in fields
    }
    any_row = F.coalesce(F.col("_n_row"), F.when(F.col("_border").isNotNull(), F.lit(1)))
    return joined.withColumns({**taken, "_n_row": any_row}).drop("_border")


def _keyed_speeds(points: DataFrame, tie: Sequence[str], hot: HotTrips) -> DataFrame:
    """Points with slice key, ``time_lag`` and ``speed``, partitioned by slice key."""
    keyed = with_slice_key(points, hot, tie)
    place = ["event_timestamp", "lat", "lng"]
    near = neighbour_columns(keyed, F.lag, tie, place)
    if hot.any:
        near = over_border(near, edge_rows(keyed, "last", tie, place), F.lag, place)
    gap = seconds_between(F.col("_n_event_timestamp"), F.col("event_timestamp"))
    metres = haversine_m(F.col("_n_lat"), F.col("_n_lng"), F.col("lat"), F.col("lng"))
    no_place = ~is_position(F.col("_n_lng"), F.col("_n_lat"))
    speed = F.when(no_place | (F.col("_gap") == 0), F.lit(0e0)).otherwise(
        kmh(metres, F.col("_gap"))
    )
    return (
        near.withColumn("_gap", gap)
        .withColumns({"time_lag": F.coalesce(F.col("_gap"), F.lit(0)).cast("long"), "speed": speed})
        .drop("_gap", "_n_row", *[f"_n_{f}" for f in place])
    )


def speed_points(
    points: DataFrame, tie: Sequence[str] = TIE, hot: HotTrips | None = None
) -> DataFrame:
    """Add ``time_lag`` (seconds since the trip's previous point) and ``speed`` (km/h).

    Both are 0 on a trip's first point; speed is also 0 after a point without position (NULL or
    not finite) and across a gap of zero seconds, and NULL at a point without position. ``tie`` orders points of the same time. ``hot`` is what
    :func:`find_hot_trips` found, which runs here unless given.
    """
    hot = hot or find_hot_trips(points, tie=tie)
    return restore_keys(_keyed_speeds(points, tie, hot), [*points.columns, "time_lag", "speed"])


def outlier_trips(
    points: DataFrame,
    limit: float = SPEED_LIMIT_KMH,
    tie: Sequence[str] = TIE,
    hot: HotTrips | None = None,
) -> DataFrame:
    """Trips with a point faster than ``limit``."""
    speeds = speed_points(points, tie, hot)
    return speeds.filter(F.col("speed") > limit).select("uid", "tid").distinct()


def drop_outlier_trips(
    points: DataFrame,
    limit: float = SPEED_LIMIT_KMH,
    tie: Sequence[str] = TIE,
    hot: HotTrips | None = None,
) -> DataFrame:
    """:func:`speed_points` without the trips that have a point faster than ``limit``.

    Points without a user or trip key belong to no trip and stay. The second window runs on
    the partitions of the first. Hot trips that are bad are marked on their slices, so their
    anti join finds the points already in place.
    """
    hot = hot or find_hot_trips(points, tie=tie)
    speeds = _keyed_speeds(points, tie, hot)
    top = F.max("speed").over(Window.partitionBy(*SLICE))
    too_fast = F.when(F.col("_null") == 0, F.col("_top")) > limit
    kept = speeds.withColumn("_top", top).filter(~F.coalesce(too_fast, F.lit(False)))
    if hot.any:
        worst = speeds.filter("_hot").groupBy(*SLICE).agg(F.max("speed").alias("_top"))
        trip_top = F.max("_top").over(Window.partitionBy(*TRIP))
        bad = worst.withColumn("_top", trip_top).filter(too_fast).select(*SLICE)
        kept = kept.join(bad, list(SLICE), "left_anti")
    return restore_keys(kept, [*points.columns, "time_lag", "speed"])


def attach_to_trips(
    points: DataFrame, per_trip: DataFrame, hot: HotTrips | None = None
) -> DataFrame:
    """Left join trip-level values onto points by ``uid`` and ``tid``; NULL keys do not match.

    The points of a hot trip are spread by a salt over as many keys as the trip has parts, and
    its row of values is copied to each.
    """
    hot = hot or find_hot_trips(points)
    columns = [c for c in per_trip.columns if c not in ("uid", "tid")]
    keyed = with_trip_key(points).drop("uid", "tid")
    trips = with_trip_key(per_trip).drop("uid", "tid")
    on = list(TRIP)
    if hot.any:
        parts = hot.trips.select(*TRIP, "_parts")
        names = [c for c in row_salt(points) if c not in ("uid", "tid")]
        keyed = join_lookup(keyed, parts, TRIP, "left", salt_by=names)
        salt = F.pmod(F.xxhash64(*names), F.coalesce(F.col("_parts"), F.lit(1)))
        keyed = keyed.withColumn("_salt", salt).drop("_parts")
        last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
        trips = join_lookup(trips, parts, TRIP, "left", salt_by=list(TRIP)).withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))
        ).drop("_parts")
        on.append("_salt")
    joined = keyed.join(trips, on, "left")
    known = F.col("_null") == 0
    joined = joined.withColumns({c: F.when(known, F.col(c)) for c in columns})
    return restore_keys(joined, [*points.columns, *columns])
