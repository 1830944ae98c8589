"""The SQL each registered query is checked against, for an engine with the test tables as views.

Geometry is checked by closed forms, not by another ray test: areas are diamonds and boxes.
Rounding goes through decimals, because the engines round binary ties differently.
"""

from __future__ import annotations

from ..functions import rules
from ..sources.country_names import COUNTRY_NAMES
from ..sources.sample_inputs import STORE_CATEGORIES, STORE_NAMES
from .catalog import (
    FILTER_COUNTRIES,
    FILTER_MODES,
    FILTER_USERS,
    ONE_TRIP,
    ORIGIN,
    PAIR,
    STORE_COUNTRY,
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _up(value: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def _even(value: str, digits: int) -> str:
    scaled = f"CAST({value} AS DECIMAL(28,10)) * {10 ** digits}"
    low = f"floor({scaled})"
    rest = f"({scaled} - {low})"
    up = f"({rest} > 0.5 OR ({rest} = 0.5 AND CAST({low} AS BIGINT) % 2 = 1))"
    return f"CAST(({low} + CASE WHEN {up} THEN 1 ELSE 0 END) AS DOUBLE) / 1e{digits}"


def _pick(index: str, values: list) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {_text(v) if isinstance(v, str) else repr(v) + 'e0'}"
        for i, v in enumerate(values)
    )
    return f"CASE {index} {whens} END"


# Great circles. A diamond or box is convex: a point is inside when it is on the inner side of the
# great circle of each edge, and two of them meet unless an edge has the other's corners all outside.


def _north(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    """Positive where the point is north of the great circle from a east to b, or west of it."""
    sines = [f"sin(radians(({u}) - ({v})))" for u, v in ((bx, ax), (bx, px), (px, ax))]
    return (
        f"(tan(radians({py}))*{sines[0]} - tan(radians({ay}))*{sines[1]} - tan(radians({by}))*{sines[2]})"
    )


def _diamond_sides(cx: str, cy: str, r: str, px: str, py: str) -> list[str]:
    """Negative inside, for each edge of the diamond."""
    w, n, e, s = (f"{cx} - {r}", cy), (cx, f"{cy} + {r}"), (f"{cx} + {r}", cy), (cx, f"{cy} - {r}")
    return [_north(*w, *n, px, py), _north(*n, *e, px, py), "-" + _north(*w, *s, px, py), "-" + _north(*s, *e, px, py)]


def _box_sides(x: str, y: str, h: str, px: str, py: str) -> list[str]:
    a, b, c, d = (f"{x} - {h}", f"{y} - {h}"), (f"{x} + {h}", f"{y} - {h}"), (f"{x} + {h}", f"{y} + {h}"), (f"{x} - {h}", f"{y} + {h}")
    return ["-" + _north(*a, *b, px, py), _north(*d, *c, px, py), _north(*a, *d, px, py), "-" + _north(*b, *c, px, py)]


def _in_diamond(cx: str, cy: str, r: str, px: str, py: str, closed: bool) -> str:
    bound = "<= 1e-14" if closed else "< -1e-14"
    return "(" + " AND ".join(f"{s} {bound}" for s in _diamond_sides(cx, cy, r, px, py)) + ")"


def _box_meets_diamond(x: str, y: str, h: str, cx: str, cy: str, r: str) -> str:
    corners = [(f"{x} {a} {h}", f"{y} {b} {h}") for a in "+-" for b in "+-"]
    ends = [(f"{cx} + {r}", cy), (f"{cx} - {r}", cy), (cx, f"{cy} + {r}"), (cx, f"{cy} - {r}")]
    by_diamond = zip(*[_diamond_sides(cx, cy, r, *p) for p in corners])
    by_box = zip(*[_box_sides(x, y, h, *p) for p in ends])
    apart = [f"least({', '.join(sides)}) > 1e-14" for sides in [*by_diamond, *by_box]]
    return "NOT (" + " OR ".join(apart) + ")"


# Inputs.

_GPS = """
gps AS (
  SELECT CAST(user_id AS VARCHAR) AS uid, CAST(week AS VARCHAR) AS tid, event_id, value, t,
         1e1*(user_id % 5) + 5e0 + (km + jitter)/111.195e0 AS lat,
         1e1*((user_id // 5) % 5) + 5e0 + ((user_id % 7) - 3)*0.9e0 + km/4e2 AS lng
  FROM (
    SELECT *,
      CASE user_id % 8 WHEN 0 THEN 0.2e0 WHEN 1 THEN 4e0 WHEN 2 THEN 9e0 WHEN 3 THEN 18e0
        WHEN 4 THEN 30e0 WHEN 5 THEN 70e0 WHEN 6 THEN 120e0 ELSE 13e0 END
        * (t - week*1008) / 3.6e3 AS km,
      CASE WHEN value > 330 THEN 5e0 WHEN user_id % 8 = 7 THEN value/1e3 ELSE value/1e5 END
        AS jitter
    FROM (
      SELECT event_id, user_id, value, epoch_us(ts) // 604800000000 AS week,
             epoch_us(ts) // 600000000 AS t
      FROM events
    )
  )
)"""

_SPEED = _GPS + """,
lagged AS (
  SELECT *, lag(t) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0
  FROM gps WINDOW w AS (PARTITION BY uid, tid ORDER BY t, event_id)
),
speed AS (
  SELECT uid, tid, event_id, value, t, lat, lng, coalesce(t - t0, 0) AS time_lag,
    CASE WHEN t0 IS NULL OR t = t0 THEN 0e0
         ELSE 12742017.6e0 * asin(sqrt(
           power(sin(radians(lat - lat0)/2e0), 2e0)
           + cos(radians(lat0))*cos(radians(lat))*power(sin(radians(lng - lng0)/2e0), 2e0)))
           / (t - t0) * 3.6e0 END AS speed
  FROM lagged
)"""

_CLEAN = _SPEED + """,
clean AS (
  SELECT * FROM speed s
  WHERE NOT EXISTS (
    SELECT 1 FROM speed o WHERE o.speed > 200 AND o.uid = s.uid AND o.tid = s.tid)
)"""

_COUNTRIES = """
countries AS (
  SELECT n_nationkey AS k, 'd' || n_nationkey AS id, 'N' || chr(65 + n_nationkey) AS iso_code,
    CASE WHEN n_nationkey <> 24 THEN n_name END AS english_name,
    CASE WHEN n_nationkey <> 24 THEN 'Republic of ' || n_name END AS official_name,
    n_name AS local_name, 1e1*(n_nationkey // 5) + 5e0 AS cx, 1e1*(n_nationkey % 5) + 5e0 AS cy
  FROM nation WHERE n_nationkey NOT IN (22, 23)
)"""

_TAGGED = _CLEAN + "," + _COUNTRIES + """,
tagged AS (
  SELECT p.*, c.iso_code AS country_code, c.english_name AS country_name
  FROM clean p LEFT JOIN countries c ON abs(p.lng - c.cx) <= 2.5e0 AND abs(p.lat - c.cy) <= 3e0
    AND """ + _in_diamond("c.cx", "c.cy", "2.5e0", "p.lng", "p.lat", False) + """
)"""

_STATS = _TAGGED + f""",
stats AS (
  SELECT uid, tid, count(*) AS point_count, {_up('avg(speed)')} AS avg_speed,
    {_up('max(speed)')} AS max_speed, {_up('min(speed)')} AS min_speed,
    {_up('stddev_samp(speed)')} AS stddev_speed,
    {_up('quantile_cont(speed, 0.5)')} AS median_speed,
    {_up('quantile_cont(speed, 0.75)')} AS p75_speed,
    {_up('quantile_cont(speed, 0.25)')} AS p25_speed
  FROM tagged WHERE speed >= 0 GROUP BY uid, tid
)"""

_MODES = _STATS + """,
modes AS (
  SELECT uid, tid, point_count, avg_speed, max_speed, median_speed,
    CASE WHEN avg_speed < 1 THEN 'stationary'
         WHEN avg_speed < 6 AND max_speed < 15 THEN 'walking'
         WHEN avg_speed >= 6 AND avg_speed < 12 AND max_speed < 20 THEN 'running'
         WHEN avg_speed >= 8 AND avg_speed < 25 AND max_speed < 45 THEN 'cycling'
         WHEN avg_speed >= 80 OR (avg_speed > 60 AND median_speed > 80) THEN 'train_airplane'
         WHEN avg_speed >= 40 AND median_speed >= 60 THEN 'driving_highway'
         WHEN avg_speed >= 15 THEN 'driving_urban'
         ELSE 'unknown' END AS transportation_mode
  FROM stats
)"""

_POINTS = _MODES + """,
points AS (
  SELECT t.*, m.transportation_mode, m.avg_speed AS trip_avg_speed,
    m.max_speed AS trip_max_speed, m.median_speed AS trip_median_speed
  FROM tagged t LEFT JOIN modes m ON t.uid = m.uid AND t.tid = m.tid
)"""

_AT = "make_timestamp(t * 1000000)"
_TIME = f"strftime({_AT}, '%Y-%m-%d %H:%M:%S')"
_RAW = f"""uid, tid, event_id, lat, lng,
  CAST(0 AS INTEGER) AS zero_col, value AS alt, t/8.64e4 AS dayno,
  strftime({_AT}, '%Y-%m-%d') AS event_date, strftime({_AT}, '%H:%M:%S') AS event_time,
  {_TIME} AS event_timestamp"""

_CODES = [line.split("|") for line in COUNTRY_NAMES.strip().splitlines()]
_REFERENCE = "reference(i, iso_code, english_name, official_name) AS (VALUES " + ", ".join(
    f"({i}, {', '.join(_text(v) for v in row)})" for i, row in enumerate(_CODES)
) + ")"
_CUSTOMERS = f"""coded AS (
  SELECT c_custkey, coalesce(r.iso_code, 'ZZ') AS iso_code
  FROM customer LEFT JOIN reference r ON c_custkey % {len(_CODES) + 1} = r.i
)"""

# Summaries.

_ID = "uid || '-' || tid"
_OVERVIEW = f"""SELECT count(*) AS total_points, count(DISTINCT uid) AS total_users,
  count(DISTINCT {_ID}) AS total_trips, {_up('avg(speed)')} AS avg_speed,
  {_up('max(speed)')} AS max_speed FROM points"""
# The mean of decimals in whole hundredths, rounded half up by integer division.
_CENTS = "sum(CAST(round(trip_avg_speed * 100) AS BIGINT))"
_MEAN = f"CAST((2*{_CENTS} + count(*)) // (2*count(*)) AS DOUBLE) / 1e2"

_PAIRS = f"""SELECT country_name, transportation_mode, count(DISTINCT {_ID}) AS trip_count
  FROM points WHERE country_name IS NOT NULL AND transportation_mode IS NOT NULL
  GROUP BY ALL"""

_TRIPS = f"""SELECT {_ID} AS trip_id, uid, tid, transportation_mode, country_name,
  count(*) AS points, {_up('trip_avg_speed')} AS avg_speed
  FROM points WHERE transportation_mode IS NOT NULL
  GROUP BY uid, tid, transportation_mode, country_name, trip_avg_speed"""

# Segments and routes.

_SEGMENTS = _POINTS + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY uid, tid ORDER BY t, event_id, country_code) AS rn
  FROM points
),
segments AS (
  SELECT a.uid, a.tid, a.rn, a.lat AS lat1, a.lng AS lon1, b.lat AS lat2, b.lng AS lon2,
    (a.speed + b.speed)/2e0 AS speed, b.time_lag AS seconds
  FROM numbered a JOIN numbered b ON a.uid = b.uid AND a.tid = b.tid AND b.rn = a.rn + 1
),
lags AS (
  SELECT uid, tid, CAST(sum(time_lag) AS BIGINT) AS total_duration_seconds
  FROM points GROUP BY uid, tid
)"""

_METRICS = _SEGMENTS + f""",
metrics AS (
  SELECT s.uid, s.tid, min_by(lat1, rn) AS start_lat, min_by(lon1, rn) AS start_lon,
    max_by(lat2, rn) AS end_lat, max_by(lon2, rn) AS end_lon, count(*) AS segments,
    any_value(total_duration_seconds) AS total_duration_seconds,
    {_even('any_value(total_duration_seconds)/6e1', 2)} AS total_duration_minutes,
    {_up('sum(speed * (seconds/3.6e3))')} AS total_distance_km
  FROM segments s JOIN lags l ON s.uid = l.uid AND s.tid = l.tid
  GROUP BY s.uid, s.tid
)"""

_ENDS = """uid, tid, start_lat, start_lon,
  end_lat, end_lon"""

_SPEED_COLOUR = "CASE " + " ".join(
    f"WHEN speed > {above} THEN '[{','.join(map(str, colour))}]'"
    for above, colour in rules.SPEED_COLOURS
) + f" ELSE '[{','.join(map(str, rules.SLOW_COLOUR))}]' END"

_ROUTES = f"""routes AS (
  SELECT uid, tid, 'driving-car' AS profile,
    CAST(round(CAST(round(CAST(count(*)*137.5e0 AS DECIMAL(28,10))) AS DECIMAL(28,10))
      / 1000, 2) AS DOUBLE) AS distance_km,
    CAST(round(CAST(round(CAST(count(*)*31.4e0 AS DECIMAL(28,10))) AS DECIMAL(28,10))
      / 60, 2) AS DOUBLE) AS duration_minutes
  FROM clean GROUP BY uid, tid
)"""

# Hexagons.

_HEX = """
cells AS (
  SELECT CAST(s_suppkey % 20 AS INTEGER) AS q, CAST(s_suppkey // 20 AS INTEGER) AS r,
    'h_' || (s_suppkey % 20) || '_' || (s_suppkey // 20) AS hex_id
  FROM supplier
)"""

_RING = """CAST((abs(b.q - a.q) + abs(b.r - a.r) + abs(b.q - a.q + b.r - a.r)) // 2 AS INTEGER)"""

_TIME_COLOUR = "CASE WHEN duration_minutes IS NULL THEN " + (
    f"'[{','.join(map(str, rules.NO_TIME_COLOUR))}]'"
) + " " + " ".join(
    f"WHEN duration_minutes < {3 * (i + 1)} THEN '[{','.join(map(str, colour))}]'"
    for i, colour in enumerate(rules.TIME_COLOURS[:-1])
) + f" ELSE '[{','.join(map(str, rules.TIME_COLOURS[-1]))}]' END"

_TIMES = _HEX + f""",
pairs AS (
  SELECT a.hex_id AS origin_hex, b.hex_id AS dest_hex, {_RING} AS ring,
    a.q AS q1, a.r AS r1, b.q AS q2, b.r AS r2
  FROM cells a JOIN cells b ON {_RING} <= 10
),
times AS (
  SELECT origin_hex, dest_hex, ring, ring*0.8e0 AS distance_km,
    CASE WHEN ring = 0 THEN 0e0
         WHEN (q1*7 + r1*11 + q2*13 + r2*3) % 50 <> 0
         THEN ring*2.5e0 + ((q2*31 + r2*17) % 10)/1e1 END AS duration_minutes,
    r1*0.012e0 AS origin_lat, q1*0.014e0 + r1*0.007e0 AS origin_lon,
    r2*0.012e0 AS dest_lat, q2*0.014e0 + r2*0.007e0 AS dest_lon
  FROM pairs
)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def _facet(column: str) -> str:
    keep = "" if column == "uid" else f" WHERE {column} IS NOT NULL"
    return f"SELECT DISTINCT '{column}' AS facet, {column} AS value FROM points{keep}"


def _spread(name: str, p: float) -> str:
    return f"{_up(f'quantile_cont(trip_avg_speed, {p})')} AS {name}"


# Holes and parts: inside the outer diamond, not strictly inside the hole, or in the island. Turning
# all of it around the axis changes no side.
_AREA_PLACES = f"""WITH areas AS (
  SELECT n_nationkey AS k, n_name AS area, 1e1*(n_nationkey // 5) + 5e0 AS cx, 1e1*(n_nationkey % 5) + 5e0 AS cy
  FROM nation
), spots AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, (c_custkey*6151 % 50000)/1e3 AS lng, (c_custkey*3571 % 50000)/1e3 AS lat
  FROM customer
)
SELECT id, area FROM spots LEFT JOIN areas ON abs(lng - cx) <= 4e0 AND abs(lat - cy) <= 5e0 AND (
  {_in_diamond('cx', 'cy', '4e0', 'lng', 'lat', True)} AND NOT {_in_diamond('cx', 'cy', '1.5e0', 'lng', 'lat', False)}
  OR k % 3 = 0 AND {_in_diamond('cx', 'cy', '0.7e0', 'lng', 'lat', True)})"""

ORACLE: dict[str, str] = {
    "area_places": _AREA_PLACES,
    "date_line_places": _AREA_PLACES,
    "origin_travel_times": _with(
        _TIMES,
        "SELECT origin_hex, dest_hex, distance_km, duration_minutes, origin_lat, origin_lon, dest_lat, "
        f"dest_lon, ring, {_TIME_COLOUR} AS color FROM times WHERE origin_hex = {_text(ORIGIN)} AND ring <= 5",
    ),
    "gps_points": _with(_GPS, f"SELECT {_RAW} FROM gps"),
    "speed_points": _with(
        _SPEED,
        f"SELECT uid, tid, event_id, {_TIME} AS event_timestamp, time_lag, "
        "round(speed, 6) AS speed FROM speed",
    ),
    "outlier_trips": _with(_SPEED, "SELECT DISTINCT uid, tid FROM speed WHERE speed > 200"),
    "points_clean": _with(
        _CLEAN, f"SELECT {_RAW}, time_lag, round(speed, 6) AS speed FROM clean"
    ),
    "country_reference": _with(
        _REFERENCE + ", " + _CUSTOMERS,
        "SELECT c.iso_code, english_name, official_name, count(*) AS customers "
        "FROM coded c LEFT JOIN reference r ON c.iso_code = r.iso_code GROUP BY ALL",
    ),
    "country_key_check": _with(
        _REFERENCE + ", " + _CUSTOMERS,
        "SELECT 'customer' AS checked, iso_code, count(*) AS occurrences FROM coded "
        "GROUP BY iso_code HAVING count(*) > 1 UNION ALL "
        "SELECT 'reference', 'N' || chr(65 + n_nationkey), count(*) FROM nation "
        "WHERE n_nationkey <> 24 GROUP BY n_nationkey HAVING count(*) > 1",
    ),
    "countries": _with(
        _COUNTRIES,
        "SELECT id, iso_code, english_name, official_name, local_name, 'country' AS subtype, "
        "'land' AS class, cx - 2.5e0 AS xmin, cx + 2.5e0 AS xmax, cy - 2.5e0 AS ymin, "
        "cy + 2.5e0 AS ymax, CAST(5 AS BIGINT) AS ring_points FROM countries",
    ),
    "points_country": _with(
        _TAGGED,
        f"SELECT {_RAW}, time_lag, round(speed, 6) AS speed, country_code, country_name FROM tagged",
    ),
    "trip_statistics": _with(_STATS, "SELECT * FROM stats"),
    "trip_modes": _with(_MODES, "SELECT * FROM modes"),
    "points_mode": _with(
        _POINTS,
        f"SELECT {_RAW}, time_lag, round(speed, 6) AS speed, country_code, country_name, "
        "transportation_mode, trip_avg_speed, trip_max_speed, trip_median_speed FROM points",
    ),
    "overview": _with(_POINTS, _OVERVIEW),
    "overview_filtered": _with(
        _POINTS,
        f"{_OVERVIEW} WHERE transportation_mode IN {_in(FILTER_MODES)} "
        f"AND country_name IN {_in(FILTER_COUNTRIES)}",
    ),
    "facet_values": _with(
        _POINTS,
        " UNION ALL ".join(_facet(c) for c in ("uid", "transportation_mode", "country_name")),
    ),
    "mode_distribution": _with(
        _POINTS,
        f"SELECT transportation_mode, count(DISTINCT {_ID}) AS trip_count, {_MEAN} AS avg_speed "
        "FROM points WHERE transportation_mode IS NOT NULL GROUP BY transportation_mode",
    ),
    "top_countries": _with(
        _POINTS,
        f"SELECT country_name, count(DISTINCT {_ID}) AS trip_count, count(*) AS point_count "
        "FROM points WHERE country_name IS NOT NULL GROUP BY country_name "
        "ORDER BY trip_count DESC, country_name LIMIT 10",
    ),
    "speed_distribution": _with(
        _POINTS,
        f"SELECT transportation_mode, {_up('min(trip_avg_speed)')} AS min_speed, "
        f"{_spread('p25_speed', 0.25)}, {_spread('median_speed', 0.5)}, "
        f"{_spread('p75_speed', 0.75)}, {_up('max(trip_avg_speed)')} AS max_speed FROM ("
        "SELECT DISTINCT uid, tid, transportation_mode, trip_avg_speed FROM points "
        "WHERE transportation_mode IS NOT NULL) GROUP BY transportation_mode",
    ),
    "mode_by_country": _with(_POINTS, _PAIRS),
    "mode_by_top_countries": _with(
        _POINTS + f", pair_counts AS ({_PAIRS})",
        "SELECT * FROM pair_counts WHERE country_name IN (SELECT country_name FROM pair_counts "
        "GROUP BY country_name ORDER BY sum(trip_count) DESC, country_name LIMIT 5)",
    ),
    "speed_by_mode_country": _with(
        _POINTS,
        f"SELECT country_name, transportation_mode, {_MEAN} AS avg_speed, "
        f"count(DISTINCT {_ID}) AS trip_count FROM points "
        "WHERE country_name IS NOT NULL AND transportation_mode IS NOT NULL "
        f"GROUP BY ALL HAVING count(DISTINCT {_ID}) >= 5 "
        "ORDER BY avg_speed DESC, country_name, transportation_mode LIMIT 20",
    ),
    "sample_trips": _with(
        _POINTS,
        "SELECT uid, tid, transportation_mode, country_name, count(*) AS points, trip_avg_speed, "
        "trip_max_speed, trip_median_speed FROM points GROUP BY ALL "
        "ORDER BY trip_avg_speed DESC NULLS FIRST, uid, tid, transportation_mode, "
        "country_name NULLS LAST LIMIT 100",
    ),
    "trip_list": _with(_POINTS, _TRIPS),
    "trip_picker": _with(
        _POINTS + f", trips AS ({_TRIPS})",
        "SELECT *, count(*) OVER (PARTITION BY country_name, transportation_mode) AS trips_found "
        "FROM trips WHERE country_name IS NOT NULL",
    ),
    "trip_segments": _with(
        _SEGMENTS,
        "SELECT s.uid, s.tid, rn, lat1, lon1, "
        "lat2, lon2, "
        f"{_up('speed')} AS avg_speed, seconds AS segment_duration_seconds, "
        f"{_SPEED_COLOUR} AS color, total_duration_seconds, "
        + _up("sum(speed * (seconds/3.6e3)) OVER (PARTITION BY s.uid, s.tid)")
        + " AS total_distance_km, 'LineString' AS segment_type, "
        "lon1 AS segment_lon1, lat2 AS segment_lat2 "
        "FROM segments s JOIN lags l ON s.uid = l.uid AND s.tid = l.tid",
    ),
    "trip_metrics": _with(
        _METRICS,
        f"SELECT {_ENDS}, segments, total_duration_seconds, total_duration_minutes, "
        "total_distance_km FROM metrics",
    ),
    "trip_endpoints": _with(_METRICS, f"SELECT {_ENDS} FROM metrics"),
    "trip_extent": _with(
        _METRICS + """, bounds AS (
          SELECT uid, tid, least(start_lat, end_lat) AS a, greatest(start_lat, end_lat) AS b,
            least(start_lon, end_lon) AS c, greatest(start_lon, end_lon) AS d FROM metrics
        ), padded AS (
          SELECT *, CASE WHEN a = b THEN 0.01e0 ELSE (b - a)*0.15e0 END AS pa,
            CASE WHEN c = d THEN 0.01e0 ELSE (d - c)*0.15e0 END AS pb FROM bounds
        )""",
        "SELECT uid, tid, a AS min_lat, b AS max_lat, "
        "pa AS lat_padding, (a + b)/2e0 AS center_lat, "
        "c AS min_lon, d AS max_lon, pb AS lon_padding, "
        "(c + d)/2e0 AS center_lon, CAST(CASE "
        "WHEN greatest(b - a + pa, d - c + pb) < 0.01e0 THEN 14 "
        "WHEN greatest(b - a + pa, d - c + pb) < 0.05e0 THEN 12 "
        "WHEN greatest(b - a + pa, d - c + pb) < 0.1e0 THEN 11 "
        "WHEN greatest(b - a + pa, d - c + pb) < 0.5e0 THEN 10 "
        "WHEN greatest(b - a + pa, d - c + pb) < 1e0 THEN 9 "
        "WHEN greatest(b - a + pa, d - c + pb) < 2e0 THEN 8 ELSE 7 END AS INTEGER) "
        "AS zoom_level FROM padded",
    ),
    "route_summary": _with(
        _CLEAN + ", " + _ROUTES, "SELECT *, 'LineString' AS geometry_type FROM routes"
    ),
    "trip_profiles": _with(
        _POINTS + f", trips AS ({_TRIPS})", "SELECT *, 'driving-car' AS profile FROM trips"
    ),
    "route_comparison": _with(
        _METRICS + ", " + _ROUTES,
        "SELECT m.uid, m.tid, profile, total_distance_km AS actual_distance_km, "
        "total_duration_minutes AS actual_duration_minutes, distance_km AS planned_distance_km, "
        "duration_minutes AS planned_duration_minutes, "
        f"{_up('total_distance_km - distance_km')} AS distance_difference, "
        f"{_up('total_duration_minutes - duration_minutes')} AS duration_difference "
        "FROM metrics m JOIN routes r ON m.uid = r.uid AND m.tid = r.tid",
    ),
    "infra_tags": """
        SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 4 WHEN 0 THEN 'parking' WHEN 1 THEN 'Parking_lot'
            WHEN 2 THEN 'bridge' ELSE 'bicycle_parking' END AS class,
          CASE WHEN p_partkey % 5 = 0 AND n = 1 THEN 'fee' ELSE 'hgv' END AS tag_key,
          CASE WHEN p_partkey % 5 = 0 AND n = 0 THEN 'yes' WHEN p_partkey % 5 = 0 THEN 'no'
            WHEN p_partkey % 5 = 1 THEN 'designated' WHEN p_partkey % 5 = 2 THEN 'no'
            WHEN n = 0 THEN 'yes' ELSE 'designated' END AS tag_value
        FROM part JOIN range(2) AS r(n) ON n = 0 OR p_partkey % 5 IN (0, 3)
        WHERE p_partkey % 5 <> 4""",
    "hgv_parkings": _with(
        _COUNTRIES + """, boxes AS (
          SELECT CAST(p_partkey AS VARCHAR) AS id, (p_partkey*7919 % 50000)/1e3 AS x,
            (p_partkey*104729 % 50000)/1e3 AS y, p_partkey % 5 AS tags FROM part
          WHERE p_partkey % 4 IN (0, 1) AND p_partkey % 3 <> 2
            AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 IN (0, 1, 3)
        )""",
        "SELECT b.id, english_name, x - 0.2e0 AS xmin, y - 0.2e0 AS ymin, "
        "x + 0.2e0 AS xmax, y + 0.2e0 AS ymax "
        "FROM boxes b JOIN countries c ON abs(x - cx) < 3e0 AND abs(y - cy) < 3e0 AND "
        + _box_meets_diamond("x", "y", "0.2e0", "cx", "cy", "2.5e0") + " "
        "JOIN range(2) AS r(n) ON n = 0 OR tags = 3",
    ),
    "retail_stores": _with(
        _COUNTRIES + f""", stores AS (
          SELECT CAST(c_custkey AS VARCHAR) AS id, {_pick('c_custkey % 9', STORE_NAMES)} AS store_name,
            {_pick('c_custkey % 4', STORE_CATEGORIES)} AS category,
            (c_custkey*6151 % 50000)/1e3 AS lng, (c_custkey*3571 % 50000)/1e3 AS lat,
            '[{{"country":"N' || chr(65 + c_nationkey) || '"}}]' AS addresses,
            {_pick('c_custkey % 9', ["REWE", "LIDL", "ALDI", "NETTO", "PENNY", "EDEKA", "REWE",
                                     "ALDI"])} AS canonical_name
          FROM customer
        )""",
        "SELECT s.* FROM stores s JOIN countries c "
        "ON abs(lng - cx) <= 2.5e0 AND abs(lat - cy) <= 3e0 AND "
        + _in_diamond("cx", "cy", "2.5e0", "lng", "lat", True) + " "
        f"WHERE english_name = {_text(STORE_COUNTRY)} AND canonical_name IS NOT NULL "
        f"AND category IN {_in(rules.RETAIL_CATEGORIES)}",
    ),
    "hex_disk": _with(
        _HEX,
        "SELECT a.hex_id, 'h_' || (a.q + dq) || '_' || (a.r + dr) AS neighbor_hex, "
        "CAST(greatest(abs(dq), abs(dr), abs(dq + dr)) AS INTEGER) AS ring_number "
        "FROM cells a, range(-10, 11) AS x(dq), range(-10, 11) AS y(dr) "
        "WHERE greatest(abs(dq), abs(dr), abs(dq + dr)) <= 10",
    ),
    "travel_times": _with(
        _TIMES,
        "SELECT origin_hex, dest_hex, distance_km, "
        "duration_minutes, origin_lat, "
        "origin_lon, dest_lat, "
        f"dest_lon, ring, {_TIME_COLOUR} AS color FROM times",
    ),
    "neighbour_detail": _with(
        _TIMES,
        "SELECT origin_hex, dest_hex, ring, duration_minutes, "
        "distance_km, dest_lat, "
        "dest_lon FROM times WHERE ring > 0",
    ),
    "neighbour_summary": _with(
        _TIMES,
        "SELECT origin_hex, count(*) - 1 AS neighbours, "
        f"{_even('avg(duration_minutes) FILTER (ring > 0)', 1)} AS avg_time, "
        f"{_even('max(duration_minutes) FILTER (ring > 0)', 1)} AS max_time, "
        f"{_even('avg(distance_km) FILTER (ring > 0)', 1)} AS avg_distance "
        "FROM times GROUP BY origin_hex",
    ),
    "ring_stats": _with(
        _TIMES,
        f"SELECT origin_hex, ring, {_even('min(duration_minutes)', 1)} AS min_time, "
        f"{_even('avg(duration_minutes)', 1)} AS avg_time, "
        f"{_even('max(duration_minutes)', 1)} AS max_time, count(duration_minutes) AS hexagons, "
        f"{_even('avg(distance_km)', 1)} AS avg_distance "
        "FROM times WHERE ring > 0 GROUP BY origin_hex, ring",
    ),
}

# The same queries over chosen facets: the points are restricted first.
_CHOSEN = _POINTS.replace("points AS (", "every_point AS (") + f""",
points AS (
  SELECT * FROM every_point WHERE uid IN {_in(FILTER_USERS)} AND transportation_mode IN {_in(FILTER_MODES)}
    AND country_name IN {_in(FILTER_COUNTRIES)}
)"""
for _name in ("overview", "mode_distribution", "top_countries", "mode_by_country", "speed_by_mode_country",
              "speed_distribution", "sample_trips"):
    ORACLE[f"chosen_{_name}"] = _with(_CHOSEN, ORACLE[_name].removeprefix(_with(_POINTS, "")))
ORACLE["chosen_speed_by_mode_country"] = ORACLE["chosen_speed_by_mode_country"].replace(") >= 5", ") >= 1")
ORACLE["chosen_sample_trips"] = ORACLE["chosen_sample_trips"].replace("LIMIT 100", "LIMIT 20")
ORACLE["cube_overview"] = ORACLE["overview"]
ORACLE["trips_of_pair"] = _with(
    _POINTS + f", trips AS ({_TRIPS})",
    "SELECT *, count(*) OVER () AS trips_found FROM trips "
    f"WHERE country_name = {_text(PAIR[0])} AND transportation_mode = {_text(PAIR[1])}",
)
ORACLE["one_trip_segments"] = _with(
    _SEGMENTS,
    f"SELECT s.uid, s.tid, rn, lat1, lon1, lat2, lon2, {_up('speed')} AS avg_speed, "
    f"seconds AS segment_duration_seconds, {_SPEED_COLOUR} AS color, total_duration_seconds, "
    + _up("sum(speed * (seconds/3.6e3)) OVER (PARTITION BY s.uid, s.tid)")
    + " AS total_distance_km FROM segments s JOIN lags l ON s.uid = l.uid AND s.tid = l.tid "
    f"WHERE s.uid = {_text(ONE_TRIP[0])} AND s.tid = {_text(ONE_TRIP[1])}",
)
