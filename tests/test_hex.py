"""Hexagonal neighbourhoods and travel times."""

import pytest
from frames import rows

from tripweave.functions.rules import NO_TIME_COLOUR, TIME_COLOURS
from tripweave.operators import hex_travel as hx


@pytest.mark.parametrize("k,cells", [(0, 1), (1, 7), (10, 331), (50, 7651), (51, 7957)])
def test_disk_sizes(spark, k, cells):
    start = spark.createDataFrame([("h_3_-2", 3, -2)], "hex_id string, q int, r int")
    disk = hx.hex_disk(start, k)
    assert disk.count() == cells == disk.select("neighbor_hex").distinct().count()
    rings = {r.ring_number: r["count"] for r in disk.groupBy("ring_number").count().collect()}
    assert rings == {0: 1, **{n: 6 * n for n in range(1, k + 1)}}


def test_ring_range_is_checked(spark):
    with pytest.raises(ValueError):
        hx.hex_disk(spark.createDataFrame([], "hex_id string, q int, r int"), -1)


@pytest.fixture(scope="module")
def tables(spark):
    cells = spark.createDataFrame(
        [(f"h_{q}_0", q, 0, q / 10, q / 5) for q in range(5)],
        "hex_id string, q int, r int, latitude double, longitude double",
    )
    pairs = [
        ("h_0_0", "h_1_0", 1.0, 2.25), ("h_0_0", "h_2_0", 2.0, None), ("h_0_0", "h_3_0", 3.0, 30.0),
        ("h_0_0", "h_0_0", 0.5, 9.0), ("h_1_0", "h_0_0", 1.0, 2.35), ("h_0_0", "gone", 1.0, 1.0),
    ]
    kind = "origin_hex string, dest_hex string, distance_km double, duration_minutes double"
    return spark.createDataFrame(pairs, kind), cells


@pytest.mark.parametrize("limit", [0, 10**9])
def test_travel_times(tables, limit):
    matrix, cells = tables
    times = hx.travel_times(matrix, cells, 2, "h_0_0", limit=limit)
    got = rows(times, "dest_hex", "duration_minutes", "ring", "color")
    assert got == sorted([
        ("h_0_0", 0.0, 0, TIME_COLOURS[0]), ("h_0_0", 9.0, 0, TIME_COLOURS[3]),
        ("h_1_0", 2.25, 1, TIME_COLOURS[0]), ("h_2_0", None, 2, NO_TIME_COLOUR),
    ], key=repr)
    assert hx.travel_times(matrix, cells, 2, limit=limit).count() == 4 + 2 + 3


def test_statistics(tables):
    times = hx.travel_times(*tables, 10, "h_0_0")
    # The row of the origin to itself in the matrix is a neighbour, but not measured.
    assert rows(hx.neighbour_summary(times)) == [("h_0_0", 4, 16.1, 30.0, 2.0)]
    assert rows(hx.ring_stats(times)) == [
        ("h_0_0", 1, 2.2, 2.2, 2.2, 1, 1.0), ("h_0_0", 2, None, None, None, 0, 2.0),
        ("h_0_0", 3, 30.0, 30.0, 30.0, 1, 3.0),
    ]
    order = [r.dest_hex for r in hx.neighbour_detail(times).collect()]
    assert order == ["h_1_0", "h_2_0", "h_3_0"]
