"""Scratch tables, size-checked joins, running totals and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: Measured bytes of a table that a join sends to all executors.
BROADCAST_BYTES = 64 << 20
#: Most rows of a narrow id table that is broadcast; above it the join shuffles.
BROADCAST_IDS = 1_000_000


_caches: dict[str, Callable[[], None]] = {}


def only_cache(name: str, clear: Callable[[], None]) -> None:
    """Let a worker keep the cache ``name`` and clear those that other operators left in it.

    Workers outlive stages: without this, each stage of a pipeline would leave its cache behind.
    """
    others = [x for x in _caches if x != name]
    for other in others:
        _caches.pop(other)()
    if others:
        release()
    _caches[name] = clear


def release() -> None:
    """Give memory that this process has freed back to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
    if trim:
        trim(0)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as Spark sends Python files."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


class Scratch:
    """A new folder for intermediate tables in the folder that all hosts share.

    Every table is written once, by Spark's own commit protocol, and read back: lineage ends
    there, and the loss of an executor costs no more than the tasks it ran.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more; without a name, all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows that; above it joins shuffle."""
    size = df.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in the stored table ``ids`` (one column, distinct).

    The ids are counted first. Up to ``BROADCAST_IDS`` of them are broadcast, so that ``df`` is
    not moved; more are joined by shuffle. The rows are the same either way.
    """
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def running_totals(
    df: DataFrame, key: str, values: dict[str, str], descending: bool = False, block: int = 1024
) -> DataFrame:
    """Add to a stored table, for each ``{value: name}``, the total of all rows before the row.

    ``key`` is a distinct whole number and gives the order. Keys are cut into blocks: a window
    runs over the totals of blocks, and another inside each block, so no task holds the table.
    """
    way = F.desc if descending else F.asc
    cut = df.withColumn("_block", F.floor(F.col(key) / block))
    sums = cut.groupBy("_block").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    over = Window.orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_block",
        *[F.coalesce(F.sum(f"_sum_{v}").over(over), F.lit(0)).alias(f"_start_{v}") for v in values],
    )
    inside = Window.partitionBy("_block").orderBy(way(key))
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    full = cut.join(starts, "_block")
    totals = [
        (F.col(f"_start_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(name)
        for v, name in values.items()
    ]
    return full.select(*df.columns, *totals)


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the least node it is connected with.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each node hands its
    least neighbour to the others, until the edges are stars around the least nodes. Minima are
    aggregated before they are shuffled, the joins on a hub are left to Spark's skew handling.
    Each round is written, and the round before it dropped.
    """
    swap = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = scratch.table(swap.where("u > v").distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        found = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == found:
            break
        mark, step = found, step + 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = f"{name}-{step - 1}", scratch.table(stars, f"{name}-{step}")
        scratch.drop(before)
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def rows_without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``ids``, as :func:`rows_of`; null keys stay."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, "left_anti")
