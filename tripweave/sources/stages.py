"""Written stages: named Parquet tables below one folder, each replaced as a whole.

Every write makes a new version folder. When all its tasks have committed, a pointer file is
swapped in by one rename, and readers follow the pointer: they see the old version or the new
one, whatever fails in between, and a stage may be computed from its own last version. The version
before the current one is kept for readers that have opened it, older ones are deleted.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def stage_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    place, fs = _hadoop(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(n for n in names if n.startswith("v-"))


def current_version(spark: SparkSession, root: str, name: str) -> str:
    """The folder that the pointer of stage ``name`` names; raises if there is no stage."""
    path = stage_path(root, name)
    place, fs = _hadoop(spark, f"{path}/{POINTER}")
    if not fs.exists(place):
        raise FileNotFoundError(f"no stage {name} below {root}")
    stream = fs.open(place)
    try:
        version = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path}/{version}"


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Swap the pointer by one rename, then delete all versions but the last two."""
    fresh, fs = _hadoop(spark, f"{path}/_{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.makeQualified(fresh).toUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    pointer = hadoop.Path(f"{path}/{POINTER}")
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), how)
    for old in [v for v in _versions(spark, path) if v < version][:-1]:
        fs.delete(hadoop.Path(f"{path}/{old}"), True)


def _new_version() -> str:
    return f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_stage(
    df: DataFrame, root: str, name: str, cluster_by: Sequence[str] | None = None
) -> DataFrame:
    """Replace stage ``name`` by ``df`` and return it as read back.

    ``cluster_by`` sorts the table over its files, so a filter on the leading columns skips
    most of them; ranges are cut within a key too, so one long trip fills many files.
    """
    path, version = stage_path(root, name), _new_version()
    if cluster_by:
        order = [F.col(c).asc_nulls_last() for c in cluster_by]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.parquet(f"{path}/{version}")
    _publish(df.sparkSession, path, version)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{version}")


def read_stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(current_version(spark, root, name))


def _table_name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, root: str, name: str, by: str, buckets: int) -> DataFrame:
    """Replace stage ``name`` by ``df`` in ``buckets`` files by a hash of ``by``, sorted by it.

    A filter on one value of ``by`` reads one file, and joins and groupings on it do not shuffle.
    """
    path, version = stage_path(root, name), _new_version()
    place = f"{path}/{version}"
    shuffled = df.repartition(buckets, by)
    shuffled.write.bucketBy(buckets, by).sortBy(by).format("parquet").option("path", place).saveAsTable(_table_name(place))
    _publish(df.sparkSession, path, version)
    return df.sparkSession.table(_table_name(place))


def read_bucketed(spark: SparkSession, root: str, name: str, by: str, buckets: int) -> DataFrame:
    """The current version of a stage that :func:`write_bucketed` wrote, with its buckets."""
    place = current_version(spark, root, name)
    table = _table_name(place)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema.fields)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) "
            f"INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(table)
