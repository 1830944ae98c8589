"""Session settings the operators rely on, and the folder that tasks on all hosts share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_MIB = 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def size_shuffle(spark: SparkSession, input_bytes: int, target_bytes: int = 128 * _MIB) -> int:
    """Start shuffles with about one partition per ``target_bytes`` of input.

    Adaptive execution only ever merges partitions, so the starting number has to fit the
    largest shuffle of the job. The value never goes below what the session already has.
    """
    have = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(have, -(-input_bytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """The folder for written stages: the cluster's checkpoint folder, read from the session.

    Only on one machine may the session name none: there a new local folder is made and set.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts of the cluster share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage_dir(spark: SparkSession) -> str:
    """A folder below :func:`shared_dir` no other application writes to."""
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as Spark sends Python files."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
