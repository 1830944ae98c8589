"""Operator 12, line dedup: levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; it is known by
128 bits of hash. Documents are taken in batches of descending id. The keys of a batch are
merge-joined with the runs: keys that no run has (the anti join) are new, and the batch's
largest id that holds one is its keeper; keys that a run has only add their number of documents.
Both are written as a run of the batch, sorted by key. When a level has ``fan`` runs they are
compacted into one run of the next level, so a key is rewritten once per level and a batch
joins few runs.

Runs are tables bucketed and sorted by key, all with the same number of buckets: a batch is
shuffled by key once, and neither the joins with the runs nor the compaction shuffle again.

A line goes if its key has ``least_chars`` code points or more, is in ``least_docs`` documents
or more, and its document is not the keeper. Every step is a DataFrame operation; no Python
runs on the executors.

Defined results: a null or empty text is one empty line; a document with a null id takes no
part, it keeps all lines and is not counted; repeated rows are one document and are cut alike,
rows that share an id but not the text count as one document, each cut by itself; an empty table
gives an empty result; columns other than id and text are never read, their names may be any.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, sized

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, n_docs long, keeper long"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped and with A-Z lower-cased; where all is ASCII, plainly lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    exact = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(exact)


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(id, row, at, h1, h2): the lines of keys long enough, ``row`` a hash of the whole text."""
    rows = docs.where("id IS NOT NULL").select(
        "id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("at", "line")
    )
    # Long enough before it is stripped, at least: most short lines go by their bytes.
    rows = rows.where(F.octet_length("line") >= least_chars)
    rows = rows.where(F.char_length(F.btrim("line", F.lit(BLANK))) >= least_chars)
    rows = rows.select("id", "row", "at", line_key(F.col("line")).alias("key"))
    return rows.select(
        "id", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(12), "key").alias("h2")
    )


class LineRuns:
    """The runs so far, by level."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fan: int = 2, buckets: int | None = None):
        self.spark, self.scratch, self.fan = spark, scratch, fan
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
            .option("path", self.scratch.path(name)).saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Merge the keys of a batch's lines (id, h1, h2) with the runs, and add its own run.

        Documents of later batches must have smaller ids, or equal ones.
        """
        pairs = lines.select(*KEY, "id").distinct()
        batch = pairs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("last"))
        known = F.lit(False)
        for i, name in enumerate(self.names()):
            run = self.spark.table(name).select(*KEY, F.lit(True).alias(f"in_{i}"))
            batch = batch.join(run.hint("merge"), KEY, "left")
            known = known | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        run = batch.select(*KEY, "n_docs", F.when(~known, F.col("last")).alias("keeper"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(run))
        self._compact(0)

    def _compact(self, level: int) -> None:
        runs = self.levels[level]
        if len(runs) < self.fan:
            return
        whole = self._write(self._merged(runs))
        self.levels[level] = []
        for name in runs:
            self._drop(name)
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(whole)
        self._compact(level + 1)

    def _merged(self, names: list[str]) -> DataFrame:
        """One row per key of the runs: their counts added, and the one keeper."""
        whole = self.spark.table(names[0]).select(*KEY, "n_docs", "keeper")
        for name in names[1:]:
            more = self.spark.table(name).select(*KEY, F.col("n_docs").alias("n2"), F.col("keeper").alias("k2"))
            both = whole.join(more.hint("merge"), KEY, "full_outer")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))
            whole = both.select(*KEY, total.alias("n_docs"), F.coalesce("keeper", "k2").alias("keeper"))
        return whole

    def repeated(self, least_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the keys in at least ``least_docs`` documents."""
        names = self.names()
        if not names:
            return self.spark.createDataFrame([], RUN).select(*KEY, "keeper")
        return self._merged(names).where(F.col("n_docs") >= least_docs).select(*KEY, "keeper")

    def close(self) -> None:
        for name in self.names():
            self._drop(name)
        self.levels = []


def dedup_lines(
    docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id",
    text: str = "text", batches: int = 4, fan: int = 2,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the lines that stay, joined), a row per row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    # Any bounds give the same rows; these make batches of about the same number of documents.
    shares = [i / batches for i in range(1, batches)]
    bounds = named.agg(F.percentile_approx("id", shares, 1000)).first()[0] or [] if shares else []
    number = sum(((F.col("id") <= int(b)).cast("int") for b in bounds), F.lit(0))
    path = scratch.path("lines")
    long_lines(named, least_chars).withColumn("batch", number).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("id long, row long, at int, h1 long, h2 long, batch int").parquet(path)

    runs = LineRuns(spark, scratch, fan)
    for i in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == i))
    repeated = scratch.table(runs.repeated(least_docs), "repeated")
    runs.close()
    gone = lines.join(sized(repeated, F.lit(40)), KEY).where("id != keeper")
    gone = gone.groupBy("id", "row").agg(F.collect_set("at").alias("gone"))
    gone = scratch.table(gone, "gone")
    scratch.drop("lines")

    cut = named.withColumn("row", F.xxhash64("text")).join(
        sized(gone, F.size("gone") * 4 + 40), ["id", "row"], "left"
    )
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(every, "gone"), lambda i: F.get("lines", i))
    whole = F.coalesce("text", F.lit(""))
    return cut.withColumn("lines", lines_of(F.col("text"))).select(
        F.col("id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
