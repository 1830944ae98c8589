"""Operator 7, embedding near-duplicates: random-hyperplane signs in several tables.

Equal vectors of a label are one class. Each class gets, per table, the signs of its products
with random hyperplanes; classes that agree on all signs of a table meet in a bucket, where the
cosine is computed exactly in double precision. A pair that meets in several tables counts in
the first. Tasks return, per class, its number of links there and a spanning forest of the
links, never the pairs; distributed connected components join the forests.

The number of signs grows with the logarithm of the largest label, the number of tables follows
from the wanted recall of pairs that lie just at the threshold. Buckets with more than ``BLOCK``
classes are cut into parts, and each pair of parts is a group of its own, so no bucket has to
fit one task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
vectors with a null label or id, link with nothing (their component is their own id); vectors
of different lengths never link; repeated rows are separate vectors of the same class, and rows
that share an id are one node; an empty table gives an empty result; other columns are never
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Classes in a group that one call compares.
BLOCK = 1024
#: Classes per bucket that the number of signs aims at.
BUCKET = 128


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(signs per table, tables) for labels of up to ``n`` classes.

    Two vectors at the threshold agree on a sign with probability 1 - angle / pi, so on a table
    of b signs with the b-th power of it.
    """
    bits = max(6, round(math.log2(max(n, 1) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _classes(vectors: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, ok, h1, h2), and one row per class of equal usable vectors."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    good = F.col(label).isNotNull() & F.col(id_col).isNotNull() & v.isNotNull() & finite & nonzero
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(good, F.lit(False)).alias("ok"),
        F.col(label).cast("string").alias("label"), v.cast("array<double>").alias("vec"),
    )
    # The sum with 0.0 makes both zeros one; two 64-bit hashes stand for the vector.
    plain = F.transform(F.col("vec"), lambda x: x + F.lit(0.0))
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "label", plain)).withColumn(
        "h2", F.xxhash64(F.lit(2), "label", plain)
    )
    classes = rows.where("ok").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"),
        F.first("vec").alias("vec"),
    )
    return rows.select("vec_id", "ok", "h1", "h2"), classes


def _coded(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Unit vectors as bytes, and one code per table."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for rows in batches:
            dims = rows["vec"].map(len)
            units = pd.Series(index=rows.index, dtype=object)
            codes = pd.Series(index=rows.index, dtype=object)
            for dim, part in rows.groupby(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                signs = ((x @ planes[dim]) > 0).reshape(len(x), tables, bits)
                packed = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                for at, u, c in zip(part.index, x, packed, strict=True):
                    units[at], codes[at] = u.tobytes(), c.tolist()
            yield pd.DataFrame({
                "label": rows["label"], "dim": dims.astype("int32"), "rep": rows["rep"], "n": rows["n"],
                "unit": units, "codes": codes,
            })

    return classes.select("label", "rep", "n", "vec").mapInPandas(
        code, "label string, dim int, rep long, n long, unit binary, codes array<long>"
    )


def _forest(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n nodes the node of least order that the links a, b connect it with."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            if order[x] > order[y]:
                x, y = y, x
            root[y] = x
    return np.array([top(x) for x in range(n)], int)


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        rep = rows["rep"].to_numpy()
        copies = rows["n"].to_numpy()
        unit = np.frombuffer(b"".join(rows["unit"].to_pylist()), np.float64).reshape(len(rep), -1)
        codes = np.array(rows["codes"].to_pylist())
        t, low, high = rows["t"][0].as_py(), rows["low"][0].as_py(), rows["high"][0].as_py()
        part = rows["part"].to_numpy()
        left = np.flatnonzero(part == low)
        right = left if low == high else np.flatnonzero(part == high)
        i, j = np.nonzero(unit[left] @ unit[right].T >= threshold)
        i, j = left[i], right[j]
        once = rep[i] < rep[j] if low == high else rep[i] != rep[j]
        i, j = i[once], j[once]
        if t:
            new = ~(codes[i, :t] == codes[j, :t]).any(1)
            i, j = i[new], j[new]
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        roots = _forest(len(rep), i, j, rep)
        some = links > 0
        return pa.table({
            "rep": rep[some], "root": rep[roots[some]], "links": links[some].astype(np.int64)
        })

    return compare


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, recall: float = 0.9999, id_col: str = "vec_id",
    vector: str = "embedding", label: str = "label", seed: int = 7, block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows, classes = _classes(vectors, id_col, vector, label)
    classes = scratch.table(classes, "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold, recall)
    coded = scratch.table(_coded(classes, bits, tables, seed), "coded")

    bucket = ["label", "dim", "t", "code"]
    spread = coded.select("label", "dim", F.posexplode("codes").alias("t", "code"))
    large = spread.groupBy(*bucket).count().where(F.col("count") > block)
    large = large.withColumn("parts", F.ceil(F.col("count") / block).cast("int")).drop("count")
    large = scratch.table(large, "large")
    members = coded.select("*", F.posexplode("codes").alias("t", "code"))
    members = members.join(large, bucket, "left")
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("rep"), parts).cast("int")
    cells = members.withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    cells = cells.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    found = cells.select(*bucket, "low", "high", "part", "rep", "n", "unit", "codes").groupBy(
        *bucket, "low", "high"
    ).applyInArrow(_compare(threshold), "rep long, root long, links long")
    found = scratch.table(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    forest = found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    components = connected_components(forest.distinct(), scratch, "stars")

    known = classes.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(
        components.withColumnRenamed("id", "rep"), "rep", "left"
    )
    known = known.select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("ok"),
    )
    full = rows.join(known, ["h1", "h2", "ok"], "left")
    component = F.coalesce("component_id", "vec_id")
    return full.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
