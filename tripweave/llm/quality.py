"""Operator 5, quality classifier: document evidence shrunk by hierarchical empirical Bayes.

A logistic classifier on simple measures of a text gives each document a log-likelihood ratio.
Sites (here ``source``) and paths in them (here ``lang``) have shares of good documents, which
are posterior means: a path's share is pulled towards its site's, a site's towards the share of
all documents, the more so the fewer documents it has. How hard each level pulls is estimated
from the spread between its groups (method of moments for a beta prior). The share of a
document's path, without the document itself, is its prior; prior odds times the evidence is
its posterior, and documents below ``threshold`` are rejected.

All statistics but one cover all documents: the weights of the classifier are fitted on at most
``FIT_ROWS`` labelled documents, those with the least hashes of their ids.

Defined results: a null or empty text has no evidence, its path alone decides; null sites and
paths are groups of their own; labels that are null or name no document are not used, several
labels of a document are averaged; with labels of one kind only, or none, there is no evidence
and nothing is rejected; repeated rows each get the same result; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows_without

#: Most labelled documents that the classifier is fitted on; they are collected as numbers.
FIT_ROWS = 20_000
#: Least posterior of a document that is kept.
THRESHOLD = 0.3

_SYMBOLS = b"&%$#*|<>{}[]=_~^\\@"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
MEASURES = [
    "log_words", "word_length", "distinct", "again", "symbols", "bars", "bangs", "upper",
    "digits", "stops", "lines",
]


def measures(text: str | None) -> list[float]:
    """Plain numbers about a text, in the order of ``MEASURES``."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(MEASURES)
    return [
        math.log1p(n),
        min(size / n, 30.0),
        len(set(words)) / n * math.log1p(n),
        sum(map(eq, words, words[1:])) / n,
        (size - len(raw.translate(None, _SYMBOLS))) / size,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        (size - len(raw.translate(None, _UPPER))) / size,
        (size - len(raw.translate(None, _DIGITS))) / size,
        raw.count(b".") / n,
        raw.count(b"\n") / n,
    ]


def measured(docs: DataFrame, id_col: str, text: str, site: str, path: str) -> DataFrame:
    """(doc_id, site, path, x) with the measures of each document."""
    wanted = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"),
        F.col(path).cast("string").alias("path"), F.col(text).alias("text"),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(v.as_py()) for v in batch.column(3)]
            columns = [*batch.columns[:3], pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "site", "path", "x"])

    return wanted.mapInArrow(measure, "doc_id long, site string, path string, x array<double>")


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[list[float], float]:
    """Weights and intercept of a ridge logistic regression, classes weighted alike.

    ``labelled`` is (doc_id, x, y). The bounded sample is solved by Newton's method.
    """
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    y = np.array([r["y"] for r in sample], float)
    if not len(y) or y.min() == y.max():
        return [0.0] * len(MEASURES), 0.0
    x = np.array([r["x"] for r in sample], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.clip((x - mean) / scale, -12, 12), np.ones((len(x), 1))])
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (y - p)) - ridge @ w
        bend = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights.tolist(), float(w[-1] - weights @ mean)


def _logit(p: Column) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame, centre: Column) -> float:
    """How many documents the prior of a level is worth, from groups (n, s) around centres."""
    r = F.col("s") / F.col("n")
    found = groups.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum("s").alias("s"), F.sum(F.col("n") * (r - centre) * (r - centre)).alias("spread"),
    ).first()
    if not found["n"] or found["groups"] < 2:
        return 1e6
    mean = found["s"] / found["n"]
    noise = mean * (1 - mean)
    free = found["n"] - found["squares"] / found["n"]
    between = (found["spread"] - (found["groups"] - 1) * noise) / max(free, 1e-9)
    if between <= noise * 1e-6:
        return 1e6
    return min(max(noise / between - 1, 1.0), 1e6)


def posteriors(evidence: DataFrame, scratch: Scratch) -> DataFrame:
    """(site, path, n, s, site_share, strength): counts of each path, and what it shrinks to.

    ``evidence`` is (site, path, p). Documents are added up per path before anything moves; the
    sites are made from the paths, the whole from the sites.
    """
    paths = scratch.table(
        evidence.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths"
    )
    sites = scratch.table(
        paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "sites"
    )
    whole = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    share = whole["s"] / whole["n"] if whole["n"] else 0.5
    pull = _strength(sites, F.lit(share))
    shrunk = sites.select(
        F.col("site").alias("of"), ((F.col("s") + pull * share) / (F.col("n") + pull)).alias("site_share")
    )
    joined = paths.join(shrunk, F.col("site").eqNullSafe(F.col("of"))).drop("of")
    strength = _strength(joined, F.col("site_share"))
    return scratch.table(joined.withColumn("strength", F.lit(strength)), "posteriors")


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
    site: str = "source", path: str = "lang", label: str = "quality",
    threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, evidence (log-likelihood ratio), prior (of the path), posterior, kept.

    The result reads tables in ``scratch``, a new folder unless given.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    table = scratch.table(measured(docs, id_col, text, site, path), "measures")
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    known = known.agg(F.avg(F.col(label).cast("double")).alias("y"))
    weights, base = fit(table.join(known, "doc_id").select("doc_id", "x", "y"), fit_rows)
    score = F.lit(base)
    for k, w in enumerate(weights):
        score = score + F.lit(w) * F.col("x")[k]
    has_text = F.col("x")[0] > 0
    score = F.when(has_text, F.greatest(F.least(score, F.lit(20.0)), F.lit(-20.0))).otherwise(0.0)
    scored = table.select("doc_id", "site", "path", score.alias("evidence"))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    groups = posteriors(scored.select("site", "path", p.alias("p")), scratch)
    same = F.col("d.site").eqNullSafe(F.col("g.site")) & F.col("d.path").eqNullSafe(F.col("g.path"))
    joined = scored.withColumn("p", p).alias("d").join(groups.alias("g"), same)
    prior = (F.col("s") - F.col("p") + F.col("strength") * F.col("site_share")) / (
        F.col("n") - 1 + F.col("strength")
    )
    full = joined.select("doc_id", "evidence", prior.alias("prior"))
    odds = F.col("evidence") + _logit(F.col("prior"))
    posterior = 1 / (1 + F.exp(-odds))
    return full.withColumn("posterior", posterior).withColumn("kept", F.col("posterior") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns.

    A document id goes if each of its rows is rejected; rows without an id stay.
    """
    scratch, working = (Scratch(docs.sparkSession, name) for name in ("rejected", "quality"))
    judged = classify(docs, labels, id_col=id_col, scratch=working, **options)
    gone = judged.groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("_kept"))
    gone = scratch.table(gone.where(~F.col("_kept") & F.col(id_col).isNotNull()).select(id_col), "ids")
    working.drop()
    return rows_without(docs, gone, id_col).select(*[F.col(f"`{c}`") for c in docs.columns])
