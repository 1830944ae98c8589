"""Operator 8, mixing sources to target weights by whole repetitions and hash-seeded copies.

Sizes are summed per source, target sizes follow from weights and the whole budget, and a
source's rate is target over size. Every document is emitted ``floor(rate)`` times, plus once
more if a hash of its id falls below the fraction that is left: a Bernoulli draw that reruns
repeat. A hash gives a draw for each of ``SEEDS`` seeds; one aggregation adds up, per source
and seed, what the mix would take, and the seed that comes nearest to the target is used, so
few large documents do not throw a source off its target.

Defined results: a null text has size 0 and is emitted like others; null is a source of its
own, after all others; a source of size 0 has target 0 and rate 0; repeated rows are drawn
alike, since the draw depends on the id alone; an empty table gives an empty mix; other
columns, whatever their names, pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Draws per document among which each source takes the best; the hash has 32 bits.
SEEDS = 64
_SPAN = 4294967296.0


def size_in_words(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def words_of_hash(key: Column) -> tuple[Column, Column]:
    """Two 32-bit words of the MD5 of an id."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def draw(first: Column, second: Column, seed: Column) -> Column:
    """Uniform on 0 to 1 for each seed: (first + seed * second) mod 2^32."""
    return ((first + seed * second) % F.lit(int(_SPAN))) / F.lit(_SPAN)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), one row per source.

    Weights are dealt to the sources in order of their code points, null last, again and again.
    A source stops at ``most`` times its size, and what it leaves goes to the others by weight.
    A level of filling is reached by sources in the order of size over weight, so one pass of
    running sums settles all of them. The table has one row per source, whatever the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    dealt = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    named = sizes.withColumn("weight", dealt)
    cap = F.lit(most) * F.col("source_size")
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = F.greatest(left, F.lit(0.0)) / heavy
    ranked = named.withColumn("_level", level).withColumn("_full", F.col("weight") * F.col("_level") >= cap)
    # From the first source that its level does not fill, that level holds for all that follow.
    first = F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("weight"), F.col("_level").alias("level")))).over(whole)
    target = F.when(F.col("_full"), cap).otherwise(F.col("weight") * first["level"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ranked.withColumn("target", target).withColumn("rate", rate).select(
        "source", "source_size", "target", "rate"
    )


def _copies(rate: Column, first: Column, second: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (draw(first, second, seed) < rate - whole).cast("long")).cast("long")


def sized(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text",
    source: str = "source",
) -> DataFrame:
    """A stored table (doc_id, source, size, h, g): what planning has to know of a document."""
    first, second = words_of_hash(F.col(id_col))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"),
        size_in_words(F.col(text)).alias("size"), first.alias("h"), second.alias("g"),
    )
    return scratch.table(narrow, "sized")


def plan(
    sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """(source, source_size, target, rate, seed), one row per source, from a ``sized`` table.

    Both small tables are stored, so Spark knows their size and broadcasts them only below the
    session's own limit.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = scratch.table(targets(sums, weights, share, most), "targets")
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    takes = [
        F.sum(F.col("size") * _copies(F.col("rate"), F.col("h"), F.col("g"), F.lit(k))).alias(f"k{k}")
        for k in range(SEEDS)
    ]
    drawn = sizes.alias("s").join(aims.alias("t"), same)
    taken = drawn.groupBy("t.source", "t.source_size", "t.target", "t.rate").agg(*takes)
    best = F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"k{k}") - F.col("target")).alias("miss"), F.lit(k).alias("seed"))
        for k in range(SEEDS)
    ]))
    columns = ["source", "source_size", "target", "rate"]
    return scratch.table(taken.select(*columns, best["seed"].alias("seed")), "plan")


def mix(
    docs: DataFrame, plan_: DataFrame, id_col: str = "doc_id", source: str = "source"
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan says."""
    fits = F.col(f"d.{source}").eqNullSafe(F.col("p.source"))
    first, second = words_of_hash(F.col(f"d.{id_col}"))
    copies = _copies(F.col("p.rate"), first, second, F.col("p.seed")).cast("int")
    turns = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    emitted = (
        docs.select(id_col, source, whole).alias("d").join(plan_.alias("p"), fits)
        .select("d._row", turns.alias("_turn"))
    )
    return emitted.select("_row.*")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Plan and mix in one step: the rows of ``docs``, repeated."""
    scratch = Scratch(docs.sparkSession, "mix")
    return mix(docs, plan(sized(docs, scratch), scratch, **options))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = sized(docs, scratch)
    made = plan(sizes, scratch, **options)
    same = F.col("s.source").eqNullSafe(F.col("p.source"))
    copies = _copies(F.col("p.rate"), F.col("s.h"), F.col("s.g"), F.col("p.seed"))
    return sizes.alias("s").join(made.alias("p"), same).select(
        "s.doc_id", "s.size", "p.source_size", "p.target", (F.col("s.size") * copies).alias("taken")
    )
