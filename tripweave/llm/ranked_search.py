"""Operator 11, ranked lexical search: pipelined term partitioning.

The terms that items ask for are dealt to owners, rare terms to the first, so that each owner
has about as many postings. Documents are read once and become blocks with the postings of those
terms. Items travel in bundles: the bundle of a block holds a sparse accumulator, the documents of
the block that may still be among the best of an item with their scores so far, and meets the
postings of one owner after another by cogroup on (block, bundle). Each owner adds its integer
contributions; after the last one the best of each block, then those of all blocks, are taken.

Accumulators that cannot be among the ``k`` best are left out, exactly: after each owner the
k-th best score so far of an item is known (best of each block, then of all), and no later
owner can add more than the largest contributions of its terms. A document that is left out and
met again later has less than its true score, which is below that bound anyway.

A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's length factor
m = 100 - b + (b n N) div L, a score the sum of weight * ((10^9 tf) div (1000 tf + 8 m)) over the
item's terms, repeats included, all in 64-bit integers but for the logarithm.

Defined results: terms are the runs of characters other than ASCII signs, blanks and controls,
with A-Z lower-cased; a null or empty text has no terms; rows of items that share an id are one
item with the terms of their different texts, a null id is an item, too; every row of documents
is a document, repeated or not, null ids come after all others of the score; items without a
document above 0 have no rows, and so has an empty table on either side; columns other than id
and text are never read, their names may be any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, running_totals

#: Documents of a block at most (their places are 16-bit numbers), and words it is closed at.
BLOCK_DOCS, BLOCK_WORDS = 4096, 1 << 20
#: Items of a bundle.
BUNDLE = 256
#: Distinct terms of the items that one pass over the documents serves; more items take more
#: passes.
PASS_TERMS = 500_000

#: Letters and digits, lower-cased, and all bytes of other characters; the rest parts terms.
_FOLD = bytes(
    b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)
POSTINGS = (
    "block long, n_docs int, with_terms long, n_terms long, terms array<int>, df array<int>, "
    "sizes binary, ids binary, no_id binary, docs binary, tf binary"
)
OWNED = (
    "block long, owner int, terms array<int>, df array<int>, most array<int>, n_docs int, "
    "ids binary, no_id binary, docs binary, parts binary"
)
BUNDLES = (
    "block long, bundle int, items binary, docs binary, scores binary, "
    "best array<struct<item:int,score:long,doc_id:long>>"
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def item_terms(items: DataFrame, scratch: Scratch, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Tables (item, item_id, pass) and (item, term, times); ``item`` numbers the items."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column(0), batch.column(1), strict=True):
                words = terms_of(value.as_py())
                if words:
                    found = pa.array(words, pa.binary()).value_counts()
                    own = pa.array([item.as_py()] * len(found), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [own, found.field(0).cast(pa.string()), found.field(1)], ["item_id", "term", "times"]
                    )

    asked = rows.mapInArrow(split, "item_id long, term string, times long")
    asked = asked.groupBy("item_id", "term").agg(F.sum("times").alias("times"))
    asked = scratch.table(asked, "asked")
    numbered = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    numbered = scratch.table(numbered.withColumn("item", F.monotonically_increasing_id()), "numbered")
    passes = running_totals(numbered, "item", {"n": "before"}).select(
        "item", "item_id", F.expr(f"before div {PASS_TERMS}").cast("int").alias("pass")
    )
    known = scratch.table(passes, "items")
    asked = asked.join(known.withColumnRenamed("item_id", "_id"), F.col("item_id").eqNullSafe(F.col("_id")))
    return known, scratch.table(asked.select("pass", "item", "term", "times"), "needs")


def postings(docs: DataFrame, vocabulary: list[str], id_col: str, text: str) -> DataFrame:
    """Blocks of documents with the postings of the terms of ``vocabulary``, ordered by term."""
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    known, n_terms = pa.array([t.encode() for t in vocabulary], pa.binary()), len(vocabulary)

    def block_of(number: int, ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
        found = pc.index_in(words.dictionary, value_set=known).fill_null(-1).to_numpy()
        term = found[words.indices.to_numpy()] if len(words) else np.empty(0, np.int32)
        doc = np.repeat(np.arange(len(texts)), sizes)[term >= 0]
        pairs, tf = np.unique(term[term >= 0].astype(np.int64) * len(texts) + doc, return_counts=True)
        terms, df = np.unique(pairs // len(texts), return_counts=True)
        row = {
            "block": number, "n_docs": len(ids), "with_terms": int((sizes > 0).sum()),
            "n_terms": int(sizes.sum()), "terms": terms.tolist(), "df": df.tolist(),
            "sizes": sizes.tobytes(), "ids": np.array([x or 0 for x in ids], np.int64).tobytes(),
            "no_id": np.array([x is None for x in ids], np.uint8).tobytes(),
            "docs": (pairs % len(texts)).astype("<u2").tobytes(), "tf": tf.astype("<u4").tobytes(),
        }
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *2 * [pa.list_(pa.int32())], *5 * [pa.binary()]]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], kind) for v, kind in zip(row.values(), kinds, strict=True)], list(row)
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(terms_of(value.as_py()))
                size += len(texts[-1])
                if len(ids) == BLOCK_DOCS or size >= BLOCK_WORDS:
                    yield block_of(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield block_of(number, ids, texts)

    assert n_terms < 1 << 31
    return wanted.mapInArrow(build, POSTINGS)


class _Plan:
    """What all owners know: weights, owners and largest contributions of terms, items' needs."""

    def __init__(self, needs: list, n: int, total: int, df: np.ndarray, owners: int, b: int):
        self.n, self.total, self.b, self.owners = n, total, b, owners
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64
        )
        order = np.argsort(df, kind="stable")
        filled = np.cumsum(df[order])
        self.owner = np.empty(len(df), np.int32)
        self.owner[order] = np.minimum(owners - 1, (filled - 1).clip(0) * owners // max(int(filled[-1]), 1))
        #: Rows (item, term, times), by item.
        self.needs = np.array(needs, np.int64).reshape(-1, 3)
        self.items = int(self.needs[:, 0].max(initial=-1)) + 1

    def later(self, most: np.ndarray) -> np.ndarray:
        """[owner, item]: the most that owners after this one can add to a score."""
        item, term, times = self.needs.T
        out = np.zeros((self.owners, self.items), np.int64)
        for k in range(self.owners):
            after = self.owner[term] > k
            np.add.at(out[k], item[after], (times * self.weight[term] * most[term])[after])
        return out


def owned(blocks: DataFrame, plan: _Plan) -> DataFrame:
    """The postings of each block by owner, as (10^9 tf) div (1000 tf + 8 m)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int64)
                m = 100 - plan.b + (plan.b * sizes * plan.n) // plan.total
                terms, df = np.array(row["terms"], np.int64), np.array(row["df"], np.int64)
                docs = np.frombuffer(row["docs"], "<u2")
                tf = np.frombuffer(row["tf"], "<u4").astype(np.int64)
                parts = (10**9 * tf) // (1000 * tf + 8 * m[docs])
                most = np.maximum.reduceat(parts, np.cumsum(df) - df) if len(df) else parts
                owner = plan.owner[terms]
                of_posting = np.repeat(owner, df)
                out = []
                for k in range(plan.owners):
                    own, mine, last = owner == k, of_posting == k, k == plan.owners - 1
                    out.append({
                        "block": row["block"], "owner": k, "terms": terms[own].tolist(),
                        "df": df[own].tolist(), "most": most[own].tolist(), "n_docs": row["n_docs"],
                        "ids": row["ids"] if last else b"", "no_id": row["no_id"] if last else b"",
                        "docs": docs[mine].tobytes(), "parts": parts[mine].astype("<i4").tobytes(),
                    })
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_pylist(out, pa.schema([
                    ("block", pa.int64()), ("owner", pa.int32()), ("terms", lists), ("df", lists),
                    ("most", lists), ("n_docs", pa.int32()), ("ids", pa.binary()),
                    ("no_id", pa.binary()), ("docs", pa.binary()), ("parts", pa.binary()),
                ]))

    return blocks.mapInArrow(deal, OWNED)


def _visit(plan: _Plan, k: int, best: int, floor: np.ndarray, later: np.ndarray):
    """The function of owner ``k``: a bundle and the postings of a block give the bundle."""
    last = k == plan.owners - 1

    def visit(bundles: pa.Table, lists: pa.Table) -> pa.Table:
        bundle, posted = bundles.to_pylist()[0], lists.to_pylist()[0]
        first = bundle["bundle"] * BUNDLE
        rows, n_docs = min(BUNDLE, plan.items - first), posted["n_docs"]
        scores = np.zeros((rows, n_docs), np.int64)
        held = np.frombuffer(bundle["items"], "<u2"), np.frombuffer(bundle["docs"], "<u2")
        scores[held] = np.frombuffer(bundle["scores"], np.int64)

        terms = np.array(posted["terms"], np.int64)
        ends = np.cumsum(posted["df"]) if len(terms) else np.empty(0, np.int64)
        docs = np.frombuffer(posted["docs"], "<u2")
        parts = np.frombuffer(posted["parts"], "<i4").astype(np.int64)
        lo, hi = np.searchsorted(plan.needs[:, 0], [first, first + rows])
        needs = plan.needs[lo:hi]
        needs = needs[plan.owner[needs[:, 1]] == k]
        place = np.searchsorted(terms, needs[:, 1])
        there = place < len(terms)
        there[there] = terms[place[there]] == needs[there, 1]
        for (item, term, times), at in zip(needs[there].tolist(), place[there].tolist(), strict=True):
            some = slice(ends[at - 1] if at else 0, ends[at])
            scores[item - first, docs[some]] += times * int(plan.weight[term]) * parts[some]

        bound = np.maximum(floor[first : first + rows], 1)
        if n_docs >= best:
            bound = np.maximum(bound, np.partition(scores, n_docs - best, 1)[:, n_docs - best])
        alive = (scores > 0) & (scores + later[k, first : first + rows, None] >= bound[:, None])
        item, doc = np.nonzero(alive)
        kept = scores[item, doc]
        if last:
            ids = np.frombuffer(posted["ids"], np.int64)
            none = np.frombuffer(posted["no_id"], np.uint8)
            order = np.lexsort((ids[doc], none[doc], -kept, item))
        else:
            order = np.lexsort((-kept, item))
        by = item[order]
        inside = np.arange(len(by)) - np.searchsorted(by, by)
        order = order[inside < best]
        tops = [
            {
                "item": int(item[x]) + first, "score": int(kept[x]),
                "doc_id": int(ids[doc[x]]) if last and not none[doc[x]] else None,
            }
            for x in order.tolist()
        ]
        kind = pa.list_(pa.struct([("item", pa.int32()), ("score", pa.int64()), ("doc_id", pa.int64())]))
        sent = (b"", b"", b"") if last else (
            item.astype("<u2").tobytes(), doc.astype("<u2").tobytes(), kept.tobytes()
        )
        return pa.table({
            "block": pa.array([bundle["block"]], pa.int64()),
            "bundle": pa.array([bundle["bundle"]], pa.int32()),
            "items": pa.array([sent[0]], pa.binary()), "docs": pa.array([sent[1]], pa.binary()),
            "scores": pa.array([sent[2]], pa.binary()), "best": pa.array([tops], kind),
        })

    return visit


def _best(bundles: DataFrame, k: int) -> DataFrame:
    """The k best rows (item, rank, doc_id, score) of each item over all blocks."""
    rows = bundles.select("block", F.inline("best"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pass(docs: DataFrame, needs: DataFrame, scratch: Scratch, name: str, k: int, owners: int, b: int, id_col: str, text: str) -> DataFrame | None:
    """(item, rank, doc_id, score) for the items of ``needs``; null if no document has a term."""
    rows = needs.select("item", "term", "times").collect()
    items, terms = sorted({r["item"] for r in rows}), sorted({r["term"] for r in rows})
    item_at, term_at = {x: i for i, x in enumerate(items)}, {x: i for i, x in enumerate(terms)}
    blocks = scratch.table(postings(docs, terms, id_col, text), f"{name}-postings")
    n, total = blocks.agg(F.sum("with_terms"), F.sum("n_terms")).first()
    if not n:
        return None

    def of_terms(table: DataFrame, value: str, how) -> np.ndarray:
        each = table.select(F.explode(F.arrays_zip("terms", value)).alias("t"))
        out = np.zeros(len(terms), np.int64)
        for term, x in each.groupBy("t.terms").agg(how(f"t.{value}")).collect():
            out[term] = x
        return out

    local = sorted((item_at[r["item"]], term_at[r["term"]], r["times"]) for r in rows)
    plan = _Plan(local, n, total, of_terms(blocks, "df", F.sum), owners, b)
    lists = owned(blocks, plan)
    lists.write.partitionBy("owner").parquet(scratch.path(f"{name}-owned"))
    lists = scratch.spark.read.schema(OWNED).parquet(scratch.path(f"{name}-owned"))
    scratch.drop(f"{name}-postings")
    later = plan.later(of_terms(lists, "most", F.max))

    bundles = F.explode(F.sequence(F.lit(0), F.lit((plan.items - 1) // BUNDLE))).alias("bundle")
    empty = F.lit(b"")
    now = lists.where("owner = 0").select(
        "block", bundles, empty.alias("items"), empty.alias("docs"), empty.alias("scores"),
        F.lit(None).cast("array<struct<item:int,score:long,doc_id:long>>").alias("best"),
    )
    floor = np.zeros(plan.items, np.int64)
    for owner in range(owners):
        own = lists.where(F.col("owner") == owner).select("*", bundles)
        key = ["block", "bundle"]
        met = now.groupBy(*key).cogroup(own.groupBy(*key)).applyInArrow(
            _visit(plan, owner, k, floor, later), BUNDLES
        )
        now = scratch.table(met, f"{name}-bundles-{owner}")
        if owner:
            scratch.drop(f"{name}-bundles-{owner - 1}")
        if owner < owners - 1:
            for item, score in _best(now, k).where(F.col("rank") == k).select("item", "score").collect():
                floor[item] = score
    numbers = scratch.spark.createDataFrame(list(enumerate(items)), "item int, number long")
    found = _best(now, k).join(numbers, "item").select(F.col("number").alias("item"), "rank", "doc_id", "score")
    return scratch.table(found, f"{name}-found")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, owners: int = 4, b: int = 75,
    id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item.

    ``b`` is the weight of a document's length, in hundredths.
    """
    scratch = Scratch(docs.sparkSession, "search")
    known, needs = item_terms(items, scratch, item_col, item_text)
    passes = known.agg(F.max("pass")).first()[0]
    found = []
    for p in range(0 if passes is None else passes + 1):
        one = _pass(docs, needs.where(F.col("pass") == p), scratch, f"pass-{p}", k, owners, b, id_col, text)
        found += [] if one is None else [one]
    if not found:
        return scratch.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole.join(known, "item").select("item_id", "rank", "doc_id", "score")
