"""Operator 10, MinHash near-duplicates with tensored banding.

A document's set is its distinct word shingles. Instead of one band of minhashes per table, two
small collections of ``m`` half bands of ``r`` minhashes are made, and every pair of a half band
of the first and one of the second is the key of a table: 2 m r minhashes give m x m tables of
bands of 2 r, where plain banding would need 2 m m r. A pair of similarity s meets with
probability (1 - (1 - s^r)^m)^2.

Documents with equal sets are one class, numbered. Only half bands of the first collection that
two classes share are combined with those of the second. Candidates are verified on the full sets:

1. each class against the least class that it meets; a hub and its partners are dealt to groups
   of about ``BLOCK`` shingles, the hub's text goes to each group once;
2. in the buckets where components are still apart, round after round: the members outside the
   bucket's largest component are its pivots, as many as a group holds. The bucket is dealt to
   parts, each part gets all pivots of the round and compares them with its members, those that
   agree in most minhashes first; a pair is skipped once its components are linked. Pivots then
   leave the bucket, for they have met everyone in it.

A bucket grows by its pivots in each further part, so the rows of a round grow with its size, not
with the square of it; what is left after a round is what stays outside the largest component.
A pair counts in the first bucket that it shares, and buckets with the same classes are looked at
once. So every pair that meets in a table and whose sizes allow the similarity is verified on the
full sets, unless it is connected anyway. Components come from distributed alternating stars.

Defined results: words are the runs of characters other than the six ASCII white-space
characters, with A-Z lower-cased; fewer words than a shingle are one shingle of their own; a null
or empty text, or one of white space, has no shingles and links with nothing; rows with a null
id link with nothing and are kept; rows that share an id but not the text are documents of their
own, each with its own component; an empty table gives an empty result; other columns are never
read, their names may be any.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, connected_components, rows_of

#: Shingles of the documents that are compared in one call, by expectation.
BLOCK = 1 << 18
#: Words of text that are hashed at once.
WORDS = 1 << 18
#: A class in a part of a bucket, of table t.
PLACE = ["key", "part", "t", "pivot", "id", "component"]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the k-word shingles of each text."""
    words = [t.encode().lower().split() if t else [] for t in texts]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    hashed = pd.util.hash_array(flat) if len(flat) else np.empty(0, np.uint64)
    odd = _mix(np.arange(1, k + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    sets, at = [], 0
    for ws in words:
        h, at = hashed[at : at + len(ws)], at + len(ws)
        n = len(h) - k + 1
        if n < 1:
            short = np.sum(h * odd[: len(h)], dtype=np.uint64, keepdims=True) + _MIX * np.full(1, len(h), np.uint64)
            sets.append(_mix(short) if len(h) else h)
            continue
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += h[i : i + n] * odd[i]
        sets.append(np.unique(_mix(total)))
    return sets


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, row, text): ``row``, a hash of the whole text, tells rows of one id apart."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"),
        F.col(text).alias("text"),
    )


def _batches(values: pa.Array, size: int = WORDS * 6) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a column of texts of about ``size`` characters, with their first row."""
    start, held, chars = 0, [], 0
    for value in values:
        text = value.as_py()
        held.append(text)
        chars += len(text or "")
        if chars >= size:
            yield start, held
            start, held, chars = start + len(held), [], 0
    if held:
        yield start, held


def signatures(
    docs: DataFrame, k: int, m: int, r: int, seed: int = 11, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, row, n (size of the set), s1, s2 (its hash), a, b (half bands), sketch (minhashes)."""
    wanted = _rows(docs, id_col, text)
    rng = np.random.default_rng(seed)
    salt = rng.integers(1, 1 << 63, 2 * m * r, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(0, 1 << 63, 2 * m * r, dtype=np.uint64)
    band = rng.integers(1, 1 << 63, (2 * m, r), dtype=np.uint64) | np.uint64(1)
    schema = (
        "doc_id long, row long, n long, s1 long, s2 long, a array<long>, b array<long>, sketch binary"
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _batches(batch.column(2)):
                sets = shingle_sets(texts, k)
                n = np.array([len(s) for s in sets])
                s1 = [int(np.sum(s, dtype=np.uint64).astype(np.int64)) for s in sets]
                s2 = [int(np.bitwise_xor.reduce(_mix(s + _MIX)).astype(np.int64)) if len(s) else 0 for s in sets]
                full = np.flatnonzero(n)
                low = np.zeros((len(sets), 2 * m * r), np.uint64)
                if len(full):
                    joined = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for q in range(2 * m * r):
                        low[full, q] = np.minimum.reduceat(joined * salt[q] + shift[q], starts)
                keys = _mix((low.reshape(-1, 2 * m, r) * band).sum(2, dtype=np.uint64)).view(np.int64)
                sketch = (_mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(sets)), batch.column(1).slice(start, len(sets)),
                        pa.array(n, pa.int64()),
                        pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                        pa.array(list(keys[:, :m]), lists), pa.array(list(keys[:, m:]), lists),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    ["doc_id", "row", "n", "s1", "s2", "a", "b", "sketch"],
                )

    return wanted.mapInArrow(sign, schema)


def buckets(classes: DataFrame, m: int, scratch: Scratch) -> DataFrame:
    """(key, t, id, n, hub): keys of table t that two classes or more share, with their classes.

    Keys are first counted by the half bands of the first collection: a class goes on only with
    those that it shares, and only these are combined with the second collection.
    """
    first = classes.select("id", "n", "b", F.posexplode("a").alias("i", "half"))
    shared = first.groupBy("i", "half").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = shared.where("lo < hi").select("i", "half")
    going = scratch.table(first.join(shared, ["i", "half"]), "half-bands")
    rows = going.select("id", "n", "i", "half", F.posexplode("b").alias("j", "other"))
    table = (F.col("i") * m + F.col("j")).alias("t")
    rows = rows.select("id", "n", table, F.xxhash64("i", "half", "j", "other").alias("key"))
    live = rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("hi"))
    live = live.where("hub < hi").select("key", "hub")
    return scratch.table(rows.join(live, "key"), "buckets")


def _spread(places: DataFrame, wide: DataFrame) -> DataFrame:
    """``places`` with the columns that ``wide`` has for their id.

    The places of a class are listed before the join, so a wide row is joined once and not once
    for each bucket of its class.
    """
    each = [c for c in places.columns if c != "id"]
    lists = places.groupBy("id").agg(F.collect_list(F.struct(*each)).alias("places"))
    return lists.join(wide, "id").select("id", *[c for c in wide.columns if c != "id"], F.inline("places"))


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, text) of the classes in the stored table ``ids``: the text of their least row."""
    of = scratch.table(rows_of(classes, ids, "id").select("id", "doc_id", "row"), f"{name}-rows")
    small = of.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(of) if small else of, ["doc_id", "row"]).select("id", "text")
    return scratch.table(found.dropDuplicates(["id"]), f"{name}-texts")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch, name: str, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets, of the whole texts, are similar enough.

    Only texts of classes that occur in a pair are moved; that of ``a`` once for each group of
    its partners.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = _texts(docs, classes, scratch.table(ids, f"{name}-ids"), scratch, name)
    parts = F.ceil(F.sum("nb") / block).cast("int").alias("parts")
    hubs = scratch.table(pairs.groupBy("a").agg(parts), f"{name}-hubs")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    others = pairs.join(hubs, "a").select("a", part, F.col("b").alias("id")).join(texts, "id")
    own = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = own.join(texts.select(F.col("id").alias("a"), F.col("text").alias("hub_text")), "a")

    def check(hub: pa.Table, members: pa.Table) -> pa.Table:
        kept: list[int] = []
        if len(hub) and len(members):
            mine = shingle_sets([hub["hub_text"][0].as_py()], k)[0]
            ids = members["id"].to_pylist()
            for start, some in _batches(members["text"]):
                good = _similar(mine, shingle_sets(some, k), percent)
                kept += [ids[start + i] for i in np.flatnonzero(good).tolist()]
        hubs = [hub["a"][0].as_py()] * len(kept)
        return pa.table({"a": pa.array(hubs, pa.int64()), "b": pa.array(kept, pa.int64())})

    key = ["a", "part"]
    links = own.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(check, "a long, b long")
    return scratch.table(links, f"{name}-links")


class _Part:
    """The members of a part of a bucket and its pivots, and the pairs that may be similar."""

    def __init__(self, table: pa.Table, percent: int, m: int):
        rows = self.rows = table.combine_chunks()
        self.percent = percent
        self.ids, self.comp, self.n = (rows[c].to_numpy() for c in ("id", "component", "n"))
        self.pivots = np.flatnonzero(rows["pivot"].to_numpy(zero_copy_only=False))
        self.i, self.j = divmod(rows["t"][0].as_py(), m)
        size = len(self.ids)
        self.sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(size, -1)
        self.a, self.b = (rows[c].combine_chunks().flatten().to_numpy().reshape(size, m) for c in ("a", "b"))

    def partners(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of other components whose sizes allow the similarity, with their agreement."""
        n, i, j = self.n, self.i, self.j
        some = np.flatnonzero(
            (self.comp != self.comp[x])
            & (100 * np.minimum(n, n[x]) >= self.percent * np.maximum(n, n[x]))
        )
        before = (self.a[some, :i] == self.a[x, :i]).any(1) | (self.b[some, :j] == self.b[x, :j]).any(1)
        some = some[~before]
        return some, (self.sketch[some] == self.sketch[x]).mean(1) if len(some) else np.empty(0)


def _with_partner(percent: int, m: int):
    def members(table: pa.Table) -> pa.Table:
        part = _Part(table, percent, m)
        wanted = np.zeros(len(part.ids), bool)
        for x in part.pivots:
            some, _ = part.partners(x)
            if len(some):
                wanted[some] = wanted[x] = True
        return part.rows.select(PLACE).filter(pa.array(wanted))

    return members


def _similar(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar enough to the set ``own``."""
    sizes = np.array([len(s) for s in others])
    if not len(own) or not sizes.all():
        return np.array([bool(len(own) and len(s)) and _similar(own, [s], percent)[0] for s in others], bool)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(own) + sizes - both)


def _linked(percent: int, m: int, k: int):
    def links(table: pa.Table) -> pa.Table:
        part = _Part(table, percent, m)
        sets: list[np.ndarray] = []
        for _, texts in _batches(part.rows["text"].combine_chunks()):
            sets += shingle_sets(texts, k)
        root = {c: c for c in part.comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x in part.pivots.tolist():
            some, agree = part.partners(x)
            some, size = some[np.argsort(-agree, kind="stable")], 1
            while len(some):
                own = top(int(part.comp[x]))
                some = np.array([y for y in some.tolist() if top(int(part.comp[y])) != own], int)
                head, some = some[:size], some[size:]
                if len(head):
                    good = _similar(sets[x], [sets[y] for y in head], percent)
                    for y in head[good].tolist():
                        if top(int(part.comp[y])) != top(int(part.comp[x])):
                            root[top(int(part.comp[y]))] = top(int(part.comp[x]))
                            out.append((int(part.ids[y]), int(part.ids[x])))
                size = 4 * size
        return pa.table({
            "a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())
        })

    return links


def _apart(placed: DataFrame, block: int) -> DataFrame:
    """Of the buckets with several components: (key, top, groups, parts).

    ``top`` is the largest component, the members outside it are dealt to ``groups``, all members
    to ``parts``. Of buckets with the same members, the one of the first table stands for all.
    """
    one, two = F.xxhash64("id"), F.xxhash64(F.lit(1), "id")
    of = placed.groupBy("key", "component").agg(
        F.count("*").alias("rows"), F.sum("n").alias("n"), F.first("t").alias("t"),
        F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"),
    )
    order = F.struct("n", "component")
    outside_n = F.sum("n") - F.max("n")
    outside = F.sum("rows") - F.max_by("rows", order)
    found = of.groupBy("key").agg(
        F.count("*").alias("components"), F.first("t").alias("t"), F.sum("rows").alias("rows"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max_by("component", order).alias("top"),
        F.least(F.ceil(outside_n / block), outside).cast("int").alias("groups"),
        F.ceil(F.sum("n") / block).cast("int").alias("parts"),
    ).where("components > 1")
    one_of = found.groupBy("rows", "x", "y").agg(F.min(F.struct("t", "key", "top", "groups", "parts")).alias("k"))
    return one_of.select("k.key", "k.top", "k.groups", "k.parts")


def _round(number: int, met: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, m: int, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """Links (a, b) found by this round's pivots, and the members that stay; null if none is apart."""
    name = f"round-{number}"
    component = F.coalesce("component", "id").alias("component")
    placed = met.join(components, "id", "left").select("key", "t", "id", "n", component)
    placed = scratch.table(placed, f"{name}-placed")
    apart = scratch.table(_apart(placed, block), f"{name}-apart")
    if apart.isEmpty():
        return None
    chosen = F.pmod(F.xxhash64("id", F.lit(number)), F.col("groups")) == 0
    dealt = placed.join(apart, "key").withColumn("pivot", (F.col("component") != F.col("top")) & chosen)
    dealt = scratch.table(dealt, f"{name}-dealt")
    own = F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    places = dealt.withColumn("part", F.explode(F.when(F.col("pivot"), every).otherwise(own)))
    narrow = _spread(places.select(*PLACE), classes.select("id", "n", "a", "b", "sketch"))
    group = ["key", "part"]
    schema = places.select(*PLACE).schema
    members = narrow.select(*PLACE, "n", "a", "b", "sketch").groupBy(*group).applyInArrow(_with_partner(percent, m), schema)
    members = scratch.table(members, f"{name}-members")
    ids = scratch.table(members.select("id").distinct(), f"{name}-ids")
    wide = _texts(docs, classes, ids, scratch, name).join(classes.select("id", "n", "a", "b", "sketch"), "id")
    found = _spread(members, wide).groupBy(*group).applyInArrow(_linked(percent, m, k), "a long, b long")
    links = scratch.table(found.distinct(), f"{name}-links")
    rest = scratch.table(dealt.where(~F.col("pivot")).select("key", "t", "id", "n"), f"{name}-rest")
    for table in ("placed", "dealt", "members", "texts"):
        scratch.drop(f"{name}-{table}")
    return links, rest


def _judged(
    docs: DataFrame, words: int, percent: int, m: int, r: int, id_col: str, text: str, block: int, scratch: Scratch
) -> DataFrame:
    """doc_id, row, n, and doc_id and row of the least document of the component as ``first``."""
    signed = scratch.table(signatures(docs, words, m, r, id_col=id_col, text=text), "signatures")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("n", "s1", "s2").agg(
        F.min(F.struct("doc_id", "row")).alias("least"), F.first("a").alias("a"), F.first("b").alias("b"),
        F.first("sketch").alias("sketch"),
    )
    classes = scratch.table(
        classes.select(F.monotonically_increasing_id().alias("id"), "n", "s1", "s2", "least.*", "a", "b", "sketch"),
        "classes",
    )
    whole = _rows(docs, id_col, text)
    met = buckets(classes, m, scratch)

    nearest = met.where("id != hub").groupBy(F.col("id").alias("b"), F.col("n").alias("nb")).agg(F.min("hub").alias("a"))
    nearest = nearest.join(classes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
    nearest = nearest.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = scratch.table(nearest.select("a", "b", "nb"), "pairs")
    links = verify(pairs, whole, classes, words, percent, scratch, "hubs", block)
    number = 0
    while True:
        components = scratch.table(connected_components(links, scratch, f"stars-{number}"), f"components-{number}")
        more = _round(number, met, components, classes, whole, words, percent, m, block, scratch)
        if more is None:
            break
        links, met, number = links.union(more[0]), more[1], number + 1

    known = classes.join(components, "id", "left").select(
        "n", "s1", "s2", F.coalesce("component", "id").alias("component"), F.struct("doc_id", "row").alias("least")
    )
    known = scratch.table(known, "known")
    firsts = known.groupBy("component").agg(F.min("least").alias("first"))
    known = known.join(firsts, "component").select("n", "s1", "s2", "first")
    return signed.select("doc_id", "row", "n", "s1", "s2").join(known, ["n", "s1", "s2"], "left").select(
        "doc_id", "row", "n", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first")
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, m: int = 10, r: int = 3,
    id_col: str = "doc_id", text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "minhash")
    judged = _judged(docs, words, percent, m, r, id_col, text, block, scratch)
    component = F.coalesce("first.doc_id", "doc_id")
    return judged.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(
    docs: DataFrame, words: int = 5, percent: int = 80, m: int = 10, r: int = 3,
    id_col: str = "doc_id", text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` without all but the least document of each group, all columns.

    Rows of the same id and text count as one document, of which one row stays; rows with a null
    id stay.
    """
    scratch, working = (Scratch(docs.sparkSession, name) for name in ("copies", "minhash"))
    judged = _judged(docs, words, percent, m, r, id_col, text, block, working)
    least = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.row") == F.col("row"))
    gone = judged.where(F.col("first").isNotNull() & ~least).select("doc_id", "row").distinct()
    gone = scratch.table(gone, "gone")
    working.drop()
    key = [f"_{uuid.uuid4().hex}" for _ in range(2)]
    marked = docs.withColumns({key[0]: F.col(f"`{id_col}`").cast("long"), key[1]: F.xxhash64(F.col(f"`{text}`"))})
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    gone = gone.toDF(*key)
    left = marked.join(F.broadcast(gone) if small else gone, key, "left_anti")
    named = marked.where(F.col(key[0]).isNotNull())
    if not named.groupBy(*key).count().where("count > 1").isEmpty():
        left = left.where(F.col(key[0]).isNotNull()).dropDuplicates(key).union(left.where(F.col(key[0]).isNull()))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
