"""Operator 9, benchmark decontamination by template canonicalisation.

Words are canonicalised: numbers, units and names (capitalised words inside a sentence) become
typed placeholders, other words lose case and outer punctuation. Windows of ``words`` canonical
words are the templates. Windows of the benchmark are joined by hash with those of the
documents; a fixed-size Bloom filter of the benchmark's hashes, pushed into the scan of the
documents, drops the windows that cannot match. Matches of a document and an item are gathered
per diagonal (position in the document less position in the item). There the placeholders'
values must agree one to one: what stands for a value of the item must be the same throughout,
and stand for no other. So a question with other numbers and names is caught, while texts that
only share a frame with conflicting fillers are not.

A window with fewer than half of its words literal says too little as a template: it keeps its
words, and matches only the same ones. So does an item with fewer words than a window, which is
one window of its own length, wherever it stands in a document.

A document is contaminated by an item if, on one diagonal with consistent slots, matching
windows cover ``least_words`` words of the item, or all but one of an item with fewer, or all of
an item shorter than a window. Matches of items below ``least_item`` words are reported, but do
not contaminate: any text may hold so few words.

Defined results: a null or empty text matches nothing; rows without an id are not matched;
repeated rows and items count once; an empty table on either side gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_lookup
from .common import BROADCAST_BYTES, Scratch, only_cache, rows_without
from .minhash import _batches, _mix

#: Words of a template window, and words that a match has to cover.
WORDS, LEAST_WORDS = 8, 13
#: Items of fewer words contaminate nothing.
LEAST_ITEM = 4
#: The Bloom filter has 2^23 bits, one megabyte, whatever the benchmark.
_BITS = 23
_VOCABULARY = 200_000
_LITERAL, _NUMBER, _UNIT, _NAME, _BOTH = range(5)
_EDGE = "\"'`.,;:!?()[]{}<>«»“”„‘’¡¿…*#&%$|_~"
_NUMERIC = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|e[+-]?\d+)?%?")
_MEASURE = re.compile(r"([+-]?\d[\d.,]*)([a-zµ°²³/]+)")
#: Units of measure and money that become a placeholder. Fixed values.
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz "
    "ounce ounces gram grams kilogram kilograms ton tons ml cl dl l liter liters litre litres "
    "gallon gallons pint pints cup cups s sec second seconds min minute minutes h hr hrs hour "
    "hours day days week weeks month months year years meter meters metre metres centimeter "
    "centimeters kilometer kilometers kilometre kilometres mph kmh km/h m/s hz khz mhz ghz w kw "
    "kwh j kj cal kcal v a ma pa kpa bar k °c °f degrees percent dollar dollars cent cents euro "
    "euros pound pounds usd eur gbp kb mb gb tb".split()
)


class _Words(dict):
    """A number for each word, with what is known of the word by that number."""

    def __init__(self):
        super().__init__()
        self.kinds, self.texts, self.ends = [], [], []
        self.kept = (np.empty(0, np.uint8), np.empty(0, np.uint64), np.empty(0, bool))

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGE)
        low = bare.lower()
        measure = _MEASURE.fullmatch(low)
        if _NUMERIC.fullmatch(bare):
            kind = _NUMBER
        elif low in UNITS:
            kind = _UNIT
        elif measure and measure[2] in UNITS:
            kind = _BOTH
        elif bare[:1].isupper() and bare[1:2].islower() and bare.replace("-", "").isalpha():
            kind = _NAME
        else:
            kind = _LITERAL
        self.kinds.append(kind)
        self.texts.append(low)
        self.ends.append(word.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":"))
        number = self[word] = len(self)
        return number

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds, hashes of the literal forms, and whether the word ends a sentence."""
        if self.texts:
            more = (
                np.array(self.kinds, np.uint8),
                pd.util.hash_array(np.array(self.texts, object)), np.array(self.ends, bool),
            )
            self.kept = tuple(map(np.concatenate, zip(self.kept, more, strict=True)))
            self.kinds, self.texts, self.ends = [], [], []
        return self.kept


@lru_cache(maxsize=1)
def _vocabulary() -> list[_Words]:
    return [_Words()]


class Canonical(NamedTuple):
    """The canonical words of texts, one text after the other."""

    #: Hash of the template's word: of the placeholder at a slot, of the word elsewhere.
    template: np.ndarray
    #: Hash of the word itself.
    plain: np.ndarray
    #: Whether the word is a slot here, and whether it is one inside a sentence.
    slot: np.ndarray
    free: np.ndarray

    def part(self, own: slice) -> Canonical:
        return Canonical(*[values[own] for values in self])


def canonical(texts: list[list[str]]) -> Canonical:
    only_cache("words", _vocabulary.cache_clear)
    holder = _vocabulary()
    if len(holder[0]) > _VOCABULARY:
        holder[0] = _Words()
    known, sizes = holder[0], np.array([len(words) for words in texts], np.int64)
    every = itertools.chain.from_iterable(texts)
    numbers = np.fromiter(map(known.__getitem__, every), np.int64, int(sizes.sum()))
    kinds, hashes, ends = known.arrays()
    kind, plain = kinds[numbers], hashes[numbers]
    free = kind != _LITERAL
    opens = np.ones(len(numbers), bool)
    opens[1:] = ends[numbers[:-1]]
    opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    kind = np.where((kind == _NAME) & opens, _LITERAL, kind)
    slot = kind != _LITERAL
    return Canonical(np.where(slot, _mix(kind.astype(np.uint64)), plain), plain, slot, free)


def _factors(size: int) -> np.ndarray:
    return _mix(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)


def _verbatim(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each place, their number included."""
    total = np.full(len(at), size, np.uint64)
    for i, factor in enumerate(_factors(size)):
        total += words[at + i] * factor
    return _mix(total ^ _mix(np.full(1, size, np.uint64))).view(np.int64)


def windows(words: Canonical, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, keeps its words) of the window from each place of one text that one fits in."""
    n = len(words.slot) - size + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, bool)
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(_factors(size)):
        total += words.template[i : i + n] * factor
    hashed = _mix(total).view(np.int64)
    slots = np.concatenate([[0], np.cumsum(words.slot)])
    kept = 2 * (slots[size:] - slots[:-size]) > size
    dense = np.flatnonzero(kept)
    if len(dense):
        hashed[dense] = _verbatim(words.plain, dense, size)
    return hashed, kept


def whole(words: Canonical, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, hash) of each different run of ``size`` words of one text."""
    n = len(words.plain) - size + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashed, first = np.unique(_verbatim(words.plain, np.arange(n), size), return_index=True)
    return first, hashed


def _rows(
    df: DataFrame, id_col: str, text: str, size: int, lengths: list[int] | None, bloom: np.ndarray | None
) -> DataFrame:
    """(id, words, pos, h, slots) of each window that the filter, if any, lets pass.

    ``slots`` are the values at the window's placeholders as ``position in window:value``. Runs
    of each of ``lengths`` words are windows, too; if it is None, a text shorter than a window
    is one as a whole.
    """
    wanted = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")
    )
    columns = ["id", "words", "pos", "h", "slots"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]

    def passing(h: np.ndarray) -> np.ndarray:
        if bloom is None or not len(h):
            return np.arange(len(h))
        bit = h.view(np.uint64) >> np.uint64(64 - _BITS)
        mask = np.uint64(1) << (bit & np.uint64(63))
        return np.flatnonzero(bloom[bit >> np.uint64(6)] & mask)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in _batches(batch.column(1)):
                found, split, end = [], [(t or "").split() for t in texts], 0
                every = canonical(split)
                for doc_id, words in zip(ids[start : start + len(split)], split, strict=True):
                    own = every.part(slice(end, end := end + len(words)))
                    h, kept = windows(own, size)
                    at = passing(h)
                    for p, x, k in zip(at.tolist(), h[at].tolist(), kept[at].tolist(), strict=True):
                        slots = (own.free if k else own.slot)[p : p + size]
                        values = [f"{i}:{words[p + i].strip(_EDGE).lower()}" for i in np.flatnonzero(slots)]
                        found.append((doc_id, len(words), p, x, values))
                    short = lengths if lengths is not None else [len(words)] if 0 < len(words) < size else []
                    for length in short:
                        first, h = whole(own, length)
                        at = passing(h)
                        for p, x in zip(first[at].tolist(), h[at].tolist(), strict=True):
                            found.append((doc_id, len(words), p, x, []))
                parts = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], columns
                )

    return wanted.mapInArrow(scan, "id long, words long, pos long, h long, slots array<string>")


def _bloom(items: DataFrame) -> np.ndarray:
    """The filter of all hashes in the stored table ``items``, or-ed together by Spark."""
    bit = F.shiftrightunsigned("h", 64 - _BITS)
    word = F.shiftright(bit, 6).alias("word")
    mask = F.expr("shiftleft(1L, cast(b as int))")
    found = items.select(word, (bit % 64).alias("b")).groupBy("word").agg(F.bit_or(mask).alias("bits"))
    out = np.zeros(1 << (_BITS - 6), np.uint64)
    for row in found.collect():  # at most 2^17 rows
        out[row["word"]] = np.int64(row["bits"]).astype(np.uint64)
    return out


def matches(
    docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least_words: int = LEAST_WORDS,
    id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
    least_item: int = LEAST_ITEM, broadcast_bytes: int = BROADCAST_BYTES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, item_id, words_matched, item_words, consistent, contaminated of the best diagonal.

    One row per document and item that share a window. The benchmark's windows are broadcast up
    to ``broadcast_bytes``, measured; beyond that, windows that many documents hold are salted.
    The result reads tables in ``scratch``, a new folder unless given.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    items = scratch.table(_rows(benchmark, item_col, item_text, words, None, None).distinct(), "items")
    short = items.where(F.col("words") < words).select("words").distinct().orderBy("words").collect()
    lengths = [row["words"] for row in short]  # fewer than ``words``
    seen = scratch.table(_rows(docs, id_col, text, words, lengths, _bloom(items)), "windows")
    theirs = items.select(
        "h", F.col("id").alias("item_id"), F.col("words").alias("item_words"),
        F.col("pos").alias("at"), F.col("slots").alias("there"),
    )
    ours = seen.select("h", F.col("id").alias("doc_id"), "pos", F.col("slots").alias("here"))
    joined = join_lookup(ours, theirs, ["h"], how="inner", limit=broadcast_bytes).select(
        "doc_id", "item_id", "item_words", (F.col("pos") - F.col("at")).alias("shift"),
        F.col("at").alias("pos"), "here", "there",
    )
    pair = F.zip_with("there", "here", lambda i, d: F.struct(
        F.regexp_replace(i, r"^\d+:", "").alias("i"), F.regexp_replace(d, r"^\d+:", "").alias("d")
    ))
    # Positions and slots of a diagonal are as many as the words of one item.
    lines = joined.groupBy("doc_id", "item_id", "shift").agg(
        F.first("item_words").alias("item_words"), F.array_sort(F.collect_set("pos")).alias("at"),
        F.array_distinct(F.flatten(F.collect_set(pair))).alias("fills"),
    )

    def sides(name: str):
        return F.size(F.array_distinct(F.transform("fills", lambda s: s[name])))

    consistent = (sides("i") == F.size("fills")) & (sides("d") == F.size("fills"))
    start = F.struct(F.lit(-words).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("at", start, lambda s, p: F.struct(
        p.alias("last"), (s["n"] + F.least(F.lit(words).cast("long"), p - s["last"])).alias("n")
    ))["n"]
    covered = F.least(covered, "item_words")
    length = F.lit(words).cast("long")
    enough = F.least(F.lit(least_words).cast("long"), F.greatest(F.col("item_words") - 1, length))
    enough = F.when(F.col("item_words") < words, F.col("item_words")).otherwise(enough)
    lines = lines.select(
        "doc_id", "item_id", "item_words", covered.alias("words_matched"), consistent.alias("consistent")
    )
    reached = (F.col("words_matched") >= enough) & (F.col("item_words") >= least_item)
    lines = lines.withColumn("contaminated", F.col("consistent") & reached)
    order = F.struct("contaminated", "consistent", "words_matched", "item_words")
    best = lines.groupBy("doc_id", "item_id").agg(F.max(order).alias("best"))
    return best.select(
        "doc_id", "item_id", "best.words_matched", "best.item_words", "best.consistent", "best.contaminated"
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options
) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, all columns."""
    scratch, working = (Scratch(docs.sparkSession, name) for name in ("leaks", "decontamination"))
    leaks = matches(docs, benchmark, id_col=id_col, scratch=working, **options).where("contaminated")
    gone = scratch.table(leaks.select(F.col("doc_id").alias(id_col)).distinct(), "ids")
    working.drop()
    return rows_without(docs, gone, id_col).select(*[F.col(f"`{c}`") for c in docs.columns])
