"""Operator 13, periodic run detection on a grammar of the word ids.

The words of a batch of documents become numbers, and Re-Pair makes a grammar of them: adjacent
pairs that repeat are replaced by nonterminals, the more frequent pair first. All pairs of a
round are counted at once and replaced in the order of their counts, which are taken anew in the
next round. The sequences that are left, one for each document, are halved pair by pair into
binary nodes, so that every stretch of a document lies in a least node and crosses its boundary.

A run is looked for once for each nonterminal, at its boundary: a run of period q that crosses it
and is three periods long has three equal words q apart, the boundary's next word among them, so
one comparison of words for all periods up to a third of the node names the few that are
extended word by word. What is found goes to all places of the nonterminal in the derivations;
of the intervals of one period those inside others go, and of one interval the least period
stays. A run reaches the end of the nonterminals inside it, but not of its least node, or of the
document: there it is found at full length.

The grammar spans the documents of a batch, so what copies share is looked at once; runs never
cross documents, and no result depends on the batches.

Defined results: words are the runs of characters other than the six ASCII white-space
characters; a null or empty text has no words and no runs; every row is a document of its own,
repeated or not, whatever its id; an empty table gives an empty result; columns other than id and
text are never read, their names may be any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Words of documents that share a grammar; a longer document has one of its own.
BATCH_WORDS = 300_000
#: Pairs of a node and a period that are compared at once.
TRIALS = 1 << 20
#: Rounds of replacement end when fewer than one symbol in so many goes.
LEAST_GAIN = 256
#: Words after an anchor that are compared for all candidates at once, before single ones.
AHEAD = 16

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


class Grammar:
    """Re-Pair over several sequences: rules ``left``, ``right`` for symbols from ``base`` on.

    ``size`` counts the words of a symbol, ``first`` is one place of it in the words. ``symbols``
    and ``at`` are the sequences that are left and their places, ``of`` their sequence numbers.
    """

    def __init__(self, words: np.ndarray, of: np.ndarray):
        self.base = int(words.max(initial=-1)) + 1
        self.symbols, self.of, self.at = words.astype(np.int64), of, np.arange(len(words))
        self.left, self.right, self.size, self.first = (np.empty(0, np.int64) for _ in range(4))
        self.rounds = [0]
        while self._replace():
            pass

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Words of each symbol."""
        out = np.ones(len(symbols), np.int64)
        made = symbols >= self.base
        out[made] = self.size[symbols[made] - self.base]
        return out

    def _replace(self) -> bool:
        symbols = self.symbols
        if len(symbols) < 2:
            return False
        top = self.base + len(self.left)
        pair = symbols[:-1] * top + symbols[1:]
        pair[self.of[:-1] != self.of[1:]] = -1
        values, pair, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if values[0] == -1:
            counts[0] = 0
        counts[counts < 2] = 0
        # Pairs by their counts; equal only for the same pair.
        order = np.where(counts[pair] > 0, counts[pair] * len(values) + pair, -1)
        before, after = np.roll(order, 1), np.roll(order, -1)
        before[0] = after[-1] = -1
        # Where a pair overlaps itself (a a a), every other place counts.
        index = np.arange(len(order))
        stretch = np.maximum.accumulate(np.where(order != before, index, 0))
        picked = np.flatnonzero(
            (order >= 0) & (order >= before) & (order >= after) & ((index - stretch) % 2 == 0)
        )
        if len(picked) == 0:
            return False
        _, place, new = np.unique(pair[picked], return_index=True, return_inverse=True)
        source = picked[place]
        left, right = symbols[source], symbols[source + 1]
        size = self.sizes(left) + self.sizes(right)
        self.left, self.right = np.append(self.left, left), np.append(self.right, right)
        self.size, self.first = np.append(self.size, size), np.append(self.first, self.at[source])
        self.rounds.append(len(self.left))
        symbols = symbols.copy()
        symbols[picked] = top + new
        keep = np.ones(len(symbols), bool)
        keep[picked + 1] = False
        self.symbols, self.at, self.of = symbols[keep], self.at[keep], self.of[keep]
        return len(picked) * LEAST_GAIN >= len(symbols)

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, boundary, end) of the binary nodes over the sequences that are left."""
        start, of = self.at, self.of
        end = start + self.sizes(self.symbols)
        made: list[tuple] = []
        while len(start):
            opens = np.ones(len(of), bool)
            opens[1:] = of[1:] != of[:-1]
            index = np.arange(len(of))
            inside = index - np.maximum.accumulate(np.where(opens, index, 0))
            second = np.flatnonzero(inside % 2 == 1)
            if len(second) == 0:
                break
            made.append((start[second - 1], start[second], end[second]))
            end = end.copy()
            end[second - 1] = end[second]
            keep = inside % 2 == 0
            start, end, of = start[keep], end[keep], of[keep]
        if not made:
            return tuple(np.empty(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rule, place): every place of the wanted rules in the derivations of the sequences."""
        holds = wanted.copy()
        for lo, hi in zip(self.rounds, self.rounds[1:], strict=False):
            for child in (self.left[lo:hi], self.right[lo:hi]):
                made = child >= self.base
                holds[lo:hi][made] |= holds[child[made] - self.base]
        rules, places = [], []
        symbols, at = self.symbols, self.at
        while True:
            some = symbols >= self.base
            rule, at = symbols[some] - self.base, at[some]
            rule, at = rule[holds[rule]], at[holds[rule]]
            if len(rule) == 0:
                break
            rules.append(rule[wanted[rule]])
            places.append(at[wanted[rule]])
            symbols = np.concatenate([self.left[rule], self.right[rule]])
            at = np.concatenate([at, at + self.sizes(self.left[rule])])
        if not rules:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rules), np.concatenate(places)


def _extended(words: np.ndarray, lo: int, hi: int, a: int, q: int) -> tuple[int, int]:
    """The stretch around a, a + q inside lo..hi in which words q apart are equal."""
    start, step = a, 64
    while start > lo:
        to = max(lo, start - step)
        odd = np.flatnonzero(words[to:start] != words[to + q : start + q])
        if len(odd):
            start = to + int(odd[-1]) + 1
            break
        start, step = to, 4 * step
    end, step = a + q + 1, 64
    while end < hi:
        to = min(hi, end + step)
        odd = np.flatnonzero(words[end:to] != words[end - q : to - q])
        if len(odd):
            end += int(odd[0])
            break
        end, step = to, 4 * step
    return start, end


def _candidates(words: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> Iterator[tuple]:
    """(nodes, periods, anchors): three equal words a period apart, around the boundary of a node."""
    if len(lo) == 0:
        return
    trials = (hi - lo) // 3
    cuts = np.searchsorted(np.cumsum(trials), np.arange(0, int(trials.sum()), TRIALS))
    for first, last in zip(cuts, [*cuts[1:], len(lo)], strict=True):
        if first == last:
            continue
        many = trials[first:last]
        node = np.repeat(np.arange(first, last), many)
        q = np.arange(1, len(node) + 1) - np.repeat(np.cumsum(many) - many, many)
        here = words[mid[node]]
        down, up = mid[node] - q, mid[node] + q
        back = (down >= lo[node]) & (words[np.maximum(down, 0)] == here)
        on = up < hi[node]
        on &= words[np.where(on, up, 0)] == here
        some = np.flatnonzero(back | on)
        node, q, here, back, on = node[some], q[some], here[some], back[some], on[some]
        far = mid[node] - 2 * q
        twice_back = back & (far >= lo[node]) & (words[np.maximum(far, 0)] == here)
        far = mid[node] + 2 * q
        twice_on = on & (far < hi[node])
        twice_on &= words[np.where(twice_on, far, 0)] == here
        picks = [(twice_back, 2), (back & on, 1), (twice_on, 0)]
        yield (
            np.concatenate([node[p] for p, _ in picks]), np.concatenate([q[p] for p, _ in picks]),
            np.concatenate([mid[node[p]] - k * q[p] for p, k in picks]),
        )


def crossing_runs(
    words: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int, exponent: int = 3
) -> np.ndarray:
    """Rows (node, start, end, period): long enough stretches at the boundary ``mid`` of lo..hi.

    ``exponent`` is the least number of periods, 3 or more.
    """
    found: list[tuple[int, int, int, int]] = []
    for node, q, a in _candidates(words, lo, mid, hi):
        for ahead in range(1, AHEAD + 1):
            good = (ahead > q) | (words[a + np.minimum(ahead, q)] == words[a + np.minimum(ahead, q) + q])
            node, q, a = node[good], q[good], a[good]
        order = np.lexsort((a, q, node))
        last, known = -1, []
        for k in order.tolist():
            n, period, anchor = int(node[k]), int(q[k]), int(a[k])
            if n != last:
                last, known = n, []
            if any(period % p == 0 and s <= anchor and anchor + 2 * period < e for s, e, p in known):
                continue
            start, end = _extended(words, int(lo[n]), int(hi[n]), anchor, period)
            # The last anchor, too: else the stretch ends before the boundary, in another node.
            if end > anchor + 2 * period and end - start >= max(least, exponent * period):
                known.append((start, end, period))
                found.append((n, start, end, period))
    return np.array(found, np.int64).reshape(-1, 4)


def maximal(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) without those inside others of the period, least periods only."""
    if len(runs) == 0:
        return runs
    start, end, period = runs.T
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    far = end + np.unique(period, return_inverse=True)[1] * (int(end.max()) + 1)
    reach = np.maximum.accumulate(far)
    keep = np.ones(len(far), bool)
    keep[1:] = far[1:] > reach[:-1]
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return np.stack([start[keep], end[keep], period[keep]], 1)


def find_runs(words: np.ndarray, of: np.ndarray, least: int = 24, exponent: int = 3) -> np.ndarray:
    """Rows (start, end, period): the maximal runs of all sequences, as places in ``words``.

    ``of`` numbers the sequence of each word, in ascending order.
    """
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    grammar = Grammar(words, of)
    words = words.astype(np.int32)
    own = np.flatnonzero(grammar.size >= least)
    lo = grammar.first[own]
    inner = crossing_runs(
        words, lo, lo + grammar.sizes(grammar.left[own]), lo + grammar.size[own], least, exponent
    )
    lo, mid, hi = grammar.halves()
    big = hi - lo >= least
    outer = crossing_runs(words, lo[big], mid[big], hi[big], least, exponent)
    rows = [outer[:, 1:]]
    if len(inner):
        rule = own[inner[:, 0]]
        shift = inner[:, 1:3] - grammar.first[rule][:, None]
        wanted = np.zeros(len(grammar.left), bool)
        wanted[rule] = True
        place_rule, place = grammar.places(wanted)
        # The runs of a rule stand together: node numbers ascend.
        begin, stop = np.searchsorted(rule, place_rule), np.searchsorted(rule, place_rule, "right")
        many = stop - begin
        at = np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        moved = np.repeat(place, many)
        rows.append(np.stack([moved + shift[at, 0], moved + shift[at, 1], inner[at, 3]], 1))
    return maximal(np.concatenate(rows))


def _collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, end, period in runs.tolist():
        keep[start + period : end] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _solved(ids: list, texts: list[list[bytes]], least: int, exponent: int) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    numbers = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find_runs(numbers, np.repeat(np.arange(len(texts)), sizes), least, exponent)
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1 if len(runs) else np.empty(0, np.int64)
    out_runs, out_texts = [[] for _ in texts], [None] * len(texts)
    for k in np.unique(owner).tolist():
        own = runs[owner == k] - np.array([starts[k], starts[k], 0])
        order = np.lexsort((own[:, 2], own[:, 0]))
        out_runs[k] = [{"start": s, "length": e - s, "period": p} for s, e, p in own[order].tolist()]
        out_texts[k] = b" ".join(_collapsed(texts[k], own))
    for k, text in enumerate(out_texts):
        out_texts[k] = (b" ".join(texts[k]) if text is None else text).decode()
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out_runs, kind), pa.array(out_texts, pa.string())],
        ["doc_id", "n_words", "runs", "text"],
    )


def periodic_runs(
    docs: DataFrame, least: int = 24, exponent: int = 3, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_words, runs, text (collapsed), a row per row of ``docs``.

    ``runs`` lists (start, length, period) by start, then period: the longest stretches of
    ``least`` words and ``exponent`` periods or more whose words a least period apart are equal.
    The collapsed text has of each run the first period alone; words are joined by one space.
    """
    ship(docs.sparkSession)
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (value.as_py() or "").encode().split()
                if ids and size + len(words) > BATCH_WORDS:
                    yield _solved(ids, texts, least, exponent)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
        if ids:
            yield _solved(ids, texts, least, exponent)

    return wanted.mapInArrow(solve, RUNS)
