"""Ranked search, line dedup and run detection against plain Python, with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tripweave.llm import grammar_runs, line_runs, queries, ranked_search, tokens

DOCS = "doc_id long, text string, n_terms string, term int, runs string, item int, gone int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], DOCS)


def test_any_text_is_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    known, own = Tokenizer.from_file(tokens.default_tokenizer()), tokens.encoder(tokens.default_tokenizer())
    assert own.by_units
    parts = [
        " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "<|endoftext|>", "<|endof", "|>", "'s", "'ll", "'",
        "abc", "don't", "Éèpa", "α", "abcα", "中文", "123", "x²", "Ⅷ", "ǅ",
        "a1", "-", "well-known", ".", "!?", "_a_", "\U0001f600", "a\u200db", "\x85", "\x00", "ß", "×",
    ]
    draw = random.Random(4)
    for _ in range(4000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 9)))
        got = np.frombuffer(own.encode(text), "<u4").tolist()
        assert got == known.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_encode_texts_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, text = tokens.Encoder(path), "Two  Words<|endoftext|> it's"
    assert not own.by_units
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == expected


def test_forgotten_units_are_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 4)
    own = tokens.Encoder(tokens.default_tokenizer())
    text = " ".join(f"word{i % 7} other" for i in range(50))
    assert own.encode(text) == tokens.encoder(tokens.default_tokenizer()).encode(text)


# Ranked search.


def best_documents(docs, items, k=10):
    def terms(text):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, bag in bags:
            size = sum(bag.values())
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * bag[t] // (1000 * bag[t] + 8 * (25 + 75 * size * n_docs // total)))
                for t, times in wanted.items() if bag[t]
            )
            if score > 0:
                scores.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


def ranked(result):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in result.collect()), key=repr)


@pytest.mark.parametrize("owners", [1, 4])
def test_search(spark, owners, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 16)
    monkeypatch.setattr(ranked_search, "BUNDLE", 3)
    draw = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Été", "été", "a-b", "X9"]
    rare = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(draw.choices(words, rare, k=draw.randint(0, 40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "?! ."), (None, "w39 w38"), (5, rows[5][1]), (903, "w1 " * 5000)]
    items = [(i, " ".join(draw.choices(words, rare, k=draw.randint(1, 9)))) for i in range(7)]
    items += [(20, None), (21, ""), (22, "nowhere"), (3, items[3][1]), (3, "w39"), (None, "W38 w39 W38"), (23, "w39 " * 30)]
    wanted = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS doc_id")
    found = ranked_search.search(table(spark, rows).repartition(5), wanted, owners=owners)
    assert ranked(found) == best_documents(rows, items)
    none = table(spark, rows).limit(0)
    assert ranked_search.search(none, wanted).count() == 0
    assert ranked_search.search(table(spark, rows), wanted.limit(0)).count() == 0


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "PASS_TERMS", 3)
    rows = [(i, f"a{i % 3} b{i % 5} c{i}") for i in range(40)]
    items = [(i, f"a{i % 3} b{i} c{i}") for i in range(6)]
    found = ranked_search.search(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert ranked(found) == best_documents(rows, items, 4)


# Line dedup.


def cut_lines(rows, least_chars, least_docs):
    blank = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if i is None or len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == i
        ]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (4, 2), (5, 3)])
def test_lines(spark, batches, fan):
    draw = random.Random(batches)
    lines = ["short", "", "  ", "Line one of SOME length", "line ONE of some length \t", "Été à la plage 123",
             "été à la plage 123", "yet another line 中文", "rare line number one"]
    rows = [(i, "\n".join(draw.choices(lines, k=draw.randint(1, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "\n".join(lines)), (7, rows[7][1]), (7, "\n".join(lines)),
             (103, "\n".join(["Line one of some length"] * 3000 + ["own line that is alone here"] * 2))]
    got = line_runs.dedup_lines(table(spark, rows).repartition(3), 12, 5, batches=batches, fan=fan)
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr)
    assert found == cut_lines(rows, 12, 5)
    assert sum(r[2] for r in found) > 100
    assert line_runs.dedup_lines(table(spark, rows).limit(0)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_hold_a_key_once_per_level(spark):
    """Each batch adds a run, levels are compacted, and joins with the runs shuffle the batch only."""
    from tripweave.llm.common import Scratch

    runs = line_runs.LineRuns(spark, Scratch(spark, "test"), fan=2, buckets=4)
    for b in range(3):
        rows = [(100 - 10 * b - i, h, 0) for i in range(5) for h in range(b, b + 4)]
        runs.add(spark.createDataFrame(rows, "id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 1]
    merged = {r.h1: r.keeper for r in runs.repeated(10).collect()}
    assert merged == {1: 100, 2: 100, 3: 100, 4: 90}
    plan = runs.repeated(10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    runs.close()


# Periodic runs.


def all_runs(words, least=24, exponent=3):
    """(start, end, least period) of the maximal runs, by comparing every pair of words."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def periodic_texts(seed, n):
    draw, out = random.Random(seed), []
    for _ in range(n):
        letters, words = draw.choice([1, 2, 3, 5, 50]), []
        for _ in range(draw.randint(0, 5)):
            if draw.random() < 0.6:
                one = [f"v{draw.randrange(letters)}" for _ in range(draw.randint(1, 14))]
                words += (one * draw.randint(1, 12))[: draw.randint(1, 120)]
            else:
                words += [f"v{draw.randrange(letters)}" for _ in range(draw.randint(0, 30))]
        out.append(" ".join(words))
    return out + out[: n // 5]


@pytest.mark.parametrize("least", [6, 24])
def test_runs_of_words(least):
    for seed in range(150):
        texts = [t.split() for t in periodic_texts(seed, 5)]
        flat = [w for t in texts for w in t]
        number = {w: i for i, w in enumerate(sorted(set(flat)))}
        words = np.array([number[w] for w in flat], np.int64)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        expected, at = [], 0
        for t in texts:
            expected += [(s + at, e + at, q) for s, e, q in all_runs(t, least)]
            at += len(t)
        assert sorted(map(tuple, grammar_runs.find_runs(words, of, least).tolist())) == sorted(expected)


def test_grammar_derives_its_words():
    draw = np.random.default_rng(2)
    words = np.concatenate([np.tile(draw.integers(0, 4, 9), 30), draw.integers(0, 3, 500)])
    of = np.repeat([0, 1, 2], [100, 300, len(words) - 400])
    grammar = grammar_runs.Grammar(words, of)

    def derived(symbol):
        stack, out = [symbol], []
        while stack:
            s = stack.pop()
            if s < grammar.base:
                out.append(s)
            else:
                stack += [grammar.right[s - grammar.base], grammar.left[s - grammar.base]]
        return out

    assert [w for s in grammar.symbols for w in derived(s)] == words.tolist()
    assert len(grammar.symbols) < len(words) / 2
    everywhere = np.ones(len(grammar.left), bool)
    for rule, at in zip(*grammar.places(everywhere)):
        assert words[at : at + grammar.size[rule]].tolist() == derived(rule + grammar.base)


def run_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted((s, e - s, q) for s, e, q in all_runs(words))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept))
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], *digests)


def test_run_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grammar_runs, "BATCH_WORDS", 700)
    plain = " ".join(f"u{i % 211}z{i % 97}" for i in range(400))
    rows = [(i, t) for i, t in enumerate(periodic_texts(9, 60))] + [(i, plain) for i in range(200, 260)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (None, "a b " * 40), (-5, plain), (3, rows[3][1])]
    rows += [(303, "x " * 5000), (304, " ".join(f"{i * i % 1009}" for i in range(4000)))]
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_grammar_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((run_digest(*r) for r in rows), key=repr)
    assert grammar_runs.periodic_runs(table(spark, rows).limit(0)).count() == 0
