"""Decontamination and the classifier against plain Python, on rows made to hit every branch."""

import numpy as np
import pytest
from brute import judged, leaks

from tripweave.llm import decontamination, quality

WORDS = "the man bought Anna Bert Carl 12 7 kg litres 5kg of sold. then Then and it (old)".split()


def found(df):
    return {
        (r.doc_id, r.item_id): (r.words_matched, r.item_words, r.consistent, r.contaminated)
        for r in df.collect()
    }


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)

    def some(low, high):
        return [WORDS[i] for i in rng.integers(0, len(WORDS), rng.integers(low, high))]

    items = [(i, some(0, 22)) for i in range(60)]
    docs = []
    for i in range(80):
        body = list(items[int(rng.integers(0, 60))][1])
        if i % 2:
            swap = {"Anna": "Bert", "Bert": "Dora", "12": "31", "kg": "pounds"}
            body = [swap.get(w, w) if rng.random() < 0.95 else w for w in body]
        docs.append((i, " ".join(some(0, 12) + body + some(0, 12))))
    items = [(i, " ".join(w)) for i, w in items]
    docs += [(90, None), (91, ""), (92, "Anna"), (None, docs[0][1]), docs[1]]
    items += [(70, None), (71, "1 2 3 4 5 6 7 8 9"), (72, "of"), items[3], (None, items[4][1])]
    docs += [(93, "1 2 3 4 5 6 7 8 9"), (94, "1 2 3 4 5 6 7 8 10"), (95, " ".join(WORDS * 200))]
    return docs, items


@pytest.mark.parametrize("size, least, limit", [(4, 6, 1 << 26), (8, 13, 1 << 26), (4, 6, 0)])
def test_matches(spark, texts, size, least, limit):
    docs, items = texts
    got = decontamination.matches(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        words=size, least_words=least, least_item=3, broadcast_bytes=limit,
    )
    want = leaks(docs, items, size, least, 3)
    assert found(got) == want
    states = {(w[1] < size, w[2], w[3]) for w in want.values()}
    assert states >= {(True, True, True), (True, True, False), (False, True, True), (False, True, False)}


def test_sample_against_plain_python(spark, sf_dir):
    docs, items = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark")]
    want = leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(decontamination.matches(docs, items)) == want and any(w[3] for w in want.values())


def test_short_items_and_dense_windows(spark):
    items = [(1, "Who wrote Faust first?"), (2, "Yes it is"), (3, "3 1 4 1 5 9 2 6 5 3 5 8 9 7"), (4, "")]
    docs = [
        (1, "they asked: who wrote faust first and when"), (2, "yes it is, who wrote Hamlet first"),
        (3, "digits 3 1 4 1 5 9 2 6 5 3 5 8 9 7 go on"), (4, "digits 2 7 1 8 2 8 1 8 2 8 4 5 9 0 go on"),
    ]
    got = decontamination.matches(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert sorted((r.doc_id, r.item_id, r.contaminated) for r in got) == [(1, 1, True), (2, 2, False), (3, 3, True)]


def test_posteriors(spark):
    rng = np.random.default_rng(8)
    docs = []
    for i in range(900):
        site = None if i % 11 == 0 else f"s{i % 7}"
        bad = rng.random() < {0: 0.9, 1: 0.1}.get(i % 7, 0.4)
        words = ["!!!", "|", "BUY", "9"] if bad else ["plain", "words", "go", "on."]
        text = " ".join(words[j] for j in rng.integers(0, 4, rng.integers(1, 30)))
        docs.append((i, text, site, f"p{i % 3}" if i % 5 else None, int(not bad)))
    docs += [(900, None, "s1", "p1", 1), (901, "", None, None, 0), (902, "alone here", "only", "x", 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, quality int")
    labels = table.select("doc_id", "quality").where("doc_id % 4 = 0")
    known = spark.createDataFrame(
        [(d[0], quality.measures(d[1]), float(d[4])) for d in docs if d[0] % 4 == 0],
        "doc_id long, x array<double>, y double",
    )
    weights, base = quality.fit(known)
    got = {r.doc_id: r for r in quality.classify(table, labels).collect()}
    want = judged([d[:4] for d in docs], weights, base)
    assert len(got) == len(want) and {w[4] for w in want} == {True, False}
    for doc_id, evidence, prior, posterior, kept in want:
        row = got[doc_id]
        assert row.evidence == pytest.approx(evidence, abs=1e-6)
        assert row.prior == pytest.approx(prior, rel=1e-6)
        assert row.posterior == pytest.approx(posterior, rel=1e-6, abs=1e-9) and row.kept == kept
    assert 1.0 < brute_strength(want, docs) < 1e6


def brute_strength(want, docs):
    from brute import strength

    sites = {}
    for (_, score, *_), (_, _, site, *_) in zip(want, docs, strict=True):
        n, s = sites.get(site, (0, 0.0))
        sites[site] = (n + 1, s + 1 / (1 + np.exp(-score)))
    share = sum(s for _, s in sites.values()) / len(docs)
    return strength(sites, dict.fromkeys(sites, share))


def test_fit_is_the_least_of_its_loss(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(quality.MEASURES)))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=300) > 0.4).astype(float)
    rows = [(i, x[i].tolist(), float(y[i])) for i in range(300)]
    weights, base = quality.fit(spark.createDataFrame(rows, "doc_id long, x array<double>, y double"))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    share = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(w, b):
        t = z @ w + b
        return (share * (np.logaddexp(0, t) - y * t)).sum() + 0.5 * (w @ w)

    w = np.array(weights) * scale
    b = base + np.array(weights) @ mean
    least = loss(w, b)
    for _ in range(50):
        step = rng.normal(size=len(w) + 1) * 1e-2
        assert loss(w + step[:-1], b + step[-1]) >= least - 1e-9
