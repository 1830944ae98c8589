"""The corpus pipeline: stages keep columns, rejects go, the last stage reads records back."""

import zlib
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
from brute import judged, leaks
from tokenizers import Tokenizer

from tripweave.llm import quality, queries, tokens
from tripweave.llm.common import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, columns, sizes = Scratch(spark, "test"), docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = sorted((r.start, r.n_tokens) for r in out.collect())
    assert len(rows) == sizes[4] and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_run_against_plain_python(spark, sf_dir):
    """All rows of ``run`` from second computations of its five stages, chained."""
    docs, labels, items = (
        spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels", "benchmark")
    )
    rows = sorted((r.doc_id, r.text, r.source, r.lang) for r in docs.collect())
    assert len({r[0] for r in rows}) == len(rows)
    known = {}
    for r in labels.where("quality IS NOT NULL").collect():
        known.setdefault(r.doc_id, []).append(float(r.quality))
    fitted = [(r[0], quality.measures(r[1]), float(np.mean(known[r[0]]))) for r in rows if r[0] in known]
    weights, base = quality.fit(spark.createDataFrame(fitted, "doc_id long, x array<double>, y double"))
    good = {r[0] for r in judged(rows, weights, base) if r[4]}
    rows = [r for r in rows if r[0] in good]

    sets = [shingles(r[1]) for r in rows]
    first = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((first[a], first[b]))
                first = [low if x == high else x for x in first]
    rows = [r for i, r in enumerate(rows) if first[i] == i]

    found = leaks([r[:2] for r in rows], [(r.item_id, r.text) for r in items.collect()])
    gone = {doc_id for (doc_id, _), match in found.items() if match[3]}
    rows = [r for r in rows if r[0] not in gone]

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source", "lang"]))
    head, tail = queries.ORACLE["op8_source_mix"].rsplit("(size * (floor(rate)", 1)
    sql = f"{head}(1 * (floor(rate){tail}"  # copies instead of words taken
    copies = {r[0]: r[4] for r in con.execute(sql).fetchall()}
    assert set(copies.values()) & {1, 2}

    encoder, want, start = Tokenizer.from_file(tokens.default_tokenizer()), [], 0
    for doc_id, text, _, _ in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        for _ in range(copies[doc_id]):
            want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want


def test_working_tables_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = Path(Scratch(spark, "probe").root).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, sf_dir).count() > 0
    left = {p.name.split("-")[1] for p in set(folder.iterdir()) - before}
    assert left == {"rejected", "copies", "leaks"}
