"""The ten operators against plain Python on small tables, with the awkward cases in them."""

import base64
import hashlib
import html as entities
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import (
    decontamination, embed_dedup, html_text, minhash, mixing, pii, quality, token_counts,
    token_records, tokens, warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int"
WORDS = [f"word{i}" for i in range(60)]
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
TEXTS = [
    (1, " ".join(WORDS)), (2, " ".join([*WORDS[:58], "other", "end"])), (3, " ".join(WORDS).upper()),
    (4, None), (5, ""), (6, " \t\n"), (7, "two words"), (8, "Two\nwords"), (9, LONG), (9, LONG),
    (None, "two words"), (10, "a  b c éè, <|endoftext|> it's\r\n\r\n  9.5 x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "a" if n % 3 else None, None, "x", 7) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids_of(text):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokens.default_tokenizer())
    return known.encode(text or "", add_special_tokens=False).ids


def test_lengths(docs, none):
    sizes = [len(ids_of(t)) for _, t in TEXTS]
    found = token_counts.length_histogram(docs)
    for r in found.collect():
        n = r.n_tokens
        assert r.n_docs == sizes.count(n)
        assert r.docs_from == sum(s >= n for s in sizes)
        assert r.tokens_from == sum(s for s in sizes if s >= n)
        assert r.truncated_total == sum(min(s, n) for s in sizes)
    limits = [0, 1, 50, 10**6]
    got = {r.context_limit: r.truncated_total for r in token_counts.at_limits(found, limits).collect()}
    assert got == {x: sum(min(s, x) for s in sizes) for x in limits}
    assert token_counts.quantile(found, 0.5) == sorted(sizes)[len(sizes) // 2 - 1]
    assert token_counts.length_histogram(none).count() == 0


def test_records(docs, none):
    got = token_records.token_digests(docs).orderBy("start").collect()
    expected = []
    for i, t in TEXTS:
        ids = np.array([*ids_of(t), 0], "<u4")
        expected.append((i is not None, i or 0, len(ids), zlib.crc32(ids.tobytes())))
    expected.sort()
    assert [(r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got] == expected
    assert [r.start for r in got] == np.cumsum([0] + [e[2] for e in expected])[:-1].tolist()
    assert token_records.token_digests(none).count() == 0
    assert token_records.crc32c([b"123456789"])[0] == 0xE3069283


def test_records_in_any_order_and_damage(docs, tmp_path):
    index = token_records.write_records(docs, str(tmp_path / "out"))
    wanted = index.orderBy(F.desc("n_tokens"))
    rows = {(r.doc_id, r.n_tokens) for r in token_records.read_at(wanted).collect()}
    assert rows == {(r.doc_id, r.n_tokens) for r in index.collect()}
    path = index.orderBy("path").first()["path"]
    with open(path, "r+b") as f:
        f.seek(20)
        f.write(b"\xff")
    with pytest.raises(Exception, match="checksum"):
        token_records.read_records(index).count()


PAGES = "page_id long, url string, html string, digest string, first int"


def test_archives(spark):
    rows = [(1, "http://www.b.org/x", "<p>é"), (2, "http://a.org/#t", "<p>é"), (3, None, None), (4, "x y", ""),
            (None, "http://a.org", "<p>é"), (5, "http://a.org/", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "d", 0) for r in rows], PAGES)
    got = warc.archive_digest(pages).collect()
    first = {"<p>é": 1, "": 3, "z" * 300_000: 5}
    for r in got:
        body = next((h or "") for i, _, h in rows if i == r.page_id)
        raw = body.encode()
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r.refers_to == (None if r.page_id == first[body] else first[body])
        assert r.record_type == ("revisit" if r.refers_to else "response")
    order = [(r.urlkey, r.timestamp) for r in sorted(got, key=lambda r: r.ordinal)]
    assert order == sorted(order) and sorted(r.ordinal for r in got) == list(range(len(rows)))
    assert warc.archive_digest(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(3)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 20)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_pseudonyms(spark):
    values = {
        "4465758382889437": r"4\d{15}", "4111 1111 1111 1111": r"4\d{3}( \d{4}){3}", "1999-02-28": r"\d{4}-\d\d-\d\d",
        "28.02.1999": r"\d\d\.\d\d\.\d{4}", "123-45-6789": r"\d{3}-\d\d-\d{4}", "+1 (743) 555-3824": r"\+1 \(\d{3}\) \d{3}-\d{4}",
        "217.94.102.185": r"\d+\.\d+\.\d+\.\d+", "hein.19@mail5.example.com": r"[a-z]{4}\.\d\d@mail5\.example\.com",
        "DE89 3704 0044 0532 0130 00": r"DE\d\d( \d{4}){4} \d\d", "GB29NWBK60161331926819": r"GB\d\dNWBK\d{14}",
    }
    rows = [(i, f"{v} and ({v}), ünd", 1) for i, v in enumerate(values)]
    kept = [(90, None, 1), (91, "", 1), (92, "4465758382889438 1999-02-30 666-45-6789 999.1.1.1 v2.0.", 1)]
    made = spark.createDataFrame(rows + kept, "doc_id long, text string, n_pseudonyms int")
    got = {r.doc_id: r for r in pii.pseudonymize(made, "k").collect()}
    for i, (value, shape) in enumerate(values.items()):
        one, two = re.fullmatch(rf"({shape}) and \(({shape})\), ünd", got[i].text).group(1), got[i].n_pseudonyms
        assert one != value and two == 2 and got[i].text.count(one) == 2
    assert [got[i].text for i in (90, 91, 92)] == [k[1] for k in kept]
    assert pii.pseudonymize(made, "k").agg(F.sum("n_pseudonyms")).first()[0] == 2 * len(values)
    assert pii.pseudonymize(made, "other").where("doc_id = 0").first().text != got[0].text


def test_pseudonyms_permute_their_domain(spark):
    octets = [f"10.0.{i // 256}.{i % 256}" for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in octets], "text string")
    new = [r.text for r in pii.pseudonymize(df, "k").collect()]
    assert len(set(new)) == 2000 and all(max(map(int, v.split("."))) < 256 for v in new)
    cards = [r.text for r in pii.pseudonymize(spark.createDataFrame([("4465758382889437",)], "text string"), "k").collect()]
    d = [int(c) for c in cards[0][::-1]]
    assert sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_quality(spark, docs, none, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality.classify(table, seen).join(held, "doc_id")
    right = judged.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95 and judged.where("quality = 1 AND NOT kept").count() <= 2
    odd = quality.classify(docs, labels.limit(0))
    assert odd.count() == len(TEXTS) and odd.where("NOT kept").count() == 0
    assert quality.classify(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_main_text(spark):
    furniture = "<nav><ul><li><a href=x>Menu</a><li>Two</ul></nav><div class='ad'>Buy</div>"
    foot = "<footer>(c)</footer><div id='comments'><p>Nice!</p></div><script>var t='</p>';</script>"

    def page(body):
        return f"<html><head><title>T</title></head><body>{furniture}<article>{body}</article>{foot}</body>"

    bodies = ["<h1>A</h1><p><b>One &amp; x<br><p>two  3</p>", "<h1>B</h1><p>q<i>r</i></p>", "<p>only</p>", ""]
    texts = ["A One & x two 3", "B qr", "only", ""]
    rows = [(i, "http://h.org/%d" % i, page(b), "m") for i, b in enumerate(bodies)]
    rows += [(10 + i, "http://plain.org/%d" % i, f"<div>Subscribe</div><div><p>text {i}</p></div>", "m") for i in range(4)]
    rows += [(20, None, None, "m"), (21, "bad", "1 < 2 and <b>bold", "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert [got[i] for i in range(4)] == texts
    assert [got[10 + i] for i in range(4)] == [f"text {i}" for i in range(4)]
    assert (got[20], got[21]) == ("", "1 < 2 and bold")
    assert html_text.main_text(df.limit(0)).count() == 0


def test_wrapper_groups():
    one = html_text.skeleton([(("body", "dl", x), x) for x in ("dt", "dd", "dt", "dd")])
    two = html_text.skeleton([(("body", "p"), "a"), (("body", "dl", "dt"), "b"), (("body", "dl", "dd"), "c")])
    merged = html_text.align(one, two)
    marks = {(p[0], p[1]) for p in merged[0][2]}
    assert ("p", "?") in marks and ("dl", "") in marks
    assert {"/".join(p) for p, _, _ in html_text.fields(merged)} == {"body/p", "body/dl/dt", "body/dl/dd"}
    assert html_text.unpacked(*html_text.packed(merged)) == merged


def test_slots_and_template_text():
    pages = [[(("div", "h2"), "News"), (("div", "p"), f"text {i}"), (("ul", "li"), "one"), (("ul", "li"), "two")] for i in range(3)]
    wrapper = html_text.skeleton(pages[0])
    for page in pages[1:]:
        wrapper = html_text.align(wrapper, html_text.skeleton(page))
    found = {"/".join(p): (h is None, n) for p, h, n in html_text.fields(wrapper)}
    assert found == {"div/h2": (False, 3), "div/p": (True, 3), "ul/li": (False, 3)}
    assert html_text.content_fields(wrapper) == (set(), {"div/p"})


def test_template_without_tell_tale_names_is_dropped(spark):
    """Menu, tag line and an optional box go because the wrapper says they are template text."""
    rows = []
    for i in range(12):
        box = "<div><p>Our shop is open</p></div>" if i % 2 else ""
        body = "".join(f"<p>words {i} {j}</p>" for j in range(1 + i % 3))
        rows.append((i, f"http://h.org/{i}", f"<body class='right-sidebar'><div><ul><li>Home<li>About</ul></div>{box}<section>{body}</section><div>All rights</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {i: " ".join(f"words {i} {j}" for j in range(1 + i % 3)) for i in range(12)}
    one = spark.createDataFrame([(1, "http://x.org", "<body class='has-widgets'><article><p>hello</p></article>")], "page_id long, url string, html string")
    assert html_text.main_text(one).first().text == "hello"


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "in the deep" + "</div>" * 5000
    wide = "".join(f"<p class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}'>w{i}</p>" for i in range(15_000))
    rows = [(1, "http://d.org/1", deep), (2, "http://d.org/2", deep + "<div>more</div>"), (3, "http://w.org/1", wide), (4, "http://w.org/2", wide + "<h1>x</h1>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got[1] == "in the deep" and got[2] == "in the deep more"
    assert got[3] == " ".join(f"w{i}" for i in range(15_000)) and got[4] == got[3] + " x"


def test_long_runs_and_clashing_names(spark):
    text = "a" * 1_000_000 + " b.c@x.org " + "0" * 100_000
    df = spark.createDataFrame([(text, "kept")], "text string, _pseudonyms string")
    row = pii.pseudonymize(df, "k").first()
    assert row["_pseudonyms"] == "kept" and row.n_pseudonyms == 1 and len(row.text) == len(text)
    assert row.text[:1_000_000] == text[:1_000_000] and row.text[1_000_001:].endswith("@x.org " + "0" * 100_000)


def feistel_of(key, kind, a, b, x, y):
    """A second network, step by step, as HMAC over the coordinate that is not changed."""
    def mixed(i, v):
        inner = hashlib.sha256(f"in:{key}|{kind}|{i}|{v}".encode()).hexdigest()
        return int(hashlib.sha256(f"out:{key}{inner}".encode()).hexdigest()[:15], 16)

    for i in range(pii.ROUNDS):
        x, y = ((x + mixed(i, y)) % a, y) if i % 2 == 0 else (x, (y + mixed(i, x)) % b)
    return x, y


def test_network_step_by_step_and_back(spark):
    domains = [(7, 5, x, y) for x in range(7) for y in range(5)] + [(10**6, 10**6, 123456, 654321), (229, 319, 17, 300)]
    df = spark.createDataFrame(domains, "a long, b long, x long, y long")
    kind = F.lit("card")
    got = df.select("*", pii.feistel("key", kind, F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("p")).collect()
    for r in got:
        assert (r.p.x, r.p.y) == feistel_of("key", "card", r.a, r.b, r.x, r.y)
        x, y = r.p.x, r.p.y
        for i in reversed(range(pii.ROUNDS)):
            def mixed(v):
                inner = hashlib.sha256(f"in:key|card|{i}|{v}".encode()).hexdigest()
                return int(hashlib.sha256(f"out:key{inner}".encode()).hexdigest()[:15], 16)
            x, y = ((x - mixed(y)) % r.a, y) if i % 2 == 0 else (x, (y - mixed(x)) % r.b)
        assert (x, y) == (r.x, r.y)
    assert len({(r.p.x, r.p.y) for r in got if r.a == 7}) == 35


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i}.org", f"<p>{i}") for i in range(40)], "page_id long, url string, html string").repartition(8)
    runs = warc.write_archives(pages, str(tmp_path / "out"))
    text = warc.read_archives(runs)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and "xxhash64(path" in text
    final = warc.archive_digest(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [path" not in final and "SortMergeJoin [path" in final


def test_articles_of_the_sample(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.main_text(pages).collect():
        body = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))
        assert r.text == " ".join(entities.unescape(body).split()) and r.n_chars == len(r.text)


def components(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    vecs = [base[i % 30] + 0.12 * rng.standard_normal(16) for i in range(150)] + [base[0]] * 12
    rows = [(i, [float(x) for x in v], i % 2 if i < 150 else 0, "x") for i, v in enumerate(vecs)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows += [(200 + k, v, 0, "x") for k, v in enumerate(odd)] + [(300, rows[0][1], None, "x"), (301, [1.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string")
    x = np.array([r[1] for r in rows[:162]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:162]])
    link = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = components(162, zip(*np.nonzero(np.triu(link))))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, block=block).collect()}
    for i in range(162):
        assert got[i] == (link[i].sum(), comp[i], comp[i] == i)
    assert all(got[i] == (0, i, True) for i in (*range(200, 206), 300, 301)) and len(got) == 170
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("block", [500, 1 << 18])
def test_near_copies(spark, docs, none, block):
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in range(120)]
    made = []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            w[at] = f"n{i}"
        made.append((100 + i, " ".join(w)))
    rows = [t for t in TEXTS if t[0] not in (9, None)] + made
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t, 4) for _, t in rows]
    pairs = [
        (a, b) for b in range(len(rows)) for a in range(b)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    comp = components(len(rows), pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table, words=4, block=block).collect()}
    assert got == {rows[i][0]: (len(sets[i]), rows[comp[i]][0]) for i in range(len(rows))}
    # Rows that share an id but not the text are documents of their own.
    twice = [(1, rows[0][1]), (1, rows[-1][1]), (2, rows[-1][1]), (2, rows[-1][1]), (3, rows[0][1])]
    judged = minhash.near_duplicates(spark.createDataFrame(twice, "doc_id long, text string"), words=4)
    assert sorted((r.doc_id, r.component_id) for r in judged.collect()) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]
    assert sorted(r.doc_id for r in minhash.keep_one(spark.createDataFrame(twice, "doc_id long, text string")).collect()) == [1, 1]
    once = minhash.keep_one(docs, words=5)
    assert once.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in once.collect()) == [0, 1, 4, 5, 6, 7, 9, 10]
    assert minhash.near_duplicates(none).count() == 0


def test_mix(docs, none, spark):
    got = mixing.mix_digest(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in TEXTS)
    assert all(r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_digest(docs).collect()))
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_digest(none).count() == 0 and mixing.mixed(none).count() == 0
    many = spark.createDataFrame(
        [(i, "w " * (i % 90), f"s{i % 7}" if i % 5 else None) for i in range(4000)], "doc_id long, text string, source string"
    )
    sums = mixing.mix_digest(many).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 0.02 * r.target for r in sums)


def test_decontamination(spark, docs, none):
    item = "On Monday farmer Anna sold 12 kg of apples to Bert and later Anna gave 12 more apples back to old Bert again."
    changed = item.replace("Anna", "Clara").replace("12", "31").replace("kg", "pounds").replace("Bert", "Dora")
    broken = changed.replace("later Clara", "later Dora").replace("gave 31", "gave 77")
    texts = [item, "before it. " + changed + " After it.", "x " + broken, item.lower()[:30], None, "", LONG, item]
    rows = [(i, t, "y") for i, t in enumerate(texts)] + [(None, item, "y"), (0, item, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, words string")
    bench = spark.createDataFrame([(5, item), (6, None), (7, "short one"), (5, item)], "item_id long, text string")
    found = decontamination.matches(table, bench)
    hits = sorted((r.doc_id, r.item_id) for r in found.where("contaminated").collect())
    assert hits == [(0, 5), (1, 5), (7, 5)]
    assert not found.where("doc_id = 2").first().consistent
    kept = decontamination.keep_clean(table, bench)
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 2, 3, 4, 5, 6]
    assert decontamination.matches(none, bench).count() == 0 and decontamination.matches(docs, bench.limit(0)).count() == 0
