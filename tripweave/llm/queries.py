"""The registered query of each operator, and SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, embed_dedup, grammar_runs, html_text, line_runs, minhash, mixing, pii, quality,
    ranked_search, token_counts, token_records, warc,
)

#: The key of the registered query alone; a release takes one from where secrets are kept.
DEMO_KEY = "public-demo-key"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(_read(spark, sf_dir, "documents"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_digests(_read(spark, sf_dir, "documents"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(_read(spark, sf_dir, "pages"))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, DEMO_KEY)


def op5_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op7_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_read(spark, sf_dir, "documents"))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(
        _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    )
    return found.where(F.col("contaminated"))


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=4)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup_lines(_read(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("text"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the CRC-32 of its id, made periodic from a word on."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = F.expr(
        "array_join(transform(sequence(0, n - 1), i -> "
        "get(w, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')"
    )
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grammar_runs.periodic_runs(planted(_read(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # Greatest length / period exactly, then smallest start, then period.
    first = F.expr(
        "get(array_sort(runs, (x, y) -> case "
        "when x.length * y.period > y.length * x.period then -1 "
        "when x.length * y.period < y.length * x.period then 1 "
        "when x.start < y.start then -1 when x.start > y.start then 1 "
        "when x.period < y.period then -1 when x.period > y.period then 1 else 0 end), 0)"
    )
    return found.withColumn("best", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_length_histogram, op2_token_records, op3_warc_index, op4_feistel_pseudonyms,
        op5_empirical_bayes, op6_wrapper_text, op7_hyperplane_dedup, op8_source_mix,
        op9_template_decontamination, op10_tensored_minhash, op11_ranked_search, op12_line_dedup,
        op13_grammar_runs,
    )
}

_OP3 = r"""
WITH body AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         regexp_replace(coalesce(url, ''), '#.*$', '') AS clean
  FROM pages
), keyed AS (
  SELECT page_id, strlen(html) AS payload_bytes,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31) + 1)::INT, 1)),
           'string_agg', '') AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first,
         lower(regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host,
         lower(regexp_replace(clean, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')) AS rest,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0)), '%Y%m%d%H%M%S') AS timestamp
  FROM body
), history AS (
  SELECT *, array_to_string(list_reverse(string_split(regexp_replace(host, '^www[0-9]*\.', ''), '.')), ',')
            || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS urlkey
  FROM keyed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, urlkey, timestamp,
       row_number() OVER (ORDER BY urlkey, timestamp, page_id NULLS FIRST) - 1 AS ordinal
FROM history
"""

_OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.x = v.vec_id LEFT JOIN degree ON degree.x = v.vec_id
"""

_TAKES = ", ".join(
    f"abs(sum(size * (floor(rate) + (((h + {k} * g) % 4294967296) / 4294967296.0 < rate - floor(rate))::INT)) - target)"
    for k in range(mixing.SEEDS)
)
_OP8 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 9, 8))::BIGINT AS g
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(2.0 * sum(source_size) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM sums
  WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (SELECT *, weight * level >= 2.0 * source_size AS full_ FROM levels),
aims AS (
  SELECT source, source_size,
         CASE WHEN full_ THEN (2.0 * source_size)::DOUBLE
              ELSE weight * (SELECT arg_min(level, place) FROM marked WHERE NOT full_) END AS target
  FROM marked
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aims
), misses AS (
  SELECT r.source, source_size, target, rate, [{_TAKES}] AS miss
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
  GROUP BY r.source, source_size, target, rate
), plan AS (SELECT *, list_position(miss, list_min(miss)) - 1 AS seed FROM misses)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + (((h + seed * g) % 4294967296) / 4294967296.0 < rate - floor(rate))::INT))::BIGINT AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
"""

_OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), shingles AS (SELECT doc_id, unnest(s) AS sh FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * shared >= 80 * (len(a.s) + len(b.s) - shared)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON least.x = doc_id
"""

_OP11 = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, total GROUP BY term, all_docs
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), total
  GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0)
WHERE rank <= 10
"""

_OP12 = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, place, line, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE = {
    "op3_warc_index": _OP3, "op7_hyperplane_dedup": _OP7, "op8_source_mix": _OP8,
    "op10_tensored_minhash": _OP10, "op11_ranked_search": _OP11, "op12_line_dedup": _OP12,
}
