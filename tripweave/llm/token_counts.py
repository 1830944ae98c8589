"""Operator 1, token counts: an exact histogram of encoded lengths with suffix sums.

Documents are reduced to one number each, the numbers to one row per distinct length. Suffix
sums over that table answer the total of tokens, any quantile, and the total that is left
after cutting every document at a context limit, for every limit, without another look at the
documents.

Defined results: a null or empty text has length 0; repeated rows count each time; an empty
table gives an empty histogram; columns other than the text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running_totals
from .tokens import default_tokenizer, encoder


def encoded_lengths(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row (n_tokens, n_docs) per length that a batch of documents has: not yet summed."""
    path = tokenizer or default_tokenizer()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            found: dict[int, int] = {}
            for value in batch.column(0):
                n = len(known.encode(value.as_py())) // 4
                found[n] = found.get(n, 0) + 1
            yield pa.RecordBatch.from_pydict(
                {"n_tokens": pa.array(found, pa.int64()), "n_docs": pa.array(found.values(), pa.int64())}
            )

    return docs.select(F.col(text)).mapInArrow(lengths, "n_tokens long, n_docs long")


def length_histogram(
    docs: DataFrame, text: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """Per distinct length: documents, documents and tokens at or above it, total when cut there.

    Columns: n_tokens, n_docs, docs_from, tokens_from (of documents at least as long), docs_upto,
    tokens_below, truncated_total (tokens left if each document is cut to n_tokens).
    """
    scratch = Scratch(docs.sparkSession, "lengths")
    counts = (
        encoded_lengths(docs, text, tokenizer)
        .groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    )
    counts = scratch.table(counts, "histogram")
    above = running_totals(
        counts, "n_tokens", {"n_docs": "docs_above", "tokens": "tokens_above"}, descending=True
    )
    whole = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens")).first()
    docs_all, tokens_all = whole["all_docs"] or 0, whole["all_tokens"] or 0
    from_ = above.select(
        "n_tokens", "n_docs",
        (F.col("docs_above") + F.col("n_docs")).alias("docs_from"),
        (F.col("tokens_above") + F.col("tokens")).alias("tokens_from"),
        (F.lit(docs_all) - F.col("docs_above")).alias("docs_upto"),
    )
    below = F.lit(tokens_all) - F.col("tokens_from")
    return from_.withColumn("tokens_below", below).withColumn(
        "truncated_total", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_from")
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_cut, truncated_total) for each context limit.

    Documents longer than the limit are cut to it. The shortest length above the limit answers
    alone: its suffix sums hold everything that is cut. One pass for all limits.
    """
    longer = [F.col("n_tokens") > int(x) for x in limits]
    answers = [
        F.struct(
            F.lit(int(x)).cast("long").alias("context_limit"),
            F.coalesce(F.max(F.when(over, F.col("docs_from"))), F.lit(0)).alias("docs_cut"),
            F.coalesce(
                F.max(F.col("tokens_from"))
                - F.coalesce(F.max(F.when(over, F.col("tokens_from"))), F.lit(0))
                + int(x) * F.coalesce(F.max(F.when(over, F.col("docs_from"))), F.lit(0)),
                F.lit(0),
            ).alias("truncated_total"),
        )
        for x, over in zip(limits, longer, strict=True)
    ]
    return histogram.agg(F.array(*answers).alias("answers")).select(F.inline("answers"))


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of all documents do not exceed; null if none."""
    total = histogram.agg(F.max("docs_upto")).first()[0]
    if total is None:
        return None
    return histogram.where(F.col("docs_upto") >= share * total).agg(F.min("n_tokens")).first()[0]
