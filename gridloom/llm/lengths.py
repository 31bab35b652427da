"""Exact histogram of encoded lengths, with suffix sums for every context limit.

A row of the histogram is a length that occurs: how many documents have it,
how many are longer, the tokens of all documents cut at that limit and the
tokens so lost. ``totals`` and ``quantile`` answer for any limit or share from
the histogram alone. Null and empty texts have length 0. An empty table has an
empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.bpe import encoder
from gridloom.runtime import Scratch, ship

#: Lengths are summed by ranges of so many first, so that no task needs all of them.
RANGE = 128


def lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``n_tokens``: the encoded length of each document, without special tokens."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for _, rows in enc.encode_all(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(len, rows), np.int64, len(rows)) // 4)], ["n_tokens"])

    return docs.select(text_col).mapInArrow(run, "n_tokens bigint")


def histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Rows (n_tokens, n_docs) and, with context limit n_tokens: docs_at_most, docs_over, tokens_at_most, tokens_kept (all documents cut at the limit), tokens_lost."""
    scratch = Scratch(docs.sparkSession, "lengths")
    counts = scratch.table("counts", lengths(docs, tokenizer, text_col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    return with_sums(counts)


def with_sums(counts: DataFrame) -> DataFrame:
    """Suffix sums of a table (n_tokens, n_docs): within ranges of lengths, plus the sums of the ranges above."""
    cells = counts.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    ranges = cells.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"))
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = cells.select("*", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d_in"), F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t_in")).join(ranges, "range")
    over, long = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    whole = counts.agg(F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens"))).first()
    n_docs, n_tokens = (F.lit(x or 0).cast("bigint") for x in whole)
    lost = long - over * F.col("n_tokens")
    return out.select("n_tokens", "n_docs", (n_docs - over).alias("docs_at_most"), over.alias("docs_over"), (n_tokens - long).alias("tokens_at_most"), (n_tokens - lost).alias("tokens_kept"), lost.alias("tokens_lost"))


def totals(hist: DataFrame, limit: int) -> dict[str, int]:
    """Documents, tokens and tokens after cutting every document at ``limit``."""
    row = hist.agg(F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")), F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit)))).first()
    return dict(zip(("docs", "tokens", "kept"), (x or 0 for x in row), strict=True))


def quantile(hist: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    n = hist.agg(F.sum("n_docs")).first()[0]
    return hist.where(F.col("docs_at_most") >= F.lit(share * (n or 0))).agg(F.min("n_tokens")).first()[0]
