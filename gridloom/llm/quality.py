"""Quality rules with host verdicts.

Each document is judged by base rules on its own words. Failures are then
counted by host, every host's failure rate is shrunk towards the overall rate
with a beta prior fitted to the hosts by moments, and documents of hosts whose
shrunk rate is above ``reject_rate`` go too.

Rows stay rows: a repeated document counts each time. Null texts are empty, so
they fail the base rules for want of words. A null host is a host of its own.
An empty table gives an empty result. Columns of the input other than the id,
text and host columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textkern import WS, BYTE, Hasher, mix, shingles, slices, words
from gridloom.runtime import Scratch, give_back, ship, unused

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A host goes if its shrunk failure rate is above this.
REJECT_RATE = 0.5
#: Rejected hosts up to so many are sent to all tasks.
BROADCAST_HOSTS = 500_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and for each but the first in that order whether it equals the one before."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, k[1:] == k[:-1]


def text_stats(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The columns of STATS for each row of a slice."""
    rows = len(offsets) - 1
    u64 = np.uint64
    start, end, first = words(offsets, data)
    hasher = Hasher(data, BYTE)
    n = np.diff(first)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    out = np.zeros((rows, len(STATS)), np.int64)
    out[:, 0] = n
    out[:, 1] = _sums(~WS[data] & ((data & 0xC0) != 0x80), offsets)
    out[:, 2] = _sums(symbol[data], offsets)

    # lines: between row starts and line feeds
    feeds = np.flatnonzero(data == 10)
    cut = np.sort(np.concatenate((feeds, offsets[1:])), kind="stable")  # each line's end
    row = np.searchsorted(feeds, offsets[1:], "left") + np.arange(rows)  # place of each row's last line
    begin = np.empty(len(cut), np.int64)
    begin[1:] = cut[:-1] + 1
    if len(cut):
        begin[0] = 0
    begin[row[:-1] + 1] = offsets[1:-1]
    owner = np.repeat(np.arange(rows), np.diff(np.concatenate(([-1], row))))
    filled = np.searchsorted(start, cut) > np.searchsorted(start, begin)
    owner, begin, cut = owner[filled], begin[filled], cut[filled]
    order, same = _groups(mix(hasher.of(begin, cut) + owner.astype(u64) * u64(0x9E3779B97F4A7C15)))
    out[:, 3] = np.bincount(owner[order[1:][same]], minlength=rows)

    # words in windows that repeat
    h, bounds, at = shingles(hasher.of(start, end), first)
    owner = np.repeat(np.arange(rows), np.diff(bounds)).astype(u64)
    order, same = _groups(mix(h + owner * u64(0x9E3779B97F4A7C15)))
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(start) + 6, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 5, -1)
    out[:, 4] = _sums(np.cumsum(edge)[: len(start)] > 0, first)
    return out


def fails(stats: np.ndarray) -> np.ndarray:
    """The base rules on rows of ``text_stats``."""
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > REPEAT_PERCENT * stats[:, 0])


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row per document: id, host, the columns of STATS and ``base_failed``."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in slices(batch.column("text")):
                x = text_stats(offsets, data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("host").slice(a, b - a), *(pa.array(x[:, k]) for k in range(len(STATS))), pa.array(fails(x))],
                    ["doc_id", "host", *STATS, "base_failed"],
                )
        give_back()

    return picked.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{c} bigint" for c in STATS) + ", base_failed boolean")


def host_rates(stats: DataFrame, reject_rate: float = REJECT_RATE) -> DataFrame:
    """A row per host: documents, failures, shrunk rate and verdict.

    The prior's strength comes from the spread of the hosts' rates around the
    overall rate beyond what chance gives; without such spread it is as strong
    as the mean host is large.
    """
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.avg("n_docs").alias("size"), F.avg(1.0 / F.col("n_docs")).alias("inverse"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("spread"))
    noise = F.col("mean") * (1 - F.col("mean"))
    between = F.col("spread") - noise * F.col("inverse")
    prior = total.select("mean", F.when((between > 0) & (noise > between), noise / between - 1).otherwise(F.col("size")).alias("strength"))
    mean, strength = (x or 0.0 for x in prior.first())  # an aggregate over everything: one row, nulls without documents
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > reject_rate).alias("host_rejected"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source", reject_rate: float = REJECT_RATE) -> DataFrame:
    """The documents that neither fail the base rules nor come from a rejected host, with all their columns.

    Texts are judged once: the documents are written with the outcome, from
    which the hosts are counted, and read again.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    outcome, its_host = unused(docs, "base_failed"), unused(docs, "its_host")

    @F.arrow_udf("boolean")
    def failed(column: pa.Array) -> pa.Array:
        out = [text_stats(offsets, data) for _, _, offsets, data in slices(column)]
        x = np.concatenate(out) if out else np.zeros((0, len(STATS)), np.int64)
        give_back()
        return pa.array(fails(x))

    host = F.col(host_col).cast("string")
    judged = scratch.table("judged", docs.withColumn(outcome, failed(F.col(text_col))))
    rates = host_rates(judged.select(host.alias("host"), F.col(outcome).alias("base_failed")), reject_rate)
    bad = scratch.table("hosts", rates.where("host_rejected").select(F.col("host").alias(its_host)))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad
    return judged.where(~F.col(outcome)).drop(outcome).join(bad, host.eqNullSafe(F.col(its_host)), "left_anti")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", reject_rate: float = REJECT_RATE) -> DataFrame:
    """A row per document: id, STATS, base_failed, host, host_rate, kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.table("stats", document_stats(docs, id_col, text_col, host_col))
    hosts = host_rates(stats, reject_rate).withColumnRenamed("host", "its_host")
    both = stats.join(hosts, stats["host"].eqNullSafe(hosts["its_host"]), "left")
    return both.select("doc_id", *STATS, "base_failed", (~(F.col("base_failed") | F.coalesce("host_rejected", F.lit(False)))).alias("kept"), "host", "host_rate")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM grams),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY 1),
ln AS (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM ln GROUP BY 1),
st AS (SELECT w.doc_id, host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
       FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM st),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY 1),
t AS (SELECT sum(f) / sum(n) AS m, avg(n) AS size, avg(1.0 / n) AS inv, coalesce(var_samp(f / n), 0) AS spread FROM h),
p AS (SELECT m, CASE WHEN spread - m * (1 - m) * inv > 0 AND m * (1 - m) > spread - m * (1 - m) * inv
        THEN m * (1 - m) / (spread - m * (1 - m) * inv) - 1 ELSE size END AS k FROM t)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT (base_failed OR (f + m * k) / (n + k) > 0.5) AS kept
FROM b JOIN h USING (host) CROSS JOIN p
"""
