"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are code points as they are, the n-grams five long. Counts, the
tables made from them and the joins that score texts are all sharded by
n-gram (see ``charlm``); none is gathered in one place, and all grow with the
text.

1. Counts. Each task counts the n-grams of its own trusted text; the counts
   are summed by n-gram over shuffle shards.
2. Model. Joins of these count tables give each n-gram its probability (raw
   counts for the longest, continuation counts for the others, the three
   discounts of Chen and Goodman from the counts of counts) and each context
   the weight that it leaves to shorter ones.
3. Scores. Blocks of documents join their distinct n-grams with the model,
   and each document gets the sum over its n-grams and so its perplexity.

Trusted are the documents that the labels call good and not toxic; a label of
null does not count, and a document with several labels needs all of them. The
model is trained on four fifths of them, by a hash of the text, so that copies
stay together. A document is kept if its perplexity is at most the ``share``
quantile of the last fifth in its language: texts that the model was trained
on are likelier than others and would make the quantile too low.

Null and empty texts have no perplexity and are not kept. A language without
held-out documents, and a null one, gets the quantile of all held-out ones;
without any, that of the training documents. Without trusted documents nothing
can be judged and every text with characters is kept. Short texts are judged
with some mean trusted text added. Repeated rows stay rows. Empty tables give empty results. Only id,
text, language and label columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.charlm import N, Found, Grams, gram_counts, keyed, scored, shorter_counts
from gridloom.runtime import Scratch, release, ship

#: The quantile of the held-out trusted documents of a language beyond which a text is not kept.
SHARE = 0.99
#: One in so many trusted documents is held out.
FOLDS = 5
#: Code points of mean trusted text that go with each text when it is judged.
PRIOR = 100
#: Labels up to so many are sent to all tasks; beyond, texts and labels are joined by a shuffle.
LABEL_ROWS = 5_000_000
#: Languages up to so many are sent to all tasks with their thresholds.
LANGUAGES = 100_000


def kneser_ney(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """A table (gram, p, weight) of n-grams of all lengths: the interpolated probability of the n-gram's last unit after the others, and the weight that the n-gram, as a context, leaves to shorter ones; and the probability that an unseen unit has by itself before any weight."""
    levels = {N: counts}
    for k in range(N - 1, 0, -1):  # continuation counts: how many units come before
        levels[k] = scratch.table(f"count-{k}", shorter_counts(levels[k + 1], k, True))
    unseen = 1.0 / (levels[1].count() + 1)
    out, lower = None, None
    for k in range(1, N + 1):
        t = dict(levels[k].where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect())  # four rows at most
        cut = F.when(F.col("n") == 1, (d := discounts(t))[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        grams = levels[k].withColumn("context", F.substring("gram", 1, k - 1)).withColumn("cut", cut)
        contexts = grams.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        joined = grams.join(contexts, "context")
        if lower is None:
            q = F.lit(unseen)
        else:
            q = F.col("q")
            joined = joined.withColumn("short", F.substring("gram", 2, k - 1)).join(lower.select(F.col("gram").alias("short"), F.col("p").alias("q")), "short")
        lower = scratch.table(f"p-{k}", joined.select("gram", ((F.col("n") - F.col("cut") + F.col("left") * q) / F.col("total")).alias("p")))
        weights = contexts.select(F.col("context").alias("gram"), (F.col("left") / F.col("total")).alias("weight"))
        both = lower.select("gram", "p", F.lit(None).cast("double").alias("weight")).unionByName(weights.select("gram", F.lit(None).cast("double").alias("p"), "weight"))
        out = both if out is None else out.unionByName(both)
    return out.groupBy("gram").agg(F.max("p").alias("p"), F.max("weight").alias("weight")), unseen


def discounts(n: dict[int, int]) -> list[float]:
    """What is taken off counts of 1, of 2 and of 3 or more, from the number of n-grams of each count."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(v, 0.0), float(i)) for i, v in enumerate(d, 1)]


def surprise(unseen: float):
    """A kernel for the negative log-likelihood of each text."""

    def kernel(grams: Grams, model: Found) -> list[np.ndarray]:
        p = np.array([unseen])
        weight = model.get("weight", model.places(grams.keys[0]), 1.0)  # a context that was not seen leaves all to the shorter one
        for k in range(1, N + 1):
            places = model.places(grams.keys[k])
            own = model.values["p"][places]
            p = np.where(np.isnan(own), weight[grams.before(k)] * p[grams.shorter(k)], own)
            weight = model.get("weight", places, 1.0)
        return [-grams.sums(np.log(p))]

    return kernel


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", share: float = SHARE) -> DataFrame:
    """A row per document: id, lang, perplexity (by code point), threshold, kept."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "kneser")
    fold = F.pmod(F.xxhash64(text_col), F.lit(FOLDS)).cast("int")
    picked = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), fold.alias("fold"), F.col(text_col).alias("text"))
    good = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("good")).where("good").select("id")
    good = scratch.table("good", good)
    sent = F.broadcast(good) if good.count() <= LABEL_ROWS else good
    trusted = picked.join(sent, "id", "left_semi")
    counts = scratch.table("counts", gram_counts(trusted.where("fold <> 0")))
    if counts.isEmpty():  # few trusted texts, or none
        counts = scratch.table("all-counts", gram_counts(trusted))
    if counts.isEmpty():
        return picked.select(F.col("id").alias(id_col), "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (F.length(F.coalesce("text", F.lit(""))) > 0).alias("kept"))
    model, unseen = kneser_ney(counts, scratch)
    model = scratch.table("model", keyed(model))
    for name in ("counts", "all-counts", *(f"{t}-{k}" for t in ("count", "p") for k in range(1, N + 1))):
        scratch.drop(name)
    release(spark)
    judged = scratch.table("scored", scored(picked, model, surprise(unseen), "nats", scratch))
    for name in ("blocks", "model"):
        scratch.drop(name)
    judges = judged.join(sent, "id", "left_semi").where("size > 0")
    mean = judges.agg(F.sum("nats") / F.sum("size")).first()[0] or 0.0
    if not judges.where("fold = 0").isEmpty():
        judges = judges.where("fold = 0")
    # short texts say little: they count as if PRIOR code points of mean trusted text went with them
    steady = F.exp((F.col("nats") + F.lit(PRIOR * mean)) / (F.col("size") + PRIOR))
    cut = F.percentile_approx(steady, share, 100_000)
    whole = judges.agg(cut.alias("t")).first()[0]
    by_lang = scratch.table("thresholds", judges.where("lang is not null").groupBy("lang").agg(cut.alias("own")))
    by_lang = F.broadcast(by_lang) if by_lang.count() <= LANGUAGES else by_lang
    out = judged.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(whole)))
    perplexity = F.when(F.col("size") > 0, F.exp(F.col("nats") / F.col("size")))
    return out.select(F.col("id").alias(id_col), "lang", perplexity.alias("perplexity"), "threshold", ((F.col("size") > 0) & F.coalesce(steady <= F.col("threshold"), F.lit(False))).alias("kept"))
