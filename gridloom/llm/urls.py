"""URL filter: rules by host and path, and a character language model for the rest.

Two Markov models of code points, one of accepted and one of rejected URLs,
give each URL the difference of its log-likelihoods divided by its length.
Each model has contexts of 0 to 4 units and uses, at every position, the
longest context that it has seen, with Witten-Bell weights on the shorter
ones. Counts are sharded by n-gram and joined with the URLs' n-grams (see
``charlm``), so they grow with the input and nothing is gathered.

The labels are the rules' own verdicts. What rules go by is left out of the
text that is modelled, or the models would only read the rules off the URL:
the last label of the host, labels that stand in a rule's host, and as many
segments at the start of the path as rules have. Four fifths of the labelled
hosts (by a hash) are counted; on the last fifth, whose hosts the models have
never seen, the cut is calibrated: as many accepted as rejected URLs on the
wrong side, but at most ``FALSE_BLOCK`` of the accepted ones.

A null URL and one without ``://`` have an empty host and path; no rule fits
them, and the model judges them as empty. Without URLs of both labels there is
nothing to learn from, and what no rule decides is allowed. Repeated rows and
ids stay. An empty table gives an empty result. Only the id and URL columns
are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.charlm import N, Found, Grams, gram_counts, keyed, scored, shorter_counts
from gridloom.runtime import Scratch, ship

#: (rule, verdict): a host, which stands for its subdomains too, and the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The share of accepted URLs that the model may block.
FALSE_BLOCK = 0.05
#: One in so many labelled hosts is held out.
FOLDS = 5
#: The histogram of scores for the calibration.
BINS, LOW, HIGH = 8192, -16.0, 16.0
#: The unit after the last one of a text: the edge.
END = "\uffff"


def host_path(url: F.Column | str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def with_rules(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (the longest that fits, else null) and rule_verdict."""
    host, path = host_path(url_col)
    out = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit("/" + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def modelled_text(url: F.Column | str, rules: tuple[tuple[str, str], ...] = RULES) -> F.Column:
    """What of a URL the models see: host and the rest, without the parts that rules go by, and the edge."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host, _ = host_path(url)
    after = F.regexp_extract(url, r"(?s)://[^/?#]*(.*)$", 1)
    own = {x for rule, _ in rules for x in rule.partition("/")[0].split(".")}
    depth = max((rule.partition("/")[2].count("/") for rule, _ in rules), default=0)
    labels = F.split(host, r"\.")
    labels = F.filter(F.slice(labels, 1, F.size(labels) - 1), lambda x: ~x.isin(*own))
    return F.concat(F.array_join(labels, "."), F.regexp_replace(after, f"^(?:/[^/?#]*){{0,{depth}}}", ""), F.lit(END))


def markov_model(urls: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """From rows (text, rejected) a table (gram, n_0, total_0, kinds_0, n_1, total_1, kinds_1) of n-grams of all lengths, for accepted (0) and rejected texts: how often it occurs, and as a context how many units and kinds of units follow; and the probability of a unit before any count."""
    both = [gram_counts(urls.where(F.col("rejected") == F.lit(bool(k)))).withColumn("label", F.lit(k)) for k in (0, 1)]
    counts = scratch.table(f"count-{N}", both[0].unionByName(both[1]))
    rows = None
    for k in range(N, 0, -1):
        if k < N:
            counts = scratch.table(f"count-{k}", shorter_counts(counts, k, False))
        event = counts.select("gram", "label", "n", F.lit(0).alias("total"), F.lit(0).alias("kinds"))
        context = counts.groupBy(F.substring("gram", 1, k - 1).alias("gram"), "label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).select("gram", "label", F.lit(0).alias("n"), "total", "kinds")
        both = event.unionByName(context)
        rows = both if rows is None else rows.unionByName(both)
    units = counts.select("gram").distinct().count()
    sums = [F.sum(F.when(F.col("label") == k, F.col(c)).otherwise(0)).cast("double").alias(f"{c}_{k}") for k in (0, 1) for c in ("n", "total", "kinds")]
    return rows.groupBy("gram").agg(*sums), 1.0 / (units + 1)


def difference(base: float):
    """A kernel for the log-likelihood of each text as a rejected one less that as an accepted one."""

    def kernel(grams: Grams, model: Found) -> list[np.ndarray]:
        places = [model.places(k) for k in grams.keys]
        logs = []
        for label in (1, 0):
            p = np.array([base])
            for k in range(1, N + 1):
                context = places[k - 1][grams.before(k)]
                total, kinds = (model.get(f"{c}_{label}", context, 0.0) for c in ("total", "kinds"))
                n, short = model.get(f"n_{label}", places[k], 0.0), p[grams.shorter(k)]
                p = np.where(total > 0, (n + kinds * short) / np.maximum(total + kinds, 1.0), short)
            logs.append(np.log(p))
        return [grams.sums(logs[0] - logs[1])]

    return kernel


def cut_between(held_out: DataFrame, share: float = FALSE_BLOCK) -> float:
    """Of the scores above which at most ``share`` of the accepted rows (score, rejected) are, that above which the share of accepted rows is nearest to the share of rejected ones below; in the middle of a gap. From histograms of fixed size; 0 without rows of both kinds."""
    place = F.least(F.greatest(F.floor((F.col("score") - LOW) / ((HIGH - LOW) / BINS)), F.lit(0)), F.lit(BINS - 1))
    hist = np.zeros((2, BINS))
    for r in held_out.groupBy(place.cast("int").alias("bin"), "rejected").agg(F.count(F.lit(1)).alias("n")).collect():
        hist[int(r.rejected), r.bin] += r.n
    if not hist[0].sum() or not hist[1].sum():
        return 0.0
    above, below = 1 - np.cumsum(hist[0]) / hist[0].sum(), np.cumsum(hist[1]) / hist[1].sum()
    may = above <= share + 1e-12
    gap = np.where(may, np.abs(above - below), np.inf)
    best = np.flatnonzero(gap <= gap.min() + 1e-12)
    return LOW + (best[len(best) // 2] + 1) * (HIGH - LOW) / BINS


def judge(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per URL: id, host, path, rule, verdict (allow or block: the rule's, else the model's), score (by unit, above 0 where the rejected model fits better), model_blocks (what the model says alone), held_out (labelled, but not counted by the models)."""
    spark = urls.sparkSession
    ship(spark)
    scratch = Scratch(spark, "urls")
    picked = with_rules(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), rules).withColumn("text", modelled_text("url", rules)).drop("url")
    labelled = picked.where("rule_verdict is not null").withColumn("rejected", F.col("rule_verdict") == "block")
    held_out = F.col("rule_verdict").isNotNull() & (F.pmod(F.xxhash64("host"), F.lit(FOLDS)) == 0)
    trained = labelled.where(~held_out)
    if trained.select("rejected").distinct().count() < 2:  # few labelled hosts: all of them
        trained = labelled
    end = [F.col("id").alias(id_col), "host", "path", "rule"]
    if trained.select("rejected").distinct().count() < 2:
        return picked.select(*end, F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("model_blocks"), held_out.alias("held_out"))
    model, base = markov_model(trained.select("text", "rejected"), scratch)
    model = scratch.table("model", keyed(model))
    for k in range(1, N + 1):
        scratch.drop(f"count-{k}")
    out = scored(picked, model, difference(base), "difference", scratch)
    out = scratch.table("scored", out.withColumn("score", F.col("difference") / F.col("size")).withColumn("held_out", held_out))
    for name in ("blocks", "model"):
        scratch.drop(name)
    blocks = F.col("score") > cut_between(out.where("held_out").select("score", (F.col("rule_verdict") == "block").alias("rejected")))
    return out.select(*end, F.coalesce("rule_verdict", F.when(blocks, "block").otherwise("allow")).alias("verdict"), "score", blocks.alias("model_blocks"), "held_out")


def report(judged: DataFrame) -> DataFrame:
    """From ``judge``'s rows, for each suffix of hosts: URLs without a rule and the share of them that is blocked; held-out accepted and rejected URLs and the shares of them that the model judges as the rules do."""
    suffix = F.element_at(F.split("host", r"\."), -1)
    share = lambda rows, yes: (F.count_if(rows & yes) / F.nullif(F.count_if(rows), F.lit(0)))
    free, accepted, rejected = F.col("rule").isNull(), F.col("held_out") & (F.col("verdict") == "allow"), F.col("held_out") & (F.col("verdict") == "block")
    return judged.groupBy(suffix.alias("suffix")).agg(F.count_if(free).alias("n_free"), share(free, F.col("verdict") == "block").alias("free_blocked"), F.count_if(accepted).alias("n_accepted"), share(accepted, ~F.col("model_blocks")).alias("accepted_right"), F.count_if(rejected).alias("n_rejected"), share(rejected, F.col("model_blocks")).alias("rejected_right"))
