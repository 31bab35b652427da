"""Benchmark decontamination: short test items found inside long documents.

A document leaks an item if it has at least ``percent`` per cent of the item's
distinct word shingles (five words, A-Z lower-cased). The search is by MinHash
under one hash function:

1. Signatures. An item of n shingles, of which m must be shared, is signed by
   its n - m + j smallest hashes, with j about n / 8. A document that leaks it
   lacks at most n - m of its shingles, so it has at least j of those hashes:
   no leak is missed, however long the document is. Bands of several hashes
   would miss some, since the similarity of a short item and a long document
   is next to nothing.
2. Size partitions. Items are partitioned by size, by powers of two. All
   signatures of a partition lie below one hash, its bound, and it needs
   documents of some size. A document's own sketch for a partition is its
   hashes below the bound; for a document, only the partitions that its size
   allows count, so most of its hashes are never looked up.
3. Candidates. Sketches and signatures are joined by hash, and the pairs that
   share j hashes or more stay.
4. Containment. For these pairs the shingles themselves, not their hashes, are
   compared and counted.

DataFrame functions only: texts are split and hashed in generated JVM code,
and the items' signatures are broadcast if their number is below
``BROADCAST_ROWS``, else joined by a shuffle.

Null and empty texts have no shingles and neither leak nor are leaked. A text
of fewer than five words has one shingle, its whole sequence. Rows that repeat
id and text are one; a null id is an id. Items that share an id are one item
with the shingles of all. Empty tables give an empty result. Only ids and
texts are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import Scratch, unused

#: Tables of keys and hashes up to so many rows are broadcast: 16 bytes each.
BROADCAST_ROWS = 2_000_000
K = 5


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shingle_rows(df: DataFrame, text_col: str = "text", texts: bool = False) -> DataFrame:
    """A row per run of ``K`` words of the text, in its place: ``hash`` and ``size``, the number of runs with repeats; with ``texts`` the run itself too, as ``shingle``, and ``short`` if it is all of a text of fewer words."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.split(F.trim(F.coalesce(lower, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    keep = [F.col(c) for c in df.columns if c != text_col]
    whole = F.size("w") >= K
    size = F.when(whole, F.size("w") - (K - 1)).when(F.get("w", F.lit(0)) != "", 1).otherwise(0)
    # explode_outer: for explode the optimiser would add a filter that splits every text a second time
    rows = df.select(*keep, words.alias("w")).select("*", size.alias("size")).select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1))).alias("at")).where("at is not null")
    run = [F.get("w", F.col("at") + j) for j in range(K)]
    out = [F.when(whole, F.xxhash64(*run)).otherwise(F.xxhash64(F.lit("short"), F.concat_ws(" ", "w"))).alias("hash"), "size"]
    if texts:
        out += [F.when(whole, F.concat_ws(" ", *run)).otherwise(F.concat_ws(" ", "w")).alias("shingle"), (~whole).alias("short")]
    return rows.select(*keep, *out)


def item_shingles(items: DataFrame, percent: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, hash, shingle, short, n, need, least, part, signed): each item's distinct shingles, its size, how many must be shared, how many of its signature, its size partition, and whether the hash is in its signature."""
    one = shingle_rows(items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), texts=True).drop("size").distinct()
    sets = one.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("hash", "shingle", "short"))).alias("all"))
    sized = sets.withColumn("n", F.size("all")).withColumn("need", F.ceil(F.col("n") * percent / 100).cast("int")).withColumn("least", F.least(F.col("need"), F.ceil(F.col("n") / 8).cast("int")))
    sized = sized.withColumn("part", F.floor(F.log2("n")).cast("int"))
    return sized.select("item", "n", "need", "least", "part", F.posexplode("all").alias("at", "s")).select("item", "s.*", "n", "need", "least", "part", (F.col("at") < F.col("n") - F.col("need") + F.col("least")).alias("signed"))


def partition_bounds(shingled: DataFrame) -> list[tuple[int, int, int]]:
    """(partition, least size of a document, largest hash of a signature) of the items' partitions: one for each power of two."""
    return [tuple(r) for r in shingled.where("signed").groupBy("part").agg(F.min("need"), F.max("hash")).orderBy("part").collect()]


def leaks(docs: DataFrame, items: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc id, item id, n_item, n_shared, containment, doc_key), one per leaked item of each document; ``doc_key`` is a hash of id and text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    shingled = scratch.table("items", item_shingles(items, percent, item_col, item_text_col))
    n_items = shingled.count()
    picked = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc_key"), F.col(text_col).alias("text"))
    # the sketch of a document: hashes below the largest bound among the partitions that its size allows
    bounds, bound = partition_bounds(shingled), F.lit(None).cast("bigint")
    for size in sorted({b[1] for b in bounds}):
        bound = F.when(F.col("size") >= size, max(b[2] for b in bounds if b[1] <= size)).otherwise(bound)
    sketches = shingle_rows(picked.select("doc_key", "text")).where(F.col("hash") <= bound)
    signatures = _small(shingled.where("signed").select("hash", "item", "need", "least"), n_items)
    met = sketches.join(signatures, "hash").where("size >= need").select("doc_key", "item", "least", "hash").distinct()
    pairs = scratch.table("pairs", met.groupBy("doc_key", "item", "least").agg(F.count(F.lit(1)).alias("met")).where("met >= least").select("doc_key", "item"))
    n_pairs = pairs.count()
    # exact containment, for the candidates alone
    keys = _small(pairs.select("doc_key").distinct(), n_pairs)
    again = shingle_rows(picked.join(keys, "doc_key", "left_semi"), texts=True).select("doc", "doc_key", "hash", "shingle", "short")
    hits = again.join(_small(shingled.select("hash", "shingle", "short", "item", "n", "need"), n_items), ["hash", "shingle", "short"])
    wanted = _small(pairs, n_pairs).withColumnsRenamed({"doc_key": "pair_key", "item": "pair_item"})
    hits = hits.join(wanted, (F.col("doc_key") == F.col("pair_key")) & F.col("item").eqNullSafe(F.col("pair_item")), "left_semi")
    by = ["doc", "doc_key", "item", "n", "need"]
    counted = hits.select(*by, "hash", "shingle").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_shared")).where("n_shared >= need")
    return counted.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("n").cast("bigint").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"), "doc_key")


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    scratch = Scratch(docs.sparkSession, "leaks")
    its_id, its_key = unused(docs, "id"), unused(docs, "key")
    found = leaks(docs, items, percent, id_col, text_col, item_col, item_text_col).select(F.col(id_col).alias(its_id), F.col("doc_key").alias(its_key)).distinct()
    found = scratch.table("keys", found)
    same = (F.xxhash64(docs[id_col], docs[text_col]) == F.col(its_key)) & docs[id_col].eqNullSafe(F.col(its_id))
    return docs.join(_small(found, found.count()), same, "left_anti")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
d AS (SELECT DISTINCT doc_id, len(ws) < 5 AS short, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
b AS (SELECT DISTINCT item_id, len(ws) < 5 AS short, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM v WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT doc_id, item_id, n::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / n AS containment
FROM d JOIN b ON d.g = b.g AND d.short = b.short JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n
"""
