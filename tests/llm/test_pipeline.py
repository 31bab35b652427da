"""The pipeline against the same steps by brute force."""

import hashlib
import re

import corpus_pipeline
from gridloom.llm import queries

from .test_text_operators import SF, brute_base, brute_components, brute_leaks, brute_stats


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    failed = {d for d, t in rows for s in [brute_stats(t)] if s[0] < 10 or 100 * s[4] > 20 * s[0]}
    rows = [r for r in rows if r[0] not in failed]  # no host of these tables is rejected
    least = {d: c for d, _, c in brute_components(rows)}
    rows = [(d, t) for d, t in rows if least[d] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in brute_leaks(rows, items)}
    rows = [(d, t) for d, t in rows if d not in leaked]
    library = Tokenizer.from_file(queries.tokenizer())
    want = {}
    for d, t in rows:
        spans = brute_base(t)  # no secret of these tables is encoded; the next test has some
        out, at = "", 0
        for a, _, b in spans:
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        text = out + t[at:]
        ids = library.encode(text, add_special_tokens=False).ids
        want[d] = (len(ids), ids, hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, list(r.token_ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and leaked and len(rows) < len(least)


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert not [t for t in (r.text for r in out.collect()) if re.search(r'token = "[0-9a-f]{30,}', t or "")]


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_planted_cases(spark, tmp_path):
    """Junk, copies, leaks and encoded secrets among clean documents, with nulls and columns of clashing names."""
    import base64
    import gzip
    import random

    from tokenizers import Tokenizer

    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n))
    clean = [prose(60) for _ in range(6)]
    item, copied = prose(40), prose(80)
    hidden = base64.b64encode(gzip.compress(b'password = "hunter2hunter2"')).decode()
    texts = [*clean, copied, copied.upper(), copied + " more", clean[0] + " " + item + " " + prose(200), "few words", "z y " * 60, None, "", clean[5] + " key " + hidden + " end " + prose(30)]
    rows = [(i, t, "en", f"h{i}", 1, 2, 3.0, "x") for i, t in enumerate(texts)] + [(None, prose(60), None, None, None, 2, 3.0, "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, key double, base_failed string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 14, None}
    library = Tokenizer.from_file(queries.tokenizer())
    text = lambda i: library.decode(list(got[i].token_ids), skip_special_tokens=False)
    assert all(text(i) == texts[i] for i in range(7))
    assert text(14) == texts[14].replace(hidden, "[secret]")
