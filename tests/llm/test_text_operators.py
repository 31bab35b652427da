"""Each operator against brute force, and with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import bpe, charlm, decontam, graph, jaccard, kneser, lengths, queries, quality, secrets, textkern, tokenbin, urls, warc
from gridloom.runtime import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, class int, id string, n int, hash double, component int"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of every awkward sort, with columns whose names the operators use themselves."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = prose(80)
    words = base.split()
    near = [" ".join(words[:k] + [prose(1)] + words[k + 1 :]) for k in (3, 40, 70)]
    texts = [None, "", "   \n\t ", "one", "One two", "one  two", "a b c d", base, base, base.upper(), *near, prose(5), prose(3000), base + " " + prose(80), "x" * 50_000, "é ü ж 中 😀 \x85 \xa0 \u2028 y", "l\nl\nl\n\nl2\n l2\n", 'token = "abcdef0123456789abcdef0123" <|endoftext|> x', "z " * 200]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "h1", "h2", ""][i % 4], None, "k", 1, "i", 2, 0.5, 3) for i, t in enumerate(texts)]
    rows += [rows[7], rows[1], (None, base, "en", "h1", 1, "k", 1, "i", 2, 0.5, 3), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words_of(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingle_set(text):
    w = words_of(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


# ---- text kernels ----------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\téA😀", max_size=30)), max_size=8))
def test_kernels(texts):
    seen = []
    for a, b, offsets, data in textkern.slices(pa.array(texts, pa.string()), 16):
        start, end, first = textkern.words(offsets, data)
        h, bounds = textkern.shingle_sets(offsets, data)
        for r in range(b - a):
            own = [data[s:e].tobytes().decode() for s, e in zip(start[first[r] : first[r + 1]], end[first[r] : first[r + 1]], strict=True)]
            assert own == words_of(texts[a + r])
            seen.append(frozenset(h[bounds[r] : bounds[r + 1]].tolist()))
    want = [frozenset(shingle_set(t)) for t in texts]
    assert [len(x) for x in seen] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(seen[i] & seen[j]) == len(want[i] & want[j])


# ---- 1 ---------------------------------------------------------------------


def brute_leaks(docs, items):
    sets = defaultdict(set)
    for i, t in items:
        sets[i] |= shingle_set(t)
    return sorted({(d, t, i, len(s), len(s & shingle_set(t))) for d, t in docs for i, s in sets.items() if s and 100 * len(s & shingle_set(t)) >= 75 * len(s)}, key=repr)


def test_leaks(spark, odd, docs, agree):
    agree(queries.op1_leaked_items, decontam.SQL)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    long = next(t for _, t in rows if t and len(t.split()) == 3000).split()
    items = [(1, " ".join(long[100:140])), (2, " ".join(long[100:120] + ["q"] * 3 + long[123:140])), (3, "ONE two"), (4, None), (5, ""), (6, "not in any of these texts"), (None, " ".join(long[:20])), (1, " ".join(long[100:140])), (7, rows[7][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    got = decontam.leaks(odd, bench)
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()), key=repr) == sorted(((d, i, n, s) for d, _, i, n, s in brute_leaks(rows, items)), key=repr)
    bad = {(d, t) for d, t, *_ in brute_leaks(rows, items)}
    assert rows_of(decontam.without_leaks(odd, bench).select("doc_id", "text")) == sorted((r for r in rows if r not in bad), key=repr)
    assert decontam.leaks(odd.limit(0), bench).isEmpty() and decontam.leaks(odd, bench.limit(0)).isEmpty()
    assert decontam.without_leaks(odd, bench.limit(0)).columns == odd.columns
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def test_signatures_miss_no_leak(spark):
    """Documents that have just the least share of an item's shingles, any of them, meet the least number of its signature below the bounds."""
    rng = random.Random(9)
    items = [(i, " ".join(f"w{i}x{rng.randrange(9)}y{j}" for j in range(rng.choice([1, 4, 5, 8, 9, 12, 30, 80, 300])))) for i in range(40)]
    shingled = decontam.item_shingles(spark.createDataFrame(items, "item_id int, text string"), 75).collect()
    bounds = {p: (least, bound) for p, least, bound in decontam.partition_bounds(spark.createDataFrame(shingled))}
    by = defaultdict(list)
    for r in shingled:
        by[r.item].append(r)
    for rows in by.values():
        r = rows[0]
        signed = sorted(x.hash for x in rows if x.signed)
        assert len(rows) == r.n and r.need == -(-75 * r.n // 100) and signed == sorted(x.hash for x in rows)[: len(signed)]
        assert bounds[r.part][0] <= r.need and bounds[r.part][1] >= signed[-1] and 2**r.part <= r.n < 2 ** (r.part + 1)
        for _ in range(20):
            kept = rng.sample([x.hash for x in rows], r.need)
            assert len(set(kept) & set(signed)) >= r.least >= 1
    docs = [(i, "a b c d e f " + " ".join(t.split()[: -(-len(t.split()) * 9 // 10)]) + " g h i j k") for i, t in items]
    df, bench = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontam.leaks(df, bench).collect()) == sorted((d, i, n, s) for d, _, i, n, s in brute_leaks(docs, items))


def test_without_leaks_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 1, 2, 3), (2, "other text", 1, 2, 3)], "doc_id int, text string, id int, key int, _leak int")
    assert [tuple(r) for r in decontam.without_leaks(docs, spark.createDataFrame([(1, text)], "item_id int, text string")).collect()] == [(2, "other text", 1, 2, 3)]


def test_leaks_without_broadcast(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = rows_of(decontam.leaks(docs, bench))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert rows_of(decontam.leaks(docs, bench)) == want and want


# ---- 2 ---------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(r, v) for r, v in urls.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_urls(spark):
    some = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://EXAMPLE.net/en/x?y", "http://a.example.net/en", "http://a.example.net/de/#f", "ftp://example.com/de/x", "http://notexample.com/de/x", "http://x.org/fr/", "http://x.org?q=/fr/", "http://x://y/fr/", "http://a.b.net#/", "http://ж.org/fr/ж", "http://" + "a" * 9000 + ".net/"]
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate([*some, some[6]])] + [(None, None, None, None)], "page_id bigint, url string, host string, score double")
    got = urls.judge(df).collect()
    assert len(got) == len(some) + 2
    for r in got:
        host, path, rule, verdict = brute_rule(([*some, some[6]] + [None])[r.page_id if r.page_id is not None else -1])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert urls.judge(df.limit(0)).isEmpty()
    unlabelled = urls.judge(df.where("url is null or url not like '%://%'")).collect()
    assert {r.verdict for r in unlabelled} == {"allow"}


WORD_LISTS = ("bcdfg", "xyzq")


def test_url_model_learns(spark):
    """Hosts of one word list are rejected, those of another accepted; hosts without a rule are judged alike under any suffix."""
    rng = random.Random(1)
    name = lambda k: "".join(rng.choices(WORD_LISTS[k], k=9))
    rows = [(i, f"http://{name(1)}.net/es/{name(1)}" if i % 2 else f"http://{name(0)}.org/fr/{name(0)}") for i in range(600)]
    free = [(f"{name(i % 2)}", f"en/{name(i % 2)}?q={i}") for i in range(100)]
    rows += [(1000 + i, f"http://{h}.com/{p}") for i, (h, p) in enumerate(free)] + [(2000 + i, f"https://{h}.example.org/{p}") for i, (h, p) in enumerate(free)]
    judged = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"))
    got = {r.page_id: r for r in judged.collect()}
    assert sum((got[1000 + i].verdict == "block") == (i % 2 == 1) for i in range(100)) >= 95
    for i in range(100):
        a, b = got[1000 + i], got[2000 + i]
        assert a.rule is None and b.rule is None and a.score == pytest.approx(b.score, abs=1e-9) and a.verdict == b.verdict
    shares = {r.suffix: r for r in urls.report(judged).collect()}
    assert shares["com"].n_free == 100 and shares["com"].free_blocked == sum(got[1000 + i].verdict == "block" for i in range(100)) / 100
    assert shares["org"].accepted_right >= 0.9 and shares["net"].rejected_right >= 0.9 and shares["net"].n_free == 0


def brute_markov(texts, n=charlm.N):
    """Witten-Bell by the book."""
    after = defaultdict(Counter)
    for x in texts:
        t = urls.END * (n - 1) + x
        for i in range(len(x)):
            for k in range(n):
                after[t[i + n - 1 - k : i + n - 1]][t[i + n - 1]] += 1

    def p(context, unit, base):
        shorter = p(context[1:], unit, base) if context else base
        seen = after.get(context)
        return (seen[unit] + len(seen) * shorter) / (sum(seen.values()) + len(seen)) if seen else shorter

    return p


def test_url_scores_are_witten_bell(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 6)))
    some = [f"http://{word()}.{rng.choice(['example.net', 'a.net', 'org', 'info', 'example.com'])}/{rng.choice(['en', 'fr', 'de', 'x'])}/{word()}{rng.choice(['', '?q=1', '#é'])}" for _ in range(150)] + ["http://x.org/fr/", "", "odd"]
    df = spark.createDataFrame(list(enumerate(some)), "page_id int, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    fold = {r.page_id: r.fold for r in df.select("page_id", F.pmod(F.xxhash64(urls.host_path("url")[0]), F.lit(urls.FOLDS)).alias("fold")).collect()}

    def text(u):
        if "://" not in u:
            return urls.END
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        own = [x for x in host.translate(LOWER).split(".")[:-1] if x not in ("net", "example", "com", "org")]
        return ".".join(own) + re.sub(r"^/[^/?#]*", "", rest[len(host) :]) + urls.END

    verdict = {i: brute_rule(u)[3] for i, u in enumerate(some)}
    models = [brute_markov([text(u) for i, u in enumerate(some) if verdict[i] == v and fold[i]]) for v in ("block", "allow")]
    base = 1 / (1 + len(set("".join(text(u) for i, u in enumerate(some) if verdict[i] and fold[i]))))
    scores = {}
    for i, u in enumerate(some):
        t = urls.END * 4 + text(u)
        logs = [sum(np.log(p(t[j : j + 4], t[j + 4], base)) for j in range(len(t) - 4)) for p in models]
        scores[i] = (logs[0] - logs[1]) / (len(t) - 4)
        assert got[i].score == pytest.approx(scores[i], rel=1e-3, abs=1e-4), u
        assert got[i].held_out == (verdict[i] is not None and fold[i] == 0)
    # the cut: between the highest score allowed and the lowest blocked; at most a twentieth of held-out accepted above it
    free = [i for i in scores if verdict[i] is None]
    cut = [max((scores[i] for i in free if got[i].verdict == "allow"), default=-99), min((scores[i] for i in free if got[i].verdict == "block"), default=99)]
    held = [scores[i] for i in scores if verdict[i] == "allow" and not fold[i]]
    assert cut[0] < cut[1] + 1e-3 and sum(x > cut[1] + 1e-3 for x in held) <= urls.FALSE_BLOCK * len(held)


def test_url_cut(spark):
    def cut(accepted, rejected, share=0.05):
        rows = [(float(x), False) for x in accepted] + [(float(x), True) for x in rejected]
        return urls.cut_between(spark.createDataFrame(rows, "score double, rejected boolean"), share)

    assert abs(cut([-7, -6], [6, 7])) < 0.02  # the middle of the gap
    noise = [random.Random(i).gauss(0, 1) for i in range(400)]
    c = cut(noise, noise)
    assert sum(x > c for x in noise) <= 20 and sum(x > c - 0.05 for x in noise) > 20
    assert abs(cut(noise, noise, 1.0) - sorted(noise)[200]) < 0.05
    assert cut([], [1]) == cut([1], []) == 0.0
    assert cut([-99], [99]) == pytest.approx(0, abs=0.02)


# ---- 3 ---------------------------------------------------------------------


def test_archives(spark, agree):
    agree(queries.op3_arc_to_warc, warc.SQL)
    x = "x" * 150
    pages = spark.createDataFrame([(1, "http://a b/", None, "d"), (2, None, x, "d"), (3, "u\nv", x, "d"), (4, "ü://ü/", "é" * 60, "d"), (5, "", "", "d"), (5, "e", x, "d"), (None, "n", x, "d"), (6, "s", "short", "d"), (7, "s", "short", "d"), (0, "long", "y" * 3_000_000, "d"), (9, "h", "HTTP/1.1 200\r\n\r\n" + x, "d")], "page_id bigint, url string, html string, digest string")
    got = rows_of(warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(r.page_id, len((r.html or "").encode()), sha(r.html), "revisit" if r.html == x and r.page_id != 2 else "response", 2 if r.html == x and r.page_id != 2 else None) for r in pages.collect()]
    assert got == sorted(want, key=repr)
    assert warc.archive(pages.limit(0)).isEmpty()


class _Stream:
    def __init__(self, raw, step):
        self.raw, self.at, self.step = raw, 0, step

    def read(self, n):
        out = self.raw[self.at : self.at + min(n, self.step)]
        self.at += len(out)
        return out


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    blocks = [b"", b"HTTP/1.1 200 OK\r\n\r\nbody\nhttp://not.a.header 1.1.1.1 2000 text/html 3\n", bytes(range(256)) * 50]
    raw = warc.member(warc.arc_version_block("f.arc", "20010203040506", version)) + b"".join(warc.member(warc.arc_record(f"http://x/{i}", "20010203040506", b, version, "f.arc", i)) for i, b in enumerate(blocks))
    for step in (1, 7, 1 << 20):
        got = list(warc.read_arc(_Stream(raw, step)))
        assert [r["block"] for r in got] == blocks and {r["version"] for r in got} == {version} and {r["status"] for r in got} == {None if version == 1 else 200}
    assert list(warc.read_arc(_Stream(raw, 99))) == got
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_arc(_Stream(raw[:-9], 99)))
    with pytest.raises(ValueError, match="fields"):
        list(warc.read_arc(_Stream(warc.member(warc.arc_version_block("f", "2001", version)) + warc.member(b"http://x 1.1.1.1\n"), 99)))
    with pytest.raises(ValueError, match="declared"):
        list(warc.read_arc(_Stream(warc.member(warc.arc_version_block("f", "2001", version)) + warc.member(warc.arc_record("u", "2001", b"12345", version)[:-4]), 99)))
    assert warc.iso_date("2001") == "2001-01-01T00:00:00Z" and warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z" and warc.iso_date("x").startswith("1970")


@pytest.mark.parametrize("version", [1, 2])
def test_damaged_and_odd_arc_records(spark, tmp_path, version):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 150
    good = lambda url: warc.member(warc.arc_record("U", "20010203", block, version, "f.arc").replace(b"U ", url + b" ", 1))
    raw = warc.member(warc.arc_version_block("f.arc", "2001", version)) + good(b"http://a/with two blanks") + warc.member(b"http://x 1.1.1.1\n") + good(b"http://b/") + warc.member(warc.arc_record("u", "2001", b"12345", version)[:-4]) + good(b"http://c/") + b"no member"
    with pytest.raises(ValueError, match="fields"):
        list(warc.read_arc(_Stream(raw, 99)))
    got = list(warc.read_arc(_Stream(raw, 99), "PERMISSIVE"))
    assert [r.get("url") for r in got] == ["http://a/with two blanks", None, "http://b/", None, "http://c/", None] and [r["block"] for r in got if "url" in r] == [block] * 3
    (tmp_path / "f.arc.gz").write_bytes(raw)
    archives = spark.createDataFrame([("f.arc.gz",)], "archive string")
    index = warc.arc_index(spark, tmp_path.as_uri(), archives, "PERMISSIVE")
    assert index.where("error is not null").count() == 3
    kind = spark.range(1).schema["id"].dataType
    files = warc.convert_archives(spark, tmp_path.as_uri(), tmp_path.as_uri(), warc.choose_responses(index, kind))
    rows = warc.read_warcs(spark, tmp_path.as_uri(), files, kind).orderBy("url").collect()
    assert [(r.url, r.record_type) for r in rows] == [("http://a/with two blanks", "response"), ("http://b/", "revisit"), ("http://c/", "revisit")]
    with pytest.raises(Exception, match="fields"):
        warc.arc_index(spark, tmp_path.as_uri(), archives).collect()


# ---- 4 ---------------------------------------------------------------------

SECRET = 'password = "hunter2hunter2"'


def brute_base(text):
    out = []
    for k, pattern in enumerate([r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+"]):
        for m in re.finditer(pattern, text or ""):
            if (len(m[2]) >= 6) if k == 0 else len(m[0]) >= (20, 24)[k - 1]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secret_query(spark, odd, docs):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["deadbeef" * 3, "deadbeef" * 2 + "deadbee", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "token=token=abcdef", "token: token: abcdef", "xtokeny='abcde", "API_KEY:abcdef é apikey = 'x.y-z_/+'", "aaaaaaaaaaaaaaa", "aaaaaaaaaaaa", "bbbbbbbbbbbbb"])], "doc_id bigint, text string")
    for df in (odd, more, docs):
        got = secrets.scan(df).collect()
        assert len(got) == df.count()
        want = Counter((r.doc_id, hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute_base(r.text)).encode()).hexdigest(), tuple(sum(k == j for _, k, _ in brute_base(r.text)) for j in range(3))) for r in df.collect())
        assert Counter((r.doc_id, r.base_sha256, (r.n_assign, r.n_access, r.n_hex)) for r in got) == want
    assert secrets.scan(odd.limit(0)).isEmpty()


def test_nested_secrets(spark):
    import base64
    import bz2
    import gzip
    import lzma
    from urllib.parse import quote

    import zstandard

    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    url = lambda x: quote(x, safe="")
    uni = lambda x: "".join(f"\\u{ord(c):04x}" for c in x)
    layers = {"url": url, "unicode": uni, "base64": b64, "gzip": lambda x: b64(gzip.compress(x.encode())), "bz2": lambda x: b64(bz2.compress(x.encode())), "xz": lambda x: b64(lzma.compress(x.encode())), "zstd": lambda x: b64(zstandard.compress(x.encode())), "zlib": lambda x: b64(zlib.compress(x.encode())), "entity": lambda x: "".join(f"&#{ord(c)};" for c in x)}
    cases = [f"é {f(SECRET)} z" for f in layers.values()] + [f"é {f(g(SECRET))} z" for f in layers.values() for g in layers.values()] + ["é " + b64(gzip.compress(gzip.compress(url(SECRET).encode()))) + " z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id bigint, text string")
    for r in secrets.scan(df).collect():
        assert r.n_inner >= 1, cases[r.doc_id]
        for span in r.spans.split(","):
            kind, a, b = span.split(":")
            assert 2 <= int(a) < int(b) <= len(cases[r.doc_id]) - 2
    for r in secrets.mask(df).collect():
        assert "[secret]" in r.text and r.text.startswith("é ")
    # URL escapes map back to the characters they stand for
    text = "see " + url(SECRET) + " end"
    ((a, _, b),) = secrets.inner_spans(text)
    assert text[a:b] == url(SECRET)[: -len("%22")]
    for quiet in ("100%25 %%% \\u \\x &# plain", "a" * 40, b64("\x00\x01binary\xff" * 9), "%zz", "%25" * 30, "\\u005cu005c" * 9):
        assert not secrets.inner_spans(quiet)


def hidden(text):
    """The kinds found in the layers of a text, all within it."""
    got = secrets.inner_spans("é " + text + " z")
    assert all(2 <= a < b <= len(text) + 2 for a, _, b in got)
    return {kind for _, kind, _ in got}


def test_joined_wrapped_and_binary_layers():
    import base64
    import gzip
    import lzma

    b64 = lambda x: base64.b64encode(x).decode()
    wrapped = lambda x, end="\n": end.join(x[i : i + 76] for i in range(0, len(x), 76))
    secret, noise = b'api_key = "abcdef0123456789abcdef0123"', random.Random(1).randbytes(300)
    long = gzip.compress(noise.hex().encode() + b" " + secret)
    cases = [front + b64(secret) for front in ("", "a/", "x-", "/v1/", "key_")] + ["a/" + b64(long), "a/" + b64(zlib.compress(secret))]
    cases += [wrapped(b64(long)), wrapped(b64(long), "\r\n"), wrapped(b64(b"x" * 40 + b" " + secret)), b64(noise[:31] + b"\0" + secret + b"\0" + noise[:31])]
    for f in (gzip.compress, zlib.compress, lzma.compress):
        cases += ["".join(f"%{x:02X}" for x in f(secret)), "".join(f"\\x{x:02x}" for x in f(secret)), repr(f(secret))]
    for text in cases:
        assert hidden(text) >= {"assign", "hex"}, text


def test_all_of_a_compressed_stream():
    import base64
    import bz2
    import gzip
    import lzma

    import zstandard

    b64 = lambda x: base64.b64encode(x).decode()
    secret = b'api_key = "abcdef0123456789abcdef0123"'
    for f in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        assert hidden(b64(f(b"nothing here") + f(secret))) >= {"assign", "hex"}
    deep = secret
    for _ in range(20):
        deep = gzip.compress(deep)
    large = b"a quiet line of the log\n" * 3_000_000 + secret
    dense = random.Random(1).randbytes(6_000_000) + b"\n" + secret
    for x in (deep, gzip.compress(large), bz2.compress(bz2.compress(large)), gzip.compress(gzip.compress(dense))):
        assert hidden(b64(x)) >= {"assign", "hex"}


def test_wide_and_binary_text():
    import base64
    import gzip

    b64 = lambda x: base64.b64encode(x).decode()
    for raw in (b"password = hunter2hunter2\0", b"\xff\x01password = hunter2hunter2\xfe", "password = hunter2hunter2".encode("utf-16-le"), "password = hunter2hunter2".encode("utf-16-be"), "\ufeffé password = hunter2hunter2".encode("utf-16-le")):
        assert hidden(b64(raw)) == {"assign"} == hidden(b64(gzip.compress(raw))), raw
    # exact spans: the characters of base64 that the match was decoded from
    for raw, at, end in (("abcd password = hunter2hunter2".encode("utf-16-le"), 10, 60), (b"abc password = hunter2hunter2 abc", 4, 29), ("é password = hunter2hunter2".encode(), 3, 28)):
        ((a, _, b),) = secrets.inner_spans("see " + b64(raw) + " end")
        assert (a, b) == (4 + at * 8 // 6, 4 + -(-end * 8 // 6))


def brute_layers(text, depth=0):
    """Another decoder: everything that a few standard functions can make of a text, level by level."""
    import base64
    import bz2
    import codecs
    import gzip
    import html
    import lzma
    from urllib.parse import unquote

    import zstandard

    out = {unquote(text), html.unescape(text)} - {text}
    with_escapes = re.sub(r"\\\\u[0-9a-f]{4}", lambda m: codecs.decode(m[0], "unicode_escape"), text)
    out |= {with_escapes} - {text}
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}", text):
        try:
            raw = base64.b64decode(m[0] + "=" * (-len(m[0]) % 4))
        except ValueError:
            continue
        for f in (lambda x: x, gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress, lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x)):
            try:
                data = f(raw)
                out |= {data.decode("utf-16-le" if data[1:2] == b"\0" else "utf-8")}
            except Exception:  # noqa: S112
                continue
    return out | {y for x in out if depth < 5 for y in brute_layers(x, depth + 1)}


def test_planted_secrets_against_another_decoder():
    """Random nests of encodings: what the other decoder finds is found, and at least nine of ten secrets are."""
    import base64
    import bz2
    import gzip
    import lzma
    from urllib.parse import quote

    import zstandard

    rng = random.Random(11)
    b64 = lambda x: base64.b64encode(x).decode()
    packers = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress]
    encoders = [lambda x: quote(x, safe=""), lambda x: "".join(f"\\u{ord(c):04x}" for c in x), lambda x: "".join(f"&#{ord(c)};" for c in x), lambda x: b64(x.encode()), lambda x: b64(x.encode("utf-16-le")), lambda x: b64(rng.choice(packers)(x.encode()))]
    secret = {"assign": lambda: "password=" + "".join(rng.choices("abcXYZ123", k=12)), "access": lambda: "AKIA" + "".join(rng.choices("ABCDEFGH234", k=16)), "hex": lambda: "".join(rng.choices("0123456789abcdef", k=32))}
    found = n = 0
    for _ in range(150):
        kind = rng.choice(list(secret))
        text = "x " + secret[kind]() + " y"
        for _ in range(rng.randint(1, 4)):
            text = "some words " + rng.choice(encoders)(text) + " and more"
        got = {k for _, k, _ in secrets.inner_spans(text)}
        brute = {secrets.KINDS[k] for layer in brute_layers(text) for _, k, _ in brute_base(layer)}
        assert brute <= got | {k for _, k, _ in secrets.base_spans(text)}, text
        found, n = found + (kind in got), n + 1
    assert found >= 0.98 * n


def test_mask_keeps_columns(odd):
    out = secrets.mask(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert Counter(r.text is None for r in out.collect()) == Counter(r.text is None for r in odd.collect())
    assert not [r for r in out.collect() if r.text and "abcdef0123456789abcdef0123" in r.text]


# ---- 5 ---------------------------------------------------------------------


def brute_stats(text):
    w, t = words_of(text), text or ""
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = Counter(x for x in t.split("\n") if words_of(x))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), sum(n - 1 for n in lines.values()), len(covered)


def test_quality(spark, odd, docs, agree):
    agree(queries.op5_host_rules, quality.SQL)
    got = quality.judge(odd).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.STATS)) for r in got) == Counter((r.doc_id, *brute_stats(r.text)) for r in odd.collect())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge(odd.limit(0)).isEmpty() and quality.keep(odd.limit(0)).isEmpty()
    kept = Counter(r.doc_id for r in got if r.kept)
    out = quality.keep(odd)
    assert Counter(r.doc_id for r in out.collect()) == kept and out.columns == odd.columns


def test_hosts_are_rejected(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "few words"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "junk") for i in range(200)] + [(5000, good, "new"), (5001, bad, "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[1].kept and not got[1010].kept and not got[1010].base_failed and got[5000].kept
    assert got[5001].host_rate < 1 and not got[5001].kept
    assert {r.doc_id for r in quality.keep(df).collect()} == {k for k, r in got.items() if r.kept}


def test_keep_with_clashing_names(spark):
    good = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, good, "h", 1, 2, 3), (2, "few", "h", 1, 2, 3)], "doc_id int, text string, source string, _host int, base_failed int, its_host int")
    out = quality.keep(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, good, "h", 1, 2, 3)]


# ---- 6, 8, 10 --------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


@pytest.mark.parametrize("words", [bpe.CACHE_WORDS, 100])
def test_words_are_split_as_the_library_does(library, monkeypatch, words):
    monkeypatch.setattr(bpe, "SLICE", 1000)
    rng = random.Random(1)
    alphabet = [*"ab'sdtmrel \n\t\r\x0b\x0c\x1c\x1d\x1f\x85\xa0\xad0123²½ªéñ_-.,!×÷ȻɀΩж中٣\u2028\u3000😀́", "<|endoftext|>", "'ll"]
    texts = ["".join(rng.choices(alphabet[: rng.choice([33, 60])], k=rng.randint(0, 25))) for _ in range(6000)]
    enc = bpe.WordEncoder(queries.tokenizer())
    monkeypatch.setattr(bpe, "CACHE_WORDS", words)
    for a, rows in enc.encode_all(pa.array(texts)):
        for j, x in enumerate(rows):
            assert np.frombuffer(x, "<u4").tolist() == library.encode(texts[a + j], add_special_tokens=False).ids, texts[a + j]


def encoded(df, library):
    return [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()]


def brute_bpe(df, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return sorted(((d, len(i), sha(",".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for d, i in encoded(df, library)), key=repr)


@pytest.mark.parametrize("block,shard", [(bpe.BLOCK, bpe.SHARD_WORDS), (2000, 50)])
def test_bpe(odd, docs, library, monkeypatch, block, shard):
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe, "SHARD_WORDS", shard)
    for df in (odd, docs):
        ids = bpe.encode(df, queries.tokenizer())
        assert rows_of(bpe.digests(bpe.decode(ids, queries.tokenizer()))) == brute_bpe(df, library)
    assert bpe.encode(odd.limit(0), queries.tokenizer()).isEmpty()


def test_bpe_query(spark, docs, library):
    assert rows_of(queries.op10_word_table_bpe(spark, SF)) == brute_bpe(docs, library)


@pytest.mark.parametrize("part", [bpe.PART, 5])
def test_decode_as_the_library_does(spark, library, monkeypatch, part):
    monkeypatch.setattr(bpe, "PART", part)
    rng = random.Random(2)
    size = library.get_vocab_size(with_added_tokens=True)
    lists = [None, [], [464, 2], [10**6, 0, -5], [None, 464, None], *([rng.randrange(size) for _ in range(rng.choice([1, 12, 3000]))] for _ in range(60))]
    df = spark.createDataFrame([(i, "kept", x, "k", i) for i, x in enumerate(lists)] + [(2, "kept", [464, 2], "k", 2)], "id int, text string, token_ids array<int>, piece string, part int").coalesce(2)
    got = bpe.decode(df, queries.tokenizer())
    assert got.columns == ["id", "token_ids", "piece", "part", "text"]
    rows = got.collect()
    assert len(rows) == len(lists) + 1
    for r in rows:
        own = lists[r.id]
        assert (r.token_ids, r.piece, r.part) == (own, "k", r.id)
        assert r.text == (None if own is None else library.decode([x for x in own if x is not None and 0 <= x < size], skip_special_tokens=False))
    assert bpe.decode(df, queries.tokenizer(), out_col="out").where("id = 2").first().text == "kept"
    assert bpe.decode(df.limit(0), queries.tokenizer()).isEmpty()
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString() and "piece_id" in got._jdf.queryExecution().toString()


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=20), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packing(words, numbers):
    raw, sizes = "".join(words).encode(), [len(w.encode()) for w in words]
    data, got = bpe.unpack_words(bpe.pack_words(np.frombuffer(raw, np.uint8), np.array(sizes, np.int64)))
    assert data.tobytes() == raw and got.tolist() == sizes
    h = bpe.word_hashes(data, got).tolist()
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(i))
    assert bpe.unpack_numbers(bpe.pack_numbers(np.array(numbers, "<u4"))).tolist() == numbers
    assert jaccard.unpack(jaccard.pack(np.array(sorted(numbers), np.uint64), True), True).tolist() == sorted(numbers)


@pytest.mark.parametrize("ids,rows", [(tokenbin.FILE_IDS, tokenbin.FILE_DOCS), (3000, 1 << 20), (1 << 28, 1)])
def test_token_files(spark, odd, docs, library, tmp_path, monkeypatch, ids, rows):
    monkeypatch.setattr(tokenbin, "FILE_IDS", ids)
    monkeypatch.setattr(tokenbin, "FILE_DOCS", rows)
    for name, df in (("docs", docs), ("odd", odd)):
        path = (tmp_path / name).as_uri()
        manifest = tokenbin.write(df, path, queries.tokenizer())
        got = [tuple(r) for r in tokenbin.read(spark, path, manifest, df.schema["doc_id"].dataType).collect()]
        assert len(manifest) > 4 or ids > 3000
        want, at = [], 0
        for d, own in sorted(encoded(df, library), key=lambda x: (x[0] is not None, x[0] or 0)):
            want.append((d, len(own) + 1, zlib.crc32(np.array([*own, 2], "<u4").tobytes())))
        assert Counter((d, n, c) for d, _, n, c in got) == Counter(want)
        for d, start, n, _ in sorted(got, key=lambda r: r[1]):
            assert start == at
            at += n
        assert [d for d, *_ in sorted(got, key=lambda r: r[1])] == [d for d, *_ in want]
    assert tokenbin.write(odd.limit(0), (tmp_path / "none").as_uri(), queries.tokenizer()) == []
    assert tokenbin.read(spark, path, [], odd.schema["doc_id"].dataType).isEmpty()


def test_token_file_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "CHUNK", 7)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 1 << 32, rng.integers(0, 40), dtype=np.uint64).astype("<u4") for _ in range(50)]
    with open(tmp_path / "t", "wb") as f:
        w = tokenbin.Writer(f)
        for i, d in enumerate(docs):
            w.add(pa.array([i]), [d.tobytes()])
        w.close()
    raw = (tmp_path / "t").read_bytes()
    with open(tmp_path / "t", "rb") as f:
        r = tokenbin.Reader(f, len(raw))
        assert [x.tolist() for _, x in r.documents()] == [d.tolist() for d in docs]
        assert np.concatenate([r.chunk(k) for k in reversed(range(len(r.sizes)))][::-1]).tolist() == np.concatenate(docs).tolist()
        assert set(r.sizes[:-1]) == {7}
    (tmp_path / "cut").write_bytes(raw[:-3])
    with open(tmp_path / "cut", "rb") as f, pytest.raises(ValueError):
        tokenbin.Reader(f, len(raw) - 3)


def test_lengths(spark, odd, docs, library, monkeypatch):
    monkeypatch.setattr(lengths, "RANGE", 50)
    for df in (odd, docs):
        n = np.array([len(i) for _, i in encoded(df, library)])
        hist = lengths.histogram(df, queries.tokenizer())
        want = [(int(v), int((n == v).sum()), int((n <= v).sum()), int((n > v).sum()), int(n[n <= v].sum()), int(np.minimum(n, v).sum()), int((n - np.minimum(n, v)).sum())) for v in np.unique(n)]
        assert rows_of(hist) == sorted(want, key=repr)
        for limit in (0, 1, 100, 10**6):
            assert lengths.totals(hist, limit) == {"docs": len(n), "tokens": n.sum(), "kept": np.minimum(n, limit).sum()}
        for share in (0.01, 0.5, 1.0):
            assert lengths.quantile(hist, share) == min(v for v in n if (n <= v).mean() >= share)
    empty = lengths.histogram(odd.limit(0), queries.tokenizer())
    assert empty.isEmpty() and lengths.quantile(empty, 0.5) is None and lengths.totals(empty, 5)["docs"] == 0


# ---- 7 ---------------------------------------------------------------------


def brute_model(texts, n=charlm.N):
    """Counts, discounts and interpolation by the book: P(unit | context) as a function."""
    edge = "\uffff"
    raw = Counter(t[i : i + n] for x in texts for t in [edge * (n - 1) + x] for i in range(len(x)))
    levels = {n: raw}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {}
    for k, c in levels.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else 0.0
        d = (1 - 2 * y * m[2] / m[1] if m[1] else 0.5, 2 - 3 * y * m[3] / m[2] if m[2] else 1.0, 3 - 4 * y * m[4] / m[3] if m[3] else 1.5)
        cut[k] = [min(max(v, 0.0), float(i)) for i, v in enumerate(d, 1)]
    after = {k: defaultdict(dict) for k in levels}
    for k, c in levels.items():
        for g, v in c.items():
            after[k][g[:-1]][g[-1]] = v

    def p(context, unit):
        if not context:
            shorter = 1 / (len(levels[1]) + 1)
        else:
            shorter = p(context[1:], unit)
        seen = after[len(context) + 1].get(context)
        if not seen:
            return shorter
        off = lambda v: cut[len(context) + 1][min(v, 3) - 1]
        left = sum(off(v) for v in seen.values())
        return (max(seen.get(unit, 0) - off(seen[unit]), 0) + left * shorter) / sum(seen.values()) if unit in seen else left * shorter / sum(seen.values())

    return p, sorted(levels[1])


def brute_perplexity(p, text, n=charlm.N):
    padded = "\uffff" * (n - 1) + text
    return np.exp(-np.mean([np.log(p(padded[i : i + n - 1], padded[i + n - 1])) for i in range(len(text))])) if text else None


TRAINED = ["the cat sat on the mat. the cat ran", "a rat", "", "né à Évry, né à Paris 😀 中文 中文", "the mat sat on the cat"]
JUDGED = [*TRAINED, None, "the rat ran on", "zzz 😀", "中文", "t", "x" * 3000 + " the cat"]


@pytest.mark.parametrize("block,shard,asked,direct", [(charlm.BLOCK, charlm.SHARD, charlm.ASKED, charlm.DIRECT), (30, 20, 7, 100)])
def test_perplexity_is_kneser_ney(spark, monkeypatch, block, shard, asked, direct):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("ASKED", asked), ("DIRECT", direct)):
        monkeypatch.setattr(charlm, name, value)
    scratch = Scratch(spark, "test")
    counts = charlm.gram_counts(spark.createDataFrame([(t,) for t in [*TRAINED, None]], "text string"))
    model, unseen = kneser.kneser_ney(counts, scratch)
    rows = spark.createDataFrame([(i, "en", 0, t) for i, t in enumerate(JUDGED)], "id bigint, lang string, fold int, text string")
    got = {r.id: r for r in charlm.scored(rows, charlm.keyed(model), kneser.surprise(unseen), "nats", scratch).collect()}
    p, units = brute_model(TRAINED)
    assert len(got) == len(JUDGED)
    for i, t in enumerate(JUDGED):
        assert got[i].size == len(t or "")
        if t:
            assert np.exp(got[i].nats / got[i].size) == pytest.approx(brute_perplexity(p, t), rel=1e-4), t
    for context in ("", "c", "the ", "\uffff" * 4, "zzz", "né "):
        assert sum(p(context, u) for u in units) + p(context, "\x01") == pytest.approx(1)


def test_classifier(spark, odd, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op7_kneser_ney(spark, SF)
    assert got.count() == docs.count()
    both = got.join(labels, "doc_id").collect()
    good = [r for r in both if r.quality == 1 and r.toxic == 0]
    bad = [r for r in both if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.95 * len(good) and sum(r.kept for r in bad) <= 0.5 * len(bad)
    marks = spark.createDataFrame([(7, 1, 0), (10, 1, None), (11, None, 0), (12, 1, 1), (None, 1, 0), (13, 1, 0), (13, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = kneser.judge(odd, marks).collect()
    assert len(out) == odd.count() and all(r.perplexity is None and not r.kept for r in out if r.doc_id in (0, 1)) and next(r for r in out if r.doc_id == 7).kept
    assert kneser.judge(odd.limit(0), marks).isEmpty()
    untold = kneser.judge(odd, marks.limit(0)).collect()
    assert all(r.kept == (r.doc_id not in (0, 1) and r.doc_id is not None or r.doc_id is None and r.kept) for r in untold)


def test_threshold_is_the_language_quantile(spark):
    """The whole operator by brute force: model of four fifths, quantile of the last fifth by language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").select("doc_id").distinct().collect()}
    rows = docs.selectExpr("doc_id", "lang", "text", f"pmod(xxhash64(text), {kneser.FOLDS}) as fold").collect()
    p, _ = brute_model([r.text for r in rows if r.doc_id in trusted and r.fold and r.text])
    memo = {r.text: brute_perplexity(p, r.text) for r in rows if r.text}
    mean = sum(np.log(memo[r.text]) * len(r.text) for r in rows if r.doc_id in trusted and r.text) / sum(len(r.text) for r in rows if r.doc_id in trusted and r.text)
    steady = lambda t: np.exp((np.log(memo[t]) * len(t) + kneser.PRIOR * mean) / (len(t) + kneser.PRIOR))
    for share in (0.5, 0.9):
        got = {r.doc_id: r for r in kneser.judge(docs, labels, share=share).collect()}
        held = [(r.lang, steady(r.text)) for r in rows if r.doc_id in trusted and r.text and not r.fold]
        for r in rows:
            own = sorted(s for lang, s in held if lang == r.lang) or sorted(s for _, s in held)
            t = own[max(0, int(np.ceil(share * len(own))) - 1)]
            assert got[r.doc_id].threshold == pytest.approx(t, rel=1e-4)
            if r.text:
                assert got[r.doc_id].perplexity == pytest.approx(memo[r.text], rel=1e-4)
                assert got[r.doc_id].kept == (steady(r.text) <= t) or abs(steady(r.text) / t - 1) < 1e-4


# ---- 9 ---------------------------------------------------------------------


def brute_components(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(s), min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def crowd(n, seed):
    """Copies, and variants of variants at all distances around the threshold."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    passage = rng.choices(vocabulary, k=50)
    out = [rng.choices(vocabulary, k=rng.choice([3, 8, 40, 60, 120])) for _ in range(6)]
    while len(out) < n:
        w = list(rng.choice(out))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = w + passage if rng.random() < 0.5 else w[: max(1, len(w) - rng.randrange(8))]
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed,fragment,block", [(1, jaccard.FRAGMENT, jaccard.BLOCK), (2, 300, 500), (3, 300, 20)])
def test_components_of_a_crowd(spark, monkeypatch, seed, fragment, block):
    monkeypatch.setattr(jaccard, "FRAGMENT", fragment)
    monkeypatch.setattr(jaccard, "FRAGMENTS", 3)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ROW", 0)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 4)
    if seed == 3:  # all by joins
        monkeypatch.setattr(jaccard, "FILTER_KEYS", 0)
        monkeypatch.setattr(jaccard, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(graph, "SMALL", 0)
    rows = crowd(250, seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert rows_of(jaccard.components(df)) == brute_components(rows)


def test_dealt_rows_are_even(spark, monkeypatch):
    """No fragment gets much more than another, and rows of blocks by fragments do not outgrow the shingles."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghijklmnopqrst", k=60))) for i in range(2000)], "key bigint, text string").coalesce(2)
    got = jaccard._deal(docs, 5, 20, 2000).selectExpr("fragment", "octet_length(keys) + octet_length(owners) + octet_length(classes) + coalesce(octet_length(table), 0) as n").groupBy("fragment").sum("n").collect()
    size = sorted(r[1] for r in got)
    assert len(size) == 20 and size[-1] < 2 * size[10]
    assert jaccard.grown(1_000_000, 10**8) == 1_000_000
    for total in (10**10, 10**12, 10**14):
        rows = (total / jaccard.grown(jaccard.BLOCK, total)) * (total / jaccard.grown(jaccard.FRAGMENT, total))
        assert rows <= total / jaccard.ROW * 1.01


def test_blocks_do_not_depend_on_order(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghij", k=9000))) for i in range(150)], "key bigint, text string").coalesce(1)
    cut = lambda df: sorted(tuple(r) for r in jaccard._deal(df.sortWithinPartitions("key"), 5, 4, 1000).collect())
    assert cut(docs) == cut(docs.sort(F.desc("key")).coalesce(1))


def test_representatives_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4), (2, text, 1, 2, 3, 4), (1, text, 1, 2, 3, 4)], "doc_id int, text string, id int, key int, _gone int, _again int")
    assert [r.doc_id for r in jaccard.representatives(docs).collect()] == [1]


def test_components(spark, odd, agree):
    agree(queries.op9_vertical_jaccard, jaccard.SQL)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(jaccard.components(odd)) == brute_components(rows)
    assert jaccard.components(odd.limit(0)).isEmpty()
    unlinked = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    assert rows_of(jaccard.components(unlinked)) == [(1, 2, 1), (2, 0, 2)]


def test_null_ids_leave_other_links(spark):
    texts = [" ".join(f"w{p}x{j}" for j in range(60)) for p in range(40)]
    pairs = [(2 * p + i, t + " end" * i) for p, t in enumerate(texts) for i in range(2)]
    rows = pairs + [(None, texts[p] + " other") for p in range(5)]
    got = rows_of(jaccard.components(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)))
    assert [r for r in got if r[0] is not None] == sorted(((i, 56 + i % 2, i - i % 2) for i, _ in pairs), key=repr)
    assert Counter(r[2] for r in got if r[0] is None) == Counter(2 * p for p in range(5))


def test_representatives(spark, odd):
    out = jaccard.representatives(odd)
    assert out.columns == odd.columns
    want = Counter()
    seen = set()
    for (d, t), (_, n, c) in zip(sorted(((r.doc_id, r.text) for r in odd.collect()), key=repr), brute_components(sorted(((r.doc_id, r.text) for r in odd.collect()), key=repr)), strict=True):
        if d == c and not (n and (d, t) in seen):
            want[d] += 1
            seen.add((d, t))
    assert Counter(r.doc_id for r in out.collect()) == want
    assert jaccard.representatives(odd.limit(0)).isEmpty()


def brute_graph(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("small", [graph.SMALL, 0])
def test_graph(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7), (None, 3), (5, None), (1, 0), (0, 1)]
    rows = lambda e: spark.createDataFrame(e, "a bigint, b bigint")
    got = dict(tuple(r) for r in graph.components(rows(edges), Scratch(spark, "g")).collect())
    assert got == brute_graph(edges)
    assert graph.components(rows([]), Scratch(spark, "g")).isEmpty()
    # bit by bit: the same, each node once
    rng.shuffle(edges)
    scratch, found = Scratch(spark, "g"), None
    for k, at in enumerate(range(0, len(edges), 60)):
        found = graph.merged(found, rows(edges[at : at + 60]), scratch, f"m{k}", lambda df: df)
    got = [tuple(r) for r in found.collect()]
    assert dict(got) == brute_graph(edges) and len(got) == len(dict(got))
