"""Exact Jaccard join of documents on word shingles, by vertical partitioning.

The global order of shingles (64-bit hashes, A-Z lower-cased) is cut into
fragments. Each fragment sees only its part of every set:

1. Sets. Documents with equal sets form a class, which stands for them all.
2. Sharing. Every block of documents sends each of its shingles once to the
   shingle's fragment, which tells which ones occur in other classes too; the
   counts are summed per class. A pair at similarity t shares at least t of
   either set, so only classes with that share of common shingles stay.
3. Candidates. With the most frequent shingles (a bounded list) last in the
   order, linked sets share one of the first (1 - t) * n + 1 shingles. These
   prefixes go to their fragments, which pair the sets that meet there.
4. Overlaps. Each fragment counts, for every candidate pair, the shingles it
   has of both; the partial counts are summed per pair and tested exactly.

Only components are asked for, so no group is expanded into all its pairs: in
the first rounds sets are paired with one set of each place where they meet;
what these links join is one component, and the last round pairs only sets of
different components. Dropping those pairs loses no link between components.
Sets whose overlaps with one centre show that they cannot link are not paired
either.

Null and empty texts have no shingles and link with nothing; texts of fewer
words than a shingle have one, their whole sequence. Repeated rows are copies.
An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import graph
from gridloom.llm.textkern import distinct, mix, shingle_sets, slices
from gridloom.runtime import Scratch, give_back, release, ship, unused

#: Least shingles of a fragment; a task holds one fragment at a time.
FRAGMENT = 2_500_000
#: Hashes of sets that a task cuts up at a time.
PART = 500_000
#: There are at least so many fragments.
FRAGMENTS = 40
#: Least shingles of a block of documents, which one task holds before it deals them out.
BLOCK = 1_000_000
#: Every block sends a row to every fragment. Both grow with the square root of the corpus, so that a row keeps so many shingles on average.
ROW = 100
#: The most frequent shingles, put last in the order: at most so many are sent to all tasks.
FREQUENT = 131_072
#: A shingle may be in that list if so many classes, or blocks of them, have it.
FREQUENT_FROM = 16
#: Keys of documents up to so many are sent to all tasks.
BROADCAST_KEYS = 2_000_000
#: Keys up to so many are put into a filter of 16 bits each, which all tasks get; more are joined.
FILTER_KEYS = 8_000_000
#: How many sets of the largest component a set tries in each step before.
TRIALS = 6
#: The step that pairs all sets that are left; those before only try some.
LAST = 4
U = np.uint64
GOLD = 0x9E3779B97F4A7C15


# ---- packed columns -------------------------------------------------------


def pack(x: np.ndarray, delta: bool = False) -> bytes:
    """Unsigned 64-bit numbers as compressed byte planes; ``delta`` suits ascending ones."""
    x = np.ascontiguousarray(x, np.uint64)
    if delta and len(x):
        x = np.concatenate((x[:1], np.diff(x)))
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes, delta: bool = False) -> np.ndarray:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if delta else x


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _table(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(names, types, rows)])


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of each hash: equal ranges of the order."""
    return (((h >> U(32)) * U(fragments)) >> U(32)).astype(np.int64)


def class_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key of each row's set, 0 for an empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ U(GOLD)), dtype=np.uint64)))[bounds]
    n = np.diff(bounds).astype(np.uint64)
    key = mix(np.diff(total) + n * U(GOLD))
    return np.where(n == 0, U(0), np.where(key == 0, U(1), key))


def ranged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
    return start, np.diff(start, append=len(x))


# ---- filters --------------------------------------------------------------


def _bits(key: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(key)
    return [(mix(h + U(k * GOLD & (1 << 64) - 1)) & U(size - 1)).astype(np.int64) for k in range(3)]


def key_filter(keys: DataFrame, *columns: str) -> np.ndarray:
    """A Bloom filter over long columns, built in parallel."""
    size = 1 << max(12, int(16 * keys.count() * len(columns)).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size // 64, np.uint64)
        for b in batches:
            for column in b.columns:
                for at in _bits(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), size):
                    np.bitwise_or.at(words, at >> 6, U(1) << (at & 63).astype(np.uint64))
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(words[full].view(np.int64))], ["word", "bits"])

    got = keys.select(*columns).mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def only(df: DataFrame, column: str, keys: DataFrame, *columns: str):
    """``df`` and a filter for it, in a broadcast, of the keys in ``columns`` of a written table; or, where these are many, the rows of ``df`` with such a key, and None."""
    if keys.count() * len(columns) <= FILTER_KEYS:
        return df, df.sparkSession.sparkContext.broadcast(key_filter(keys, *columns))
    known = keys.select(F.col(columns[0]).alias(column))
    for c in columns[1:]:
        known = known.union(keys.select(c))
    return df.join(known.distinct(), column, "left_semi"), None


def in_filter(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    ok = np.ones(len(key), bool)
    for at in _bits(key, len(words) * 64):
        ok &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & U(1) == 1
    return ok


# ---- the steps ------------------------------------------------------------


def members(docs: DataFrame, k: int) -> DataFrame:
    """(id, key, n_shingles, class) of each document of a table (id, key, text); null class without shingles."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in slices(batch.column("text")):
                h, bounds = shingle_sets(offsets, data, k)
                key = class_keys(h, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(key.view(np.int64), mask=key == 0)],
                    ["id", "key", "n_shingles", "class"],
                )
        give_back()

    return docs.mapInArrow(run, f"id {kind}, key bigint, n_shingles bigint, class bigint")


def grown(least: int, total: int) -> int:
    """Shingles of a block or fragment of ``total``: ``least``, which holds up to about a terabyte of text, or more."""
    return max(least, math.isqrt(ROW * total))


_DEALT = (["fragment", "block", "keys", "owners", "counts", "present", "classes", "table"], [pa.int64(), pa.int64(), *[pa.binary()] * 6])


def _deal(docs: DataFrame, k: int, fragments: int, size: int) -> DataFrame:
    """Each block's distinct shingles by fragment, with the one class that has it or a note that several have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, 0
        own: dict[int, int] = {}
        sets: list[np.ndarray] = []

        def block() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(x) for x in sets], np.int64)
            h = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            start, count = runs(h)
            several = count > 1
            local = np.bincount(owner[np.repeat(several, count)], minlength=len(sets))
            key, one = h[start], np.where(several, 0, owner[start] + 1)
            cut = np.searchsorted(fragment_of(key, fragments), np.arange(fragments + 1))
            classes = np.fromiter(own, np.uint64, len(own))
            table = b"".join(len(x).to_bytes(8, "little") + x for x in (pack(classes), pack(sizes), pack(local)))
            rows, full = [], np.flatnonzero(np.diff(cut)).tolist()
            keeper = full[int(mix(classes[:1])[0] >> U(33)) % len(full)]  # the block's table goes with one of its fragments, each block's with another
            for f in full:
                a, b = cut[f], cut[f + 1]
                present, place = np.unique(one[a:b], return_inverse=True)
                base = int(present[0] == 0)
                place = place + (1 - base)  # 0: several
                present = present[base:] - 1
                rows.append((f, (part << 32) + number, pack(key[a:b], True), pack(place), pack(count[a:b][several[a:b]]), pack(present, True), pack(classes[present]), table if f == keeper else None))
                if len(rows) == 64:
                    yield _rows(*_DEALT, rows)
                    rows = []
            if rows:
                yield _rows(*_DEALT, rows)

        for batch in batches:
            for _, _, offsets, data in slices(batch.column("text")):
                h, bounds = shingle_sets(offsets, data, k)
                for r, key in enumerate(class_keys(h, bounds).tolist()):
                    if key and key not in own:
                        own[key] = len(own)
                        sets.append(h[bounds[r] : bounds[r + 1]])
                        held += len(sets[-1])
                if held >= size:
                    yield from block()
                    own, sets, held, number = {}, [], 0, number + 1
        if sets:
            yield from block()
        own, sets = {}, []
        give_back()

    return docs.mapInArrow(run, "fragment bigint, block bigint, keys binary, owners binary, counts binary, present binary, classes binary, table binary")


_SHARED = (["block", "present", "shared", "table", "hash", "seen"], [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])


def _share(table: pa.Table) -> pa.Table:
    """In one fragment: how many of each block's and class's own shingles other classes have; the frequent shingles."""
    keys, classes, counts, places, blocks = [], [], [], [], []
    for r in range(table.num_rows):
        get = lambda c, r=r: table.column(c)[r].as_py()
        keys.append(unpack(get("keys"), True))
        place = unpack(get("owners")).astype(np.int64)
        present = unpack(get("present"), True)
        own = np.concatenate((np.zeros(1, np.uint64), unpack(get("classes"))))
        n = np.ones(len(place), np.uint32)
        n[place == 0] = unpack(get("counts"))
        classes.append(own[place])
        counts.append(n)
        places.append(place.astype(np.int32))
        blocks.append((get("block"), present, get("table")))
    h = np.concatenate(keys)
    del keys
    order = np.argsort(h, kind="stable")
    h = h[order]
    start, size = runs(h)
    h = h[start]
    c = np.concatenate(classes)[order]  # 0: several classes of one block
    del classes
    shared = np.zeros(len(c), bool)
    seen = np.zeros(0, np.int64)
    if len(c):
        low = np.minimum.reduceat(c, start)
        shared[order] = np.repeat((low == 0) | (low != np.maximum.reduceat(c, start)), size)
        seen = np.add.reduceat(np.concatenate(counts)[order], start, dtype=np.int64)
    out, at = [], 0
    for place, (block, present, own) in zip(places, blocks, strict=True):
        n = np.bincount(place[shared[at : at + len(place)]], minlength=len(present) + 1)[1:]
        at += len(place)
        full = n > 0
        out.append((block, pack(present[full], True), pack(n[full]), own, None, None))
    often = np.flatnonzero(seen >= FREQUENT_FROM)
    if len(often) > FREQUENT:
        often = often[np.argsort(-seen[often], kind="stable")[:FREQUENT]]
    out += [(None, None, None, None, x, n) for x, n in zip(h[often].view(np.int64).tolist(), seen[often].tolist(), strict=True)]
    del c, order, shared, counts, places
    give_back()
    return _table(*_SHARED, out)


def _sum_block(percent: int):
    """The classes of one block whose share of common shingles allows a link."""

    def run(table: pa.Table) -> pa.Table:
        raw = next(x.as_py() for x in table.column("table") if x.is_valid)
        parts, at = [], 0
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 8], "little")
            parts.append(unpack(raw[at + 8 : at + 8 + n]))
            at += 8 + n
        classes, size, shared = parts
        size, shared = size.astype(np.int64), shared.astype(np.int64)
        for p, n in zip(table.column("present"), table.column("shared"), strict=True):
            shared[unpack(p.as_py(), True).astype(np.int64)] += unpack(n.as_py()).astype(np.int64)
        return pa.table({"class": classes[100 * shared >= percent * size].view(np.int64)})

    return run


def _candidates_sets(docs: DataFrame, k: int, percent: int, words, frequent) -> DataFrame:
    """(class, n, hashes, prefix) of the documents whose key is in the filter, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value  # hashes, ascending; and their ranks
        for batch in batches:
            picked = batch
            if words is not None:
                picked = batch.filter(pa.array(in_filter(words.value, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))))
            for _, _, offsets, data in slices(picked.column("text")):
                h, bounds = shingle_sets(offsets, data, k)
                rows = []
                for r, key in enumerate(class_keys(h, bounds).view(np.int64).tolist()):
                    if not key:
                        continue
                    x = h[bounds[r] : bounds[r + 1]]
                    n = len(x)
                    at = np.minimum(np.searchsorted(often[0], x), max(len(often[0]) - 1, 0))
                    rank = np.where(often[0][at] == x, often[1][at], 0) if len(often[0]) else np.zeros(n, np.int64)
                    order = np.argsort(rank, kind="stable")  # the rest by hash, as they are
                    rows.append((key, n, x.tobytes(), x[order[: n - (percent * n + 99) // 100 + 1]].tobytes()))
                yield _rows(["class", "n", "hashes", "prefix"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows)
        give_back()

    return docs.mapInArrow(run, "class bigint, n bigint, hashes binary, prefix binary")


def _cut_sets(sets: DataFrame, fragments: int, column: str, extra: list[str], words=None) -> DataFrame:
    """The parts of each set by fragment: class, size of the part, its hashes with their places in the set's list, and ``extra`` long columns."""

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x.as_py() for x in batch.column(column)]
        size = np.array([len(x) // 8 for x in raw], np.int64)
        h = np.frombuffer(b"".join(raw), np.uint64)
        owner = np.repeat(np.arange(len(raw)), size)
        place = ranged(np.zeros(len(raw), np.int64), size).astype(np.uint64)
        f = fragment_of(h, fragments)
        order = np.argsort(f, kind="stable")
        f, h, owner, place = f[order], h[order], owner[order], place[order]
        cut = np.searchsorted(f, np.arange(fragments + 1))
        columns = {c: batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("class", *extra)}
        rows = []
        for g in np.flatnonzero(np.diff(cut)).tolist():
            start, n = runs(owner[cut[g] : cut[g + 1]])
            who = owner[cut[g] + start]
            rows.append((g, pack(n), pack(h[cut[g] : cut[g + 1]]), pack(place[cut[g] : cut[g + 1]]) if extra else None, *(pack(c[who]) for c in columns.values())))
        return _rows(["fragment", "sizes", "hashes", "places", *columns], [pa.int64(), *[pa.binary()] * (3 + len(columns))], rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if words is not None:
                batch = batch.filter(pa.array(in_filter(words.value, batch.column("class").to_numpy().view(np.uint64))))
            cut = batch.column(column)
            room = np.cumsum(pc.binary_length(cut).to_numpy(zero_copy_only=False)) // (8 * PART)
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(room)) + 1):
                if len(part):
                    yield pieces(batch.slice(int(part[0]), len(part)))
        give_back()

    return sets.mapInArrow(run, "fragment bigint, sizes binary, hashes binary, places binary, class binary" + "".join(f", {c} binary" for c in extra))


def _column(table: pa.Table, name: str) -> np.ndarray:
    parts = [unpack(x.as_py()) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _fits(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def _meet(percent: int, step: int):
    """Pairs of sets that meet in one fragment and can link.

    Sets whose first common shingle is in places i and j of their prefixes
    share at most min(n - i, m - j). At later common shingles this is less
    than it should be, but the pair is then found at the first.

    Step 0: each set with the first set of about its size at each shingle.
    Then: at each shingle with a few sets of the component that has most sets
    there, if it is another one. Step LAST: with all sets of other components.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes = _column(table, "sizes").astype(np.int64)
        h = _column(table, "hashes")
        one = {name: _column(table, name).view(np.int64) for name in ("class", "n", "component", "centre", "inside")}
        who = np.repeat(np.arange(len(sizes)), sizes)
        ids = one["class"]
        found: list[np.ndarray] = []

        place = _column(table, "places").view(np.int64)

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            """Pairs of entries of the lists."""
            a, b = who[x], who[y]
            na, nb = one["n"][a], one["n"][b]
            most = np.minimum(na - place[x], nb - place[y])
            ok = (one["component"][a] != one["component"][b]) & _fits(na, nb, percent) & ((100 + percent) * most >= percent * (na + nb))
            a, b = a[ok], b[ok]
            # both were counted against one centre: they share no more than the smaller part inside it and the smaller outside
            (na, nb), (ia, ib) = ((one[c][a], one[c][b]) for c in ("n", "inside"))
            most = np.minimum(ia, ib) + np.minimum(na - ia, nb - ib)
            ok = (one["centre"][a] != one["centre"][b]) | (100 * most >= percent * (na + nb - most))
            a, b = a[ok], b[ok]
            swap = ids[a] > ids[b]
            low, high = np.where(swap, b, a), np.where(swap, a, b)
            found.append(distinct(low * len(ids) + high))

        if step == 0:
            band = np.floor(np.log(one["n"]) / np.log(100 / percent)).astype(np.int64) if len(ids) else ids
            order = np.lexsort((ids[who], band[who], h))
            hs, w = h[order], who[order]
            new = np.ones(len(w), bool)  # a new shingle or size class
            if len(w):
                new[1:] = (hs[1:] != hs[:-1]) | (band[w][1:] != band[w][:-1])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))] if len(w) else w
            keep(order, first)
        elif step < LAST:
            order = np.lexsort((one["component"][who], h))
            hs, comp = h[order], one["component"][who][order]
            list_start, list_size = runs(hs)
            new = np.ones(len(hs), bool)
            if len(hs):
                new[1:] = (hs[1:] != hs[:-1]) | (comp[1:] != comp[:-1])
            start = np.flatnonzero(new)
            size = np.diff(start, append=len(hs))
            of_list = np.searchsorted(list_start, start, "right") - 1
            best = start[np.lexsort((size, of_list))][np.flatnonzero(np.diff(of_list, append=-1))] if len(start) else start
            most = size[np.searchsorted(start, best)]
            # the members in a ring by hash; a set tries those next to some places that it alone picks, much the same ones wherever they meet
            ring = np.flatnonzero(np.isin(np.repeat(start, size), best))
            of_ring = np.repeat(np.arange(len(best)), most)
            key = mix(ids[who[order[ring]]].view(np.uint64) + U(step * GOLD & (1 << 64) - 1)) >> U(32)
            ring, key = ring[np.lexsort((key, of_ring))], np.sort((of_ring.astype(np.uint64) << U(32)) | key)
            first = np.cumsum(most) - most
            mine = np.flatnonzero(comp != np.repeat(comp[best], list_size))
            its = np.repeat(np.arange(len(best)), list_size)[mine]
            for k in range(TRIALS):
                want = mix(ids[who[order[mine]]].view(np.uint64) ^ U((step * TRIALS + k) * GOLD & (1 << 64) - 1)) >> U(32)
                at = np.searchsorted(key, (its.astype(np.uint64) << U(32)) | want)
                at = np.where(at < first[its] + most[its], at, first[its])
                keep(order[mine], order[ring[at]])
        else:
            order = np.lexsort((one["component"][who], h))
            hs, w = h[order], who[order]
            start, count = runs(hs)
            comp = one["component"][w]
            lone = np.minimum.reduceat(comp, start) == np.maximum.reduceat(comp, start) if len(start) else np.zeros(0, bool)
            end = np.repeat(start + count, count)
            # each set with those after its own component at the same shingle
            new = np.ones(len(w) + 1, bool)
            if len(w):
                new[1:-1] = (hs[1:] != hs[:-1]) | (comp[1:] != comp[:-1])
            edges = np.flatnonzero(new)
            after = edges[np.searchsorted(edges, np.arange(len(w)), "right")] if len(w) else w
            size = np.where(np.repeat(lone, count), 0, end - after)
            live = np.flatnonzero(size)
            total = np.cumsum(size[live])
            a = 0
            while a < len(live):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 2_000_000, "right")))
                own = live[a:b]
                keep(np.repeat(order[own], size[own]), order[ranged(after[own], size[own])])
                a = b
        code = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
        x, y = code // max(len(ids), 1), code % max(len(ids), 1)
        return pa.table({"a": ids[x], "b": ids[y], "na": one["n"][x], "nb": one["n"][y]})

    return run


def _places(sets: DataFrame, fragments: int, words) -> DataFrame:
    """(class, places): the fragments in which each class, of the filter or of all, has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch if words is None else batch.filter(pa.array(in_filter(words.value, batch.column("class").to_numpy().view(np.uint64))))
            places = [distinct(fragment_of(np.frombuffer(x.as_py(), np.uint64), fragments)).astype("<u4").tobytes() for x in own.column("hashes")]
            yield pa.RecordBatch.from_arrays([own.column("class"), pa.array(places, pa.binary())], ["class", "places"])
        give_back()

    return sets.select("class", "hashes").mapInArrow(run, "class bigint, places binary")


def _spread(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, places), dealt to the fragments in which a has shingles: no more of them than a has shingles, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() for x in batch.column("places")]
            f = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
            owner = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
            order = np.argsort(f, kind="stable")
            f, owner = f[order], owner[order]
            a, b = (batch.column(c).to_numpy().view(np.uint64)[owner] for c in "ab")
            start, size = runs(f)
            yield _rows(["fragment", "a", "b"], [pa.int64(), pa.binary(), pa.binary()], [(int(f[x]), pack(a[x : x + n]), pack(b[x : x + n])) for x, n in zip(start.tolist(), size.tolist(), strict=True)])

    return pairs.select("a", "b", "places").mapInArrow(run, "fragment bigint, a binary, b binary")


def _count(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial overlaps of the pairs in one fragment, those above 0."""
    names = ["a", "b", "overlap"]
    if not sets.num_rows or not pairs.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    a, b = _column(pairs, "a").view(np.int64), _column(pairs, "b").view(np.int64)
    classes, who = np.unique(_column(sets, "class").view(np.int64), return_inverse=True)
    owner = np.repeat(who, _column(sets, "sizes").astype(np.int64))
    _, rank = np.unique(_column(sets, "hashes"), return_inverse=True)
    cell = distinct((owner << 32) + rank)  # a set that came twice counts once
    bound = np.searchsorted(cell, np.arange(len(classes) + 1) << 32)
    ia, ib = (np.minimum(np.searchsorted(classes, x), len(classes) - 1) for x in (a, b))
    here = np.flatnonzero((classes[ia] == a) & (classes[ib] == b))
    size = bound[ia[here] + 1] - bound[ia[here]]
    total, out, x = np.cumsum(size), np.zeros(len(here), np.int64), 0
    while x < len(here):
        y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + 2_000_000, "right")))
        own = here[x:y]
        want = (cell[ranged(bound[ia[own]], size[x:y])] & 0xFFFFFFFF) + (np.repeat(ib[own], size[x:y]) << 32)
        hit = cell[np.minimum(np.searchsorted(cell, want), len(cell) - 1)] == want
        out[x:y] = np.bincount(np.repeat(np.arange(y - x), size[x:y])[hit], minlength=y - x)
        x = y
    full = out > 0
    return pa.table({"a": a[here[full]], "b": b[here[full]], "overlap": out[full]})


def class_links(docs: DataFrame, own: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame | None:
    """Components of linked classes, a row (node, component) per class with a link; None if no pair can link.

    ``docs`` has (id, key, text), ``own`` is ``members`` of it.
    """
    spark = docs.sparkSession
    whole = int(own.agg(F.sum("n_shingles")).first()[0] or 0)
    fragments = max(FRAGMENTS, -(-whole // grown(FRAGMENT, whole)))
    # in order, so that a task that is repeated makes the same blocks, whatever order its rows come in
    dealt = _deal(docs.sortWithinPartitions("key"), k, fragments, grown(BLOCK, whole))
    partial = scratch.table("partial", dealt.groupBy("fragment").applyInArrow(_share, "block bigint, present binary, shared binary, table binary, hash bigint, seen bigint"))
    release(spark)
    top = partial.where("hash is not null").select("hash", "seen").orderBy(F.desc("seen"), "hash").limit(FREQUENT).toArrow()
    h = top["hash"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    frequent = spark.sparkContext.broadcast((h[order], (len(h) - order).astype(np.int64)))  # the most frequent last
    able = partial.where("block is not null").groupBy("block").applyInArrow(_sum_block(percent), "class bigint").distinct()
    reps = own.where("class is not null").groupBy("class").agg(F.min("key").alias("key"))  # ids can be null, keys never are
    reps = scratch.table("able", reps.join(able, "class", "left_semi"))
    picked, words = only(docs, "key", reps, "key")
    sets = scratch.table("sets", _candidates_sets(picked, k, percent, words, frequent), codec="none")
    scratch.drop("partial")
    total = int(sets.agg(F.sum("n")).first()[0] or 0)
    if not total:
        return None
    cuts = max(FRAGMENTS, -(-total // grown(FRAGMENT, whole)))
    parts = -(-2 * total // grown(FRAGMENT, whole))  # whole sets take more room than prefixes
    found, centres = None, None
    for step in range(LAST + 1):
        prefix = sets.select("class", "n", "prefix")
        if found is not None:
            prefix = prefix.join(found.withColumnRenamed("node", "class"), "class", "left")
        if centres is not None:
            prefix = prefix.join(centres, "class", "left")
        own_value = {"component": "class", "centre": "class", "inside": "n"}
        prefix = prefix.select("class", "n", "prefix", *(F.coalesce(c, o).alias(c) if c in prefix.columns else F.col(o).alias(c) for c, o in own_value.items()))
        met = _cut_sets(prefix, cuts, "prefix", ["n", *own_value]).groupBy("fragment").applyInArrow(_meet(percent, step), "a bigint, b bigint, na bigint, nb bigint")
        pairs = scratch.table(f"pairs-{step}", met.distinct())
        if pairs.isEmpty():
            continue
        of_pairs, near = only(sets.select("class", "hashes"), "class", pairs, "a", "b")
        left = _cut_sets(of_pairs, parts, "hashes", [], near)
        placed = pairs.select("a", "b").join(_places(of_pairs, parts, near).withColumnRenamed("class", "a"), "a")
        counted = left.groupBy("fragment").cogroup(_spread(placed).groupBy("fragment")).applyInArrow(_count, "a bigint, b bigint, overlap bigint")
        counted = scratch.table(f"counted-{step}", counted.groupBy("a", "b").agg(F.sum("overlap").alias("overlap")).join(pairs, ["a", "b"]))
        release(spark)
        if step == 0:  # there the smaller class of a pair is the one that the other was paired with
            least = counted.groupBy(F.col("b").alias("class")).agg(F.min(F.struct("a", "overlap")).alias("c"))
            centres = scratch.table("centres", least.select("class", F.col("c.a").alias("centre"), F.col("c.overlap").alias("inside")))
        new = counted.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")
        if new.isEmpty():
            continue
        before, found = found, graph.merged(found, new, scratch, f"components-{step}", _small)
        if before is not None:
            scratch.drop_read(before)
    for name in ("sets", "able", "centres", *(f"{t}-{step}" for t in ("pairs", "counted") for step in range(LAST + 1))):
        scratch.drop(name)
    return found


def _small(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it has few enough rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, Scratch]:
    """(id, key, n_shingles, component_id) per row; the key is a hash of id and text."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "jaccard")
    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    own = scratch.table("members", members(picked, k))
    found = class_links(picked, own, scratch, k, percent)
    classes = own.where("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    classes = classes.withColumn("component_id", F.col("least"))
    if found is not None:
        linked = scratch.table("linked", classes.join(found, classes["class"] == found["node"]).select("class", "least", "component"))
        least = scratch.table("least", linked.groupBy("component").agg(F.min("least").alias("component_id")))
        joined = linked.join(_small(least), "component").select("class", F.col("component_id").alias("of_links"))
        classes = classes.join(joined, "class", "left").withColumn("component_id", F.coalesce("of_links", "least"))
    classes = scratch.table("classes", classes.select("class", "component_id"))  # written, so that a class with very many copies can be split in the join
    return own.join(classes, "class", "left").select("id", "key", "n_shingles", F.coalesce("component_id", "id").alias("component_id")), scratch


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """A row per document: ``doc_id``, ``n_shingles``, ``component_id``.

    Documents link when 100 * common shingles >= ``percent`` * all shingles of
    both; the component is the smallest id that links lead to. Rows with a
    null id keep a row, and the component of the others in it if there are.
    """
    found, _ = _components(docs, id_col, text_col, k, percent)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One document of each component, that with the smallest id, with all columns; of rows that repeat its id and text, one.

    Documents without words stay. The keys of those that go are broadcast if
    they are few enough, else joined by a shuffle.
    """
    found, scratch = _components(docs, id_col, text_col, k, percent)
    found = scratch.table("found", found)
    for name in ("members", "classes", "linked", "least"):
        scratch.drop(name)
    its_id, its_key = unused(docs, "id"), unused(docs, "key")

    def these(rows: DataFrame) -> DataFrame:
        return _small(scratch.table(f"these-{uuid.uuid4().hex}", rows.select(F.col("id").alias(its_id), F.col("key").alias(its_key)).distinct()))

    def same(df: DataFrame) -> F.Column:
        return (F.xxhash64(df[id_col], df[text_col]) == F.col(its_key)) & df[id_col].eqNullSafe(F.col(its_id))

    own = F.col("id").eqNullSafe(F.col("component_id"))
    kept = docs.join(these(found.where(~own)), same(docs), "left_anti")
    again = found.where((F.col("n_shingles") > 0) & own).groupBy("id", "key").count().where("count > 1")
    if again.isEmpty():
        return kept
    again = these(again)
    one = kept.join(again, same(kept), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, same(kept), "left_anti").unionByName(one)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM e),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least.m, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
