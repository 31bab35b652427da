"""Language models of characters whose n-grams are sharded: kernels, and the join of texts with a model.

The units are code points as they are, the n-grams up to ``N`` long. A model
is a table of n-grams with some numbers for each; it may be as large as it
likes, since no task ever holds all of it. Texts go into blocks; a block sends
each of its distinct n-grams, of all lengths, once to the n-gram's shard,
which joins them with the model; what is found goes back to the block, where a
kernel turns it into numbers for each text. Shards are also cut by block, so
that a task holds a bounded part of what is asked.

Null texts are empty. U+FFFF counts as the edge of a text, U+0000 as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.bpe import pack_numbers, unpack_numbers
from gridloom.llm.jaccard import pack, unpack
from gridloom.llm.textkern import distinct, mix, slices
from gridloom.runtime import Scratch, give_back, partitions

N = 5
EDGE = 0xFFFF
#: Text bytes of a block: what one task holds at a time.
BLOCK = 16 << 20
#: Text bytes that a kernel works on.
SLICE = 1 << 20
#: N-grams of the model, and n-grams of blocks, that a task holds.
SHARD, ASKED = 500_000, 4_000_000
#: Codes of n-grams up to so many are renumbered through a table, more by sorting.
DIRECT = 1 << 23
U = np.uint64
#: The key of the n-gram of no unit.
FIRST = np.array([0x9E3779B97F4A7C], np.uint64)
_STEP = U(0xD6E8FEB86659FD93)


# ---- n-grams of a slice -----------------------------------------------------


def next_key(key: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Keys of n-grams made longer by one code point: 56 bits of a hash."""
    return mix(key * _STEP + point.astype(np.uint64) + U(1)) >> U(8)


def _renumbered(code: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """Numbers from 0 on for the codes, all below ``room``, in ascending order; and how many there are."""
    if room > DIRECT:
        known, out = np.unique(code, return_inverse=True)
        return out.astype(np.int32), len(known)
    there = np.zeros(room, bool)
    there[code] = True
    number = np.cumsum(there, dtype=np.int32) - 1
    return number[code], int(number[-1]) + 1 if room else 0


class Grams:
    """The distinct n-grams, of 1 to N code points, of a slice of texts; texts begin with edges."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        rows = len(offsets) - 1
        first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]  # in code points
        self.sizes = np.diff(first)
        #: The code points with N - 1 edges before each text, and where those of texts are.
        self.points = np.full(int(first[-1]) + rows * (N - 1), EDGE, np.uint32)
        self.live = np.arange(first[-1]) + np.repeat(np.arange(1, rows + 1) * (N - 1), self.sizes)
        own = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        self.points[self.live] = np.where(own == 0, 0xFFFD, own)
        #: For each length: the number of the n-gram that ends at each place, and for each number a place.
        self.ids: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.keys = [FIRST]
        symbol, n = _renumbered(self.points, 0x110000)
        for k in range(1, N + 1):
            if k == 1:
                ids, count = symbol, n
            else:
                code = symbol.astype(np.int64)
                code[1:] += self.ids[-1][:-1].astype(np.int64) * n
                ids, count = _renumbered(code, len(self.at[-1]) * n)
            at = np.zeros(count, np.int64)
            at[ids] = np.arange(len(ids))
            before = self.keys[-1][self.ids[-1][np.maximum(at - 1, 0)]] if k > 1 else self.keys[0]
            self.keys.append(next_key(before, self.points[at]))
            self.ids.append(ids)
            self.at.append(at)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest n-grams that end in a text, as strings, and how often."""
        n = np.bincount(self.ids[-1][self.live], minlength=len(self.at[-1]))
        full = np.flatnonzero(n)
        window = self.points[self.at[-1][full][:, None] + np.arange(1 - N, 1)]  # the last place of each, which has N - 1 units before it
        return np.ascontiguousarray(window).view(f"<U{N}").ravel(), n[full]

    def before(self, k: int) -> np.ndarray:
        """For each n-gram of length k the number of its context, of length k - 1."""
        return self.ids[k - 2][np.maximum(self.at[k - 1] - 1, 0)] if k > 1 else np.zeros(len(self.at[0]), np.int64)

    def shorter(self, k: int) -> np.ndarray:
        """For each n-gram of length k the number of the one without its first unit."""
        return self.ids[k - 2][self.at[k - 1]] if k > 1 else np.zeros(len(self.at[0]), np.int64)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of a number for each longest n-gram, the sum over each text."""
        total = np.concatenate(([0.0], np.cumsum(x[self.ids[-1][self.live]])))
        return np.diff(total[np.concatenate(([0], np.cumsum(self.sizes)))])


class Found:
    """What the model has of some n-grams, with ascending keys: a row of numbers for each, by column."""

    def __init__(self, keys: np.ndarray, values: dict[str, np.ndarray]):
        self.keys = keys
        self.values = {c: np.append(v, np.nan).astype(np.float64) for c, v in values.items()}  # the last: not found

    def places(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys))

    def get(self, column: str, places: np.ndarray, none: float) -> np.ndarray:
        x = self.values[column][places]
        return np.where(np.isnan(x), none, x)


# ---- models -----------------------------------------------------------------


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) of all n-grams of length N of a column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in slices(batch.column(0), SLICE):
                if len(data):
                    gram, n = Grams(offsets, data).counted()
                    yield pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["gram", "n"])
        give_back()

    return texts.select("text").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def shorter_counts(counts: DataFrame, n: int, continuation: bool) -> DataFrame:
    """From (gram, n) of length n + 1, those of length n: how often each ends a longer one, or with ``continuation`` after how many units."""
    by = counts.groupBy(F.substring("gram", 2, n).alias("gram"), *(c for c in counts.columns if c not in ("gram", "n")))
    return by.agg((F.count(F.lit(1)) if continuation else F.sum("n")).alias("n"))


def keyed(model: DataFrame) -> DataFrame:
    """A model with keys in place of the n-grams: ``key`` and the other columns, which are doubles."""
    values = [c for c in model.columns if c != "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            size = np.array([len(g) for g in grams], np.int64)
            points = np.array(grams, f"<U{N}").view(np.uint32).reshape(len(grams), N)
            key = np.repeat(FIRST, len(grams))
            for k in range(N):
                key = np.where(size > k, next_key(key, points[:, k]), key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c) for c in values)], ["key", *values])

    return model.select("gram", *values).mapInArrow(run, "key bigint" + "".join(f", {c} double" for c in values))


# ---- scores -----------------------------------------------------------------


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents: their rows, and the keys of their distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        keys: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            known = distinct(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            row = [(part << 32) + number, len(known), zstandard.ZstdCompressor(level=3).compress(_ipc(held)), pack(known, True)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "n_keys", "rows", "keys"])

        for batch in batches:
            for a, b, offsets, data in slices(batch.column("text"), SLICE):
                held.append(batch.slice(a, b - a))
                size += len(data)
                if len(data):
                    keys.append(distinct(np.concatenate(Grams(offsets, data).keys)))
                if len(keys) == 16:
                    keys = [distinct(np.concatenate(keys))]
                if size >= BLOCK:
                    yield block()
                    held, size, keys, number = [], 0, [], number + 1
        if held:
            yield block()
        give_back()

    return docs.mapInArrow(run, "block bigint, n_keys bigint, rows binary, keys binary")


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending keys by shard, ascending within it; and the bounds of the shards."""
    shard = keys.view(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _asked(blocks: DataFrame, shards: int, cuts: int) -> DataFrame:
    """The keys of each block by shard; ``cut`` parts the blocks that ask one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("keys"), strict=True):
                key = unpack(raw.as_py(), True)
                order, edge = _by_shard(key, shards)
                full = np.flatnonzero(np.diff(edge))
                cut = int(mix(np.array([block], np.uint64))[0] % U(cuts))
                own = [pack(key[order[edge[s] : edge[s + 1]]], True) for s in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([cut] * len(full), pa.int64()), pa.array([block] * len(full), pa.int64()), pa.array(own, pa.binary())], ["shard", "cut", "block", "keys"])

    return blocks.select("block", "keys").mapInArrow(run, "shard bigint, cut bigint, block bigint, keys binary")


def pack_floats(x: np.ndarray) -> bytes:
    """The three upper bytes of each 32-bit float, rounded: a relative error of 1 in 65 536 at most."""
    return pack_numbers((x.astype("<f4").view("<u4") + np.uint32(128)) >> np.uint32(8))


def unpack_floats(raw: bytes) -> np.ndarray:
    return (unpack_numbers(raw) << np.uint32(8)).view("<f4")


def _answer(values: list[str]):
    """Which of the n-grams that each block asked for the shard has (a bit each), and their numbers."""

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        out = []
        key = model.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        key = key[order]
        numbers = [model.column(c).to_numpy()[order] for c in values]
        for shard, block, raw in zip(asked.column("shard").to_pylist(), asked.column("block").to_pylist(), asked.column("keys"), strict=True):
            want = unpack(raw.as_py(), True)
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            hit = key[at] == want if len(key) else np.zeros(len(want), bool)
            if hit.any():
                out.append((block, shard, np.packbits(hit).tobytes(), *(pack_floats(v[at[hit]]) for v in numbers)))
        give_back()
        columns = zip(("block", "shard", "hit", *values), (pa.int64(), pa.int64(), *[pa.binary()] * (1 + len(values))), strict=True)
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(columns)})

    return run


def _found(keys: np.ndarray, answers: pa.Table, shards: int, values: list[str]) -> Found:
    """The answers to a block that asked for ``keys``."""
    order, edge = _by_shard(keys, shards)
    there, numbers = np.zeros(len(keys), bool), {c: np.zeros(len(keys)) for c in values}
    for r in range(answers.num_rows):
        shard = answers.column("shard")[r].as_py()
        own = order[edge[shard] : edge[shard + 1]]
        own = own[np.unpackbits(np.frombuffer(answers.column("hit")[r].as_py(), np.uint8), count=len(own)).astype(bool)]
        there[own] = True
        for c in values:
            numbers[c][own] = unpack_floats(answers.column(c)[r].as_py())
    return Found(keys[there], {c: v[there] for c, v in numbers.items()})


Kernel = Callable[[Grams, Found], list[np.ndarray]]


def scored(docs: DataFrame, model: DataFrame, kernel: Kernel, out: str, scratch: Scratch) -> DataFrame:
    """``docs`` with the double columns ``out`` in place of ``text``, and with ``size``, its code points. The kernel gives the columns for a slice of texts, from what the model (``keyed``) has of their n-grams; empty texts have 0."""
    from pyspark.sql.pandas.types import to_arrow_schema

    values, names = [c for c in model.columns if c != "key"], out.split()
    keep = [f for f in docs.schema if f.name != "text"]
    blocks = scratch.bucketed("blocks", _blocks(docs), "block")
    n_keys = blocks.agg(F.sum("n_keys")).first()[0] or 0
    shards = max(partitions(docs.sparkSession), -(-model.count() // SHARD))
    cuts = max(1, -(-n_keys // (ASKED * shards)))
    sharded = model.withColumn("shard", F.pmod("key", F.lit(shards).cast("bigint"))).withColumn("cut", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cuts - 1).cast("bigint"))))
    asked = _asked(blocks, shards, cuts).groupBy("shard", "cut")
    answers = asked.cogroup(sharded.groupBy("shard", "cut")).applyInArrow(_answer(values), "block bigint, shard bigint, hit binary" + "".join(f", {c} binary" for c in values))
    schema = T.StructType([*keep, *(T.StructField(c, T.DoubleType()) for c in names), T.StructField("size", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for raw, keys in zip(block.column("rows"), block.column("keys"), strict=True):  # one
            found = _found(unpack(keys.as_py(), True), answers, shards, values)
            for batch in pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw.as_py())):
                for a, b, offsets, data in slices(batch.column("text"), SLICE):
                    if len(data):
                        grams = Grams(offsets, data)
                        got, size = kernel(grams, found), grams.sizes
                    else:
                        got, size = [np.zeros(b - a)] * len(names), np.zeros(b - a, np.int64)
                    rows.append(pa.table([*(batch.column(f.name).slice(a, b - a).cast(arrow.field(f.name).type) for f in keep), *map(pa.array, got), pa.array(size, pa.int64())], arrow.names))
        give_back()
        return pa.concat_tables(rows) if rows else arrow.empty_table()

    return blocks.select("block", "rows", "keys").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
