"""Byte-level BPE encoding and decoding with a distinct-word table.

``encode`` splits the texts in Spark into blocks of documents. A block holds
each of its distinct words once, in hash shards; a shard gathers the words of
all blocks, encodes each distinct word once and sends its ids back to the
blocks that hold it, which join them to the words' positions. ``decode`` joins
the distinct ids of each part of the rows with the pieces of the vocabulary.

Only tokenizers whose words do not depend on their surroundings can be used
this way: byte-level BPE with the usual split pattern and no normaliser, as
``WordEncoder`` checks. Texts with characters past U+023F, or with added
tokens, are split by the tokenizers library itself, others by an array kernel
of the same pattern. Within a slice and a block, words are told apart by
64-bit hashes of text and length.

Null texts are empty and have no ids. Repeated rows and null ids stay rows of
their own. An empty table gives an empty result. Only the id and text columns
of the input are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.textkern import BYTE, SLICE, Hasher, slices
from gridloom.runtime import Scratch, give_back, partitions, ship

#: Text bytes of a block: what one task holds at a time.
BLOCK = 8 << 20
#: Ids that are decoded at a time.
PART = 250_000
#: Words, over all blocks, that a shard is made for.
SHARD_WORDS = 1_000_000
#: Words that a worker keeps with their ids; more only cost encoding them again.
CACHE_WORDS = 1_200_000

# The split pattern of byte-level BPE vocabularies, over characters below U+0240:
# 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces before the last one of a run|spaces
_LETTER = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ȿ]")
_NUMBER = re.compile("[0-9²³¹¼-¾]")
_SPACE = re.compile("[\t-\r \x85\xa0]")
_PLAIN = re.compile(" [A-Za-zªµºÀ-ÖØ-öø-ȿ]+")
_SPACES, _LETTERS, _NUMBERS, _OTHERS, _NONE = range(5)
_KIND = np.array([_LETTERS if _LETTER.match(chr(i)) else _NUMBERS if _NUMBER.match(chr(i)) else _SPACES if _SPACE.match(chr(i)) else _OTHERS for i in range(0x240)], np.int8)
#: Lead bytes above this start characters past U+023F.
_LAST_LEAD = 0xC8


def word_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where words begin in the bytes of a slice, by the split pattern; of no use for rows with characters past U+023F."""
    place = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
    point = data[place].astype(np.int32)
    two = np.flatnonzero(point >= 0xC0)
    if len(two):
        point[two] = np.minimum((point[two] & 0x1F) << 6 | data[np.minimum(place[two] + 1, len(data) - 1)] & 0x3F, 0x23F)
    kind = _KIND[point]
    n = len(kind)
    edge = np.zeros(n + 1, bool)  # of rows
    edge[np.searchsorted(place, offsets)] = True
    before, after, blank = np.full(n, _NONE, np.int8), np.full(n + 3, _NONE, np.int8), np.zeros(n, bool)
    before[1:], after[: n - 1], blank[1:] = kind[:-1], kind[1:], point[:-1] == 0x20
    before[edge[:-1]], after[:n][edge[1:]] = _NONE, _NONE
    blank &= before != _NONE
    # the last of several spaces goes with what follows; what follows a blank begins with it
    start = np.where(kind == _SPACES, (before != _SPACES) | (after[:n] < _NONE) & (after[:n] > _SPACES), (before != kind) & ~blank)
    quote = np.flatnonzero((point == 0x27) & start & (after[:n] == _LETTERS))
    if len(quote):
        more = np.concatenate((point, np.zeros(3, np.int32)))
        first, second = more[quote + 1], np.where(after[quote + 1] == _LETTERS, more[quote + 2], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        both = ~one & (((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l")))
        start[quote[one | both] + 1] = False
        for end in (quote[one] + 2, quote[both] + 3):
            end = end[after[end - 1] == _LETTERS]
            start[end] = True
    return place[start]


class WordEncoder:
    """Splits texts into words and encodes words, as ``encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not plain byte-level BPE")
        if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in added):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {x["content"]: x["id"] for x in added}
        self._marks = [x.encode() for x in self.added]
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.table = _Table()

    def split(self, text: str) -> list[str]:
        """Words of a text, as the library has them."""
        parts = self._cut.split(text) if self._cut is not None else [text]
        own = lambda part: [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return [w for part in parts for w in ([part] if part in self.added else own(part)) if w]

    def bounds(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of a slice, and for each row the number of its first word, with an end."""
        start = word_starts(offsets, data)
        far = np.concatenate(([0], np.cumsum(data > _LAST_LEAD)))[offsets]
        odd = np.diff(far) > 0
        raw = data.tobytes()
        for mark in self._marks:
            at = raw.find(mark)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(mark, at + 1)
        if odd.any():  # these rows are split by the library
            owner = np.searchsorted(offsets, start, "right") - 1
            parts = [start[~odd[owner]]]
            for r in np.flatnonzero(odd).tolist():
                sizes = [len(w.encode()) for w in self.split(raw[offsets[r] : offsets[r + 1]].decode())]
                parts.append(offsets[r] + np.cumsum([0, *sizes[:-1]]))
            start = np.sort(np.concatenate(parts))
        return start, np.append(start[1:], len(data))[: len(start)], np.searchsorted(start, offsets)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if _PLAIN.fullmatch(w)]
        for a in range(0, len(plain), 512):  # many words make one text, since each starts with its space
            at = plain[a : a + 512]
            e = self.tokenizer.encode("".join(words[i] for i in at), add_special_tokens=False)
            ids, of = np.array(e.ids, "<u4"), np.array(e.word_ids)
            if len(of) and of[-1] + 1 == len(at):
                raw, cut = ids.tobytes(), (np.searchsorted(of, np.arange(len(at) + 1)) * 4).tolist()
                for k, i in enumerate(at):
                    out[i] = raw[cut[k] : cut[k + 1]]
        rest = [i for i, x in enumerate(out) if x is None]
        for a in range(0, len(rest), 4096):
            at = rest[a : a + 4096]
            for i, e in zip(at, self.tokenizer.encode_batch([words[i] for i in at], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode_slice(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a slice, through the worker's table of words, and the bounds of the rows."""
        start, end, first = self.bounds(offsets, data)
        known, at, word = np.unique(Hasher(data, BYTE).of(start, end), return_index=True, return_inverse=True)
        place = self.table.places(known)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.table) + len(new) > CACHE_WORDS:
                self.table = _Table()
                new, place = np.arange(len(known)), np.full(len(known), -1)
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            place[new] = len(self.table) + np.arange(len(new))
            self.table.add(known[new], self.encode_words(words))
        begin, size = self.table.begin[place][word], self.table.size[place][word]
        tokens = self.table.pool[ragged(begin, size)]
        return tokens, np.concatenate(([0], np.cumsum(size)))[first]

    def encode_all(self, strings: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """(first row, ids of each row as little-endian unsigned 32-bit integers) for slices of a column."""
        for a, _, offsets, data in slices(strings, 4 * SLICE):
            tokens, bounds = self.encode_slice(offsets, data)
            raw, cut = tokens.tobytes(), (bounds * 4).tolist()
            yield a, [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


class _Table:
    """Words, by hash, with their ids in one array. Hashes are kept in order, the latest ones apart until they are many."""

    def __init__(self):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.known = [none, none]  # all, and the latest: hashes and numbers
        self.begin, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, "<u4")
        self.words = self.used = 0

    def __len__(self) -> int:
        return self.words

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it is not there."""
        out = np.full(len(wanted), -1)
        for keys, number in self.known:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                out = np.where(keys[at] == wanted, number[at], out)
        return out

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys, number = (np.concatenate(x) for x in zip(a, b, strict=True))
        order = np.argsort(keys, kind="stable")
        return keys[order], number[order]

    def add(self, wanted: np.ndarray, ids: list[bytes]) -> None:
        """New words, by ascending hash."""
        at, size = self.words, np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.words, end = at + len(ids), self.used + int(size.sum())
        while self.words > len(self.begin):
            self.begin, self.size = (np.concatenate((x, np.zeros(len(x), np.int64))) for x in (self.begin, self.size))
        while end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), "<u4")))
        self.size[at : self.words] = size
        self.begin[at : self.words] = self.used + np.cumsum(size) - size
        self.pool[self.used : end] = np.frombuffer(b"".join(ids), "<u4")
        self.used = end
        self.known[1] = self._merged(self.known[1], (wanted, np.arange(at, self.words)))
        if len(self.known[1][0]) > max(1 << 16, len(self.known[0][0]) // 4):
            self.known = [self._merged(*self.known), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file, loaded once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as zstandard-compressed byte planes."""
    return _squeeze(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(_expand(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def pack_words(data: np.ndarray, sizes: np.ndarray) -> bytes:
    """Words of ``sizes`` bytes, one after the other."""
    return _squeeze(struct.pack("<I", len(sizes)) + sizes.astype("<u4").tobytes() + data.tobytes())


def unpack_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _expand(raw)
    (n,) = struct.unpack_from("<I", raw)
    return np.frombuffer(raw, np.uint8, -1, 4 + 4 * n), np.frombuffer(raw, "<u4", n, 4).astype(np.int64)


def word_hashes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words, a stretch at a time."""
    end = np.cumsum(sizes)
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(sizes):
        at = end[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(end, at + (1 << 19), "right")))
        out.append(Hasher(data[at : end[b - 1]], BYTE).of(end[a:b] - sizes[a:b] - at, end[a:b] - at))
        a = b
    return np.concatenate(out)


def _column(x: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", x.type)])) as w:
        w.write_batch(pa.record_batch([x], ["x"]))
    return sink.getvalue().to_pybytes()


def _uncolumn(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column("x").combine_chunks()


def _blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Blocks of documents: their ids, words in each, positions' word numbers, distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, k = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, sizes, texts, starts, hashes, held = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            column = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in ids])
            known, at, code = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            text, start = np.concatenate(texts), np.concatenate(starts)
            size = np.diff(start, append=held)[at]
            words = pack_words(text[ragged(start[at], size)], size)
            row = [(part << 32) + k, len(known), _column(column), pack_numbers(np.concatenate(sizes)), pack_numbers(code), words]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["block", "n_words", "ids", "sizes", "codes", "words"])

        for batch in batches:
            for a, b, offsets, data in slices(batch.column("text")):
                start, end, first = enc.bounds(offsets, data)
                ids.append(batch.column("id").slice(a, b - a))
                sizes.append(np.diff(first))
                texts.append(data)
                starts.append(start + held)
                hashes.append(Hasher(data, BYTE).of(start, end))
                held += len(data)
                if held >= BLOCK:
                    yield block()
                    ids, sizes, texts, starts, hashes, held, k = [], [], [], [], [], 0, k + 1
        if ids:
            yield block()
        ids, sizes, texts, starts, hashes = [], [], [], [], []
        give_back()

    return docs.mapInArrow(run, "block bigint, n_words bigint, ids binary, sizes binary, codes binary, words binary")


def _dealt(blocks: DataFrame, shards: int) -> DataFrame:
    """Each block's distinct words by hash shard, with their numbers in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                data, size = unpack_words(raw.as_py())
                shard = (word_hashes(data, size) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cut))
                own, start = [order[cut[s] : cut[s + 1]] for s in full], np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([block] * len(full), pa.int64()), pa.array([pack_numbers(np.diff(x, prepend=0)) for x in own], pa.binary()), pa.array([pack_words(data[ragged(start[x], size[x])], size[x]) for x in own], pa.binary())],
                    ["shard", "block", "at", "words"],
                )

    return blocks.mapInArrow(run, "shard bigint, block bigint, at binary, words binary")


def _encode_shard(tokenizer: str):
    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_words(x.as_py()) for x in table.column("words")]
        text, lengths = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in ((0, np.uint8), (1, np.int64)))
        known, at, word = np.unique(word_hashes(text, lengths), return_index=True, return_inverse=True)
        end, raw = np.cumsum(lengths), text.tobytes()
        distinct = [raw[a:b].decode() for a, b in zip((end[at] - lengths[at]).tolist(), end[at].tolist(), strict=True)]
        ids = encoder(tokenizer).encode_words(distinct)  # each distinct word once
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        rows = np.split(word, np.cumsum([len(p[1]) for p in parts])[:-1])
        own = [(pack_numbers(size[x]), pack_numbers(pool[ragged(start[x], size[x])])) for x in rows]
        del ids, rows, distinct, text, raw, parts
        give_back()
        return pa.table({"block": table.column("block"), "at": table.column("at"), "sizes": pa.array([x for x, _ in own], pa.binary()), "tokens": pa.array([x for _, x in own], pa.binary())})

    return run


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``starts[i] ... starts[i] + sizes[i] - 1`` of all i in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _joined(kind: pa.DataType):
    """Ids by position for the documents of one block."""

    def run(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = [(np.cumsum(unpack_numbers(r["at"].as_py()), dtype=np.int64), unpack_numbers(r["sizes"].as_py()), unpack_numbers(r["tokens"].as_py())) for b in right for r in (dict(zip(b.schema.names, x, strict=True)) for x in zip(*b.columns, strict=True))]
        for batch in left:
            for j in range(batch.num_rows):
                row = {n: batch.column(n)[j].as_py() for n in ("n_words", "ids", "sizes", "codes")}
                size, tokens = np.zeros(row["n_words"], np.int64), np.concatenate([t for _, _, t in dealt]) if dealt else np.zeros(0, "<u4")
                start, base = np.zeros(row["n_words"], np.int64), 0
                for at, n, t in dealt:
                    size[at] = n
                    start[at] = base + np.cumsum(n, dtype=np.int64) - n
                    base += len(t)
                docs, words, codes = _uncolumn(row["ids"]), unpack_numbers(row["sizes"]).astype(np.int64), unpack_numbers(row["codes"])
                cut = np.concatenate(([0], np.cumsum(words)))
                a = 0
                while a < len(docs):
                    b = max(a + 1, int(np.searchsorted(cut, cut[a] + 200_000, "right")) - 1)
                    own = codes[cut[a] : cut[b]]
                    n = size[own]
                    value = tokens[ragged(start[own], n)].astype(np.int32)
                    ends = np.concatenate(([0], np.cumsum(n)))[cut[a : b + 1] - cut[a]]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value))
                    yield pa.RecordBatch.from_arrays([docs.slice(a, b - a).cast(kind), lists], ["id", "token_ids"])
                    a = b

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``id_col`` and ``token_ids`` (array<int>)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "bpe")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType
    blocks = scratch.bucketed("blocks", _blocks(picked, tokenizer), "block")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    shards = max(partitions(spark), -(-total // SHARD_WORDS))
    dealt = _dealt(blocks.select("block", "words"), shards)
    encoded = dealt.groupBy("shard").applyInArrow(_encode_shard(tokenizer), "block bigint, at binary, sizes binary, tokens binary")
    from pyspark.sql.pandas.types import to_arrow_type

    joined = _joined(to_arrow_type(kind))

    def table_join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(joined(left.to_batches(), right.to_batches()))
        give_back()
        return pa.Table.from_batches(out, schema=None if out else pa.schema([("id", to_arrow_type(kind)), ("token_ids", pa.list_(pa.int32()))]))

    schema = T.StructType([T.StructField("id", kind), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    own = blocks.select("block", "n_words", "ids", "sizes", "codes")
    return own.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(table_join, schema).withColumnRenamed("id", id_col)


def pieces(tokenizer: str) -> list[bytes]:
    """The bytes of each id, from the vocabulary file."""
    from tokenizers import Tokenizer

    # fixed values: the printable stand-ins of byte-level vocabularies
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    t = Tokenizer.from_file(tokenizer)
    vocab = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


def _groups(ids: DataFrame, ids_col: str) -> DataFrame:
    """(part, n, rows, id): rows of ``ids`` in parts of about ``PART`` ids, each a row with the packed rows and the number of distinct ids, and a row for each of these."""
    place = ids.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART, "right")))
                own = batch.slice(a, b - a)
                known = own.column(place).flatten().unique().drop_null().cast(pa.int64())
                n = len(known) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([len(known)] + [None] * (n - 1), pa.int64()), pa.array([_packed(own)] + [None] * (n - 1), pa.binary()), pa.concat_arrays([pa.nulls(1, pa.int64()), known])],
                    ["part", "n", "rows", "id"],
                )
                a, part = b, part + 1

    return ids.mapInArrow(run, "part bigint, n bigint, rows binary, id bigint")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _texts(lists: pa.Array, ids: np.ndarray, pieces: pa.Array) -> pa.Array:
    """The texts of lists of ids, from the pieces of the distinct ones."""
    order = np.argsort(ids)
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    value = lists.flatten()
    if value.null_count:  # an id of null has no piece
        value = value.fill_null(-1)
        ids, pieces = np.append(ids[order], -1), pa.concat_arrays([pieces.take(pa.array(order)), pa.array([b""], pieces.type)])
        order = np.argsort(ids)
    value = value.to_numpy(zero_copy_only=False).astype(np.int64)
    bytes_of = pieces.take(pa.array(order[np.searchsorted(ids[order], value)])) if len(value) else pa.array([], pieces.type)
    _, offsets, data = bytes_of.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(value) + 1] if len(value) else np.zeros(1, np.int64)
    cut = offsets[np.concatenate(([0], np.cumsum(sizes)))].tolist()
    raw = memoryview(data) if data is not None else memoryview(b"")
    return pa.array([str(raw[x:y], "utf-8", "replace") if ok else None for x, y, ok in zip(cut[:-1], cut[1:], lists.is_valid().to_pylist(), strict=True)], pa.string())


def decode(ids: DataFrame, tokenizer: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """``ids`` with the text of ``ids_col`` in ``out_col``, special tokens too. Null lists give null; ids that are null or outside the vocabulary give nothing.

    Each distinct id of a part of the rows is joined to its piece; the
    vocabulary, whose size the tokenizer file fixes, is broadcast, so rows
    stay in their partition.
    """
    spark = ids.sparkSession
    ship(spark)
    place = ids.columns.index(ids_col)
    vocabulary = pieces(tokenizer)
    table = spark.createDataFrame(pa.table({"piece_id": pa.array(range(len(vocabulary)), pa.int64()), "piece": pa.array(vocabulary, pa.binary())}))
    joined = _groups(ids, ids_col).join(F.broadcast(table), F.col("id") == F.col("piece_id"), "left").select("part", "n", "rows", "id", "piece")
    schema = T.StructType([*(f for f in ids.schema if f.name != out_col), T.StructField(out_col, T.StringType())])
    keep = [i for i, c in enumerate(ids.columns) if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}  # by part: packed rows, distinct ids to come, what came
        for batch in batches:
            part = batch.column("part").to_numpy()
            for own in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if not len(own):
                    continue
                here = batch.slice(int(own[0]), len(own))
                held = waiting.setdefault(int(part[own[0]]), [None, -1, []])
                head = here.filter(pc.is_valid(here.column("rows")))
                if head.num_rows:
                    held[:2] = head.column("rows")[0].as_py(), head.column("n")[0].as_py()
                here = here.filter(pc.is_valid(here.column("id")))
                held[2].append((here.column("id").to_numpy(), here.column("piece").cast(pa.large_binary()).fill_null(b"")))
                if sum(len(x) for x, _ in held[2]) != held[1]:
                    continue
                del waiting[int(part[own[0]])]
                known = np.concatenate([x for x, _ in held[2]])
                piece = pa.concat_arrays([y for _, y in held[2]])
                for rows in pa.ipc.open_stream(held[0]):
                    text = _texts(rows.column(place), known, piece)
                    yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in keep), text], schema.names)
        give_back()

    return joined.mapInArrow(run, schema)


def digests(ids: DataFrame, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` for rows with ids and decoded text, beside their other columns."""
    joined = F.concat_ws(",", F.col(ids_col).cast("array<string>"))
    return ids.select(*[c for c in ids.columns if c not in (ids_col, text_col)], F.size(ids_col).cast("bigint").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col(text_col).cast("binary"), 256).alias("decoded_sha256"))
