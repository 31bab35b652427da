"""Token-id files with shuffled byte planes.

A file holds documents in id order, a shard or, where that is large, a part of
one: files are rolled at ``FILE_IDS`` ids or ``FILE_DOCS`` documents. Its ids, each document's
followed by the end id, are cut into chunks of ``CHUNK`` ids; a chunk's four
byte planes are compressed by themselves with zstandard, so the planes of high
bytes shrink to almost nothing. The footer indexes the chunks and documents:

    magic | planes of chunk 0 | planes of chunk 1 | ... | footer | footer size (8 bytes) | magic

The footer is an Arrow stream of one row: for each chunk its number of ids and
the four ends of its planes, and for each document its id and the end of its
ids. Files are written under another name and then moved, so a lost or
repeated task leaves no half file.

Null texts are empty: only the end id. Rows with equal ids are ordered by a
hash of their text; null ids come first. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.bpe import encoder
from gridloom.runtime import give_back, partitions, ship

MAGIC = b"GLTOK1\n\0"
CHUNK = 1 << 16
#: A file is closed when it has so many ids or documents; what a writer holds for the footer is bounded by that.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 22


class Writer:
    """Writes one file to a binary stream, holding one chunk at a time."""

    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.waiting: list[bytes] = []
        self.held = 0
        self.sizes = array("q")
        self.ends = array("q")
        self.ids: list[pa.Array] = []
        self.doc_ends = array("q")
        self.total = 0
        sink.write(MAGIC)

    def add(self, ids: pa.Array, tokens: list[bytes]) -> None:
        """Documents with their ids as little-endian unsigned 32-bit integers."""
        self.ids.append(ids)
        for x in tokens:
            self.total += len(x) // 4
            self.doc_ends.append(self.total)
        self.waiting += tokens
        self.held += sum(map(len, tokens))
        if self.held >= 4 * CHUNK:
            raw = b"".join(self.waiting)
            whole = len(raw) // (4 * CHUNK) * 4 * CHUNK
            for a in range(0, whole, 4 * CHUNK):
                self._chunk(raw[a : a + 4 * CHUNK])
            self.waiting, self.held = [raw[whole:]], len(raw) - whole

    def _chunk(self, raw: bytes) -> None:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, 4).T
        for p in planes:
            out = self.zstd.compress(p.tobytes())
            self.sink.write(out)
            self.at += len(out)
            self.ends.append(self.at)
        self.sizes.append(len(raw) // 4)

    def close(self) -> None:
        if self.held:
            self._chunk(b"".join(self.waiting))
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.int64())
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        number = lambda x: pa.array(np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64))
        table = pa.table({"sizes": whole(number(self.sizes)), "ends": whole(number(self.ends)), "docs": whole(ids), "doc_ends": whole(number(self.doc_ends))})
        buffer = pa.BufferOutputStream()
        with pa.ipc.new_stream(buffer, table.schema) as w:
            w.write_table(table)
        footer = self.zstd.compress(buffer.getvalue().to_pybytes())
        self.sink.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads a file of ``Writer``: any chunk by itself, or all documents in order."""

    def __init__(self, source, size: int):
        self.source = source
        tail = len(MAGIC) + 8
        self._seek(size - tail)
        end = source.read(tail)
        if end[8:] != MAGIC:
            raise ValueError("not a token file, or a cut one")
        n = int.from_bytes(end[:8], "little")
        self._seek(size - tail - n)
        raw = zstandard.ZstdDecompressor().decompress(source.read(n))
        row = pa.ipc.open_stream(raw).read_all()
        self.sizes = row["sizes"].combine_chunks().values.to_numpy()
        self.ends = row["ends"].combine_chunks().values.to_numpy().reshape(-1, 4)
        self.docs = row["docs"].combine_chunks().values
        self.doc_ends = row["doc_ends"].combine_chunks().values.to_numpy()

    def _seek(self, at: int) -> None:
        self.source.seek(int(at))

    def chunk(self, k: int) -> np.ndarray:
        begin = int(self.ends[k - 1, 3]) if k else len(MAGIC)
        self._seek(begin)
        raw = self.source.read(int(self.ends[k, 3]) - begin)
        cut = [0, *(int(x) - begin for x in self.ends[k])]
        d = zstandard.ZstdDecompressor()
        planes = [np.frombuffer(d.decompress(raw[a:b]), np.uint8) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return np.stack(planes, axis=1).copy().view("<u4").ravel()

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the document, its ids)."""
        ids, k, base = np.zeros(0, "<u4"), 0, 0
        begin = 0
        for i, end in enumerate(self.doc_ends.tolist()):
            more = [ids[begin - base :]]
            have = base + len(ids)
            while have < end:
                x = self.chunk(k)
                more.append(x)
                have += len(x)
                k += 1
            if len(more) > 1:
                ids, base = np.concatenate(more), begin
            yield i, ids[begin - base : end - base]
            begin = end


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int, int]]:
    """Encode and write all documents in ascending id order; returns the manifest, a row (shard, file, documents, ids) per file in order."""
    spark = docs.sparkSession
    ship(spark)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = picked.repartitionByRange(partitions(spark), F.col("id"), tie).sortWithinPartitions("id", tie)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        where, folder = fs.FileSystem.from_uri(path)
        writer = sink = None
        number = 0

        def closed() -> pa.RecordBatch:
            nonlocal writer, number
            writer.close()
            sink.close()
            name = f"part-{shard:06d}-{number:05d}.tok"
            where.move(draft, f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(writer.doc_ends)], "n_ids": [writer.total]})
            writer, number = None, number + 1
            return row

        for batch in batches:
            for a, rows in encoder(tokenizer).encode_all(batch.column("text")):
                total = np.cumsum([len(x) // 4 + 1 for x in rows])
                x = 0
                while x < len(rows):
                    if writer is None:
                        where.create_dir(folder, recursive=True)
                        draft = f"{folder}/.part-{uuid.uuid4().hex}"
                        sink = where.open_output_stream(draft)
                        writer = Writer(sink)
                    room = FILE_IDS - writer.total + (int(total[x - 1]) if x else 0)
                    y = min(int(np.searchsorted(total, room, "left")) + 1, x + FILE_DOCS - len(writer.doc_ends), len(rows))
                    writer.add(batch.column("id").slice(a + x, y - x), [t + end for t in rows[x:y]])
                    if writer.total >= FILE_IDS or len(writer.doc_ends) >= FILE_DOCS:
                        yield closed()
                    x = y
        if writer is not None:
            yield closed()
        give_back()

    manifest = ranged.mapInArrow(run, "shard bigint, file string, n_docs bigint, n_ids bigint").collect()
    return sorted((r.shard, r.file, r.n_docs, r.n_ids) for r in manifest)


def read(spark: SparkSession, path: str, manifest: list[tuple[int, str, int, int]], id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """A row per document from the files: id, ``start`` (ids before it in all files), ``n_tokens``, ``ids_crc32``."""
    ship(spark)
    base, rows = 0, []
    for _, name, _, n in manifest:
        rows.append((name, base))
        base += n
    files = spark.createDataFrame(rows, "file string, base bigint").repartition(max(1, len(rows)), "file")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                where, folder = fs.FileSystem.from_uri(path)
                at = f"{folder}/{name}"
                with where.open_input_file(at) as source:
                    reader = Reader(source, source.size())
                    crc = np.fromiter((zlib.crc32(x.tobytes()) for _, x in reader.documents()), np.int64, len(reader.doc_ends))
                    size = np.diff(reader.doc_ends, prepend=0)
                    yield pa.RecordBatch.from_arrays([reader.docs.cast(kind), pa.array(base + reader.doc_ends - size), pa.array(size), pa.array(crc)], [id_col, "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    return files.mapInArrow(run, schema)
