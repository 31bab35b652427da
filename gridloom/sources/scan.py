"""Raster files as tables: files, pages, tags, directories, chunks and samples.

Every table is made from rows with ``path`` and, where the bytes are at hand,
``content``. Without content a task opens the path and reads only the ranges
it needs, so large files are read chunk by chunk, on as many tasks as there
are chunks. What is wrong with a file, a page or a chunk is a row with
``error_kind`` and ``error_detail`` (mode PERMISSIVE), or fails the query
(mode FAILFAST); other pages and chunks go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.functions.domains import TAGS
from gridloom.operators.decode import chunk_bytes, decode_chunk, planes_read, stored_bytes
from gridloom.runtime import ship
from gridloom.sources.container import Header, Limits, RasterError, Source, Tags, Value, read_directory, read_header, value_bytes, walk
from gridloom.sources.page import Page, read_page

FILES = "path string, byte_order string, big boolean, first_ifd bigint, length bigint, error_kind string, error_detail string"
PAGES = "path string, page_index int, ifd_offset bigint, next_ifd bigint, width bigint, height bigint, bits int, samples int, photometric_samples int, extra_samples array<int>, sample_format int, photometric int, compression int, predictor int, planar int, fill_order int, chroma array<int>, chunk_kind string, chunk_width bigint, chunk_height bigint, chunks_across bigint, chunks_down bigint, planes int, color_type string, color_map array<int>, error_kind string, error_detail string"
VALUE = "struct<kind: string, ints: array<decimal(20,0)>, doubles: array<double>, rationals: array<struct<n: bigint, d: bigint>>, str: string, bytes: binary>"
TAG_ROWS = f"path string, page_index int, ifd_offset bigint, tag int, name string, type int, count bigint, value {VALUE}, error_kind string, error_detail string"
CHUNKS = "path string, page_index int, chunk_index int, plane int, x0 bigint, y0 bigint, data_width int, data_height int, file_offset bigint, byte_count bigint, layout string, error_kind string, error_detail string"
DECODED = "path string, page_index int, chunk_index int, plane int, x0 bigint, y0 bigint, data_width int, data_height int, bands int, dtype string, data binary, error_kind string, error_detail string"
SAMPLES = "path string, page_index int, x int, y int, band int, value double, exact decimal(20,0)"
PIXELS = "path string, page_index int, x int, y int, values array<double>, colors array<int>"


@dataclass(frozen=True)
class Options:
    """How files are read: limits in bytes (of chunks and values; of whole pages only if ``image_limit`` is given), mode, whether an unspecified extra sample may be alpha, another place to begin, and the byte-plane order of log-luminance runs."""

    limits: Limits = field(default_factory=Limits)
    mode: str = "PERMISSIVE"
    lenient: bool = False
    first_ifd: int | None = None
    reference_order: bool = False
    first_plane_only: bool = False
    image_limit: int | None = None

    @classmethod
    def of(cls, **given) -> Options:
        """From reader options: maxDecodedBytes, maxChunkBytes, maxTagBytes, maxImageBytes, mode, lenient, firstIfdOffset, referenceOrder, firstPlaneOnly."""
        d = Limits()
        limits = Limits(int(given.get("maxDecodedBytes", d.decoded)), int(given.get("maxChunkBytes", d.chunk)), int(given.get("maxTagBytes", d.tag)))
        yes = lambda k: str(given.get(k, "false")).lower() == "true"
        number = lambda k: None if given.get(k) is None else int(given[k])
        return cls(limits, str(given.get("mode", "PERMISSIVE")).upper(), yes("lenient"), number("firstIfdOffset"), yes("referenceOrder"), yes("firstPlaneOnly"), number("maxImageBytes"))


def load(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """(path, content) of the files under a path or glob; without content only names are listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content") if with_content else files.select("path", F.lit(None).cast("binary").alias("content"))


class _Opened:
    """A source for a row, closed at the end."""

    def __init__(self, path: str, content: bytes | None):
        self.path, self.content, self.file = path, content, None

    def __enter__(self) -> Source:
        if self.content is not None:
            return Source.of(self.content)
        from pyarrow import fs

        uri = self.path if "://" in self.path else self.path.replace("file:", "file://", 1) if self.path.startswith("file:") else f"file://{self.path}"
        where, name = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(name)
        source = Source(self._read, self.file.size())
        return source

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __exit__(self, *_):
        if self.file is not None:
            self.file.close()


def _each(files: DataFrame, schema: str, make, options: Options, batch_rows: int = 256, more: tuple[str, ...] = ()) -> DataFrame:
    """A table made of what ``make(path, source, *more columns)`` yields for each file, as dicts or whole batches; errors on the way become rows."""
    ship(files.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    failfast = options.mode == "FAILFAST"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, content, *own in zip(batch.column("path").to_pylist(), batch.column("content"), *(batch.column(c).to_pylist() for c in more), strict=True):
                try:
                    with _Opened(path, content.as_py()) as src:
                        for row in make(path, src, *own):
                            if isinstance(row, pa.RecordBatch):
                                if rows:
                                    yield pa.RecordBatch.from_pylist(rows, arrow)
                                    rows = []
                                yield row
                                continue
                            if failfast and row.get("error_kind"):
                                raise RasterError(row["error_kind"], row["error_detail"])
                            rows.append(row)
                            if len(rows) == batch_rows:
                                yield pa.RecordBatch.from_pylist(rows, arrow)
                                rows = []
                except RasterError as e:
                    if failfast:
                        raise
                    rows.append({"path": path, **dict(zip(more, own, strict=True)), "error_kind": e.kind, "error_detail": e.detail})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content", *more).mapInArrow(run, schema)


def _directories(src: Source, o: Options):
    """(index, directory or error) along the chain; an error ends it."""
    head = read_header(src)
    i, chain = 0, walk(src, head, o.first_ifd)
    while True:
        try:
            d = next(chain)
        except StopIteration:
            return
        except RasterError as e:
            yield head, i, e
            return
        yield head, i, d
        i += 1


def files(table: DataFrame, options: Options = Options()) -> DataFrame:
    """A row per file with its header."""

    return _each(table, FILES, _file_rows, options)


def _file_rows(path: str, src: Source):
    h = read_header(src)
    yield {"path": path, "byte_order": h.byte_order, "big": h.big, "first_ifd": h.first, "length": src.size}


def _page_row(path: str, i: int, d, head: Header, src: Source, o: Options) -> dict:
    row = {"path": path, "page_index": i, "ifd_offset": d.offset, "next_ifd": d.next}
    try:
        p = read_page(src, head, d, o.limits, o.lenient)
        row |= {"width": p.width, "height": p.height, "bits": p.bits, "samples": p.samples, "photometric_samples": p.samples - len(p.extra), "extra_samples": p.extra, "sample_format": p.format, "photometric": p.photometric, "compression": p.compression, "predictor": p.predictor, "planar": p.planar, "fill_order": p.fill_order, "chroma": list(p.chroma), "chunk_kind": p.kind, "chunk_width": p.chunk_width, "chunk_height": p.chunk_height, "chunks_across": p.across, "chunks_down": p.down, "planes": p.planes, "color_map": p.color_map}
        row["color_type"] = p.color[0]
    except RasterError as e:
        row |= {"error_kind": e.kind, "error_detail": e.detail}
    return row


def pages(table: DataFrame, options: Options = Options()) -> DataFrame:
    """A row per directory of the chain, as a page."""

    return _each(table, PAGES, lambda path, src: _page_rows(path, src, options), options)


def _page_rows(path: str, src: Source, o: Options):
    for head, i, d in _directories(src, o):
        yield {"path": path, "page_index": i, "error_kind": d.kind, "error_detail": d.detail} if isinstance(d, RasterError) else _page_row(path, i, d, head, src, o)


def value_struct(v: Value, raw: bytes | None) -> dict:
    """A value as its table's struct."""
    items = v.value if v.kind == "List" else (v,)
    kind = items[0].kind if items else "List"
    out = {"kind": v.kind if v.kind != "List" or not items else f"List<{kind}>", "bytes": raw}
    if kind in ("Rational", "SRational"):
        out["rationals"] = [{"n": x.value[0], "d": x.value[1]} for x in items]
    elif kind in ("Float", "Double"):
        out["doubles"] = [x.value for x in items]
    elif kind == "Ascii":
        out["str"] = items[0].value
    elif kind != "List":
        from decimal import Decimal

        out["ints"] = [Decimal(x.value) for x in items]
    else:
        out["ints"] = []
    return out


def tags(table: DataFrame, options: Options = Options(), pointers: bool = False) -> DataFrame:
    """A row per tag of every directory in the chain, with its value and the bytes of it as they are stored. With ``pointers``, ``table`` has a column ``ifd_offset`` too, and that directory alone is read: a sub-directory, whose page_index is null."""
    if pointers:
        return _each(table, TAG_ROWS, lambda path, src, at: _pointed_rows(path, src, at, options), options, more=("ifd_offset",))
    return _each(table, TAG_ROWS, lambda path, src: _tag_rows(path, src, options), options)


def _tags_of(path: str, i: int | None, d, head: Header, src: Source, o: Options):
    t = Tags(src, head, d, o.limits)
    for tag, e in d.entries.items():
        row = {"path": path, "page_index": i, "ifd_offset": d.offset, "tag": tag, "name": TAGS.get(tag), "type": e.type, "count": e.count}
        try:
            row["value"] = value_struct(t.get(tag), value_bytes(src, head, e, o.limits.tag))
        except RasterError as x:
            row |= {"error_kind": x.kind, "error_detail": x.detail}
        yield row


def _pointed_rows(path: str, src: Source, at: int, o: Options):
    head = read_header(src)
    yield from _tags_of(path, None, read_directory(src, head, at), head, src, o)


def _tag_rows(path: str, src: Source, o: Options):
    for head, i, d in _directories(src, o):
        if isinstance(d, RasterError):
            yield {"path": path, "page_index": i, "error_kind": d.kind, "error_detail": d.detail}
        else:
            yield from _tags_of(path, i, d, head, src, o)


DIRECTORIES = "path string, page_index int, ifd_offset bigint, next_ifd bigint, entries map<int, struct<type: int, count: bigint, raw: binary>>, error_kind string, error_detail string"


def directories(table: DataFrame, options: Options = Options()) -> DataFrame:
    """A row per directory of the chain with its entries as a map by tag, values not followed: for ``element_at``, ``map_contains_key``, ``map_concat`` and the like."""
    return _each(table, DIRECTORIES, lambda path, src: _directory_rows(path, src, options), options)


def _directory_rows(path: str, src: Source, o: Options):
    for _, i, d in _directories(src, o):
        if isinstance(d, RasterError):
            yield {"path": path, "page_index": i, "error_kind": d.kind, "error_detail": d.detail}
        else:
            yield {"path": path, "page_index": i, "ifd_offset": d.offset, "next_ifd": d.next, "entries": [(t, {"type": e.type, "count": e.count, "raw": e.raw}) for t, e in d.entries.items()]}


def extended(entries: F.Column, more: F.Column) -> F.Column:
    """Two maps of entries as one, in which the second's count."""
    return F.map_from_entries(F.array_sort(F.filter(F.map_entries(F.map_zip_with(entries, more, lambda k, a, b: F.coalesce(b, a))), lambda e: e["value"].isNotNull())))


def directory_size(n_tags: F.Column, big: F.Column) -> F.Column:
    """Bytes of a directory."""
    return F.when(big, n_tags * 20 + 16).otherwise(n_tags * 12 + 6)


def _layout(p: Page) -> str:
    """What decoding one chunk needs, without the lists of all chunks."""
    plain = {k: v for k, v in p.__dict__.items() if k not in ("offsets", "counts", "color_map", "jpeg_tables")}
    return json.dumps(plain | {"jpeg_tables": p.jpeg_tables.hex() if p.jpeg_tables else None})


@lru_cache(maxsize=64)
def page_of(layout: str) -> Page:
    """The page of a layout; where its chunks are is not part of it."""
    d = json.loads(layout)
    d["chroma"] = tuple(d["chroma"])
    tables = d.pop("jpeg_tables")
    return Page(**d, offsets=[], counts=[], color_map=None, jpeg_tables=bytes.fromhex(tables) if tables else None)


def chunks(table: DataFrame, options: Options = Options()) -> DataFrame:
    """A row per strip or tile of every valid page: where it is in the file and in the page, and the layout to decode it by."""

    return _each(table, CHUNKS, lambda path, src: _chunk_batches(path, src, options, _CHUNK_SCHEMA), options)


def _valid_pages(path: str, src: Source, o: Options):
    """(index, page) along the chain, or an error row."""
    for head, i, d in _directories(src, o):
        try:
            if isinstance(d, RasterError):
                raise d
            yield i, read_page(src, head, d, o.limits, o.lenient)
        except RasterError as e:
            yield i, {"path": path, "page_index": i, "error_kind": e.kind, "error_detail": e.detail}


def _chunk_batches(path: str, src: Source, o: Options, arrow: pa.Schema):
    """Batches of the chunks of each page, or its error as a row."""
    for i, p in _valid_pages(path, src, o):
        if isinstance(p, dict):
            yield p
            continue
        layout, offsets, counts = _layout(p), np.array(p.offsets, np.uint64), np.array(p.counts, np.uint64)
        for a in range(0, p.chunks, 1 << 14):
            c = np.arange(a, min(p.chunks, a + (1 << 14)))
            plane, cell = np.divmod(c, p.across * p.down)
            row, column = np.divmod(cell, p.across)
            x, y = column * p.chunk_width, row * p.chunk_height
            same = np.zeros(len(c), np.int64)
            columns = {"path": pa.array([path]).take(pa.array(same)), "page_index": same + i, "chunk_index": c, "plane": plane, "x0": x, "y0": y, "data_width": np.minimum(p.chunk_width, p.width - x), "data_height": np.minimum(p.chunk_height, p.height - y), "file_offset": offsets[c].view(np.int64), "byte_count": counts[c].view(np.int64), "layout": pa.array([layout]).take(pa.array(same))}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(len(c), f.type) for f in arrow], schema=arrow)


def _decoded_row(base: dict, p: Page, c: int, raw: bytes, o: Options) -> dict:
    a = decode_chunk(p, c, raw, o.limits, o.reference_order)
    return base | {"bands": a.shape[2], "dtype": a.dtype.str.lstrip("<>|="), "data": np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"))).tobytes()}


def decode(table: DataFrame, options: Options = Options()) -> DataFrame:
    """Decoded chunks of whole files: little-endian samples (rows, columns, bands) in ``data``."""

    return _each(table, DECODED, lambda path, src: _decoded_rows(path, src, options), options, 16)


def _decoded_rows(path: str, src: Source, o: Options, wanted: set[int] | None = None):
    for i, p in _valid_pages(path, src, o):
        if wanted is not None and i not in wanted:
            continue
        if isinstance(p, dict):
            yield p
            continue
        try:
            planes = planes_read(p, o.image_limit, o.first_plane_only)
        except RasterError as e:
            yield {"path": path, "page_index": i, "error_kind": e.kind, "error_detail": e.detail}
            continue
        for c in range(p.chunks):
            plane, x, y, w, h = p.place(c)
            if plane >= planes:
                continue
            base = {"path": path, "page_index": i, "chunk_index": c, "plane": plane, "x0": x, "y0": y, "data_width": w, "data_height": h}
            try:
                yield _decoded_row(base, p, c, chunk_bytes(src, p, c, o.limits), o)
            except RasterError as e:
                yield base | {"error_kind": e.kind, "error_detail": e.detail}


_CHUNK_SCHEMA = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]) for name, kind in (x.split() for x in CHUNKS.split(", "))])
_ROWS = {
    "files": lambda p, src, o, wanted: _file_rows(p, src),
    "pages": lambda p, src, o, wanted: _page_rows(p, src, o),
    "tags": lambda p, src, o, wanted: _tag_rows(p, src, o),
    "directories": lambda p, src, o, wanted: _directory_rows(p, src, o),
    "chunks": lambda p, src, o, wanted: (r for b in _chunk_batches(p, src, o, _CHUNK_SCHEMA) for r in (b.to_pylist() if isinstance(b, pa.RecordBatch) else [b])),
    "decoded": lambda p, src, o, wanted: _decoded_rows(p, src, o, wanted),
}


def file_rows(path: str, content: bytes | None, table: str, o: Options, wanted: set[int] | None = None):
    """Rows of one table (files, pages, tags, directories, chunks or decoded) for one file, as dicts."""
    try:
        with _Opened(path, content) as src:
            for row in _ROWS[table](path, src, o, wanted):
                if o.mode == "FAILFAST" and row.get("error_kind"):
                    raise RasterError(row["error_kind"], row["error_detail"])
                if wanted is None or row.get("page_index") is None or row["page_index"] in wanted:
                    yield row
    except RasterError as e:
        if o.mode == "FAILFAST":
            raise
        yield {"path": path, "error_kind": e.kind, "error_detail": e.detail}


def decode_ranges(chunk_rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Decode rows of ``chunks``, each by reading its own range of its file; filter and repartition the rows first as the question allows."""
    ship(chunk_rows.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(DECODED))
    keep = ["path", "page_index", "chunk_index", "plane", "x0", "y0", "data_width", "data_height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                base = {k: r[k] for k in keep}
                try:
                    with _Opened(r["path"], None) as src:
                        p = page_of(r["layout"])
                        raw = stored_bytes(src, p.compression, r["file_offset"], r["byte_count"], options.limits)
                        out.append(_decoded_row(base, p, r["chunk_index"], raw, options))
                except RasterError as e:
                    if options.mode == "FAILFAST":
                        raise
                    out.append(base | {"error_kind": e.kind, "error_detail": e.detail})
                if len(out) == 16:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return chunk_rows.where("error_kind is null").select(*keep, "file_offset", "byte_count", "layout").mapInArrow(run, DECODED)


def sample_batches(r: dict, exact: bool, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The samples of a row of ``decode``, in batches of bounded size."""
    if r.get("data") is None:
        return
    a = np.frombuffer(r["data"], "<" + r["dtype"])
    w, bands = r["data_width"], r["bands"]
    n, step = len(a), 1 << 18
    for at in range(0, n, step):
        k = np.arange(at, min(n, at + step))
        part = a[at : at + step]
        value = pa.array(part.astype(np.float64))
        whole = pa.array(part.astype(f"{a.dtype.kind}8")).cast(arrow.field("exact").type) if exact and a.dtype.kind in "ui" else pa.nulls(len(k), arrow.field("exact").type)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["path"]]).take(pa.array(np.zeros(len(k), np.int64))), pa.array(np.full(len(k), r["page_index"], np.int32)), pa.array((r["x0"] + k // bands % w).astype(np.int32)), pa.array((r["y0"] + k // (bands * w)).astype(np.int32)), pa.array((k % bands + r["plane"]).astype(np.int32)), value, whole],
            schema=arrow,
        )


def _samples_together(rows: list[dict], exact: bool, arrow: pa.Schema) -> pa.RecordBatch:
    """The samples of several rows of ``decode`` of one type: small chunks do not each cost the calls."""
    kind = np.dtype("<" + rows[0]["dtype"])
    value = np.frombuffer(b"".join(r["data"] for r in rows), kind)
    size = np.array([len(r["data"]) // kind.itemsize for r in rows])
    own = np.repeat(np.arange(len(rows)), size)  # the row of each sample
    of = lambda name: np.array([r[name] for r in rows], np.int64)[own]
    pixel, band = np.divmod(np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size), of("bands"))
    y, x = np.divmod(pixel, of("data_width"))
    whole = pa.array(value.astype(f"{kind.kind}8")).cast(arrow.field("exact").type) if exact and kind.kind in "ui" else pa.nulls(len(value), arrow.field("exact").type)
    columns = [pa.array([r["path"] for r in rows], pa.string()).take(pa.array(own)), pa.array([r["page_index"] for r in rows], pa.int32()).take(pa.array(own)), *(pa.array(c.astype(np.int32)) for c in (of("x0") + x, of("y0") + y, of("plane") + band)), pa.array(value.astype(np.float64)), whole]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def _grouped(rows: Iterator[dict], most: int = 1 << 18) -> Iterator[list[dict]]:
    """Rows of ``decode`` that have data, in runs of one type and of at most so many bytes; a longer row is alone."""
    held: list[dict] = []
    n = 0
    for r in rows:
        if r.get("data") is None:
            continue
        if held and (r["dtype"] != held[0]["dtype"] or n + len(r["data"]) > most):
            yield held
            held, n = [], 0
        held.append(r)
        n += len(r["data"])
    if held:
        yield held


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many: small chunks do not each cost a batch."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def samples(decoded: DataFrame, exact: bool = False) -> DataFrame:
    """A row per sample of decoded chunks; ``exact`` fills the decimal column, which 64-bit integers need."""
    ship(decoded.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(SAMPLES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        yield from _gathered(part for some in _grouped(rows) for part in ([_samples_together(some, exact, arrow)] if len(some) > 1 else sample_batches(some[0], exact, arrow)))

    return decoded.mapInArrow(run, SAMPLES)


def pixels(table: DataFrame, options: Options = Options()) -> DataFrame:
    """A row per pixel of whole files, with its bands as ``values`` and, on palette pages, ``colors`` (red, green, blue) by the page's own map.

    Chunks of all planes at a place are decoded together, so neither bands nor
    colours need a join. A band whose chunk failed is null, and so are the
    colours of an index that the map does not have; pixels and pages of which
    nothing could be read are left out.
    """
    ship(table.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(PIXELS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(part for batch in batches for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True) for part in _pixel_batches(path, content.as_py(), options, arrow))

    return table.select("path", "content").mapInArrow(run, PIXELS)


def _pixel_batches(path: str, content: bytes | None, o: Options, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    try:
        with _Opened(path, content) as src:
            for i, p in _valid_pages(path, src, o):
                if isinstance(p, dict):
                    if o.mode == "FAILFAST":
                        raise RasterError(p["error_kind"], p["error_detail"])
                    continue
                try:
                    planes = planes_read(p, o.image_limit, o.first_plane_only)
                except RasterError:
                    if o.mode == "FAILFAST":
                        raise
                    continue
                for cell in range(p.across * p.down):
                    yield from _cell_pixels(path, i, p, cell, planes, src, o, arrow)
    except RasterError:
        if o.mode == "FAILFAST":
            raise


def _cell_pixels(path: str, i: int, p: Page, cell: int, planes: int, src: Source, o: Options, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The pixels of the chunks that all planes have at one place, in batches of bounded size."""
    bands: list[np.ndarray | None] = []
    for plane in range(planes):
        c = plane * p.across * p.down + cell
        try:
            a = decode_chunk(p, c, chunk_bytes(src, p, c, o.limits), o.limits, o.reference_order)
            bands += list(a.reshape(-1, a.shape[2]).T)
        except RasterError:
            if o.mode == "FAILFAST":
                raise
            bands += [None] * (1 if p.planar == 2 else p.color[1])
    read = [b for b in bands if b is not None]
    if not read:
        return
    _, x0, y0, w, _ = p.place(cell)
    for at in range(0, len(read[0]), 1 << 16):
        parts = [None if b is None else b[at : at + (1 << 16)] for b in bands]
        k = np.arange(at, min(len(read[0]), at + (1 << 16)))
        same = pa.array(np.zeros(len(k), np.int64))
        value = np.stack([np.zeros(len(k)) if b is None else b.astype(np.float64) for b in parts], -1)
        lost = np.broadcast_to([b is None for b in parts], value.shape).ravel() if len(read) < len(bands) else None
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * len(bands)), pa.array(value.ravel(), mask=lost))
        colors = pa.nulls(len(k), arrow.field("colors").type)
        if p.color_map is not None and parts[0] is not None:
            n = len(p.color_map) // 3
            index = parts[0].astype(np.int64)
            known = (index >= 0) & (index < n)
            rgb = np.array(p.color_map[: 3 * n], np.int32).reshape(3, n).T[np.where(known, index, 0)] if n else np.zeros((len(k), 3), np.int32)
            colors = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * 3), pa.array(rgb.ravel(), mask=np.repeat(~known, 3)))
        columns = [pa.array([path]).take(same), pa.array(np.full(len(k), i, np.int32)), pa.array((x0 + k % w).astype(np.int32)), pa.array((y0 + k // w).astype(np.int32)), values, colors]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


IMAGES = "path string, page_index int, width bigint, height bigint, bands int, dtype string, data binary"


def images(decoded: DataFrame) -> DataFrame:
    """Whole pages of decoded chunks: little-endian samples (rows, columns, bands) in ``data``, bands that lay apart beside each other. A page is put together in one task, so it must fit there; pages with a chunk that failed are left out."""
    ship(decoded.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(IMAGES))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if any(r["data"] is None for r in rows):
            return arrow.empty_table()
        width, height = (max(r[a] + r[b] for r in rows) for a, b in (("x0", "data_width"), ("y0", "data_height")))
        bands = max(r["plane"] + r["bands"] for r in rows)
        out = np.zeros((height, width, bands), "<" + rows[0]["dtype"])
        for r in rows:
            x, y, w, h, n = (r[c] for c in ("x0", "y0", "data_width", "data_height", "bands"))
            out[y : y + h, x : x + w, r["plane"] : r["plane"] + n] = np.frombuffer(r["data"], out.dtype).reshape(h, w, n)
        row = {"path": rows[0]["path"], "page_index": rows[0]["page_index"], "width": width, "height": height, "bands": bands, "dtype": rows[0]["dtype"], "data": out.tobytes()}
        return pa.Table.from_pylist([row], arrow)

    return decoded.select("path", "page_index", "plane", "x0", "y0", "data_width", "data_height", "bands", "dtype", "data").groupBy("path", "page_index").applyInArrow(run, IMAGES)


def coding_units(decoded: DataFrame) -> DataFrame:
    """Chunks of all planes at the same place, as a list ordered by plane."""
    return decoded.where("error_kind is null").groupBy("path", "page_index", "x0", "y0", "data_width", "data_height", "dtype").agg(F.transform(F.sort_array(F.collect_list(F.struct("plane", "data"))), lambda s: s["data"]).alias("planes"))


_BLOCKS = "path string, page_index int, column bigint, row bigint, x0 bigint, y0 bigint, data_width int, data_height int, plane int, bands int, dtype string, data binary"
AGREEMENT = "path string, page_index int, band int, n bigint, n_equal bigint, total bigint"


def blocks(decoded: DataFrame, size: int = 64) -> DataFrame:
    """Decoded chunks cut along a grid of squares that is the same for all layouts; ``column`` and ``row`` are the square's."""
    ship(decoded.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                if r["data"] is None:
                    continue
                x0, y0, w, h = r["x0"], r["y0"], r["data_width"], r["data_height"]
                a = np.frombuffer(r["data"], "<" + r["dtype"]).reshape(h, w, r["bands"])
                for row in range(y0 // size, (y0 + h - 1) // size + 1):
                    for column in range(x0 // size, (x0 + w - 1) // size + 1):
                        x, y = max(x0, column * size), max(y0, row * size)
                        part = a[y - y0 : (row + 1) * size - y0, x - x0 : (column + 1) * size - x0]
                        out.append({"path": r["path"], "page_index": r["page_index"], "column": column, "row": row, "x0": x, "y0": y, "data_width": part.shape[1], "data_height": part.shape[0], "plane": r["plane"], "bands": r["bands"], "dtype": r["dtype"], "data": part.tobytes()})
                        if len(out) == 256:
                            yield pa.RecordBatch.from_pylist(out, arrow)
                            out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return decoded.mapInArrow(run, _BLOCKS)


def agreement(one: DataFrame, other: DataFrame, size: int = 64) -> DataFrame:
    """How two tables of decoded chunks, of any layout, agree: for each square of a page and band, the samples that either has, those that are equal, and the sum of the first's (null if it has none). Squares of both sides meet in a task, so chunks are moved in place of samples."""
    arrow = to_arrow_schema(StructType.fromDDL(AGREEMENT))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = [t.to_pylist() for t in (a, b)]
        bands = max(r["plane"] + r["bands"] for rows in sides for r in rows)
        kinds = [np.result_type(*(np.dtype(r["dtype"]) for r in rows)) if rows else np.dtype("u1") for rows in sides]
        values = [np.zeros((size, size, bands), kind) for kind in kinds]
        there = [np.zeros((size, size, bands), bool) for _ in sides]
        for rows, value, has in zip(sides, values, there, strict=True):
            for r in rows:
                x, y, w, h = r["x0"] % size, r["y0"] % size, r["data_width"], r["data_height"]
                at = np.s_[y : y + h, x : x + w, r["plane"] : r["plane"] + r["bands"]]
                value[at] = np.frombuffer(r["data"], "<" + r["dtype"]).reshape(h, w, r["bands"])
                has[at] = True
        both = there[0] & there[1] & (values[0] == values[1])
        first = (sides[0] or sides[1])[0]
        out = []
        for k in range(bands):
            n = int((there[0] | there[1])[:, :, k].sum())
            if n:
                own = there[0][:, :, k]
                out.append({"path": first["path"], "page_index": first["page_index"], "band": k, "n": n, "n_equal": int(both[:, :, k].sum()), "total": int(values[0][:, :, k][own].astype(np.int64).sum()) if own.any() else None})
        return pa.Table.from_pylist(out, arrow)

    by = ("path", "page_index", "column", "row")
    return blocks(one, size).groupBy(*by).cogroup(blocks(other, size).groupBy(*by)).applyInArrow(run, AGREEMENT)
