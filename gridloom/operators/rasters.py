"""Tables to raster files: rows as pages, groups of pages as files, files into a folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.encode import RasterWriter, tag
from gridloom.operators.samples import holding
from gridloom.runtime import ship
from gridloom.sources.container import RasterError

#: Columns of a page to write; those after data may be missing or null.
PAGE_COLUMNS = "file string, page_index int, width int, height int, bands int, dtype string, color string, data binary"


def encode_arrays(rows: DataFrame, values: str, dtype: str, path: F.Column | None = None, compression: int = 1, predictor: int = 1, big: bool = False, level: int = 0, bands: int = 1, color: str = "Gray", rows_per_strip: int | None = None) -> DataFrame:
    """Each row's array as a file of one page, one row high: adds ``path`` and ``content``. Stays within its partition; null and empty arrays give no file. A row with whole numbers beyond ``dtype`` is written in a wider type, not cut."""
    ship(rows.sparkSession)
    named = rows.withColumn("path", F.monotonically_increasing_id().cast("string") if path is None else path)

    @F.arrow_udf("binary")
    def content(column: pa.Array) -> pa.Array:
        flat, cut = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                out.append(None)
                continue
            w = RasterWriter(big)
            w.image(np.ascontiguousarray(flat[a:b]).astype(holding(flat[a:b], dtype)).reshape(1, -1, bands), color, compression=compression, predictor=predictor, level=level, rows_per_strip=rows_per_strip)
            out.append(w.finish())
        return pa.array(out, pa.binary())

    return named.where(F.size(values) > 0).withColumn("content", content(values))


def encode_files(pages: DataFrame, compression: int = 1, predictor: int = 1, big: bool = False, level: int = 0, rows_per_strip: int | None = None) -> DataFrame:
    """(path, content) of files made of the rows with the same ``file``, ordered by ``page_index``; see PAGE_COLUMNS. A file is put together in one task, so it must fit there."""
    ship(pages.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["page_index"])
        w = RasterWriter(big)
        for r in rows:
            w.image(np.frombuffer(r["data"], "<" + r["dtype"]).reshape(r["height"], r["width"], r["bands"]), r["color"], compression=compression, predictor=predictor, level=level, rows_per_strip=rows_per_strip)
        return pa.table({"path": [rows[0]["file"]], "content": pa.array([w.finish()], pa.binary())})

    return pages.select("file", "page_index", "width", "height", "bands", "dtype", "color", "data").groupBy("file").applyInArrow(run, "path string, content binary")


def encode_tags(rows: DataFrame, columns: dict[str, tuple[int, int]], path: F.Column, big: bool = False) -> DataFrame:
    """A file for each row, of one directory without an image, with the given columns as tags: {column: (tag, field type)}; null columns have no tag. Adds ``path`` and ``content``."""
    ship(rows.sparkSession)
    names = list(columns)

    @F.arrow_udf("binary")
    def content(*values: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(v.to_pylist() for v in values), strict=True):
            w = RasterWriter(big)
            w.directory({columns[c][0]: tag(columns[c][1], v) for c, v in zip(names, row, strict=True) if v is not None})
            out.append(w.finish())
        return pa.array(out, pa.binary())

    return rows.withColumn("path", path).withColumn("content", content(*names))


def save(files: DataFrame, folder: str) -> DataFrame:
    """Write (path, content) into a folder that all machines reach, under the last part of each path; a row (path, length) per file when run. Files are moved into place whole."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name = path.rstrip("/").rsplit("/", 1)[-1]
                draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                raw = content.as_py()
                with where.open_output_stream(draft, compression=None) as sink:
                    sink.write(raw)
                where.move(draft, f"{root}/{name}")
                out.append((f"{root}/{name}", len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["path", "length"])

    return files.select("path", "content").mapInArrow(run, "path string, length bigint")


def save_strips(strips: DataFrame, folder: str, compression: int = 1, predictor: int = 1, big: bool = False, level: int = 0) -> DataFrame:
    """Write pages from a table of their strips: file, page_index, width, height, dtype, color, strip_index, rows_per_strip, data.

    The strips of a file come to one task in order and are written as they
    come, through a temporary file of the task, so neither file nor page has to
    fit into memory. A row (path, length) per file when run; files are moved
    into place whole. Fails on missing or repeated strips.
    """
    ship(strips.sparkSession)
    ordered = strips.select("file", "page_index", "strip_index", "width", "height", "dtype", "color", "rows_per_strip", "data").repartition("file").sortWithinPartitions("file", "page_index", "strip_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        rows = (dict(zip(b.schema.names, x, strict=True)) for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for name, own in groupby(rows, key=lambda r: r["file"]):
            with tempfile.TemporaryFile() as held:
                w = RasterWriter(big, held)
                for _, of_page in groupby(own, key=lambda r: r["page_index"]):
                    page = None
                    for i, r in enumerate(of_page):
                        if page is None:
                            page = w.page(r["width"], r["height"], r["dtype"], r["color"], compression=compression, predictor=predictor, level=level, rows_per_strip=r["rows_per_strip"])
                        if r["strip_index"] != i:
                            raise RasterError("InvalidChunkIndex", f"strip {r['strip_index']} of {name} in place of {i}")
                        page.strip(np.frombuffer(r["data"], "<" + r["dtype"]))
                    page.close()
                held.seek(0)
                draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(draft, compression=None) as sink:
                    while part := held.read(1 << 22):
                        sink.write(part)
                where.move(draft, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([w.size])], ["path", "length"])

    return ordered.mapInArrow(run, "path string, length bigint")
