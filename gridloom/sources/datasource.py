"""``format("raster")``: the tables of ``scan`` as a data source, and a writer.

    spark.dataSource.register(RasterSource)
    spark.read.format("raster").option("table", "chunks").load("hdfs://host/folder/*.tif")
    pages.write.format("raster").option("compression", "8").mode("append").save("hdfs://host/folder")

Folders are listed, read and written through Arrow's file systems (local,
HDFS, S3, GCS), so they must be of such a kind and reachable from every
machine. Files are dealt to partitions by size. Filters are not pushed into
the source; prune with ``option("table", ...)`` and ``option("pages", "0,2")``.
Where files are many, or filters are to be pushed down, ``scan.load`` and the
tables of ``scan`` read the same through Spark's own file source.

The writer takes rows (path, content), or rows of pages as in
``rasters.PAGE_COLUMNS``, which must be dealt so that a file's pages lie in one
partition. Files get their names when the job has succeeded.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.sources import scan
from gridloom.sources.container import RasterError

_SCHEMAS = {"files": scan.FILES, "pages": scan.PAGES, "tags": scan.TAG_ROWS, "directories": scan.DIRECTORIES, "chunks": scan.CHUNKS, "decoded": scan.DECODED, "samples": scan.SAMPLES}
# option names come in lower case
_NAMES = {x.lower(): x for x in ("maxDecodedBytes", "maxChunkBytes", "maxTagBytes", "maxImageBytes", "firstIfdOffset", "referenceOrder", "firstPlaneOnly")}
#: Bytes of files, and files, that a partition has at most.
PARTITION_BYTES, PARTITION_FILES = 128 << 20, 4096


def _file_system(path: str):
    from pyarrow import fs

    if "://" not in path:
        path = path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    where, name = fs.FileSystem.from_uri(path)
    return where, name, path[: len(path) - len(name)] if path.endswith(name) else "file://"


def found(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files at a path: a file, all in a folder, or those that a pattern names; hidden ones are left out."""
    from pyarrow import fs

    parts = path.rstrip("/").split("/")
    odd = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    where, base, scheme = _file_system("/".join(parts[:odd]))
    info = where.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(scheme + info.path, info.size)]
    files = where.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    pattern = parts[odd:]

    def fits(name: str) -> bool:
        own = name[len(base) :].strip("/").split("/")
        return not any(x.startswith((".", "_")) for x in own) and len(own) >= len(pattern) and all(fnmatch.fnmatchcase(x, y) for x, y in zip(own, pattern, strict=False))

    return sorted((scheme + f.path, f.size) for f in files if f.type == fs.FileType.File and fits(f.path))


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("table", "pages")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), [f.name for f in schema], overwrite)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, arrow: pa.Schema):
        self.arrow = arrow
        self.options = {_NAMES.get(k.lower(), k.lower()): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        files = found(self.options.get("path", ""))
        if not files:
            raise RasterError("IoError", f"no files at {self.options.get('path')}")
        out, size = [_Files([])], 0
        for path, n in files:
            if out[-1].paths and (size + n > PARTITION_BYTES or len(out[-1].paths) == PARTITION_FILES):
                out, size = [*out, _Files([])], 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        o, table = scan.Options.of(**self.options), self.options.get("table", "pages")
        wanted = {int(x) for x in self.options["pages"].split(",")} if "pages" in self.options else None
        rows: list[dict] = []
        most = 16 if table == "decoded" else 1024
        for path in partition.paths:
            for row in scan.file_rows(path, None, "decoded" if table == "samples" else table, o, wanted):
                if table == "samples":
                    yield from scan.sample_batches(row, str(self.options.get("exact", "false")).lower() == "true", self.arrow)
                    continue
                rows.append(row)
                if len(rows) == most:
                    yield pa.RecordBatch.from_pylist(rows, self.arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # draft and name


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.options, self.names, self.overwrite = options, names, overwrite
        if not {"path", "content"} <= set(names) and not {"file", "page_index", "width", "height", "bands", "dtype", "color", "data"} <= set(names):
            raise RasterError("InvalidTagValueType", f"rows of {names} are neither files nor pages")
        self.drafts = f"_drafts-{uuid.uuid4().hex}"

    def _files(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        if "content" in self.names:
            yield from ((r["path"].rstrip("/").rsplit("/", 1)[-1], r["content"]) for r in rows)
            return
        from gridloom.operators.encode import RasterWriter

        o = {k.lower(): v for k, v in self.options.items()}
        how = {"compression": int(o.get("compression", 1)), "predictor": int(o.get("predictor", 1)), "level": int(o.get("level", 0)), "rows_per_strip": int(o["rowsperstrip"]) if "rowsperstrip" in o else None}
        for name, own in groupby(rows, key=lambda r: r["file"]):
            w = RasterWriter(str(o.get("big", "false")).lower() == "true")
            for r in sorted(own, key=lambda r: r["page_index"]):
                w.image(np.frombuffer(r["data"], "<" + r["dtype"]).reshape(r["height"], r["width"], r["bands"]), r["color"], **how)
            yield name, w.finish()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, root, _ = _file_system(self.options["path"])
        out = []
        for name, content in self._files(r for b in iterator for r in b.to_pylist()):
            draft = f"{root}/{self.drafts}/{uuid.uuid4().hex}"
            where.create_dir(f"{root}/{self.drafts}", recursive=True)
            with where.open_output_stream(draft, compression=None) as sink:
                sink.write(content)
            out.append((draft, f"{root}/{name}"))
        return _Written(out)

    def commit(self, messages: list[_Written | None]) -> None:
        where, root, _ = _file_system(self.options["path"])
        if self.overwrite:
            for path, _ in found(self.options["path"]):
                where.delete_file(_file_system(path)[1])
        for m in messages:
            for draft, name in m.files if m else ():
                where.move(draft, name)
        self._forget(where, root)

    def abort(self, messages: list[_Written | None]) -> None:
        where, root, _ = _file_system(self.options["path"])
        self._forget(where, root)

    def _forget(self, where, root: str) -> None:
        from pyarrow import fs

        if where.get_file_info(f"{root}/{self.drafts}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.drafts}")
