"""Legacy ARC archives and their conversion to WARC.

An ARC file starts with a version block, whose own header line says how long
it is and whose second line names the version: version 1 has header lines of
five fields, version 2 of ten. A header line ends with the declared length of
what follows. ``read_arc`` goes by these lengths alone. The converter gives
every record a WARC identifier (a UUID made from the archive's name, offset
and URL, so a repeated task makes the same), the timestamp in ISO form, a type
and SHA-256 digests of block and payload. Of records with equal payloads of at
least ``least`` bytes one is a response and the others are revisits that refer
to it, without the payload.

Archives are gzip members, one per record. They are written under another name
and then moved, so a lost or repeated task leaves no half file. Null HTML is
an empty payload, a null URL is written as ``-``. Repeated rows are records of
their own; among equal ids the one that is stored first is the response. An
empty table gives no archives and no rows. Only the id, URL and HTML columns
are read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.textkern import slices
from gridloom.runtime import Scratch, partitions, ship

# fixed values: field names of the two header lines
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Payloads below this are stored each time.
LEAST = 100
#: Bytes of records that an archive holds before the next is begun.
ARCHIVE = 64 << 20
LEVEL = 3


def member(raw: bytes) -> bytes:
    """One gzip member, equal for equal bytes."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(source) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream; holds one member at a time."""
    at, left = 0, b""
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not left:
                left = source.read(1 << 20)
                if not left:
                    if used:
                        raise ValueError(f"the archive ends within the record at {at}")
                    return
            parts.append(z.decompress(left))
            used += len(left) - len(z.unused_data)
            left = z.unused_data
        yield at, b"".join(parts)
        at += used


# ---- ARC ------------------------------------------------------------------


def arc_version_block(name: str, date: str, version: int) -> bytes:
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    body = f"{version} 0 gridloom\n{fields}\n".encode()
    if version == 1:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return head.encode() + body + b"\n"


def _field(x: str | None) -> str:
    """A header field: without the blanks and line ends that would end it."""
    return "".join(c if c > " " and c != "\x7f" else "%" + c.encode().hex().upper() for c in x) if x else "-"


def arc_record(url: str | None, date: str, block: bytes, version: int, name: str = "-", offset: int = 0) -> bytes:
    if version == 1:
        head = f"{_field(url)} 0.0.0.0 {date} text/html {len(block)}\n"
    else:
        head = f"{_field(url)} 0.0.0.0 {date} text/html 200 - - {offset} {name} {len(block)}\n"
    return head.encode() + block + b"\n"


def read_arc(source, mode: str = "FAILFAST") -> Iterator[dict]:
    """Records of a gzip ARC stream, by declared lengths: url, ip, date, type, status (version 2), offset, version, block.

    Fields are counted from the end of the header line, so blanks in a URL do
    no harm. A record that is damaged fails the stream, or with mode PERMISSIVE
    is given as (offset, error), and the next member goes on.
    """
    version = 0
    stream = members(source)
    while True:
        at = -1
        try:
            at, raw = next(stream)
            end = raw.find(b"\n")
            line = raw[:end].decode("utf-8", "replace")
            if line.startswith("filedesc://"):
                size = int(line.rsplit(" ", 1)[-1])
                found = int(raw[end + 1 : end + 1 + size].split(b" ", 1)[0])
                if found not in (1, 2):
                    raise ValueError(f"unknown ARC version {found}")
                version = found
                continue
            want = 5 if version == 1 else 10
            fields = line.rsplit(" ", want - 1)
            if not version or len(fields) != want:
                raise ValueError(f"the header line at {at} has {len(fields)} fields, not the {want} of version {version}")
            size = int(fields[-1])
            block = raw[end + 1 : end + 1 + size]
            if len(block) != size:
                raise ValueError(f"the record at {at} has {len(block)} of {size} declared bytes")
            row = {"url": fields[0], "ip": fields[1], "date": fields[2], "type": fields[3], "status": int(fields[4]) if version == 2 else None, "offset": at, "version": version, "block": block}
        except StopIteration:
            return
        except (ValueError, zlib.error) as e:
            if mode != "PERMISSIVE":
                raise
            row = {"offset": at, "error": str(e)}
            if at < 0:  # not even a gzip member: what follows cannot be told apart
                yield row
                return
        yield row


def http_split(block: bytes) -> tuple[bytes, bytes]:
    """Header part of an HTTP message, with its blank line, and payload; all payload if it has no header."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def http_headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if v}


# ---- WARC -----------------------------------------------------------------


def warc_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def iso_date(date: str) -> str:
    """A WARC date from an ARC date of 8 to 14 digits; missing digits are the first possible ones."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() and len(date) >= 4 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a gzip WARC stream."""
    for at, raw in members(source):
        end = raw.find(b"\r\n\r\n")
        if not raw.startswith(b"WARC/") or end < 0:
            raise ValueError(f"no WARC record at {at}")
        headers = http_headers(raw[:end])
        size = int(headers["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at {at} has {len(block)} of {size} declared bytes")
        yield headers, block


def convert(record: dict, archive: str, page: str, digest: str, refers: dict | None) -> bytes:
    """The WARC record of an ARC record; a revisit if it refers to another."""
    head, payload = http_split(record["block"])
    block = head if refers else record["block"]
    headers = {
        "WARC-Record-ID": warc_id(archive, record["offset"], record["url"]),
        "WARC-Date": iso_date(record["date"]),
        "WARC-Target-URI": record["url"],
        "WARC-IP-Address": record["ip"],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{sha256(block).hexdigest()}",
        "WARC-Identified-Payload-Type": record["type"],
        "X-Page-Id": page,
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers["id"], "X-Refers-To-Page": refers["page"]}
    return warc_record("revisit" if refers else "response", headers, block)


# ---- over tables ----------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_arcs(pages: DataFrame, path: str, date: str = "20000101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """ARC archives of the pages, of versions 1 and 2 in turn; a row per record when run: archive, offset, page (id as JSON), digest, size."""
    ship(pages.sparkSession)
    picked = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    names = ["archive", "offset", "page", "digest", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, at, sink, draft, name, version = TaskContext.get().partitionId(), 0, 0, None, "", "", 1
        where, folder = _open(path)
        for batch in batches:
            ids, urls = batch.column("id").to_pylist(), batch.column("url").to_pylist()
            for a, _, offsets, data in slices(batch.column("html")):
                rows = []
                for r in range(len(offsets) - 1):
                    if sink is None:
                        where.create_dir(folder, recursive=True)
                        version = 1 + (part + number) % 2
                        name = f"pages-{part:06d}-{number:04d}.arc.gz"
                        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
                        sink = where.open_output_stream(draft, compression=None)
                        at = sink.write(member(arc_version_block(name, date, version)))
                    payload = data[offsets[r] : offsets[r + 1]].tobytes()
                    page = json.dumps(ids[a + r])
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\nContent-Length: {len(payload)}\r\n\r\n"
                    rows.append((name, at, page, sha256(payload).hexdigest(), len(payload)))
                    at += sink.write(member(arc_record(urls[a + r], date, head.encode() + payload, version, name, at)))
                    if at >= ARCHIVE:
                        sink.close()
                        where.move(draft, f"{folder}/{name}")
                        sink, number = None, number + 1
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names)
        if sink is not None:
            sink.close()
            where.move(draft, f"{folder}/{name}")

    return picked.mapInArrow(run, "archive string, offset bigint, page string, digest string, size bigint")


def arc_index(spark: SparkSession, path: str, archives: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """A row per record of the ARC archives named in ``archives``, from reading them: archive, offset, url, page, digest, size; and error, for records that are damaged (mode PERMISSIVE)."""
    ship(spark)
    names = ["archive", "offset", "url", "page", "digest", "size", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _open(path)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with where.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    for r in read_arc(source, mode):
                        if "error" in r:
                            rows.append((name, r["offset"], None, None, None, None, r["error"]))
                            continue
                        head, payload = http_split(r["block"])
                        rows.append((name, r["offset"], r["url"], http_headers(head).get("x-page-id", "null"), sha256(payload).hexdigest(), len(payload), None))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], names)

    return archives.select("archive").distinct().mapInArrow(run, "archive string, offset bigint, url string, page string, digest string, size bigint, error string")


def choose_responses(index: DataFrame, id_type: T.DataType, least: int = LEAST) -> DataFrame:
    """``index``, without its damaged records, with, for revisits, the response's archive, offset, url and page; null for responses.

    The response of a payload is found by an aggregate, so equal payloads are
    never gathered, and only payloads that occur twice are joined back.
    """
    ident = F.from_json(F.concat(F.lit('{"x":'), "page", F.lit("}")), "x string")["x"].cast(id_type)
    index = index.where("error is null").withColumn("ident", ident)
    big = index.where(F.col("size") >= least)
    first = F.min(F.struct(F.col("ident").isNull().alias("none"), "ident", "archive", "offset", "url", "page")).alias("first")
    twice = big.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    both = index.join(twice, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("size") >= least) & ((F.col("archive") != F.col("first.archive")) | (F.col("offset") != F.col("first.offset")))
    return both.select("archive", "offset", "page", "digest", F.when(revisit, F.struct(*(F.col(f"first.{c}").alias(c) for c in ("archive", "offset", "url", "page")))).alias("refers"))


def convert_archives(spark: SparkSession, arcs: str, warcs: str, chosen: DataFrame) -> DataFrame:
    """Convert every ARC archive to a WARC archive; a row per archive when run: file, records."""
    ship(spark)

    def run(table: pa.Table) -> pa.Table:
        name = table.column("archive")[0].as_py()
        plan = {r["offset"]: r for r in table.select(["offset", "page", "digest", "refers"]).to_pylist()}
        where, folder = _open(arcs)
        there, out = _open(warcs)
        there.create_dir(out, recursive=True)
        file = name.replace(".arc.", ".warc.")
        draft = f"{out}/.{file}.{uuid.uuid4().hex}"
        n = 0
        with where.open_input_stream(f"{folder}/{name}", compression=None) as source, there.open_output_stream(draft, compression=None) as sink:
            info = warc_record("warcinfo", {"WARC-Record-ID": warc_id(file), "WARC-Date": iso_date("20000101"), "WARC-Filename": file, "Content-Type": "application/warc-fields"}, f"software: gridloom\r\nconverted-from: {name}\r\n".encode())
            sink.write(member(info))
            for r in read_arc(source, "PERMISSIVE"):
                p = plan.get(r["offset"])
                if p is None:  # damaged: the index has it as an error, or has failed
                    continue
                to = p["refers"]
                refers = {"id": warc_id(to["archive"], to["offset"], to["url"]), "page": to["page"]} if to else None
                sink.write(member(convert(r, name, p["page"], p["digest"], refers)))
                n += 1
        there.move(draft, f"{out}/{file}")
        return pa.table({"file": [file], "records": [n]})

    return chosen.groupBy("archive").applyInArrow(run, "file string, records bigint")


def read_warcs(spark: SparkSession, path: str, files: DataFrame, id_type: T.DataType, id_col: str = "page_id") -> DataFrame:
    """A row per response or revisit of the WARC archives: id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, date.

    Payloads that are stored are measured and digested again, and a record
    whose payload does not have its digest is an error.
    """
    ship(spark)
    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers", "url", "record_id", "date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _open(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with where.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    for h, block in read_warc(source):
                        kind = h["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        size, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            payload = http_split(block)[1]
                            size = len(payload)
                            if sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: {h['warc-record-id']} does not have its digest")
                        rows.append((h["x-page-id"], size, digest, kind, h.get("x-refers-to-page"), h["warc-target-uri"], h["warc-record-id"], h["warc-date"]))
                types = (pa.string(), pa.int64(), *[pa.string()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names)

    got = files.select("file").mapInArrow(run, "page string, payload_bytes bigint, payload_digest string, record_type string, refers string, url string, record_id string, date string")
    plain = lambda c: F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "x string")["x"].cast(id_type)
    return got.select(plain("page").alias(id_col), "payload_bytes", "payload_digest", "record_type", plain("refers").alias("refers_to"), "url", "record_id", "date")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write the pages as ARC archives, convert these to WARC archives and read those back, see ``read_warcs``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    kind = pages.schema[id_col].dataType
    arcs, warcs = f"{scratch.path}/arc", f"{scratch.path}/warc"
    n = partitions(spark)
    written = scratch.table("written", write_arcs(pages, arcs, id_col=id_col, url_col=url_col, html_col=html_col).select("archive"))
    index = scratch.table("index", arc_index(spark, arcs, written.repartition(n, "archive")))
    files = scratch.table("files", convert_archives(spark, arcs, warcs, choose_responses(index, kind, least)))
    scratch.drop("arc")
    return read_warcs(spark, warcs, files.repartition(n, "file"), kind, id_col)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
