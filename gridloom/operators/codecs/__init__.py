"""Codecs of strips and tiles, in a registry that callers can add to.

A decoder takes (bytes, job) and an encoder (bytes, level); a job says what a
chunk should become. ``register`` adds or replaces a codec by its compression
code; workers get it as the functions that are passed to them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from gridloom.functions.domains import COMPRESSION
from gridloom.operators.codecs import fax, jpeg, logluv, lzw, packbits
from gridloom.sources.container import RasterError


@dataclass(frozen=True)
class Job:
    """The chunk to decode: its size in pixels, samples of a pixel in it, bytes of a row, and what the codec may need to know."""

    width: int
    height: int
    samples: int
    row_bytes: int
    fill_order: int = 1
    tables: bytes | None = None
    reference_order: bool = False

    @property
    def size(self) -> int:
        return self.row_bytes * self.height


Decoder = Callable[[bytes, Job], bytes]
Encoder = Callable[[bytes, int], bytes]


def _inflate(raw: bytes, job: Job) -> bytes:
    z = zlib.decompressobj()
    try:
        return z.decompress(raw, job.size) if job.size else b""
    except zlib.error as e:
        raise RasterError("IoError", e) from None


def _zstd(raw: bytes, job: Job) -> bytes:
    import zstandard

    try:
        return zstandard.ZstdDecompressor().stream_reader(raw).read(job.size)
    except zstandard.ZstdError as e:
        raise RasterError("IoError", e) from None


def _zstd_encode(raw: bytes, level: int) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level or 3).compress(raw)


DECODERS: dict[int, Decoder] = {
    1: lambda raw, job: raw[: job.size],
    3: lambda raw, job: fax.decode_1d(raw, job.width, job.height, job.fill_order),
    4: lambda raw, job: fax.decode_2d(raw, job.width, job.height, job.fill_order),
    5: lambda raw, job: lzw.decode(raw, job.size),
    7: lambda raw, job: jpeg.decode(raw, job.tables, job.width, job.height, job.samples),
    8: _inflate,
    32946: _inflate,
    32773: lambda raw, job: packbits.decode(raw, job.size),
    34676: lambda raw, job: logluv.decode(raw, job.width, job.height, job.samples, job.reference_order),
    34677: lambda raw, job: logluv.decode_24(raw, job.width, job.height, job.samples),
    50000: _zstd,
}
ENCODERS: dict[int, Encoder] = {
    1: lambda raw, level: raw,
    5: lambda raw, level: lzw.encode(raw),
    8: lambda raw, level: zlib.compress(raw, level or 6),
    32946: lambda raw, level: zlib.compress(raw, level or 6),
    32773: lambda raw, level: packbits.encode(raw),
    50000: _zstd_encode,
}


def register(code: int, decoder: Decoder | None = None, encoder: Encoder | None = None) -> None:
    if decoder is not None:
        DECODERS[code] = decoder
    if encoder is not None:
        ENCODERS[code] = encoder


def decode(compression: int, raw: bytes, job: Job) -> bytes:
    if compression not in DECODERS:
        raise RasterError("UnsupportedCompressionMethod", COMPRESSION.get(compression, compression))
    try:
        return DECODERS[compression](raw, job)
    except (IndexError, KeyError, ValueError) as e:  # damaged data lead a codec out of its tables
        raise RasterError("IoError", f"damaged {COMPRESSION.get(compression, compression)} data: {e!r}") from None


def encode(compression: int, raw: bytes, level: int = 0) -> bytes:
    if compression not in ENCODERS:
        raise RasterError("UnsupportedCompressionMethod", COMPRESSION.get(compression, compression))
    return ENCODERS[compression](raw, level)
