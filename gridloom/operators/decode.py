"""From a chunk's bytes to its samples."""

from __future__ import annotations

import numpy as np

from gridloom.operators import samples as S
from gridloom.operators.codecs import Job, decode
from gridloom.sources.container import Limits, RasterError, Source
from gridloom.sources.page import Page


def chunk_bytes(src: Source, page: Page, chunk: int, limits: Limits = Limits()) -> bytes:
    """The stored bytes of a chunk."""
    return stored_bytes(src, page.compression, page.offsets[chunk], page.counts[chunk], limits)


def stored_bytes(src: Source, compression: int, at: int, n: int, limits: Limits = Limits()) -> bytes:
    """The bytes of a chunk by its place in the file. Uncompressed ones may be cut short by the end of the file."""
    if n > limits.chunk:
        raise RasterError("LimitsExceeded", n)
    return src.up_to(at, n) if compression == 1 else src.take(at, n)


def decode_rows(page: Page, chunk: int, raw: bytes, limits: Limits = Limits(), reference_order: bool = False) -> np.ndarray:
    """Samples (height, width * samples of a pixel) of the data in a chunk as they were before prediction, with unknown rows zero; bits are unpacked."""
    dtype = S.sample_type(page.bits, page.format)
    S.check_predictor(page.predictor, page.bits, page.format)
    plane, _, _, w, h = page.place(chunk)
    n = page.chunk_width * page.chunk_samples
    if page.compression == 7 and page.photometric == 6:
        row_bytes = n
    elif page.photometric == 6 and page.chroma != (1, 1) and page.compression != 7:
        raise RasterError("ChromaSubsampling", page.chroma)
    else:
        row_bytes = (n * page.bits + 7) // 8
    if row_bytes * page.chunk_height > limits.decoded:
        raise RasterError("LimitsExceeded", row_bytes * page.chunk_height)
    stored = page.chunk_height if page.kind == "Tile" else h
    if page.across > 1 and page.chunk_width * page.bits * page.chunk_samples % 8:
        raise RasterError("MisalignedTileBoundaries")
    job = Job(page.chunk_width, stored, page.chunk_samples, row_bytes, page.fill_order, page.jpeg_tables, reference_order)
    flat = decode(page.compression, raw, job)
    if len(flat) < h * row_bytes:
        raise RasterError("IoError", f"{len(flat)} of {h * row_bytes} bytes in chunk {chunk}")
    rows = np.frombuffer(flat, np.uint8, h * row_bytes).reshape(h, row_bytes)
    stride = page.chunk_samples
    native = page.compression in (34676, 34677)
    if page.predictor == 3:
        out = S.undo_float(rows, stride, page.bits // 8)
    else:
        if page.bits in (8, 16, 32, 64):
            order = "=" if native else page.order
            out = np.ascontiguousarray(rows).view(f"{order}u{page.bits // 8}").astype(f"u{page.bits // 8}")
        else:
            out = S.unpack_bits(rows, n, page.bits)
        if page.predictor == 2:
            out = S.undo_horizontal(out, stride, page.bits)
        out = out.view(dtype) if page.bits in (8, 16, 32, 64) else out.astype(dtype)
    return out[:, : w * stride]


def decode_chunk(page: Page, chunk: int, raw: bytes, limits: Limits = Limits(), reference_order: bool = False) -> np.ndarray:
    """Samples (height, width, bands) of a chunk: predictor undone, surplus samples dropped, interpretation applied."""
    kind, bands = page.color
    rows = decode_rows(page, chunk, raw, limits, reference_order)
    out = rows.reshape(len(rows), -1, page.chunk_samples)[:, :, : bands if page.planar == 1 else 1]
    if page.photometric == 0:
        out = S.invert(out, page.bits)
    elif page.photometric == 8 and page.bits == 8:
        if page.planar == 1:
            out = S.lab_bias(out)
        elif page.place(chunk)[0] in (1, 2):
            out = out + np.uint8(128)
    return out


def planes_read(page: Page, limit: int | None, first_plane_only: bool = False) -> int:
    """How many planes of a page are read under a limit of bytes for whole images: all, or else the first alone; none is an error."""
    _, bands = page.color
    plane = page.width * page.height * S.sample_type(page.bits, page.format).itemsize * (1 if page.planar == 2 else bands)
    planes = bands if page.planar == 2 else 1
    if first_plane_only or (limit is not None and plane * planes > limit):
        planes = 1
    if limit is not None and plane * planes > limit:
        raise RasterError("LimitsExceeded", plane * planes)
    return planes


def read_image(src: Source, page: Page, limits: Limits = Limits(), first_plane_only: bool = False) -> np.ndarray:
    """The samples (height, width, bands) of a page, from all its chunks; of bands that lie apart only the first, if all are beyond the limit."""
    _, bands = page.color
    dtype = S.sample_type(page.bits, page.format)
    planes = planes_read(page, limits.decoded, first_plane_only)
    out = np.zeros((page.height, page.width, planes if page.planar == 2 else bands), dtype)
    for chunk in range(page.chunks):
        plane, x, y, w, h = page.place(chunk)
        if plane >= planes:
            continue
        part = decode_chunk(page, chunk, chunk_bytes(src, page, chunk, limits), limits)
        if page.planar == 2:
            out[y : y + h, x : x + w, plane] = part[:, :, 0]
        else:
            out[y : y + h, x : x + w] = part
    return out


def packed_rows(page: Page, image: np.ndarray) -> bytes:
    """An image of less than 8 bits as the packed rows that a plain buffer holds."""
    return S.pack_bits(image.reshape(len(image), -1), page.bits).tobytes() if page.bits < 8 else image.tobytes()
