"""Pages in any layout: tiles or strips, bands together or apart, either byte order, any depth.

The writer in ``encode`` keeps to native strips of whole words; this one lays
out what else the reader knows. Chunks may also come ready from a codec that
has no encoder here.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence

import numpy as np

from gridloom.functions.domains import CODE, FIELD_TYPES
from gridloom.operators import samples as S
from gridloom.operators.codecs import encode
from gridloom.sources.container import directory_bytes

_FORMATS = {1: "B", 3: "H", 4: "I", 5: "I", 11: "f", 12: "d", 16: "Q"}


def lay_out(fields: dict[int, tuple[int, Sequence]], chunks: Sequence[bytes], order: str = "<", big: bool = False, tiled: bool = False) -> bytes:
    """A file of one directory, its chunks before it; ``fields`` are {tag: (field type, values)}."""
    number, inline = ("Q", 8) if big else ("I", 4)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = len(out) - inline
    offsets = []
    for c in chunks:
        offsets.append(len(out))
        out += c
    wide = 16 if big else 4
    places, sizes = ("TileOffsets", "TileByteCounts") if tiled else ("StripOffsets", "StripByteCounts")
    fields = fields | {CODE[places]: (wide, offsets), CODE[sizes]: (wide, [len(c) for c in chunks])}
    entries = []
    for tag, (kind, values) in sorted(fields.items()):
        data = struct.pack(f"{order}{len(values)}{_FORMATS[kind]}", *values)
        count = len(data) // FIELD_TYPES[kind][1]
        if len(data) > inline:
            out += b"\0" * (-len(out) % 4)
            at = len(out)
            out += data
            data = struct.pack(order + number, at)
        entries.append(struct.pack(order + "HH" + number, tag, kind, count) + data.ljust(inline, b"\0"))
    out += b"\0" * (-len(out) % 4)
    struct.pack_into(order + number, out, link, len(out))
    body = struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + struct.pack(order + number, 0)
    assert len(body) == directory_bytes(len(entries), big)
    return bytes(out + body)


def chunk_arrays(image: np.ndarray, planar: int, tile: tuple[int, int] | None, rows: int | None) -> list[np.ndarray]:
    """The chunks of (height, width, bands), in order; tiles are filled up with zeros, strips are not."""
    h, w, bands = image.shape
    tw, th = tile or (w, rows or h)
    out = []
    for plane in np.split(image, bands, axis=2) if planar == 2 else [image]:
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = plane[y : y + th, x : x + tw]
                if tile:
                    whole = np.zeros((th, tw, plane.shape[2]), image.dtype)
                    whole[: part.shape[0], : part.shape[1]] = part
                    part = whole
                out.append(part)
    return out


def packed(part: np.ndarray, bits: int, predictor: int, order: str) -> bytes:
    """The bytes of a chunk's samples before compression."""
    h, w, n = part.shape
    rows = np.ascontiguousarray(part).reshape(h, w * n)
    if predictor == 3:
        return S.float_predict(rows, n).tobytes()
    word = S.storage(bits)
    rows = rows.view(f"u{word // 8}")
    if predictor == 2:
        rows = S.horizontal(rows, n, bits)
    return rows.astype(f"{order}u{word // 8}").tobytes() if bits == word else S.pack_bits(rows, bits).tobytes()


def image_file(
    image: np.ndarray,
    photometric: int = 1,
    bits: int | None = None,
    compression: int = 1,
    predictor: int = 1,
    planar: int = 1,
    tile: tuple[int, int] | None = None,
    rows: int | None = None,
    order: str = "<",
    big: bool = False,
    extra: Sequence[int] = (),
    color_map: Sequence[int] | None = None,
    encoder: Callable[[np.ndarray], bytes] | None = None,
    **more: tuple[int, Sequence],
) -> bytes:
    """A file of one page with (height, width, bands) samples, of ``bits`` bits each (their type's, if None). ``encoder`` makes a chunk's bytes in place of packing and compression; ``more`` are further tags by name."""
    h, w, n = image.shape
    bits = bits or image.dtype.itemsize * 8
    fields = {
        "ImageWidth": (4, [w]),
        "ImageLength": (4, [h]),
        "BitsPerSample": (3, [bits] * n),
        "Compression": (3, [compression]),
        "PhotometricInterpretation": (3, [photometric]),
        "SamplesPerPixel": (3, [n]),
        "PlanarConfiguration": (3, [planar]),
        "Predictor": (3, [predictor]),
        "SampleFormat": (3, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]] * n),
    }
    fields |= {"TileWidth": (4, [tile[0]]), "TileLength": (4, [tile[1]])} if tile else {"RowsPerStrip": (4, [rows or h])}
    if extra:
        fields["ExtraSamples"] = (3, list(extra))
    if color_map is not None:
        fields["ColorMap"] = (3, list(color_map))
    make = encoder or (lambda part: encode(compression, packed(part, bits, predictor, order)))
    chunks = [make(part) for part in chunk_arrays(image, planar, tile, rows)]
    return lay_out({CODE[k]: v for k, v in (fields | more).items()}, chunks, order, big, tile is not None)
