"""Writes pages into a tagged raster file: classic or 64-bit offsets, strips, native byte order.

A page can be written at once or strip by strip, so a page may be larger than
memory if the writer has a file on disk. Pages are chained; directories
outside the chain can be added and pointed at.
"""

from __future__ import annotations

import io
import struct
import sys
from collections.abc import Sequence
from typing import BinaryIO

import numpy as np

from gridloom.functions.domains import CODE, FIELD_TYPES
from gridloom.operators import samples as S
from gridloom.operators.codecs import encode
from gridloom.sources.container import RasterError

ORDER = "<" if sys.byteorder == "little" else ">"
#: Bytes of a strip unless rows per strip are given.
STRIP = 1_000_000
_FORMATS = {1: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
# fixed values: photometric interpretation and bands of each colour, with the depths that can be written: u unsigned, i signed, f float
COLORS = {
    "Gray": (1, 1, "u8 u16 u32 u64 i8 i16 i32 i64 f32 f64"),
    "RGB": (2, 3, "u8 u16 u32 u64 f32 f64"),
    "RGBA": (2, 4, "u8 u16 u32 u64 f32 f64"),
    "CMYK": (5, 4, "u8 u16 u32 u64 f32 f64"),
    "CMYKA": (5, 5, "u8"),
    "YCbCr": (6, 3, "u8"),
}
EXTRA = {"RGBA": 1, "CMYKA": 1}


def tag(kind: int, value: object) -> tuple[int, int, bytes]:
    """(type, count, bytes) of a tag: a number, a pair for rationals, a list of these, text or bytes."""
    if kind == 2:
        raw = (value.encode() if isinstance(value, str) else bytes(value)) + b"\0"
        return kind, len(raw), raw
    code = _FORMATS[kind]
    items = list(value) if isinstance(value, (list, tuple, bytes, bytearray, np.ndarray)) and not (len(code) == 2 and isinstance(value, tuple)) else [value]
    flat = [x for v in items for x in (v if len(code) == 2 else (v,))]
    try:
        return kind, len(items), struct.pack(f"{ORDER}{len(flat)}{code[0]}", *flat)
    except struct.error as e:
        raise RasterError("IntSizeError", e) from None


class RasterWriter:
    """One file, in memory or in ``file``, a binary file that can seek; ``finish`` gives its bytes, or that file."""

    def __init__(self, big: bool = False, file: BinaryIO | None = None):
        self.big, self.file = big, file
        self.out = io.BytesIO() if file is None else file
        self.size = 0
        head = b"II" if ORDER == "<" else b"MM"
        self.append(head + (struct.pack(ORDER + "HHHQ", 43, 8, 0, 0) if big else struct.pack(ORDER + "HI", 42, 0)))
        #: Where the offset of the next directory goes.
        self.link = self.size - (8 if big else 4)

    def append(self, data: bytes) -> int:
        """Put bytes at the end; gives their offset."""
        at = self.size
        if not self.big and at + len(data) >= 1 << 32:
            raise RasterError("IntSizeError", "a classic file ends at 4 GB")
        self.out.write(data)
        self.size += len(data)
        return at

    def patch(self, at: int, offset: int) -> None:
        """Write an offset over one that is there."""
        self.out.seek(at)
        self.out.write(struct.pack(ORDER + ("Q" if self.big else "I"), offset))
        self.out.seek(self.size)

    def _align(self) -> None:
        self.append(b"\0" * (-self.size % 4))

    def place(self, tags: dict[int, tuple[int, int, bytes]]) -> dict[int, int]:
        """Write the values that do not fit into a directory; gives their offsets by tag."""
        out = {}
        for t, (_, _, data) in tags.items():
            if len(data) > (8 if self.big else 4):
                self._align()
                out[t] = self.append(data)
        return out

    def directory(self, tags: dict[int, tuple[int, int, bytes]], chained: bool = True, placed: dict[int, int] | None = None) -> int:
        """Write a directory; gives its offset. In the chain, the one before then leads to it. ``placed`` has the offsets of values already written."""
        inline = 8 if self.big else 4
        fields = []
        placed = (placed or {}) | self.place({t: v for t, v in sorted(tags.items()) if t not in (placed or {})})
        for t, (kind, count, data) in sorted(tags.items()):
            if kind not in FIELD_TYPES or len(data) != FIELD_TYPES[kind][1] * count:
                raise RasterError("InvalidTagValueType", t)
            if len(data) <= inline:
                fields.append((t, kind, count, data.ljust(inline, b"\0")))
            else:
                fields.append((t, kind, count, struct.pack(ORDER + ("Q" if self.big else "I"), placed[t])))
        self._align()
        count, number = ("Q", "Q") if self.big else ("H", "I")
        body = struct.pack(ORDER + count, len(fields)) + b"".join(struct.pack(ORDER + "HH" + number, t, k, n) + v for t, k, n, v in fields)
        at = self.append(body)
        link = self.append(struct.pack(ORDER + number, 0))
        if chained:
            self.patch(self.link, at)
            self.link = link
        return at

    def page(self, width: int, height: int, dtype: str, color: str = "Gray", compression: int = 1, predictor: int = 1, level: int = 0, rows_per_strip: int | None = None, extra: Sequence[int] = (), resolution: tuple | None = None, tags: dict | None = None) -> StripPage:
        """Begin a page whose strips follow, top to bottom; bands beyond the colour's are extra samples."""
        return StripPage(self, width, height, np.dtype(dtype), color, compression, predictor, level, rows_per_strip, extra, resolution, tags or {})

    def image(self, pixels: np.ndarray, color: str = "Gray", compression: int = 1, predictor: int = 1, **how) -> int:
        """Write a page of (height, width, bands) samples; gives its directory's offset. ``how`` as for ``page``."""
        if pixels.ndim == 2:
            pixels = pixels[:, :, None]
        page = self.page(pixels.shape[1], pixels.shape[0], pixels.dtype, color, compression, predictor, **how)
        if pixels.shape[2] != page.samples:
            raise RasterError("InconsistentSizesEncountered", f"{pixels.shape[2]} bands for {color} and {len(page.extra)} extra samples")
        page.begin()
        for y in range(0, len(pixels), page.rows):
            page.strip(pixels[y : y + page.rows])
        return page.close()

    def finish(self) -> bytes | BinaryIO:
        return self.out.getvalue() if self.file is None else self.file


class StripPage:
    """A page being written."""

    def __init__(self, writer: RasterWriter, width: int, height: int, dtype: np.dtype, color: str, compression: int, predictor: int, level: int, rows_per_strip: int | None, extra: Sequence[int], resolution: tuple | None, tags: dict):
        self.photometric, bands, depths = COLORS[color]
        if not height or not width:
            raise RasterError("InvalidDimensions", f"{width}x{height}")
        kind = {"u": "u", "i": "i", "f": "f"}.get(dtype.kind)
        if kind is None or f"{kind}{dtype.itemsize * 8}" not in depths.split():
            raise RasterError("UnsupportedColorType", f"{color} of {dtype}")
        if (predictor == 2 and kind == "f") or (predictor == 3 and kind != "f"):
            raise RasterError("PredictorIncompatible", f"{predictor} with {dtype}")
        self.writer, self.width, self.height, self.dtype, self.color = writer, width, height, dtype, color
        self.compression, self.predictor, self.level, self.tags = compression, predictor, level, tags
        self.extra = [*([EXTRA[color]] if color in EXTRA else []), *extra]
        self.samples = bands + len(extra)
        self.rows = rows_per_strip or (1 if compression == 32773 else -(-STRIP // (width * self.samples * dtype.itemsize)))
        self.resolution = resolution or (1, (1, 1), (1, 1))
        self.offsets: list[int] = []
        self.counts: list[int] = []
        self.written = 0
        self.lead: dict | None = None

    def begin(self) -> None:
        """Write the values that go before the strips."""
        kind = {"u": 1, "i": 2, "f": 3}[self.dtype.kind]
        self.lead = {CODE["BitsPerSample"]: tag(3, [self.dtype.itemsize * 8] * self.samples), CODE["SampleFormat"]: tag(3, [kind] * self.samples)} | self.tags
        self.placed = self.writer.place(self.lead)

    def strip(self, pixels: np.ndarray) -> None:
        """The next rows: ``rows`` of them, or those that are left."""
        if self.lead is None:
            self.begin()
        want = min(self.rows, self.height - self.written)
        if not want or pixels.size != want * self.width * self.samples:
            raise RasterError("InconsistentSizesEncountered", f"{pixels.size} samples for {want} rows of {self.width} x {self.samples}")
        part = np.ascontiguousarray(pixels, self.dtype).reshape(want, self.width * self.samples)
        if self.predictor == 2:
            part = S.horizontal(part.view(f"u{self.dtype.itemsize}"), self.samples, self.dtype.itemsize * 8)
        elif self.predictor == 3:
            part = S.float_predict(part, self.samples)
        data = encode(self.compression, part.tobytes(), self.level)
        self.offsets.append(self.writer.append(data))
        self.counts.append(len(data))
        self.written += want

    def close(self) -> int:
        """Write the directory; gives its offset."""
        if self.written != self.height:
            raise RasterError("InconsistentSizesEncountered", f"{self.written} of {self.height} rows")
        wide = 16 if self.writer.big else 4
        out = {
            CODE["ImageWidth"]: tag(4, self.width),
            CODE["ImageLength"]: tag(4, self.height),
            CODE["Compression"]: tag(3, self.compression),
            CODE["PhotometricInterpretation"]: tag(3, self.photometric),
            CODE["StripOffsets"]: tag(wide, self.offsets),
            CODE["SamplesPerPixel"]: tag(3, self.samples),
            CODE["RowsPerStrip"]: tag(4, self.rows),
            CODE["StripByteCounts"]: tag(wide, self.counts),
            CODE["XResolution"]: tag(5, tuple(self.resolution[1])),
            CODE["YResolution"]: tag(5, tuple(self.resolution[2])),
            CODE["ResolutionUnit"]: tag(3, self.resolution[0]),
            CODE["Predictor"]: tag(3, self.predictor),
        }
        if self.photometric == 6:
            out[CODE["ChromaSubsampling"]] = tag(3, [1, 1])
        if self.extra:
            out[CODE["ExtraSamples"]] = tag(3, self.extra)
        return self.writer.directory(self.lead | out | self.tags, placed=self.placed)
