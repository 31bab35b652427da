"""The validated view of a directory as a page, its colour type and its chunk grid."""

from __future__ import annotations

from dataclasses import dataclass

from gridloom.functions.domains import CODE, PHOTOMETRIC
from gridloom.sources.container import Directory, Header, Limits, RasterError, Source, Tags


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    extra: list[int]
    format: int
    photometric: int
    compression: int
    predictor: int
    planar: int
    fill_order: int
    chroma: tuple[int, int]
    kind: str  # Strip or Tile
    chunk_width: int
    chunk_height: int
    offsets: list[int]
    counts: list[int]
    color_map: list[int] | None
    jpeg_tables: bytes | None
    order: str
    lenient: bool = False

    @property
    def planes(self) -> int:
        return self.samples if self.planar == 2 else 1

    @property
    def across(self) -> int:
        return -(-self.width // self.chunk_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.chunk_height)

    @property
    def chunks(self) -> int:
        return self.across * self.down * self.planes

    @property
    def chunk_samples(self) -> int:
        """Samples of a pixel within a chunk."""
        return 1 if self.planar == 2 else self.samples

    @property
    def color(self) -> tuple[str, int]:
        """Colour type, and how many samples of a pixel it takes."""
        return color_type(self.photometric, self.samples, self.extra, self.bits, self.format, self.lenient)

    def place(self, chunk: int) -> tuple[int, int, int, int, int]:
        """(plane, x, y, width, height) of the data in a chunk."""
        per = self.across * self.down
        if not 0 <= chunk < self.chunks:
            raise RasterError("InvalidChunkIndex", chunk)
        plane, i = divmod(chunk, per)
        row, col = divmod(i, self.across)
        x, y = col * self.chunk_width, row * self.chunk_height
        return plane, x, y, min(self.chunk_width, self.width - x), min(self.chunk_height, self.height - y)


def color_type(photometric: int, samples: int, extra: list[int], bits: int, fmt: int, lenient: bool = False) -> tuple[str, int]:
    """Colour type of a page and its number of samples; what has no type is an error."""
    alpha = bool(extra) and (extra[0] in (1, 2) or (lenient and extra[0] == 0 and samples > 3))
    own = samples - len(extra)
    if photometric == 2:
        if own == 3:
            return ("RGBA", 4) if alpha else ("RGB", 3)
        if own == 4:
            return "RGBA", 4
    elif photometric == 5:
        if own == 4:
            return ("CMYKA", 5) if alpha else ("CMYK", 4)
        if own == 5:
            return "CMYKA", 5
    elif photometric == 6 and own == 3:
        return "YCbCr", 3
    elif photometric in (0, 1):
        return ("Gray", 1) if samples == 1 else ("Multiband", samples)
    elif (photometric == 9 and own == 3 and fmt == 1) or (photometric == 8 and own == 3 and bits == 8):
        return "Lab", 3
    elif photometric == 32844 and samples == 1 and bits == 32 and fmt == 3:
        return "Gray", 1
    elif photometric == 32845 and samples == 3 and bits == 32 and fmt == 3:
        return "RGB", 3
    elif photometric == 3:
        return "Palette", 1
    elif photometric == 4:
        return "Gray", 1
    raise RasterError("UnsupportedColorType", f"interpretation {PHOTOMETRIC.get(photometric, photometric)}, {bits} bits, {samples} samples")


def _uniform(values: list[int], kind: str) -> int:
    if not values or any(v != values[0] for v in values):
        raise RasterError(kind, values)
    return values[0]


def read_page(src: Source, head: Header, directory: Directory, limits: Limits = Limits(), lenient: bool = False) -> Page:
    """Check a directory against the rules for pages."""
    tags = Tags(src, head, directory, limits)
    get = lambda name, to, default=None: (lambda v: default if v is None else v)(tags.find_as(CODE[name], to))
    need = lambda name, to: (tags.get(CODE[name]), get(name, to))[1]
    many = lambda name, to: tags.find_list(CODE[name], to)

    width, height = need("ImageWidth", "u32"), need("ImageLength", "u32")
    if not width or not height:
        raise RasterError("InvalidDimensions", f"{width}x{height}")
    photometric = get("PhotometricInterpretation", "u16")
    if photometric not in PHOTOMETRIC:
        raise RasterError("UnknownInterpretation", photometric)
    compression = get("Compression", "u16", 1)
    tables = None
    if compression == 7 and tags.entry(CODE["JPEGTables"]) is not None:
        tables = bytes(many("JPEGTables", "u8"))
        if len(tables) < 2:
            raise RasterError("InvalidTagValueType", "JPEGTables")
    samples = get("SamplesPerPixel", "u16", 1)
    if not samples:
        raise RasterError("SamplesPerPixelIsZero")
    extra = [x if x in (1, 2) else 0 for x in many("ExtraSamples", "u16") or []]
    if len(extra) > samples:
        raise RasterError("InconsistentSizesEncountered", "ExtraSamples")
    formats = many("SampleFormat", "u16")
    fmt = 1 if formats is None else _uniform(formats, "UnsupportedSampleFormat" if formats else "InvalidTagValueType")
    depths = many("BitsPerSample", "u16") or [1]
    if len(depths) not in (1, samples):
        raise RasterError("InconsistentSizesEncountered", "BitsPerSample")
    bits = _uniform(depths, "InconsistentBitsPerSample")
    if not bits:
        raise RasterError("InconsistentBitsPerSample", depths)
    predictor = get("Predictor", "u16", 1)
    if predictor not in (1, 2, 3):
        raise RasterError("UnknownPredictor", predictor)
    planar = get("PlanarConfiguration", "u16", 1)
    if planar not in (1, 2):
        raise RasterError("UnknownPlanarConfiguration", planar)
    chroma = many("ChromaSubsampling", "u16") or [2, 2]
    if len(chroma) != 2:
        raise RasterError("InvalidCountForTag", "ChromaSubsampling")
    planes = samples if planar == 2 else 1

    has = lambda *t: all(tags.entry(CODE[x]) is not None for x in t)
    strips, tiles = ("StripOffsets", "StripByteCounts"), ("TileOffsets", "TileByteCounts")
    tiled = has("TileWidth") or has("TileLength")
    if tiled and (has(*tiles) or has(*strips)):  # tiles may be listed under the tags of strips
        kind, cw, ch = "Tile", need("TileWidth", "u32"), need("TileLength", "u32")
        if not cw or not ch:
            raise RasterError("InvalidTagValueType", "a tile without size")
        offsets, counts = (many(n, "u64") for n in (tiles if has(*tiles) else strips))
    elif not tiled and has(*strips):
        kind, cw, ch = "Strip", width, get("RowsPerStrip", "u32", height)
        if not ch:
            raise RasterError("InconsistentSizesEncountered", "RowsPerStrip")
        ch = min(ch, height)
        offsets, counts = (many(n, "u64") for n in strips)
    else:
        raise RasterError("StripTileTagConflict")
    expected = -(-width // cw) * -(-height // ch) * planes
    if len(offsets) != len(counts) or len(offsets) != expected:
        raise RasterError("InconsistentSizesEncountered" if len(offsets) != len(counts) else "IncorrectChunkCount", f"{len(offsets)} offsets, {len(counts)} counts, {expected} chunks")
    if compression in (34676, 34677):
        fmt, bits = 3, 32
    color_map = None
    if photometric == 3:
        color_map = many("ColorMap", "u16")
        if color_map is None:
            raise RasterError("RequiredTagNotFound", "ColorMap")
        if len(color_map) != 3 << bits:
            raise RasterError("InconsistentSizesEncountered", "ColorMap")
    return Page(width, height, bits, samples, extra, fmt, photometric, compression, predictor, planar, get("FillOrder", "u16", 1), (chroma[0], chroma[1]), kind, cw, ch, offsets, counts, color_map, tables, head.order, lenient)
