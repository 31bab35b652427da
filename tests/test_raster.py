import itertools
import struct
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.domains import CODE, names
from gridloom.operators import rasters
from gridloom.operators.decode import packed_rows, read_image
from gridloom.operators.encode import COLORS, RasterWriter, tag
from gridloom.sources.container import Entry, Limits, RasterError, Source, Tags, Value, directory_bytes, into, into_list, read_directory, read_header, read_value, swap, value_range, walk
from gridloom.sources import scan
from gridloom.sources.page import color_type, read_page

# fixed values: malformed files and the rule that each breaks
NO_CHUNKS = bytes([73, 73, 42, 0, 8, 0, 0, 0, 8, 0, 0, 1, 4, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 40, 1, 0, 0, 0, 158, 0, 0, 251, 3, 1, 3, 0, 1, 0, 0, 0, 1, 0, 0, 39, 6, 1, 3, 0, 1, 0, 0, 0, 0, 0, 0, 0, 17, 1, 4, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 3, 0, 1, 0, 0, 0, 158, 0, 0, 251, 67, 1, 3, 0, 1, 0, 0, 0, 40, 0, 0, 0, 66, 1, 4, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 48, 178, 178, 178, 178, 178, 178, 178])
TOO_MANY = bytes([73, 73, 43, 0, 8, 0, 0, 0, 8, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 255, 0, 8, 0, 0, 0, 23, 0, 12, 0, 0, 65, 4, 0, 1, 6, 0, 0, 1, 16, 0, 1, 0, 0, 0, 0, 0, 0, 128, 0, 0, 0, 0, 0, 0, 0, 3, 0, 1, 0, 0, 0, 1, 0, 0, 0, 59, 73, 84, 186, 202, 83, 240, 66, 1, 53, 22, 56, 47, 0, 0, 0, 0, 0, 0, 1, 222, 4, 0, 58, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 1, 1, 4, 0, 0, 100, 0, 0, 89, 89, 89, 89, 89, 89, 89, 89, 96, 1, 20, 89, 89, 89, 89, 18])


def opened(raw):
    src = Source.of(raw)
    head = read_header(src)
    return src, head, list(walk(src, head))


def pixels(raw, page=0, **how):
    src, head, found = opened(raw)
    return read_image(src, read_page(src, head, found[page], **how))


def hand_made(photometric, data, order="<", width=2, height=2, bits=8, samples=1, **more):
    """A file of one uncompressed strip, laid out by hand in either byte order."""
    fields = {256: (3, width), 257: (3, height), 258: (3, bits), 259: (3, 1), 262: (3, photometric), 273: (4, 0), 277: (3, samples), 279: (4, len(data))} | {CODE[k]: v for k, v in more.items()}
    at = 8 + directory_bytes(len(fields), False)
    fields[273] = (4, at)
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(fields))
    for t, (kind, v) in sorted(fields.items()):
        out += struct.pack(order + "HHI", t, kind, 1) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
    return out + struct.pack(order + "I", 0) + data


@pytest.mark.parametrize("big,at", [(False, 35), (True, 27)])
def test_tags_of_a_written_page(big, at):
    a = np.add.outer(np.arange(100), np.arange(100)).astype(np.uint8)
    w = RasterWriter(big)
    w.image(np.stack([a] * 3, -1), "RGB", tags={CODE["Artist"]: tag(2, "grid maker")})
    src, head, (d,) = opened(w.finish())
    got = {t: [x.value for x in v.value] if v.kind == "List" else v.value for t, v in Tags(src, head, d)}
    assert got == {256: 100, 257: 100, 258: [8, 8, 8], 259: 1, 262: 2, 273: at, 277: 3, 278: 3334, 279: 30000, 282: (1, 1), 283: (1, 1), 296: 1, 315: "grid maker", 317: 1, 339: [1, 1, 1]}
    assert list(got) == sorted(got)
    assert Tags(src, head, d).get(256).kind == "Unsigned" and Tags(src, head, d).get(273).kind == ("UnsignedBig" if big else "Unsigned")


def test_every_pixel_format_round_trips():
    n = 0
    for color, (_, bands, depths) in COLORS.items():
        for depth, code, big in itertools.product(depths.split(), (1, 5, 8, 32773, 50000), (False, True)):
            for predictor in (1, 3) if depth[0] == "f" else (1, 2):
                x = np.random.default_rng(n).integers(0, 120, (7, 13, bands)).astype(f"{depth[0]}{int(depth[1:]) // 8}")
                w = RasterWriter(big)
                w.image(x, color, code, predictor, rows_per_strip=3)
                y = pixels(w.finish())
                assert y.dtype == x.dtype and (y == x).all(), (color, depth, code, predictor)
                n += 1
    assert n == 2 * 2 * 5 * sum(len(d.split()) for _, _, d in COLORS.values())


def test_writer_refuses():
    for args in ((np.zeros((2, 2), np.float32), "Gray", 1, 2), (np.zeros((2, 2), np.uint8), "Gray", 1, 3), (np.zeros((2, 2, 4), np.uint8), "RGB"), (np.zeros((2, 2), np.float16), "Gray"), (np.zeros((0, 2), np.uint8), "Gray"), (np.zeros((2, 2), np.uint8), "Gray", 4)):
        with pytest.raises(RasterError):
            RasterWriter().image(*args)
    with pytest.raises(RasterError):
        tag(3, 70000)


def test_pages_and_pointed_directories():
    w = RasterWriter()
    w.image(np.array([[1, 2], [3, 4]], np.uint16))
    extra = w.directory({CODE["Artist"]: tag(2, "hidden artist")}, chained=False)
    w.image(np.arange(9, 0, -1, dtype=np.uint8).reshape(3, 3), tags={CODE["ExifDirectory"]: tag(13, extra)})
    w.directory({})
    src, head, found = opened(w.finish())
    assert len(found) == 3 and [d.next is None for d in found] == [False, False, True]
    assert pixels(w.finish()).ravel().tolist() == [1, 2, 3, 4] and pixels(w.finish(), 1).shape == (3, 3, 1)
    at = into(Tags(src, head, found[1]).get(CODE["ExifDirectory"]), "ifd")
    assert Tags(src, head, read_directory(src, head, at)).get(CODE["Artist"]).value == "hidden artist"
    with pytest.raises(RasterError):
        read_page(src, head, found[2])


def test_extra_samples():
    x = np.zeros((8, 8, 4), np.uint8)
    x[:, :, 3] = 1
    w = RasterWriter()
    w.image(x, "RGB", compression=8, predictor=2, extra=[0])
    assert pixels(w.finish()).shape == (8, 8, 3)
    lenient = pixels(w.finish(), lenient=True)
    assert lenient.shape == (8, 8, 4) and lenient.sum() == 64


@pytest.mark.parametrize("order", ["<", ">"])
def test_hand_made_pages(order):
    assert pixels(hand_made(4, bytes([0, 255, 128, 64]), order)).ravel().tolist() == [0, 255, 128, 64]
    lab = pixels(hand_made(8, bytes([128, 0, 0, 255, 50, 50, 100, 206, 206, 0, 128, 128]), order, samples=3))
    assert lab.reshape(4, 3).tolist() == [[128, 128, 128], [255, 178, 178], [100, 78, 78], [0, 0, 0]]
    # 12 bits under the horizontal predictor, and inverted
    row = bytes.fromhex("fff001001000")[:5]
    assert pixels(hand_made(1, row, order, 3, 1, 12, Predictor=(3, 2))).ravel().tolist() == [4095, 0, 1]
    assert pixels(hand_made(0, row, order, 3, 1, 12, Predictor=(3, 2))).ravel().tolist() == [0, 4095, 4094]
    assert pixels(hand_made(1, struct.pack(order + "4H", 1, 2, 3, 65535), order, bits=16)).ravel().tolist() == [1, 2, 3, 65535]
    half = struct.pack(order + "4e", 0.5, 1, -2, 0.25)
    assert pixels(hand_made(1, half, order, bits=16, SampleFormat=(3, 3))).ravel().tolist() == [0.5, 1, -2, 0.25]
    assert pixels(hand_made(0, half, order, bits=16, SampleFormat=(3, 3))).ravel().tolist() == [0.5, 0, 3, 0.75]


# fixed values: sums over 16 x 16 sequences, of packed bytes below 8 bits
@pytest.mark.parametrize("bits,total", [(1, 2720), (2, 1728), (3, 5792), (4, 15360), (5, 18944), (7, 24992)])
def test_packed_sequences(bits, total):
    from gridloom.operators.samples import pack_bits

    seq = (np.arange(256) % (1 << bits)).astype(np.uint8).reshape(16, 16)
    raw = pack_bits(seq, bits).tobytes()
    src, head, (d,) = opened(hand_made(1, raw, width=16, height=16, bits=bits))
    page = read_page(src, head, d)
    image = read_image(src, page)
    assert (image[:, :, 0] == seq).all()
    assert sum(packed_rows(page, image)) == total


@pytest.mark.parametrize("bits", [8, 10, 12, 14, 16, 24])
def test_wide_sequences(bits):
    from gridloom.operators.samples import pack_bits

    seq = np.arange(256).astype("u4" if bits > 16 else "u2" if bits > 8 else "u1").reshape(16, 16)
    raw = pack_bits(seq, bits).tobytes() if bits not in (8, 16) else seq.tobytes()
    assert pixels(hand_made(1, raw, width=16, height=16, bits=bits)).sum() == 32640


def _tiled(image, tile, planar, order="<"):
    """A tiled file of (height, width, bands) bytes, laid out by hand."""
    h, w, n = image.shape
    grid = [(y, x) for y in range(0, h, tile) for x in range(0, w, tile)]
    parts = []
    for bands in [[b] for b in range(n)] if planar == 2 else [list(range(n))]:
        for y, x in grid:
            t = np.zeros((tile, tile, len(bands)), image.dtype)
            part = image[y : y + tile, x : x + tile, bands]
            t[: part.shape[0], : part.shape[1]] = part
            parts.append(t.tobytes())
    w_ = RasterWriter()
    at = [w_.append(p) for p in parts]
    w_.directory({256: tag(4, w), 257: tag(4, h), 258: tag(3, [8] * n), 259: tag(3, 1), 262: tag(3, 2), 277: tag(3, n), 284: tag(3, planar), 322: tag(4, tile), 323: tag(4, tile), 324: tag(4, at), 325: tag(4, [len(p) for p in parts])})
    return w_.finish()


@pytest.mark.parametrize("planar", [1, 2])
def test_tiles(planar):
    image = np.random.default_rng(1).integers(0, 256, (37, 50, 3)).astype(np.uint8)
    raw = _tiled(image, 16, planar)
    assert (pixels(raw) == image).all()
    src, head, (d,) = opened(raw)
    page = read_page(src, head, d)
    assert (page.across, page.down, page.planes) == (4, 3, 3 if planar == 2 else 1)
    assert page.place(11)[1:] == (48, 32, 2, 5)
    if planar == 2:
        assert page.place(23) == (1, 48, 32, 2, 5)  # the bottom edge of a later plane
        assert read_image(src, page, first_plane_only=True).shape == (37, 50, 1)
    with pytest.raises(RasterError):
        page.place(page.chunks)


def test_values():
    w = RasterWriter()
    tags = {65000: tag(1, [1, 2, 3]), 65001: tag(6, -5), 65002: tag(8, [-1, 2, -3]), 65003: tag(17, -(1 << 60)), 65004: tag(10, [(-1, 2), (3, 4)]), 65005: tag(5, (7, 8)), 65006: tag(11, 0.5), 65007: tag(12, [1.5, 2.5]), 65008: tag(16, 1 << 63), 65009: tag(2, "ab"), 65010: tag(2, "a longer text"), 65011: tag(13, [5, 6]), 65012: tag(7, b"xyz12"), 65013: (4, 0, b"")}
    w.directory(tags)
    src, head, (d,) = opened(w.finish())
    t = Tags(src, head, d)
    assert t.find_list(65000, "u8") == [1, 2, 3] and t.find_list(65000, "u16") == [1, 2, 3]
    assert t.find_as(65001, "i8") == -5 and t.find_list(65002, "i32") == [-1, 2, -3]
    assert t.find_as(65003, "i64") == -(1 << 60) and t.find_as(65008, "u64") == 1 << 63
    assert t.find_list(65004, "i32") == [-1, 2, 3, 4] and t.find_list(65005, "u32") == [7, 8]
    assert t.find_as(65006, "f32") == 0.5 and t.find_list(65007, "f64") == [1.5, 2.5]
    assert t.get(65009).value == "ab" and t.get(65010).value == "a longer text" and t.find_list(65009, "u32") == [97, 98]
    assert t.find_list(65011, "ifd") == [5, 6] and t.find_list(65012, "u8") == list(b"xyz12")
    assert t.get(65013) == Value("List", ()) and t.find(1) is None
    assert value_range(src, head, t.entry(65010), 2, 6) == b"longer" and value_range(src, head, t.entry(65009), 1, 9) == b"b\0"
    for tag_, to in ((65001, "u8"), (65006, "f64"), (65008, "u32"), (65008, "i64")):
        with pytest.raises(RasterError):
            t.find_as(tag_, to)
    with pytest.raises(RasterError):
        t.get(1)
    with pytest.raises(RasterError) as e:
        into_list(Value("List", (Value("Rational", (1, 2)),)), "u32")
    assert e.value.kind == "InvalidTypeForTag"
    with pytest.raises(RasterError) as e:
        read_value(src, head, Entry(2, 1, b"a\0\0\0"))
    assert e.value.kind == "InvalidTag"
    with pytest.raises(RasterError) as e:
        Tags(src, head, d, Limits(tag=4)).get(65010)
    assert e.value.kind == "LimitsExceeded"
    assert swap(b"\1\2\3\4\5", 2, "<", ">") == b"\2\1\4\3\5" and swap(b"ab", 2, "<", "<") == b"ab"


@pytest.mark.parametrize("raw,kind", [(NO_CHUNKS, "StripTileTagConflict"), (TOO_MANY, "LimitsExceeded"), (b"XX*\0\0\0\0\0", "TiffSignatureNotFound"), (b"II\x29\0\0\0\0\0", "TiffSignatureInvalid"), (b"II", "IoError")])
def test_malformed(raw, kind):
    with pytest.raises(RasterError) as e:
        src = Source.of(raw)
        head = read_header(src)
        read_page(src, head, next(walk(src, head)))
    assert e.value.kind == kind


def test_cycles():
    def chain(links):
        raw = bytearray(b"II" + struct.pack("<HI", 42, links[0]))
        for at, to in zip(links, links[1:], strict=False):
            raw.extend(b"\0" * (at - len(raw)))
            raw[at : at + 6] = struct.pack("<HI", 0, to)
        return bytes(raw)

    assert len(opened(chain([0x20, 0x40, 0x60, 0]))[2]) == 3
    for links in ([0x20, 0x20], [0x20, 0x80, 0x20], [0x20, 0x40, 0x60, 0x40]):
        with pytest.raises(RasterError) as e:
            opened(chain(links))
        assert e.value.kind == "CycleInOffsets"


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_damage_is_an_error_of_ours(data):
    w = RasterWriter(data.draw(st.booleans()))
    w.image(np.arange(60, dtype=np.uint8).reshape(5, 4, 3), "RGB", data.draw(st.sampled_from([1, 5, 8, 32773])), 2, rows_per_strip=2)
    raw = bytearray(w.finish())
    for _ in range(data.draw(st.integers(1, 4))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    limits = Limits(1 << 20, 1 << 20, 1 << 16)
    try:
        src = Source.of(bytes(raw))
        head = read_header(src)
        for d in walk(src, head):
            read_image(src, read_page(src, head, d, limits), limits)
    except RasterError:
        pass


def test_color_types():
    assert color_type(2, 4, [2], 8, 1) == ("RGBA", 4) and color_type(2, 4, [0], 8, 1) == ("RGB", 3)
    assert color_type(2, 4, [0], 8, 1, lenient=True) == ("RGBA", 4) and color_type(5, 5, [1], 8, 1) == ("CMYKA", 5)
    assert color_type(1, 3, [], 16, 1) == ("Multiband", 3) and color_type(32845, 3, [], 32, 3) == ("RGB", 3)
    for args in ((10, 3, [], 8, 1), (2, 2, [], 8, 1), (8, 3, [], 16, 1)):
        with pytest.raises(RasterError):
            color_type(*args)


# ---- tables ---------------------------------------------------------------


@pytest.fixture
def files(spark):
    w = RasterWriter()
    w.image(np.arange(60, dtype=np.uint8).reshape(5, 4, 3), "RGB", 8, 2, rows_per_strip=2)
    w.image(np.array([[(1 << 63) + 1, 2]], np.uint64))
    rows = [("a.tif", bytearray(w.finish())), ("bad.tif", bytearray(b"nothing")), ("none.tif", bytearray(NO_CHUNKS)), ("cut.tif", bytearray(w.finish()[:20]))]
    return scan, spark.createDataFrame(rows, "path string, content binary")


def test_tables(files, spark):
    scan, df = files
    assert {r.path: r.error_kind for r in scan.files(df).collect()} == {"a.tif": None, "bad.tif": "IoError", "none.tif": None, "cut.tif": None}
    pages = {(r.path, r.page_index): r for r in scan.pages(df).collect()}
    assert pages["a.tif", 0].color_type == "RGB" and pages["a.tif", 0].chunks_down == 3 and pages["a.tif", 1].bits == 64
    assert pages["none.tif", 0].error_kind == "StripTileTagConflict" and pages["cut.tif", 0].error_kind == "IoError"
    chunks = scan.chunks(df).where("error_kind is null").collect()
    assert [(c.page_index, c.y0, c.data_height) for c in chunks] == [(0, 0, 2), (0, 2, 2), (0, 4, 1), (1, 0, 1)]
    decoded = scan.decode(df)
    got = scan.samples(decoded, exact=True).collect()
    assert sum(r.value for r in got if r.page_index == 0) == sum(range(60)) and {r.band for r in got} == {0, 1, 2}
    assert [int(r.exact) for r in got if r.page_index == 1] == [(1 << 63) + 1, 2]
    tags = scan.tags(df).where("path = 'a.tif' and name = 'BitsPerSample' and page_index = 0").first()
    assert [int(x) for x in tags.value.ints] == [8, 8, 8] and tags.value.kind == "List<Short>"
    with pytest.raises(Exception, match="StripTileTagConflict|IoError|CycleInOffsets"):
        scan.pages(df, scan.Options.of(mode="FAILFAST")).collect()
    small = scan.decode(df, scan.Options.of(maxDecodedBytes=20)).where("path = 'a.tif'").collect()
    assert {r.error_kind for r in small if r.page_index == 0} == {"LimitsExceeded", None} or {r.error_kind for r in small if r.page_index == 0} == {"LimitsExceeded"}
    units = scan.coding_units(decoded).count()
    assert units == 4
    assert {r.name for r in names(spark, "compression").collect()} >= {"LZW", "Deflate"}


def test_files_ranges_source_and_stream(spark, tmp_path):
    from gridloom.sources.datasource import RasterSource
    from gridloom.streaming import ingest

    pages = spark.createDataFrame([(f"f{i}.tif", p, 4, 3, 1, "u1", "Gray", bytearray([10 * i + p] * 12)) for i in range(3) for p in range(2)], rasters.PAGE_COLUMNS)
    folder = (tmp_path / "in").as_uri()
    assert rasters.save(rasters.encode_files(pages, compression=5), folder).count() == 3
    listed = scan.load(spark, folder, with_content=False)
    chunks = scan.chunks(listed)
    got = scan.decode_ranges(chunks.where("page_index = 1")).collect()
    assert sorted(bytes(r.data) for r in got) == [bytes([10 * i + 1] * 12) for i in range(3)]
    spark.dataSource.register(RasterSource)
    read = spark.read.format("raster").option("table", "decoded").option("pages", "0").load(str(tmp_path / "in"))
    assert sorted(bytes(r.data)[0] for r in read.collect()) == [0, 10, 20]
    assert spark.read.format("raster").load(str(tmp_path / "in")).count() == 6
    q = ingest.stream_table(spark, folder, "pages").writeStream.format("memory").queryName("raster_pages").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from raster_pages where width = 4").first()[0] == 6


def test_sub_directories_as_table(spark):
    w = RasterWriter()
    at = w.directory({CODE["Artist"]: tag(2, "hidden artist")}, chained=False)
    w.directory({CODE["SubIfd"]: tag(13, at)})
    df = spark.createDataFrame([("x", bytearray(w.finish()))], "path string, content binary")
    pointers = scan.tags(df).where("name = 'SubIfd'").selectExpr("path", "explode(value.ints) as p").selectExpr("path", "cast(p as bigint) as ifd_offset")
    got = scan.tags(df.join(pointers, "path"), pointers=True).collect()
    assert [(r.name, r.value.str) for r in got] == [("Artist", "hidden artist")]


def test_columns(spark):
    from gridloom.functions import classify, geometry, pixels
    from gridloom.operators.samples import pack_bits

    x = np.array([[5, 4000, 17, 4095, 0]], np.uint16)
    df = spark.createDataFrame([(bytearray(pack_bits(x, 12).tobytes()),)], "raw binary").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    assert [r.v for r in df.select(pixels.unpack(F.col("raw"), F.col("i"), 12).alias("v")).collect()] == x[0].tolist()
    one = spark.range(1)
    got = one.select(geometry.padding(F.lit(50), F.lit(16), F.lit(3), F.lit(4)).alias("p"), geometry.rows_per_strip(F.lit(300), F.lit(1)).alias("r"), geometry.planes_that_fit(F.lit(10), F.lit(3), F.lit(29)).alias("f"), classify.sample_type(F.lit(12), F.lit(1)).alias("t"), classify.predictor_supported(F.lit(3), F.lit(32), F.lit(1)).alias("s"), classify.bands(F.lit("CMYKA"), F.lit(5)).alias("b")).first()
    assert tuple(got) == (14, 3334, 1, "uint16", False, 5)
    table = spark.createDataFrame([("f", 0, list(range(12)))], "path string, page_index int, color_map array<int>")
    assert [tuple(r)[2:] for r in pixels.palette_rows(table).orderBy("index").collect()] == [(i, i, i + 4, i + 8) for i in range(4)]


def test_failfast_reaches_pointed_directories(spark):
    w = RasterWriter()
    w.directory({CODE["ImageWidth"]: tag(4, 1)})
    files = spark.createDataFrame([("f", bytearray(w.finish()), 10_000)], "path string, content binary, ifd_offset bigint")
    (row,) = scan.tags(files, pointers=True).collect()
    assert (row.path, row.ifd_offset, row.error_kind) == ("f", 10_000, "IoError")
    with pytest.raises(Exception, match="IoError"):
        scan.tags(files, scan.Options(mode="FAILFAST"), pointers=True).collect()


def test_regions_of_pages(spark):
    from gridloom.functions import geometry

    pages = spark.createDataFrame([("a", 100, 50), ("b", 40, 40)], "path string, width bigint, height bigint").selectExpr("*", "20 as chunk_width", "20 as chunk_height", "1 as planes")
    tiles = geometry.explode_chunks(pages)
    regions = spark.createDataFrame([("a", 1, 0, 0, 30, 20), ("b", 2, 15, 15, 25, 25), ("a", 3, 5, 5, 5, 9)], "path string, region int, left int, top int, right int, bottom int")
    got = geometry.region_chunks(tiles, regions, 20, 20, on=["path"]).select("region", "path", "x0", "y0").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0, 0), (1, "a", 20, 0), *((2, "b", x, y) for x in (0, 20) for y in (0, 20))]
    assert geometry.region_chunks(tiles, regions.drop("path"), 20, 20).count() == 2 * 6


def test_strips_must_be_whole(spark, tmp_path):
    strip = lambda i, n: ("f.tif", 0, 4, 5, "u1", "Gray", i, 2, bytearray(range(n)))
    schema = "file string, page_index int, width int, height int, dtype string, color string, strip_index int, rows_per_strip int, data binary"
    save = lambda rows: rasters.save_strips(spark.createDataFrame(rows, schema), tmp_path.as_uri()).collect()
    ((path, length),) = save([strip(2, 4), strip(0, 8), strip(1, 8)])
    assert length == len((tmp_path / "f.tif").read_bytes()) and pixels((tmp_path / "f.tif").read_bytes()).ravel().tolist() == [*range(8), *range(8), *range(4)]
    for rows in ([strip(0, 8), strip(1, 8)], [strip(0, 8), strip(0, 8), strip(1, 8), strip(2, 4)], [strip(1, 8), strip(2, 4)], [strip(0, 8), strip(1, 7), strip(2, 4)]):
        with pytest.raises(Exception, match="InvalidChunkIndex|InconsistentSizesEncountered"):
            save(rows)
    assert [p.name for p in tmp_path.iterdir()] == ["f.tif"]


def test_source_lists_and_writes(spark, tmp_path):
    from gridloom.sources import datasource

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "_hidden").mkdir()
    for name in ("a/1.tif", "a/b/2.tif", "a/b/3.txt", "a/.4.tif", "a/_hidden/5.tif"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda p: [x.rsplit("/", 1)[-1] for x, _ in datasource.found(p)]
    assert names(str(tmp_path / "a")) == ["1.tif", "2.tif", "3.txt"] == names((tmp_path / "a").as_uri())
    assert names(f"{tmp_path}/a/*.tif") == ["1.tif"] and names(f"{tmp_path}/*/b/*.tif") == ["2.tif"] and names(f"{tmp_path}/a/1.tif") == ["1.tif"] and names(f"{tmp_path}/none/*") == []
    spark.dataSource.register(datasource.RasterSource)
    w = RasterWriter()
    w.image(np.arange(6, dtype=np.uint8).reshape(2, 3))
    for k, (mode, left) in enumerate((("append", ["0.tif"]), ("append", ["0.tif", "1.tif"]), ("overwrite", ["2.tif"]))):
        spark.createDataFrame([(f"{k}.tif", bytearray(w.finish()))], "path string, content binary").write.format("raster").mode(mode).save(str(tmp_path / "out"))
        assert names(str(tmp_path / "out")) == left and not list((tmp_path / "out").glob("_drafts*"))
    read = lambda table, **o: spark.read.format("raster").options(table=table, **o).load(str(tmp_path / "out"))
    assert read("samples").agg({"value": "sum"}).first()[0] == 15 and read("tags").where("tag = 256").first()["value"]["ints"] == [3]
    assert read("directories").first()["next_ifd"] is None and read("chunks").count() == read("decoded").count() == 1
    (tmp_path / "out" / "bad.tif").write_bytes(b"nothing of the kind")
    assert read("pages").where("error_kind is not null").count() == 1
    with pytest.raises(Exception, match="TiffSignatureNotFound"):
        read("pages", mode="FAILFAST").collect()


def test_required_values(spark):
    from gridloom.functions import values

    one = spark.sql("SELECT named_struct('kind', 'Short', 'ints', array(cast(7 as decimal(20,0))), 'doubles', cast(null as array<double>), 'rationals', cast(null as array<struct<n: bigint, d: bigint>>), 'str', cast(null as string), 'bytes', X'0700') as v")
    assert [int(x) for x in one.select(values.scalar(F.col("v"), "u16"), values.scalar(F.col("v"), "u32")).first()] == [7, 7]
    assert one.select(values.scalar(F.col("v"), "u8"), values.scalar(F.col("v"), "string")).first()[:] == (None, None)
    with pytest.raises(Exception, match="RequiredTagNotFound"):
        one.select(values.required(values.scalar(F.col("v"), "u8"), "x")).collect()


def test_workspace_and_scratch(spark, tmp_path):
    from gridloom import runtime

    df = spark.range(3)
    with runtime.workspace(spark):
        inside = runtime.Scratch(spark, "inside")
        assert inside.table("t", df).count() == 3
    outside = runtime.Scratch(spark, "outside")
    assert outside.table("t", df).count() == 3
    at = lambda s: Path(s.path.removeprefix("file://").removeprefix("file:"))
    assert not at(inside).exists() and at(outside).exists()
    outside.drop("t")
    assert not (at(outside) / "t").exists()
    assert runtime.unused(df, "ID") != "ID" and runtime.unused(df, "x") == "x"

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        runtime.scratch_root(Cluster())


def test_large_pages_are_read_by_chunk(spark):
    """Pages beyond the limit of results, whose chunks are not."""
    from gridloom.operators.layout import image_file

    image = (np.arange(12000) % 251).astype(np.uint8).reshape(100, 40, 3)
    raw = image_file(image, 2, rows=2, planar=2)
    df = spark.createDataFrame([("a", bytearray(raw))], "path string, content binary")
    got = scan.samples(scan.decode(df, scan.Options.of(maxDecodedBytes=5000)))  # the lists of strips alone need that
    assert got.count() == 12000 and got.agg({"value": "sum"}).first()[0] == image.sum()
    bands = lambda limit: {r.band for r in scan.samples(scan.decode(df, scan.Options.of(maxImageBytes=limit))).collect()}
    assert bands(12000) == {0, 1, 2} and bands(11999) == {0} == bands(4000) and not bands(3999)
    assert scan.decode(df, scan.Options.of(maxImageBytes=3999)).first().error_kind == "LimitsExceeded"
    src, head, (d,) = opened(raw)
    assert read_image(src, read_page(src, head, d), Limits(decoded=11999)).shape == (100, 40, 1)
