"""Queries over headers, directories and what the writer puts into them, against SQL by formula of each supplier's key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import classify
from gridloom.functions.domains import CODE
from gridloom.operators.encode import COLORS, RasterWriter, tag
from gridloom.operators.layout import image_file, lay_out
from gridloom.plans.images import files_of, key, picture, picture_sql, read_back, sums
from gridloom.runtime import shuffled
from gridloom.sources import scan
from gridloom.sources.container import directory_bytes

K = "SELECT s_suppkey::BIGINT AS k FROM supplier"


def _chain(k: int) -> bytes:
    """One to four directories, of one entry each; the first lies right after the header."""
    w = RasterWriter()
    for i in range(k % 4 + 1):
        w.directory({CODE["ImageWidth"]: tag(4, 100 * i + k)})
    return w.finish()


def chain_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of a chain by number, where they are, and whether more come."""
    d = scan.directories(files_of(spark, sf_dir, _chain))
    return d.select(key().alias("s_suppkey"), F.col("page_index").cast("bigint").alias("page_index"), "ifd_offset", F.col("next_ifd").isNotNull().alias("more"))


# a directory of one entry has 18 bytes; the next begins at a multiple of 4
CHAIN_SQL = f"SELECT k AS s_suppkey, i::BIGINT AS page_index, (8 + 20 * i)::BIGINT AS ifd_offset, i < k % 4 AS more FROM ({K}), range(4) t(i) WHERE i <= k % 4"


def page_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second directory of each file that has one."""
    t = scan.tags(files_of(spark, sf_dir, _chain)).where("page_index = 1")
    return t.select(key().alias("s_suppkey"), F.get("value.ints", 0).cast("bigint").alias("width"))


def first_ifd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains begun at their second directory, which is at the same place in all files; where there is none, an error."""
    t = scan.tags(files_of(spark, sf_dir, _chain), scan.Options.of(firstIfdOffset=28))
    return t.groupBy(key().alias("s_suppkey")).agg(F.count("value").alias("n"), F.min(F.get("value.ints", 0)).cast("bigint").alias("width"), F.max("error_kind").alias("error"))


FIRST_SQL = f"SELECT k AS s_suppkey, (k % 4)::BIGINT AS n, CASE WHEN k % 4 > 0 THEN 100 + k END AS width, CASE WHEN k % 4 = 0 THEN 'IoError' END AS error FROM ({K})"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte order, variant and first directory of files, and what is no file of the kind."""
    files = files_of(spark, sf_dir, lambda k: b"no raster file" if k % 5 == 4 else image_file(picture(k, 256), order="<>"[k % 2], big=k % 3 == 0))
    return scan.files(files).select(key().alias("s_suppkey"), "byte_order", "big", "first_ifd", "length", F.col("error_kind").alias("error"))


HEADERS_SQL = f"""
SELECT k AS s_suppkey, CASE WHEN bad THEN NULL WHEN k % 2 = 0 THEN 'LittleEndian' ELSE 'BigEndian' END AS byte_order, CASE WHEN NOT bad THEN big END AS big, CASE WHEN NOT bad THEN start END AS first_ifd,
  CASE WHEN NOT bad THEN start + CASE WHEN big THEN 16 + 12 * 20 ELSE 6 + 12 * 12 END END AS length, CASE WHEN bad THEN 'TiffSignatureNotFound' END AS error
FROM (SELECT k, k % 5 = 4 AS bad, k % 3 = 0 AS big, ((CASE WHEN k % 3 = 0 THEN 16 ELSE 8 END + (17 + k % 30) * (9 + k % 13) + 3) // 4 * 4)::BIGINT AS start FROM ({K}))
"""


def unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a type that is not known are passed over, others kept."""

    def make(k: int) -> bytes:
        raw = bytearray(lay_out({256: (3, [k % 100]), 257: (3, [7]), 65000: (4, [k])}, []))
        at = len(raw) - directory_bytes(5, False) + 2
        raw[at + 12 + 2] = 99  # the type of the second entry
        return bytes(raw)

    t = scan.tags(files_of(spark, sf_dir, make)).where("tag not in (273, 279)")
    return t.groupBy(key().alias("s_suppkey")).agg(F.array_join(F.array_sort(F.collect_list("tag")).cast("array<string>"), ",").alias("tags"), F.max(F.when(F.col("tag") == 65000, F.get("value.ints", 0))).cast("bigint").alias("value"))


def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of strips and of tiles, and which of them refuse to be read by tile."""
    p = scan.pages(files_of(spark, sf_dir, lambda k: image_file(picture(k, 256), tile=(16, 16) if k % 2 else None)))
    return p.select(key().alias("s_suppkey"), "chunk_kind", classify.kind_error(F.col("chunk_kind"), "Tile").alias("error"), "chunks_across", "chunks_down")


KINDS_SQL = f"SELECT k AS s_suppkey, CASE WHEN k % 2 = 1 THEN 'Tile' ELSE 'Strip' END AS chunk_kind, CASE WHEN k % 2 = 0 THEN 'InvalidChunkType' END AS error, CASE WHEN k % 2 = 1 THEN (17 + k % 30 + 15) // 16 ELSE 1 END::BIGINT AS chunks_across, CASE WHEN k % 2 = 1 THEN (9 + k % 13 + 15) // 16 ELSE 1 END::BIGINT AS chunks_down FROM ({K})"


def unsupported_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codecs that are refused, and the page that says so."""
    files = files_of(spark, sf_dir, lambda k: image_file(picture(k, 256), compression=(2, 6, 50001, 999)[k % 4], encoder=lambda part: part.tobytes()))
    d = scan.decode(files)
    return d.select(key().alias("s_suppkey"), "error_kind", "error_detail", F.col("data").isNull().alias("none"))


UNSUPPORTED_SQL = f"SELECT k AS s_suppkey, 'UnsupportedCompressionMethod' AS error_kind, ['Huffman', 'JPEG', 'WebP', '999'][k % 4 + 1] AS error_detail, true AS none FROM ({K})"


def predictor_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which depths and kinds of samples each predictor is allowed on."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("p_partkey"))
    bits, fmt, predictor = F.col("p_partkey") % 65 + 1, F.floor(F.col("p_partkey") / 65) % 3 + 1, F.floor(F.col("p_partkey") / 195) % 3 + 1
    return p.select("p_partkey", classify.predictor_supported(predictor, bits, fmt).alias("ok"), classify.sample_type(bits, fmt).alias("type"))


SUPPORT_SQL = """
WITH p AS (SELECT p_partkey::BIGINT AS k, p_partkey % 65 + 1 AS b, p_partkey // 65 % 3 + 1 AS f, p_partkey // 195 % 3 + 1 AS p FROM part)
SELECT k AS p_partkey, CASE p WHEN 1 THEN true WHEN 2 THEN b IN (8, 16, 32, 64) OR (f = 1 AND b > 8 AND b < 32) ELSE f = 3 AND b IN (16, 32, 64) END AS ok,
  CASE WHEN f = 3 AND b IN (16, 32, 64) THEN 'float' || b WHEN f = 1 AND (b <= 32 OR b = 64) THEN 'uint' || CASE WHEN b <= 8 THEN 8 WHEN b <= 16 THEN 16 WHEN b <= 32 THEN 32 ELSE 64 END WHEN f = 2 AND b IN (8, 16, 32, 64) THEN 'int' || b END AS type FROM p
"""


# ---- the writer -------------------------------------------------------------

#: All pixel formats that are written: colour, bands, type.
FORMATS = [(color, bands, d) for color, (_, bands, depths) in COLORS.items() for d in depths.split()]


def _formats(k: int) -> bytes:
    color, bands, depth = FORMATS[k % len(FORMATS)]
    w = RasterWriter(big=k % 2 == 0)
    x = picture(k, 120, bands, f"{depth[0]}{int(depth[1:]) // 8}")
    w.image(x, color, (1, 5, 8, 32773, 50000)[k % 5], (2, 3)[depth[0] == "f"] if k % 3 else 1, rows_per_strip=4)
    return w.finish()


def pixel_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel format that can be written, with its colour type as read."""
    files = files_of(spark, sf_dir, _formats)
    s = sums(scan.samples(scan.decode(files)))
    return s.join(shuffled(scan.pages(files).select(key().alias("s_suppkey"), "color_type", F.col("bits").cast("bigint").alias("bits"))), "s_suppkey")


_NAMES = "[" + ", ".join(f"'{c}'" for c, _, _ in FORMATS) + "]"
_BANDS = "[" + ", ".join(str(b) for _, b, _ in FORMATS) + "]"
_BITS = "[" + ", ".join(d[1:] for _, _, d in FORMATS) + "]"
_OF = f"[s_suppkey % {len(FORMATS)} + 1]"
FORMATS_SQL = f"SELECT s.*, {_NAMES}{_OF} AS color_type, {_BITS}{_OF}::BIGINT AS bits FROM ({picture_sql('120', 5, where=f'b < {_BANDS}[k % {len(FORMATS)} + 1]')}) s"


def written_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer puts into a page's directory, with resolution and rows of a strip as asked for."""

    def make(k: int) -> bytes:
        w = RasterWriter()
        w.image(picture(k, 256, 3), "RGB", 8, 2, rows_per_strip=k % 5 + 1, resolution=(2, (k + 1, 3), (72, 1)))
        return w.finish()

    t = scan.tags(files_of(spark, sf_dir, make))
    number = lambda name: F.max(F.when(F.col("name") == name, F.get("value.ints", 0))).cast("bigint")
    part = lambda name, c: F.max(F.when(F.col("name") == name, F.get("value.rationals", 0)[c]))
    return t.groupBy(key().alias("s_suppkey")).agg(F.array_join(F.array_sort(F.collect_list("tag")).cast("array<string>"), ",").alias("tags"), number("RowsPerStrip").alias("rows"), number("ResolutionUnit").alias("unit"), part("XResolution", "n").alias("x_n"), part("XResolution", "d").alias("x_d"), part("YResolution", "n").alias("y_n"), F.max(F.when(F.col("name") == "StripOffsets", F.col("count"))).alias("strips"))


WRITTEN_SQL = f"SELECT k AS s_suppkey, '256,257,258,259,262,273,277,278,279,282,283,296,317,339' AS tags, k % 5 + 1 AS rows, 2::BIGINT AS unit, k + 1 AS x_n, 3::BIGINT AS x_d, 72::BIGINT AS y_n, ((9 + k % 13 + k % 5) // (k % 5 + 1))::BIGINT AS strips FROM ({K})"


def _written_extra(k: int) -> bytes:
    w = RasterWriter()
    w.image(picture(k, 256, 5), "RGB", 8, 2, extra=[0, 0], rows_per_strip=3)
    return w.finish()


def refused_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer refuses: predictors on the wrong samples, formats that cannot be, pages without size."""
    from gridloom.sources.container import RasterError

    def make(k: int) -> bytes:
        cases = ((np.zeros((2, 2), "f4"), "Gray", 2), (np.zeros((2, 2), "u1"), "Gray", 3), (np.zeros((2, 2, 3), "i2"), "RGB", 1), (np.zeros((0, 2), "u1"), "Gray", 1), (np.zeros((2, 2, 4), "u1"), "RGB", 1), (np.zeros((2, 2), "u1"), "Gray", 1))
        image, color, predictor = cases[k % 6]
        try:
            RasterWriter().image(image, color, 1, predictor)
        except RasterError as e:
            return e.kind.encode()
        return b"written"

    return files_of(spark, sf_dir, make).select(key().alias("s_suppkey"), F.decode("content", "UTF-8").alias("outcome"))


REFUSED_SQL = f"SELECT k AS s_suppkey, ['PredictorIncompatible', 'PredictorIncompatible', 'UnsupportedColorType', 'InvalidDimensions', 'InconsistentSizesEncountered', 'written'][k % 6 + 1] AS outcome FROM ({K})"


def queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """{name: (query, SQL)}"""
    return {
        "chain_walk": (chain_walk, CHAIN_SQL),
        "page_seek": (page_seek, f"SELECT k AS s_suppkey, 100 + k AS width FROM ({K}) WHERE k % 4 > 0"),
        "first_ifd": (first_ifd, FIRST_SQL),
        "headers": (headers, HEADERS_SQL),
        "unknown_types": (unknown_types, f"SELECT k AS s_suppkey, '256,65000' AS tags, k AS value FROM ({K})"),
        "chunk_kinds": (chunk_kinds, KINDS_SQL),
        "unsupported_codecs": (unsupported_codecs, UNSUPPORTED_SQL),
        "predictor_support": (predictor_support, SUPPORT_SQL),
        "first_plane": (read_back(lambda k: image_file(picture(k, 256, 3), 2, compression=8, planar=2, rows=4), firstPlaneOnly="true"), picture_sql(bands=1)),
        "pixel_formats": (pixel_formats, FORMATS_SQL),
        "written_tags": (written_tags, WRITTEN_SQL),
        "written_extra": (read_back(_written_extra), picture_sql(bands=3)),
        "refused_pages": (refused_pages, REFUSED_SQL),
    }
