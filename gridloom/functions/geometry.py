"""Chunk geometry as column expressions: integer arithmetic that Catalyst can push, fold and prune with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.floor(a.cast("bigint") / b.cast("bigint")).cast("bigint")


def tiles_across(width: Column, chunk: Column) -> Column:
    return F.ceil(width / chunk).cast("bigint")


def tiles_down(height: Column, chunk: Column) -> Column:
    return F.ceil(height / chunk).cast("bigint")


def padding(size: Column, chunk: Column, index: Column, count: Column) -> Column:
    """Pixels of the chunk with this index along an axis that lie beyond the page."""
    return F.when(index == count - 1, F.pmod(chunk - F.pmod(size, chunk), chunk)).otherwise(F.lit(0)).cast("bigint")


def chunk_count(width: Column, height: Column, chunk_width: Column, chunk_height: Column, planes: Column) -> Column:
    return tiles_across(width, chunk_width) * tiles_down(height, chunk_height) * planes


def samples_per_chunk_pixel(samples: Column, planar: Column) -> Column:
    return F.when(planar == 2, F.lit(1)).otherwise(samples).cast("bigint")


def planes(samples: Column, planar: Column) -> Column:
    return F.when(planar == 2, samples).otherwise(F.lit(1)).cast("bigint")


def row_bytes(width: Column, bits: Column, samples: Column) -> Column:
    """Bytes of a row of a chunk, filled up to a whole byte."""
    return F.ceil(width.cast("bigint") * bits * samples / 8).cast("bigint")


def rows_per_strip(row: Column, compression: Column, target: int = 1_000_000) -> Column:
    """The writer's default: about ``target`` bytes, or one row for PackBits."""
    return F.when(compression == 32773, F.lit(1)).otherwise(F.ceil(F.lit(target) / row)).cast("bigint")


def planes_that_fit(plane_bytes: Column, planes_: Column, limit: Column) -> Column:
    """How many planes a result limit holds: all, or else the first alone, or none."""
    return F.when(plane_bytes * planes_ <= limit, planes_).when(plane_bytes <= limit, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def explode_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of pages by arithmetic, without reading a file: needs width, height, chunk_width, chunk_height and planes, and keeps the other columns."""
    across, down = tiles_across(F.col("width"), F.col("chunk_width")), tiles_down(F.col("height"), F.col("chunk_height"))
    grid = pages.withColumn("chunks_across", across).withColumn("chunks_down", down)
    rows = grid.withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks_across") * F.col("chunks_down") * F.col("planes") - 1)))
    per = F.col("chunks_across") * F.col("chunks_down")
    i = F.pmod(F.col("chunk_index"), per)
    rows = rows.withColumn("plane", _div(F.col("chunk_index"), per)).withColumn("column", F.pmod(i, F.col("chunks_across"))).withColumn("row", _div(i, F.col("chunks_across")))
    rows = rows.withColumn("x0", F.col("column") * F.col("chunk_width")).withColumn("y0", F.col("row") * F.col("chunk_height"))
    return rows.withColumn("data_width", F.least(F.col("chunk_width").cast("bigint"), F.col("width") - F.col("x0"))).withColumn("data_height", F.least(F.col("chunk_height").cast("bigint"), F.col("height") - F.col("y0")))


def region_chunks(chunks: DataFrame, regions: DataFrame, chunk_width: int, chunk_height: int, on: Sequence[str] = ()) -> DataFrame:
    """Chunks that regions (region, left, top, right, bottom; the ends excluded) overlap: an equi-join on grid cells, to which each region is spread first. ``on`` names columns of both that say which page a chunk or region belongs to (path and page_index, say); without, a region is meant for every page."""
    cell = lambda a, b, n: F.sequence(F.floor(F.col(a) / n), F.floor((F.col(b) - 1) / n))
    spread = regions.where("right > left and bottom > top").withColumn("column", F.explode(cell("left", "right", chunk_width))).withColumn("row", F.explode(cell("top", "bottom", chunk_height)))
    return chunks.join(spread, [*on, "column", "row"])


def plane_bytes(width: Column, height: Column, dtype_bytes: Column, samples: Column, planar: Column) -> Column:
    """Bytes of a decoded plane: of all samples if they lie together, of one if not."""
    return (width.cast("bigint") * height * dtype_bytes * samples_per_chunk_pixel(samples, planar)).cast("bigint")


def buffer_layout(width: Column, height: Column, dtype_bytes: Column, samples: Column, planar: Column) -> Column:
    """How a decoded image or chunk of that size lies in memory: bytes of a pixel, of a row and of a plane, planes, and bytes of all."""
    pixel = (dtype_bytes * samples_per_chunk_pixel(samples, planar)).cast("bigint")
    plane = plane_bytes(width, height, dtype_bytes, samples, planar)
    n = planes(samples, planar)
    return F.struct(pixel.alias("pixel_bytes"), (pixel * width).cast("bigint").alias("row_stride"), plane.alias("plane_stride"), n.alias("planes"), (plane * n).alias("complete_len"))


def layout_error(across: Column, chunk_width: Column, bits: Column, chunk_samples: Column, photometric: Column, chroma: Column, compression: Column) -> Column:
    """Why the chunks of a page cannot be read out, or null: rows of several tiles that do not end on a byte, or subsampled chroma outside JPEG."""
    return F.when((photometric == 6) & (compression != 7) & ~((F.get(chroma, 0) == 1) & (F.get(chroma, 1) == 1)), "ChromaSubsampling").when((across > 1) & (F.pmod(chunk_width * bits * chunk_samples, F.lit(8)) != 0), "MisalignedTileBoundaries")
