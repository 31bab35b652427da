"""Colour type and support of a page's samples as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def color_type(photometric: Column, samples: Column, extra_samples: Column, bits: Column, sample_format: Column, lenient: bool = False) -> Column:
    """Colour type, or null where the combination has none."""
    first = F.get(extra_samples, 0)
    alpha = first.isin(1, 2)
    if lenient:
        alpha = alpha | ((first == 0) & (samples > 3))
    alpha = F.coalesce(alpha, F.lit(False))
    own = samples - F.size(extra_samples)
    return (
        F.when((photometric == 2) & (own == 3), F.when(alpha, "RGBA").otherwise("RGB"))
        .when((photometric == 2) & (own == 4), "RGBA")
        .when((photometric == 5) & (own == 4), F.when(alpha, "CMYKA").otherwise("CMYK"))
        .when((photometric == 5) & (own == 5), "CMYKA")
        .when((photometric == 6) & (own == 3), "YCbCr")
        .when(photometric.isin(0, 1), F.when(samples == 1, "Gray").otherwise("Multiband"))
        .when((photometric == 9) & (own == 3) & (sample_format == 1), "Lab")
        .when((photometric == 8) & (own == 3) & (bits == 8), "Lab")
        .when((photometric == 32844) & (samples == 1) & (bits == 32) & (sample_format == 3), "Gray")
        .when((photometric == 32845) & (samples == 3) & (bits == 32) & (sample_format == 3), "RGB")
        .when(photometric == 3, "Palette")
        .when(photometric == 4, "Gray")
    )


def bands(color: Column, samples: Column) -> Column:
    """Samples of a pixel that a colour type takes."""
    fixed = {"Gray": 1, "RGB": 3, "Palette": 1, "GrayA": 2, "RGBA": 4, "CMYK": 4, "CMYKA": 5, "YCbCr": 3, "Lab": 3}
    out = F.when(color == "Multiband", samples)
    for name, n in fixed.items():
        out = out.when(color == name, n)
    return out.cast("int")


def sample_type(bits: Column, sample_format: Column) -> Column:
    """Type of the samples, or null where there is none."""
    width = F.when(bits <= 8, 8).when(bits <= 16, 16).when(bits <= 32, 32).when(bits == 64, 64)
    whole = bits.isin(8, 16, 32, 64)
    return F.when((sample_format == 3) & bits.isin(16, 32, 64), F.concat(F.lit("float"), bits.cast("string"))).when(sample_format == 1, F.concat(F.lit("uint"), width.cast("string"))).when((sample_format == 2) & whole, F.concat(F.lit("int"), bits.cast("string")))


def predictor_supported(predictor: Column, bits: Column, sample_format: Column) -> Column:
    horizontal = bits.isin(8, 16, 32, 64) | ((sample_format == 1) & (bits > 8) & (bits < 32))
    return F.when(predictor == 1, True).when(predictor == 2, horizontal).when(predictor == 3, (sample_format == 3) & bits.isin(16, 32, 64)).otherwise(False)


def kind_error(kind: Column, wanted: str) -> Column:
    """The error of reading a page's chunks as strips or tiles if they are the other, else null."""
    return F.when(kind != wanted, "InvalidChunkType")
