"""Names of tags, field types and other coded values of tagged raster files.

The codes are those of the TIFF 6.0 specification, its supplements and the
registered private tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: field type -> (name, bytes, unit for byte swapping)
FIELD_TYPES = {
    1: ("BYTE", 1, 1),
    2: ("ASCII", 1, 1),
    3: ("SHORT", 2, 2),
    4: ("LONG", 4, 4),
    5: ("RATIONAL", 8, 4),
    6: ("SBYTE", 1, 1),
    7: ("UNDEFINED", 1, 1),
    8: ("SSHORT", 2, 2),
    9: ("SLONG", 4, 4),
    10: ("SRATIONAL", 8, 4),
    11: ("FLOAT", 4, 4),
    12: ("DOUBLE", 8, 8),
    13: ("IFD", 4, 4),
    16: ("LONG8", 8, 8),
    17: ("SLONG8", 8, 8),
    18: ("IFD8", 8, 8),
}

# fixed values: tags
TAGS = {
    254: "NewSubfileType",
    255: "SubfileType",
    256: "ImageWidth",
    257: "ImageLength",
    258: "BitsPerSample",
    259: "Compression",
    262: "PhotometricInterpretation",
    263: "Threshholding",
    264: "CellWidth",
    265: "CellLength",
    266: "FillOrder",
    270: "ImageDescription",
    271: "Make",
    272: "Model",
    273: "StripOffsets",
    274: "Orientation",
    277: "SamplesPerPixel",
    278: "RowsPerStrip",
    279: "StripByteCounts",
    280: "MinSampleValue",
    281: "MaxSampleValue",
    282: "XResolution",
    283: "YResolution",
    284: "PlanarConfiguration",
    288: "FreeOffsets",
    289: "FreeByteCounts",
    290: "GrayResponseUnit",
    291: "GrayResponseCurve",
    296: "ResolutionUnit",
    305: "Software",
    306: "DateTime",
    315: "Artist",
    316: "HostComputer",
    317: "Predictor",
    320: "ColorMap",
    322: "TileWidth",
    323: "TileLength",
    324: "TileOffsets",
    325: "TileByteCounts",
    330: "SubIfd",
    338: "ExtraSamples",
    339: "SampleFormat",
    340: "SMinSampleValue",
    341: "SMaxSampleValue",
    347: "JPEGTables",
    530: "ChromaSubsampling",
    531: "ChromaPositioning",
    532: "ReferenceBlackWhite",
    33432: "Copyright",
    33550: "ModelPixelScale",
    33922: "ModelTiepoint",
    34264: "ModelTransformation",
    34665: "ExifDirectory",
    34675: "IccProfile",
    34735: "GeoKeyDirectory",
    34736: "GeoDoubleParams",
    34737: "GeoAsciiParams",
    34853: "GpsDirectory",
    42113: "GdalNodata",
}
CODE = {name: code for code, name in TAGS.items()}

# fixed values
COMPRESSION = {1: "None", 2: "Huffman", 3: "Fax3", 4: "Fax4", 5: "LZW", 6: "JPEG", 7: "ModernJPEG", 8: "Deflate", 32946: "OldDeflate", 32773: "PackBits", 50000: "ZSTD", 50001: "WebP", 34676: "SGILog", 34677: "SGILog24"}
PHOTOMETRIC = {0: "WhiteIsZero", 1: "BlackIsZero", 2: "RGB", 3: "RGBPalette", 4: "TransparencyMask", 5: "CMYK", 6: "YCbCr", 8: "CIELab", 9: "IccLab", 10: "ItuLab", 32844: "CIELogL", 32845: "CIELogLuv"}
PLANAR = {1: "Chunky", 2: "Planar"}
PREDICTOR = {1: "None", 2: "Horizontal", 3: "FloatingPoint"}
RESOLUTION_UNIT = {1: "None", 2: "Inch", 3: "Centimeter"}
SAMPLE_FORMAT = {1: "Uint", 2: "Int", 3: "IEEEFP", 4: "Void"}
EXTRA_SAMPLES = {0: "Unspecified", 1: "AssociatedAlpha", 2: "UnassociatedAlpha"}

_TABLES = {"tag": TAGS, "type": {k: v[0] for k, v in FIELD_TYPES.items()}, "compression": COMPRESSION, "photometric": PHOTOMETRIC, "planar": PLANAR, "predictor": PREDICTOR, "resolution_unit": RESOLUTION_UNIT, "sample_format": SAMPLE_FORMAT, "extra_samples": EXTRA_SAMPLES}


def names(spark: SparkSession, domain: str) -> DataFrame:
    """(code, name) of a domain: tag, type, compression, photometric, planar, predictor, resolution_unit, sample_format or extra_samples. Of fixed size, so fit to be broadcast."""
    return spark.createDataFrame(sorted(_TABLES[domain].items()), "code int, name string")
