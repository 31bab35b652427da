"""Kernels on rows of samples: bit packing, predictors, inversion. All in numpy, whole chunks at a time."""

from __future__ import annotations

import numpy as np

from gridloom.sources.container import RasterError

FLOATS = {16: np.float16, 32: np.float32, 64: np.float64}


def storage(bits: int) -> int:
    """Bits of the unsigned word that holds a sample: 8, 16, 32 or 64."""
    return 8 if bits <= 8 else 16 if bits <= 16 else 32 if bits <= 32 else 64


def sample_type(bits: int, fmt: int) -> np.dtype:
    """The type that samples of a page have; other combinations are errors."""
    if fmt == 3:
        if bits not in FLOATS:
            raise RasterError("UnsupportedSampleDepth", bits)
        return np.dtype(FLOATS[bits])
    if fmt not in (1, 2):
        raise RasterError("UnsupportedSampleFormat", fmt)
    if 32 < bits < 64 or bits > 64:
        raise RasterError("UnsupportedColorType", f"{bits} bits")
    if fmt == 2 and bits not in (8, 16, 32, 64):
        raise RasterError("UnsupportedColorType", f"{bits} signed bits")
    return np.dtype(f"{'u' if fmt == 1 else ''}int{storage(bits)}")


def check_predictor(predictor: int, bits: int, fmt: int) -> None:
    """Which depths a predictor works on."""
    if predictor == 2 and not (bits in (8, 16, 32, 64) or (fmt == 1 and 8 < bits < 32)):
        raise RasterError("HorizontalPredictorNotSupported" if fmt != 3 else "UnsupportedSampleDepth", bits)
    if predictor == 3 and (fmt != 3 or bits not in FLOATS):
        raise RasterError("FloatingPointPredictorNotSupported", f"format {fmt}, {bits} bits")


def unpack_bits(rows: np.ndarray, n: int, bits: int) -> np.ndarray:
    """n samples of ``bits`` bits, highest bit first, from each row of bytes."""
    flat = np.unpackbits(rows, axis=1, count=n * bits).reshape(len(rows), n, bits)
    word = storage(bits)
    wide = np.zeros((len(rows), n, word), np.uint8)
    wide[:, :, word - bits :] = flat
    return np.packbits(wide, axis=2).view(f">u{word // 8}").astype(f"u{word // 8}").reshape(len(rows), n)


def pack_bits(samples: np.ndarray, bits: int) -> np.ndarray:
    """The bytes of rows of samples; a row is filled up to a whole byte."""
    rows, n = samples.shape
    word = storage(bits)
    raw = samples.astype(f">u{word // 8}").view(np.uint8).reshape(rows, n, word // 8)
    flat = np.unpackbits(raw, axis=2)[:, :, word - bits :]
    return np.packbits(flat.reshape(rows, n * bits), axis=1)


def undo_horizontal(rows: np.ndarray, stride: int, bits: int) -> np.ndarray:
    """Running sums by sample of a pixel, wrapping at the depth; ``rows`` are unsigned words."""
    h, n = rows.shape
    out = np.cumsum(rows.reshape(h, n // stride, stride), axis=1, dtype=rows.dtype).reshape(h, n)
    return out & rows.dtype.type((1 << bits) - 1) if bits < rows.dtype.itemsize * 8 else out


def horizontal(rows: np.ndarray, stride: int, bits: int) -> np.ndarray:
    """Differences to the pixel before, wrapping at the depth."""
    out = rows.copy()
    out[:, stride:] -= rows[:, :-stride]
    return out & rows.dtype.type((1 << bits) - 1) if bits < rows.dtype.itemsize * 8 else out


def undo_float(rows: np.ndarray, stride: int, size: int) -> np.ndarray:
    """Bytes of rows under the floating-point predictor, as rows of native floats of ``size`` bytes."""
    h, n = rows.shape
    flat = np.cumsum(rows.reshape(h, n // stride, stride), axis=1, dtype=np.uint8).reshape(h, size, n // size)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">f{size}").reshape(h, n // size).astype(f"f{size}")


def float_predict(rows: np.ndarray, stride: int) -> np.ndarray:
    """Rows of floats as bytes by significance, each the difference to the byte ``stride`` before."""
    h, n = rows.shape
    size = rows.dtype.itemsize
    planes = np.ascontiguousarray(rows.astype(f">f{size}").view(np.uint8).reshape(h, n, size).transpose(0, 2, 1)).reshape(h, n * size)
    out = planes.copy()
    out[:, stride:] -= planes[:, :-stride]
    return out


def invert(samples: np.ndarray, bits: int) -> np.ndarray:
    """White and black changed: the depth's maximum, or 1.0, less the value."""
    if samples.dtype.kind == "f":
        return (1 - samples).astype(samples.dtype)
    if samples.dtype.kind != "u":
        raise RasterError("UnknownInterpretation", "inverted signed samples")
    return samples.dtype.type((1 << bits) - 1) - samples


def lab_bias(samples: np.ndarray) -> np.ndarray:
    """8-bit CIELab a and b, stored signed, as biased by 128. The last axis is the bands."""
    out = samples.copy()
    out[..., 1:3] += np.uint8(128)
    return out


def holding(values: np.ndarray, dtype: str) -> np.dtype:
    """The integer type itself, or the narrowest wider one that holds all values, unsigned if that can be; other types as they are."""
    kind = np.dtype(dtype)
    if kind.kind not in "ui" or values.dtype.kind not in "ui" or not len(values):
        return kind
    low, high = int(values.min()), int(values.max())
    for known in (kind, *(np.dtype(f"{k}{n}") for n in (1, 2, 4, 8) if n >= kind.itemsize for k in "ui")):
        if np.iinfo(known).min <= low and high <= np.iinfo(known).max:
            return known
    raise RasterError("IntSizeError", f"{low} to {high}")
