"""SGI log-luminance pixels: 16-bit L and 32-bit LogLuv, run-length coded by byte plane, and packed 24-bit LogLuv.

Planes are stored with the most significant first, as the format was
published. ``reference_order`` reads them the other way round; no sample file
was at hand to tell which of the two a writer has used.
"""

from __future__ import annotations

import numpy as np

from gridloom.sources.container import RasterError

_LN2 = np.float32(np.log(2))
# fixed values: XYZ to RGB with sRGB primaries and white D65
_RGB = np.array([[3.2404542, -1.5371385, -0.4985314], [-0.969266, 1.8760108, 0.0415560], [0.0556434, -0.2040259, 1.0572252]], np.float32)

# fixed values: rows of the published 24-bit chroma code: u at which each begins, and how many steps it has
UV_ROWS = (
    (0.247663, 4), (0.243779, 6), (0.241684, 7), (0.237874, 9), (0.235906, 10), (0.232153, 12), (0.228352, 14), (0.226259, 15), (0.222371, 17), (0.220410, 18), (0.214710, 21), (0.212714, 22),
    (0.210721, 23), (0.204976, 26), (0.202986, 27), (0.199245, 29), (0.195525, 31), (0.193560, 32), (0.189878, 34), (0.186216, 36), (0.186216, 36), (0.182592, 38), (0.179003, 40), (0.175466, 42),
    (0.172001, 44), (0.172001, 44), (0.168612, 46), (0.168612, 46), (0.163575, 49), (0.158642, 52), (0.158642, 52), (0.158642, 52), (0.153815, 55), (0.153815, 55), (0.149097, 58), (0.149097, 58),
    (0.142746, 62), (0.142746, 62), (0.142746, 62), (0.138270, 65), (0.138270, 65), (0.138270, 65), (0.132166, 69), (0.132166, 69), (0.126204, 73), (0.126204, 73), (0.126204, 73), (0.120381, 77),
    (0.120381, 77), (0.120381, 77), (0.120381, 77), (0.112962, 82), (0.112962, 82), (0.112962, 82), (0.107450, 86), (0.107450, 86), (0.107450, 86), (0.107450, 86), (0.100343, 91), (0.100343, 91),
    (0.100343, 91), (0.095126, 95), (0.095126, 95), (0.095126, 95), (0.095126, 95), (0.088276, 100), (0.088276, 100), (0.088276, 100), (0.088276, 100), (0.081523, 105), (0.081523, 105), (0.081523, 105),
    (0.081523, 105), (0.074861, 110), (0.074861, 110), (0.074861, 110), (0.074861, 110), (0.068290, 115), (0.068290, 115), (0.068290, 115), (0.068290, 115), (0.063573, 119), (0.063573, 119), (0.063573, 119),
    (0.063573, 119), (0.057219, 124), (0.057219, 124), (0.057219, 124), (0.057219, 124), (0.050985, 129), (0.050985, 129), (0.050985, 129), (0.050985, 129), (0.050985, 129), (0.044859, 134), (0.044859, 134),
    (0.044859, 134), (0.044859, 134), (0.040571, 138), (0.040571, 138), (0.040571, 138), (0.040571, 138), (0.036339, 142), (0.036339, 142), (0.036339, 142), (0.036339, 142), (0.032139, 146), (0.032139, 146),
    (0.032139, 146), (0.032139, 146), (0.027947, 150), (0.027947, 150), (0.027947, 150), (0.023739, 154), (0.023739, 154), (0.023739, 154), (0.023739, 154), (0.019504, 158), (0.019504, 158), (0.019504, 158),
    (0.016976, 161), (0.016976, 161), (0.016976, 161), (0.016976, 161), (0.012639, 165), (0.012639, 165), (0.012639, 165), (0.009991, 168), (0.009991, 168), (0.009991, 168), (0.009016, 170), (0.009016, 170),
    (0.009016, 170), (0.006217, 173), (0.006217, 173), (0.005097, 175), (0.005097, 175), (0.005097, 175), (0.003909, 177), (0.003909, 177), (0.002340, 177), (0.002389, 170), (0.001068, 164), (0.001653, 157),
    (0.000717, 150), (0.001614, 143), (0.000270, 136), (0.000484, 129), (0.001103, 123), (0.001242, 115), (0.001188, 109), (0.001011, 103), (0.000709, 97), (0.000301, 89), (0.002416, 82), (0.003251, 76),
    (0.003246, 69), (0.004141, 62), (0.005963, 55), (0.008839, 47), (0.010490, 40), (0.016994, 31), (0.023659, 21),
)
UV_STEP, UV_FIRST = 0.0035, 0.01694
_UV_U = np.array([u for u, _ in UV_ROWS], np.float32)
_UV_FIRST = np.concatenate(([0], np.cumsum([n for _, n in UV_ROWS])))


def uv_index(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step within its row, and row, of 14-bit chroma codes; those beyond the table are the first."""
    code = np.where(code < _UV_FIRST[-1], code, 0)
    row = np.searchsorted(_UV_FIRST, code, "right") - 1
    return code - _UV_FIRST[row], row


def luminance_24(code: np.ndarray) -> np.ndarray:
    """Y of 10-bit log codes: 1/64 octaves."""
    octave = np.floor(code / 64) - 24
    y = (code - (octave + 24) * 64 + 64) / 64 * 2.0**octave
    return np.where(code == 0, 0, y).astype(np.float32)


def decode_24(raw: bytes, width: int, height: int, samples: int) -> bytes:
    """Rows of native 32-bit RGB floats from packed pixels of three bytes: 10 bits of luminance, 14 of chroma."""
    if samples != 3:
        raise RasterError("UnsupportedColorType", f"{samples} samples of 24-bit log-luminance")
    n = width * height
    if len(raw) < 3 * n:
        raise RasterError("IoError", f"{len(raw)} of {3 * n} bytes")
    px = np.frombuffer(raw, np.uint8, 3 * n).reshape(n, 3).astype(np.int64)
    code = px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2]
    step, row = uv_index(code & 0x3FFF)
    u = _UV_U[row] + step.astype(np.float32) * np.float32(UV_STEP)
    v = np.float32(UV_FIRST) + row.astype(np.float32) * np.float32(UV_STEP)
    return to_rgb(luminance_24(code >> 14 & 0x3FF), u, v).tobytes()


def _planes(raw: bytes, at: int, n: int, depth: int, reference_order: bool) -> tuple[np.ndarray, int]:
    """One row of pixels of ``depth`` bytes, the most significant first; and where the next row begins."""
    out = np.zeros((n, depth), np.uint8)
    for k in range(depth):
        i, column = 0, depth - 1 - k if reference_order else k
        while i < n:
            if at >= len(raw):
                raise RasterError("IoError", "a log-luminance row is cut")
            head = raw[at]
            at += 1
            if head >= 128:
                m = min(head - 126, n - i)
                if at >= len(raw):
                    raise RasterError("IoError", "a log-luminance row is cut")
                out[i : i + m, column] = raw[at]
                at += 1
            else:
                m = min(head, n - i)
                if at + m > len(raw):
                    raise RasterError("IoError", "a log-luminance row is cut")
                out[i : i + m, column] = np.frombuffer(raw, np.uint8, m, at)
                at += m
            i += m
    return out, at


def luminance(code: np.ndarray) -> np.ndarray:
    """Y of 16-bit log codes: sign and 15 bits of 1/256 octaves."""
    le = (code & 0x7FFF).astype(np.float32)
    y = np.exp(_LN2 / np.float32(256) * (le + np.float32(0.5)) - _LN2 * np.float32(64)).astype(np.float32)
    return np.where(code == 0, np.float32(0), np.where(code & 0x8000, -y, y))


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Linear RGB of luminance and CIE u'v'."""
    s = np.float32(1) / (6 * u - 16 * v + 12)
    x, z = 9 * u * s, 4 * v * s
    xyz = np.stack([x / z * y, y, (1 - x - z) / z * y], axis=-1).astype(np.float32)
    return (xyz @ _RGB.T).astype(np.float32)


def decode(raw: bytes, width: int, height: int, samples: int, reference_order: bool = False) -> bytes:
    """Rows of native 32-bit floats: L for one sample of a pixel, RGB for three."""
    rows, at = [], 0
    for _ in range(height):
        if samples == 1:
            px, at = _planes(raw, at, width, 2, reference_order)
            rows.append(luminance(px[:, 0].astype(np.uint16) << 8 | px[:, 1]))
        else:
            px, at = _planes(raw, at, width, 4, reference_order)
            y = luminance(px[:, 0].astype(np.uint16) << 8 | px[:, 1])
            u, v = ((px[:, k].astype(np.float32) + np.float32(0.5)) / np.float32(410) for k in (2, 3))
            rows.append(to_rgb(y, u, v).ravel())
    return np.concatenate(rows).astype(np.float32).tobytes() if rows else b""
