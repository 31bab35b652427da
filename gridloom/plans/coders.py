"""Small encoders for the codecs that the engine only decodes: what the queries need to make files."""

from __future__ import annotations

import numpy as np

from gridloom.operators.codecs import fax

_RUN = [{v: f"{code:0{size}b}" for (size, code), v in table.items()} for table in fax.RUNS]


def _bits(bits: str) -> bytes:
    n = -(-len(bits) // 8)
    return int(bits.ljust(8 * n, "0") or "0", 2).to_bytes(n, "big")


def _run(black: bool, n: int) -> str:
    out = ""
    while n >= 64:
        m = min(n // 64 * 64, 2560)
        out += _RUN[black][m]
        n -= m
    return out + _RUN[black][n]


def _lengths(row: np.ndarray) -> list[int]:
    """Lengths of runs of white (1) and black (0) in turn, the first of white."""
    edges = np.flatnonzero(np.diff(row, prepend=1 - row[:1], append=1 - row[-1:]))
    out = np.diff(edges).tolist()
    return out if row[0] else [0, *out]


def fax_3(image: np.ndarray) -> bytes:
    """One-dimensional rows of (height, width, 1) samples."""
    return _bits("".join(fax.EOL + "".join(_run(k % 2 == 1, n) for k, n in enumerate(_lengths(row))) for row in image[:, :, 0]))


def fax_4(image: np.ndarray) -> bytes:
    """Rows like the one above in vertical mode, others in horizontal mode."""
    name = {mode: code for code, mode in fax.MODES.items()}
    out, above = "", np.ones(image.shape[1], image.dtype)
    for row in image[:, :, 0]:
        if (row == above).all():
            out += name[0] * (np.count_nonzero(np.diff(row, prepend=1)) + 1)
        else:
            n = _lengths(row)
            n += [0] * (len(n) % 2)
            for white, black in zip(n[::2], n[1::2], strict=True):
                out += name["horizontal"] + _run(False, white) + _run(True, black)
        above = row
    return _bits(out + fax.EOL * 2)


def jpeg_flat(image: np.ndarray) -> bytes:
    """A baseline stream of (height, width, bands) whose blocks of 8 by 8 are of one value each."""
    h, w, n = image.shape
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n)))
    out += seg(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))  # differences: twelve codes of four bits
    out += seg(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")  # all else: the end of a block
    out += seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\x00\x3f\x00")
    bits, last = "", [0] * n
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            for c in range(n):
                v = 8 * (int(image[y, x, c]) - 128)
                d, last[c] = v - last[c], v
                size = abs(d).bit_length()
                bits += f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    return out + _bits(bits + "1" * (-len(bits) % 8)).replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def sgi_log(codes: np.ndarray) -> bytes:
    """Rows of (height, width) codes of as many bytes as their type has, by byte plane, runs and literals in turn."""
    out = bytearray()
    for row in codes:
        for plane in np.ascontiguousarray(row.astype(row.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(row), -1).T:
            at = 0
            while at < len(plane):
                n = 1
                while at + n < len(plane) and n < 127 and plane[at + n] == plane[at]:
                    n += 1
                if n > 2:
                    out += bytes([n + 126, plane[at]])
                else:
                    n = min(5, len(plane) - at)
                    out += bytes([n]) + plane[at : at + n].tobytes()
                at += n
    return bytes(out)


def log_luv_24(codes: np.ndarray) -> bytes:
    """Pixels of three bytes."""
    return b"".join(int(c).to_bytes(3, "big") for c in codes.ravel())
