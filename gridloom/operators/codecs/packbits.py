"""PackBits runs of bytes."""

from __future__ import annotations

import re

from gridloom.sources.container import RasterError

_RUN = re.compile(rb"(.)\1\1+", re.DOTALL)


def decode(raw: bytes, size: int) -> bytes:
    """Up to ``size`` bytes; a header of -128 says nothing."""
    out, at, have, n = [], 0, 0, len(raw)
    while have < size and at < n:
        head = raw[at]
        at += 1
        if head < 128:
            part = raw[at : at + head + 1]
            if len(part) <= head:
                raise RasterError("IoError", "a literal run is cut")
            at += head + 1
        elif head > 128:
            if at >= n:
                raise RasterError("IoError", "a repeated run is cut")
            part = raw[at : at + 1] * (257 - head)
            at += 1
        else:
            continue
        out.append(part)
        have += len(part)
    return b"".join(out)[:size]


def encode(raw: bytes) -> bytes:
    """Runs of three or more are repeats, and of two where no literal is open; a header takes 128 bytes at most."""
    if not raw:
        raise RasterError("IoError", "nothing to encode")
    out = bytearray()

    def repeat(byte: bytes, n: int) -> None:
        while n > 0:
            k = min(n, 128)
            if k == 1:
                out.extend(b"\0" + byte)
            else:
                out.extend(bytes([257 - k]) + byte)
            n -= k

    def literal(part: bytes) -> None:
        while part:
            if len(part) >= 2 and part[0] == part[1]:
                repeat(part[:1], 2)
                part = part[2:]
                continue
            out.append(min(len(part), 128) - 1)
            out.extend(part[:128])
            part = part[128:]

    at = 0
    for m in _RUN.finditer(raw):
        literal(raw[at : m.start()])
        repeat(m[1], m.end() - m.start())
        at = m.end()
    literal(raw[at:])
    return bytes(out)
