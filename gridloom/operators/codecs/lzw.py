"""LZW as in section 13 of TIFF 6.0: codes of 9 to 12 bits, highest bit first, widened one code early.

The width of a code depends only on how many codes came since the last CLEAR,
so all codes up to the next one are cut out of the bits at once. Entry 258 + i
of the table is what code i stands for and the first byte of the code after
it; so codes form chains, which are followed for all codes of the data
together.
"""

from __future__ import annotations

import numpy as np

from gridloom.sources.container import RasterError

CLEAR, END = 256, 257
#: Codes after a CLEAR at which the writer clears again, one before the table is full.
FULL = 4095 - 258
#: Bits of the i-th code after a CLEAR, and of all before it.
_WIDTH = np.array([min(12, (258 + i).bit_length()) for i in range(FULL + 2)], np.int64)
_BEFORE = np.concatenate(([0], np.cumsum(_WIDTH)))
#: Longer strings are copied one by one.
LONG = 64
#: Data of at most so many bytes are followed code by code: calls on whole arrays cost more than they save there. Their codes do not fill a table.
SMALL = 1024
_BYTES = [bytes([i]) for i in range(256)] + [b"", b""]


def _codes(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The codes without CLEAR and END, for each the place of the first one after its CLEAR, and whether END came. Stops when there are surely enough."""
    data = np.frombuffer(raw + b"\0\0\0", np.uint8).astype(np.int64)
    word = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    bits, at, n = 8 * len(raw), 0, 0
    codes, first = [], []
    live, ended = True, False
    while live and n < size:
        step = 0  # codes since the CLEAR that are read
        while True:
            more = np.arange(step, step + FULL + 1)
            width = _WIDTH[np.minimum(more, FULL + 1)]
            begin = at + (_BEFORE[more] if step == 0 else 12 * np.arange(len(more)))
            fit = int(np.searchsorted(begin + width, bits, "right"))
            begin, width = begin[:fit], width[:fit]
            code = word[begin >> 3] >> (24 - (begin & 7) - width) & (1 << width) - 1
            ends = np.flatnonzero((code == CLEAR) | (code == END))
            k = int(ends[0]) if len(ends) else fit
            codes.append(code[:k])
            first.append(np.full(k, n))
            step += k
            if len(ends):
                live, ended = code[k] == CLEAR, code[k] == END
                at = int(begin[k] + width[k])
                break
            if fit < len(more):
                live = False
                break
            at = int(begin[-1] + width[-1])
        n += step
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *codes]), np.concatenate([none, *first]), ended


def _decode_small(raw: bytes, size: int) -> bytes:
    """Like ``decode``, for data that are too short to fill a table."""
    bits, left = int.from_bytes(raw, "big"), 8 * len(raw)
    table, last, width, mask = _BYTES.copy(), b"", 9, 511
    out, have = [], 0
    while have < size:
        if left < width:
            raise RasterError("IoError", "LZW data end early")
        left -= width
        code = bits >> left & mask
        if code == END:
            break
        if code == CLEAR:
            table, last, width, mask = _BYTES.copy(), b"", 9, 511
            continue
        if last:
            table.append(last + (table[code] if code < len(table) else last)[:1])
        if code >= len(table):
            raise RasterError("IoError", "LZW code out of range")
        last = table[code]
        out.append(last)
        have += len(last)
        if len(table) >= mask:
            width += 1
            mask = (1 << width) - 1
    return b"".join(out)[:size]


def decode(raw: bytes, size: int) -> bytes:
    """Up to ``size`` bytes; without an end code the data may simply end once they are there."""
    if size and len(raw) <= SMALL:
        return _decode_small(raw, size)
    code, first, ended = _codes(raw, size)
    n = len(code)
    own = np.arange(n)
    parent = np.where(code < 256, own, first + code - 258)  # the code whose string this one's begins with
    wrong = np.flatnonzero((code > 255) & (parent >= own))
    usable = int(wrong[0]) if len(wrong) else n
    code, parent, own = code[:usable], parent[:usable], own[:usable]
    root, length = parent.copy(), (code > 255).astype(np.int64)
    while len(root) and (root != root[root]).any():  # up the chains in doubling steps
        length = length + length[root]
        root = root[root]
    length += 1
    end = np.cumsum(length)
    need = int(np.searchsorted(end, size, "left")) + 1
    if need > usable:
        if usable < n:
            raise RasterError("IoError", "LZW code out of range")
        if not ended and (end[-1] if n else 0) < size:
            raise RasterError("IoError", "LZW data end early")
        need = usable
    code, parent, root, length, end = (x[:need] for x in (code, parent, root, length, end))
    if not need:
        return b""
    # the last byte of each string: its own, or the first of the string after its parent's
    after = np.minimum(parent + 1, need - 1)
    last = np.where(code < 256, code, code[root[after]]).astype(np.uint8)
    out = np.zeros(int(end[-1]), np.uint8)
    short = np.flatnonzero(length <= LONG)
    node, place = short, end[short] - 1
    while len(node):
        out[place] = last[node]
        more = code[node] > 255
        node, place = parent[node[more]], place[more] - 1
    for i in np.flatnonzero(length > LONG).tolist():
        j, a, b = int(parent[i]), int(end[i] - length[i]), int(end[i])
        out[a : b - 1] = out[end[j] - length[j] : end[j]]
        out[b - 1] = last[i]
    return out[:size].tobytes()


def encode(raw: bytes) -> bytes:
    codes, widths = [CLEAR], [_WIDTH[:1]]
    table: dict[int, int] = {}
    find, add = table.get, codes.append
    begun, room = 1, FULL
    word = raw[0] if raw else -1
    for byte in memoryview(raw)[1:]:
        key = word << 8 | byte
        longer = find(key)
        if longer is not None:
            word = longer
            continue
        add(word)
        table[key] = 4095 - room
        room -= 1
        word = byte
        if not room:  # begin again
            add(CLEAR)
            widths.append(_WIDTH[: len(codes) - begun])
            begun, room = len(codes), FULL
            table.clear()
    if word >= 0:
        add(word)
    add(END)
    widths.append(_WIDTH[: len(codes) - begun])
    width = np.concatenate(widths)
    out, x = [], np.array(codes, ">u2")
    for a in range(0, len(x), 1 << 16):
        part = np.unpackbits(x[a : a + (1 << 16)].view(np.uint8)).reshape(-1, 16)
        out.append(part[np.arange(16) >= 16 - width[a : a + (1 << 16), None]])
    return np.packbits(np.concatenate(out)).tobytes()
