"""Bilevel fax codes: one-dimensional T.4 and two-dimensional T.6.

Rows come out packed, eight pixels to a byte, with 1 for white and 0 for black
as a fax pixel decodes to the brighter value; the photometric interpretation
is applied later.
"""

from __future__ import annotations

from gridloom.sources.container import RasterError

# fixed values: run lengths by code, ITU-T T.4 tables 2 and 3
WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
WHITE_LONG = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
BLACK_LONG = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
LONGEST = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
# fixed values: modes of T.6
MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
EOL = "000000000001"


def _codes(short: str, long: str) -> dict[tuple[int, int], int]:
    out = {c: n for n, c in enumerate(short.split())}
    out |= {c: 64 * (n + 1) for n, c in enumerate(long.split())}
    out |= {c: 1792 + 64 * n for n, c in enumerate(LONGEST.split())}
    return {(len(c), int(c, 2)): n for c, n in out.items()}


RUNS = (_codes(WHITE, WHITE_LONG), _codes(BLACK, BLACK_LONG))
_MODE = {(len(c), int(c, 2)): m for c, m in MODES.items()}
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class _Bits:
    def __init__(self, raw: bytes, fill_order: int):
        raw = raw.translate(_REVERSED) if fill_order == 2 else raw
        self.value, self.size, self.at = int.from_bytes(raw, "big"), 8 * len(raw), 0
        self.raw = raw

    def peek(self, n: int) -> int:
        """The next n bits, zeros after the end."""
        a = self.at >> 3
        part = self.raw[a : a + 5].ljust(5, b"\0")
        return int.from_bytes(part, "big") >> (40 - (self.at & 7) - n) & (1 << n) - 1

    def code(self, table: dict[tuple[int, int], object], longest: int):
        for n in range(1, longest + 1):
            if (found := table.get((n, self.peek(n)))) is not None:
                self.at += n
                return found
        return None

    def run(self, black: int) -> int | None:
        total = 0
        while (n := self.code(RUNS[black], 13)) is not None:
            total += n
            if n < 64:
                return total
        return None


def _pack(changes: list[int], width: int) -> bytes:
    """A row from the places where the colour changes, white first."""
    bits, at, color = 0, 0, 1
    for c in [*changes, width]:
        n = min(c, width) - at
        if n > 0:
            bits = bits << n | ((1 << n) - 1 if color else 0)
            at += n
        color ^= 1
    pad = -width % 8
    return (bits << pad).to_bytes((width + 7) // 8, "big")


def decode_1d(raw: bytes, width: int, height: int, fill_order: int = 1) -> bytes:
    """Group 3 without two-dimensional rows; end-of-line codes and fill before a row are passed over."""
    src, out = _Bits(raw, fill_order), []
    while len(out) < height and src.at < src.size:
        while src.at < src.size and src.peek(11) == 0:  # fill, then EOL
            save = src.at
            while src.at < src.size and src.peek(1) == 0:
                src.at += 1
            if src.at >= src.size:
                break
            if src.at - save >= 11:
                src.at += 1
        if src.at >= src.size:
            break
        changes, at, black = [], 0, 0
        while at < width:
            n = src.run(black)
            if n is None:
                raise RasterError("IoError", "no fax run code")
            at += n
            changes.append(at)
            black ^= 1
        out.append(_pack(changes, width))
    return b"".join(out)


def decode_2d(raw: bytes, width: int, height: int, fill_order: int = 1) -> bytes:
    """Group 4: each row against the one above."""
    src, out, above = _Bits(raw, fill_order), [], []
    while len(out) < height:
        row: list[int] = []
        a0, color = -1, 0
        while a0 < width:
            mode = src.code(_MODE, 7)
            if mode is None:
                if src.peek(12) == 1 or src.at >= src.size:
                    return b"".join(out)
                raise RasterError("IoError", "no fax mode code")
            i = 0  # b1: the first change above right of a0 towards the other colour
            while i < len(above) and (above[i] <= a0 or i % 2 != color):
                i += 1
            b1 = above[i] if i < len(above) else width
            b2 = above[i + 1] if i + 1 < len(above) else width
            if mode == "pass":
                a0 = b2
            elif mode == "horizontal":
                start = max(a0, 0)
                first = src.run(color)
                second = src.run(color ^ 1) if first is not None else None
                if second is None:
                    raise RasterError("IoError", "no fax run code")
                row += [min(start + first, width), min(start + first + second, width)]
                a0 = start + first + second
            else:
                a0 = b1 + mode
                row.append(max(0, min(a0, width)))
                color ^= 1
        out.append(_pack(row, width))
        above = [c for c in row if c < width]
    return b"".join(out)
