"""Baseline, extended sequential and progressive JPEG with Huffman codes, 8 bits, for strips and tiles with shared tables.

Components come out as stored, without colour conversion; subsampled ones are
repeated to full size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from gridloom.sources.container import RasterError

# fixed values: zigzag order by rule, anti-diagonals in turn
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K = np.arange(8)
_DCT = np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16) * np.where(_K == 0, np.sqrt(0.125), 0.5)


class _Codes:
    """A Huffman table: what each code of so many bits stands for, and by the next 8 bits the code of no more that they begin with."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.all: dict[tuple[int, int], int] = {}
        self.short: list[tuple[int, int] | None] = [None] * 256
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.all[(length, code)] = symbols[k]
                if length <= 8 and code < 1 << length:
                    for next8 in range(code << (8 - length), (code + 1) << (8 - length)):
                        self.short[next8] = self.short[next8] or (length, symbols[k])
                code += 1
                k += 1
            code <<= 1


_codes = lru_cache(maxsize=64)(_Codes)  # chunks of a page have the same tables


class _Frame:
    def __init__(self):
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[tuple[int, int], _Codes] = {}
        self.parts: list[dict] = []
        self.width = self.height = self.restart = 0
        self.progressive = False


def _segments(raw: bytes, frame: _Frame):
    """Reads markers into the frame; yields (components, first byte of data, (first and last coefficient, bits known before, bits left for later)) at each scan."""
    at = 2 if raw[:2] == b"\xff\xd8" else 0
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            at += 1
            continue
        marker = raw[at + 1]
        if marker in (0x00, 0x01, 0xFF) or 0xD0 <= marker <= 0xD9:
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                q = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                table = np.zeros(64)
                table[_ZIGZAG] = q
                frame.quant[name] = table
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                kind, counts = body[0], body[1:17]
                end = 17 + sum(counts)
                frame.huffman[(kind >> 4, kind & 15)] = _codes(counts, body[17:end])
                body = body[end:]
        elif marker in (0xC0, 0xC1, 0xC2):
            frame.progressive = marker == 0xC2
            if body[0] != 8:
                raise RasterError("JpegDecoder", f"{body[0]} bits")
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
        elif 0xC3 <= marker <= 0xCF and marker != 0xCC:
            raise RasterError("JpegDecoder", f"process {marker & 15}")
        elif marker == 0xDD:
            frame.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            for i in range(body[0]):
                part = next((p for p in frame.parts if p["id"] == body[1 + 2 * i]), None)
                if part is None:
                    raise RasterError("JpegDecoder", "a scan of no component")
                part["dc"], part["ac"] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            first, last, bits = body[1 + 2 * body[0] :][:3]
            yield [next(p for p in frame.parts if p["id"] == body[1 + 2 * i]) for i in range(body[0])], at, (first, last, bits >> 4, bits & 15) if frame.progressive else (0, 63, 0, 0)


class _Bits:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.bits, self.held = raw, 0, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            byte = self.raw[self.at] if self.at < len(self.raw) else 0
            self.at += 1
            self.bits = (self.bits << 8 | byte) & 0xFFFFFFFFFF
            self.held += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.held -= n
        return self.bits >> self.held & (1 << n) - 1

    def symbol(self, table: _Codes) -> int:
        self.need(16)
        known = table.short[self.bits >> (self.held - 8) & 255]
        if known is not None:
            self.held -= known[0]
            return known[1]
        for n in range(9, 17):
            found = table.all.get((n, self.bits >> (self.held - n) & (1 << n) - 1))
            if found is not None:
                self.held -= n
                return found
        raise RasterError("JpegDecoder", "no Huffman code")

    def number(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def decode(raw: bytes, tables: bytes | None, width: int, height: int, samples: int) -> bytes:
    """Rows of interleaved bytes; ``tables`` is a stream of shared tables, whose end marker and the data's start marker are left out between the two."""
    if tables:
        raw = tables[:-2] + raw[2:]
    frame, planes = _Frame(), []
    started = False
    for parts, at, band in _segments(raw, frame):
        if not started:
            started = True
            hm, vm = max(p["h"] for p in frame.parts), max(p["v"] for p in frame.parts)
            across, down = -(-frame.width // (8 * hm)), -(-frame.height // (8 * vm))
            for p in frame.parts:
                p["blocks"] = np.zeros((down * p["v"], across * p["h"], 64), np.int64)
        _scan(raw, at, frame, parts, band, hm, vm, across, down)
    if not started:
        raise RasterError("JpegDecoder", "no scan")
    if len(frame.parts) != samples:
        raise RasterError("JpegDecoder", f"{len(frame.parts)} components for {samples} samples")
    for p in frame.parts:
        c = (p["blocks"] * frame.quant[p["q"]]).reshape(*p["blocks"].shape[:2], 8, 8)
        px = np.clip(np.rint(_DCT @ c @ _DCT.T + 128), 0, 255).astype(np.uint8)
        plane = px.transpose(0, 2, 1, 3).reshape(px.shape[0] * 8, px.shape[1] * 8)
        planes.append(plane.repeat(vm // p["v"], 0).repeat(hm // p["h"], 1)[: frame.height, : frame.width])
    image = np.stack(planes, axis=-1)
    out = np.zeros((height, width, samples), np.uint8)
    h, w = min(height, frame.height), min(width, frame.width)
    out[:h, :w] = image[:h, :w]
    return out.tobytes()


def _scan(raw: bytes, at: int, frame: _Frame, parts: list[dict], band: tuple[int, int, int, int], hm: int, vm: int, across: int, down: int) -> None:
    end = at
    intervals, begin = [], at
    while end + 1 < len(raw):
        end = raw.find(b"\xff", end)
        if end < 0 or end + 1 >= len(raw):
            end = len(raw)
            break
        if 0xD0 <= raw[end + 1] <= 0xD7:
            intervals.append(raw[begin:end])
            begin = end = end + 2
        elif raw[end + 1] == 0:
            end += 2
        elif raw[end + 1] == 0xFF:
            end += 1
        else:
            break
    intervals.append(raw[begin:end])
    if len(parts) == 1:  # blocks of one component, as many as it needs
        p = parts[0]
        w, h = -(-(-(-frame.width * p["h"] // hm)) // 8), -(-(-(-frame.height * p["v"] // vm)) // 8)
        units = [[(p, y, x)] for y in range(h) for x in range(w)]
    else:
        units = [[(p, y * p["v"] + j, x * p["h"] + i) for p in parts for j in range(p["v"]) for i in range(p["h"])] for y in range(down) for x in range(across)]
    step = frame.restart or len(units)
    for k, data in enumerate(intervals):
        bits = _Bits(data.replace(b"\xff\x00", b"\xff"))
        state = {"blocks": 0} | {p["id"]: 0 for p in parts}  # blocks that an end-of-band still covers; the last constant terms
        for unit in units[k * step : (k + 1) * step]:
            for p, y, x in unit:
                _block(bits, p["blocks"][y, x], p, frame, band, state)


def _block(bits: _Bits, block: np.ndarray, part: dict, frame: _Frame, band: tuple[int, int, int, int], state: dict) -> None:
    """One block of a scan: its constant term, a band of others, or both; or one more bit of them."""
    first, last, known, left = band
    if first == 0:
        if known:
            block[0] |= bits.take(1) << left
        else:
            state[part["id"]] += bits.number(bits.symbol(frame.huffman[(0, part["dc"])]))
            block[0] = state[part["id"]] << left
    if last == 0:
        return
    ac = frame.huffman[(1, part["ac"])]
    if known:
        _refine(bits, block, ac, first, last, left, state)
        return
    if state["blocks"]:
        state["blocks"] -= 1
        return
    i = max(first, 1)
    while i <= last:
        s = bits.symbol(ac)
        run, size = s >> 4, s & 15
        if not size:
            if run != 15:
                state["blocks"] = (1 << run) - 1 + bits.take(run)
                return
            i += 16
            continue
        i += run
        if i > last:
            raise RasterError("JpegDecoder", "a block is too long")
        block[_ZIGZAG[i]] = bits.number(size) << left
        i += 1


def _refine(bits: _Bits, block: np.ndarray, ac: _Codes, first: int, last: int, left: int, state: dict) -> None:
    """The next lower bit of the coefficients of a band that are known, and those that begin with it."""
    one, i = 1 << left, first

    def correct(at: int) -> None:
        if bits.take(1) and not abs(block[at]) & one:
            block[at] += one if block[at] > 0 else -one

    while i <= last and not state["blocks"]:
        s = bits.symbol(ac)
        run, new = s >> 4, 0
        if s & 15:
            new = one if bits.take(1) else -one
        elif run != 15:
            state["blocks"] = (1 << run) + bits.take(run)
            break
        while i <= last:  # past ``run`` coefficients that stay zero
            if block[_ZIGZAG[i]]:
                correct(_ZIGZAG[i])
            elif run:
                run -= 1
            else:
                break
            i += 1
        if new:
            if i > last:
                raise RasterError("JpegDecoder", "a block is too long")
            block[_ZIGZAG[i]] = new
        i += 1
    if state["blocks"]:
        for j in range(i, last + 1):
            if block[_ZIGZAG[j]]:
                correct(_ZIGZAG[j])
        state["blocks"] -= 1
