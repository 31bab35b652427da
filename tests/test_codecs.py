import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.operators import samples as S
from gridloom.operators.codecs import Job, decode, encode, fax, jpeg, logluv, lzw, packbits, register
from gridloom.sources.container import RasterError

TEXT = b"This is a string for checking various compression algorithms."
# fixed values: known encodings
LZW = bytes.fromhex("80150D06939882082030880E674391A4DC6710198DE721018CD065319AE1D103B1861A6F3AC14C66F369C0E465399CCD26F37420D867899A4E868369CC5D01")


def test_packbits_known():
    assert packbits.encode(b"\x3f") == b"\x00\x3f"
    assert packbits.encode(b"This st" + b"r" * 48 + b"ing hangs.") == b"\x06This st\xd1r\x09ing hangs."
    assert packbits.encode(TEXT) == b"\x3c" + TEXT
    long = packbits.encode(b"This st" + b"r" * 158 + b"ing hangs." + bytes(range(158)))
    assert long[:14] == b"\x06This st\x81r\xe3r\x7fi" and len(long) == 182 and long[141:143] == b"\x27\x76"
    # a header of -128 is passed over
    raw = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert packbits.decode(raw, 24).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    with pytest.raises(RasterError):
        packbits.encode(b"")
    with pytest.raises(RasterError):
        packbits.decode(b"\x05ab", 6)


def test_lzw_known():
    assert lzw.encode(TEXT) == LZW
    assert lzw.decode(LZW, len(TEXT)) == TEXT
    with pytest.raises(RasterError):
        lzw.decode(LZW[:20], len(TEXT))


def test_deflate():
    assert decode(8, zlib.compress(TEXT), Job(61, 1, 1, 61)) == TEXT
    with pytest.raises(RasterError):
        decode(8, b"nothing of the kind", Job(61, 1, 1, 61))


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.sampled_from([1, 5, 8, 32946, 32773, 50000]))
def test_round_trip(raw, code):
    assert decode(code, encode(code, raw), Job(len(raw), 1, 1, len(raw))) == raw


def test_lzw_fills_its_table():
    rng = random.Random(3)
    for n, k in ((200_000, 256), (200_000, 2), (70_000, 20)):
        raw = bytes(rng.randrange(k) for _ in range(n))
        assert lzw.decode(lzw.encode(raw), n) == raw


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 3000), st.integers(0, 500))
def test_lzw_damage(raw, size, cut):
    """Any bytes give at most ``size`` bytes or an error of ours, the same as a plain decoder does."""
    for data in (raw, lzw.encode(raw * 5)[:cut]):
        table, out, last, at, want = None, b"", None, 0, None
        bits = "".join(f"{b:08b}" for b in data)
        table, n = {i: bytes([i]) for i in range(256)}, 258
        while len(out) < size:
            width = min(12, max(9, (n + (last is not None)).bit_length())) if n < 4096 else 12
            if at + width > len(bits):
                want = "end"
                break
            code, at = int(bits[at : at + width], 2), at + width
            if code == lzw.CLEAR:
                table, n, last = {i: bytes([i]) for i in range(256)}, 258, None
                continue
            if code == lzw.END:
                break
            if code not in table and not (last is not None and code == n and n < 4096):
                want = "code"
                break
            word = table[code] if code in table else last + last[:1]
            if last is not None and n < 4096:
                table[n] = last + word[:1]
                n += 1
            last = word
            out += word
        if want:
            with pytest.raises(RasterError):
                lzw.decode(data, size)
        else:
            assert lzw.decode(data, size) == out[:size]


def test_lzw_small_data_are_decoded_as_large_ones(monkeypatch):
    rng = np.random.default_rng(5)

    def tried(data, size):
        try:
            return lzw.decode(data, size)
        except RasterError as e:
            return e.kind, e.detail

    cases = []
    for k in range(300):
        raw = rng.integers(0, (1, 3, 20, 255)[k % 4], int(rng.integers(1, 600)), "u1", endpoint=True).tobytes()
        data = bytearray(lzw.encode(raw))
        if k % 3 == 1:
            data[int(rng.integers(len(data)))] ^= int(rng.integers(1, 256))
        elif k % 3 == 2:
            data = data[: int(rng.integers(len(data)))]
        cases.append((bytes(data), len(raw) + int(rng.integers(-3, 4)) * (k % 5 == 0)))
    cases = [(data, max(0, size)) for data, size in cases if len(data) <= lzw.SMALL]
    assert len(cases) > 200
    got = [tried(*c) for c in cases]
    monkeypatch.setattr(lzw, "SMALL", -1)
    assert got == [tried(*c) for c in cases]


def test_lzw_long_runs():
    for raw in (b"\0" * 300_000, b"ab" * 100_000, bytes(range(256)) * 300 + b"x" * 9000):
        assert lzw.decode(lzw.encode(raw), len(raw)) == raw
        assert lzw.decode(lzw.encode(raw), 1000) == raw[:1000]


def test_unsupported_and_registered():
    for code in (2, 6, 50001, 999):
        with pytest.raises(RasterError) as e:
            decode(code, b"", Job(1, 1, 1, 1))
        assert e.value.kind == "UnsupportedCompressionMethod"
    register(60123, lambda raw, job: raw[::-1], lambda raw, level: raw[::-1])
    assert decode(60123, encode(60123, b"abc"), Job(3, 1, 1, 3)) == b"abc"


def _run_codes(row):
    inverse = [{v: k for k, v in t.items()} for t in fax.RUNS]
    out, color, n = "", 1, 0
    lengths = []
    for p in row:
        if p != color:
            lengths.append(n)
            color, n = p, 0
        n += 1
    for i, n in enumerate([*lengths, n]):
        while n >= 64:
            m = min(n // 64 * 64, 2560)
            size, code = inverse[i % 2][m]
            out += f"{code:0{size}b}"
            n -= m
        size, code = inverse[i % 2][n]
        out += f"{code:0{size}b}"
    return out


def _bytes(bits):
    n = -(-len(bits) // 8)
    return int(bits.ljust(8 * n, "0"), 2).to_bytes(n, "big")


def test_fax_tables_are_prefix_codes():
    for table in fax.RUNS:
        codes = [f"{c:0{n}b}" for n, c in table]
        assert len(codes) == 64 + 27 + 13
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)


@pytest.mark.parametrize("flavour", ["plain", "fill", "reversed", "bare"])
def test_fax3(flavour):
    rng = random.Random(5)
    image = [[(x // rng.choice([1, 3, 70, 900])) % 2 for x in range(3000)] for _ in range(5)] + [[i % 2 for i in range(3000)]]
    eol = "" if flavour == "bare" else ("00000" if flavour == "fill" else "") + fax.EOL
    raw = _bytes("".join(eol + _run_codes(r) for r in image))
    if flavour == "reversed":
        raw = bytes(int(f"{b:08b}"[::-1], 2) for b in raw)
    got = fax.decode_1d(raw, 3000, 6, 2 if flavour == "reversed" else 1)
    assert (np.unpackbits(np.frombuffer(got, np.uint8).reshape(6, -1), axis=1) == np.array(image)).all()


def _t6(image):
    """Two-dimensional codes of an image of 0 (black) and 1 (white)."""
    width = len(image[0])
    modes = {m: c for c, m in fax.MODES.items()}
    out, above = "", [1] * width

    def change(row, at, color):  # the next place after at, where row turns away from ``color``
        x = at
        while x < width and row[x] == color:
            x += 1
        return x

    for row in image:
        a0, color = -1, 1
        while a0 < width:
            start = max(a0, 0)
            a1 = change(row, start, color)
            x = a0 + 1
            while x < width and not (above[x] != color and (above[x - 1] if x else 1) == color):
                x += 1
            b1 = x
            b2 = change(above, b1, 1 - color) if b1 < width else width
            if b2 < a1:
                out += modes["pass"]
                a0 = b2
            elif abs(a1 - b1) <= 3:
                out += modes[a1 - b1]
                a0, color = a1, 1 - color
            else:
                a2 = change(row, a1, 1 - color)
                inverse = [{v: k for k, v in t.items()} for t in fax.RUNS]
                out += modes["horizontal"]
                for n, black in ((a1 - start, color == 0), (a2 - a1, color == 1)):
                    for part in ([n // 64 * 64] if n >= 64 else []) + [n % 64]:
                        size, code = inverse[black][part]
                        out += f"{code:0{size}b}"
                a0 = a2
            if a0 >= width:
                break
        above = row
    return _bytes(out + fax.EOL + fax.EOL)


def test_fax4():
    rng = random.Random(9)
    for width in (1, 7, 64, 301):
        image = []
        for y in range(12):
            row = image[-1][:] if image and y % 4 else [rng.randrange(2) for _ in range(width)]
            for _ in range(rng.randrange(3)):
                row[rng.randrange(width)] ^= 1
            image.append(row)
        image += [[1] * width, [0] * width, [1] * width]
        got = fax.decode_2d(_t6(image), width, len(image))
        assert (np.unpackbits(np.frombuffer(got, np.uint8).reshape(len(image), -1), axis=1)[:, :width] == np.array(image)).all(), width


def test_log_luminance():
    assert logluv.luminance(np.array([0], np.uint16))[0] == 0
    y = logluv.luminance(np.array([16384, 16384 | 0x8000], np.uint16))
    assert abs(y[0] - 2 ** (0.5 / 256)) < 1e-5 and y[1] == -y[0]
    # one row of two grey pixels: runs by plane, the most significant first
    raw = bytes([128, 0x40, 128, 0x00, 128, 81, 128, 192])
    rgb = np.frombuffer(logluv.decode(raw, 2, 1, 3), np.float32).reshape(2, 3)
    assert np.allclose(rgb[0], rgb[1]) and np.allclose(rgb[0], 1.0, atol=0.05)
    back = bytes([128, 192, 128, 81, 128, 0x00, 128, 0x40])
    assert logluv.decode(back, 2, 1, 3, reference_order=True) == rgb.tobytes()
    with pytest.raises(RasterError):
        logluv.decode(raw[:5], 2, 1, 3)


def test_log_luminance_24():
    step, row = logluv.uv_index(np.array([0, 3, 4, 9, 16288, 16289]))
    assert list(zip(step.tolist(), row.tolist(), strict=True)) == [(0, 0), (3, 0), (0, 1), (5, 1), (20, 162), (0, 0)]
    assert logluv.luminance_24(np.array([0, 640, 704, 672])).tolist() == [0, 2.0**-14, 2.0**-13, 1.5 * 2.0**-14]
    # the code nearest to white is grey
    best = min(range(16289), key=lambda c: (lambda s, r: (logluv._UV_U[r] + s * 0.0035 - 0.19784) ** 2 + (0.01694 + r * 0.0035 - 0.46832) ** 2)(*(int(x[0]) for x in logluv.uv_index(np.array([c])))))
    code = 640 << 14 | best
    rgb = np.frombuffer(logluv.decode_24(code.to_bytes(4, "big")[1:] * 2, 2, 1, 3), np.float32)
    assert np.allclose(rgb * 2.0**14, 1, atol=0.03)
    with pytest.raises(RasterError):
        logluv.decode_24(b"abc", 2, 1, 3)


def _jpeg(image, quant=1):
    """A baseline stream of (height, width, components) with one pair of tables."""
    h, w, n = image.shape
    k = np.arange(8)
    dct = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    symbols = list(range(12)), sorted({0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))})
    table = lambda c, s: bytes([c << 4]) + bytes([0] * 7 + [min(len(s), 255)] + [0] * 8) + bytes(s)  # noqa: E731  all of eight bits
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([quant] * 64)) + seg(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n)))
    out += seg(0xC4, table(0, symbols[0])) + seg(0xC4, table(1, symbols[1])) + seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\x00\x3f\x00")
    bits = ""

    def number(v):
        s = int(abs(v)).bit_length()
        return s, f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else ""

    padded = np.pad(image, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(float) - 128
    last = [0] * n
    for y in range(0, padded.shape[0], 8):
        for x in range(0, padded.shape[1], 8):
            for c in range(n):
                f = np.rint(dct.T @ padded[y : y + 8, x : x + 8, c] @ dct / quant).astype(int).ravel()[jpeg._ZIGZAG]
                s, b = number(f[0] - last[c])
                last[c] = f[0]
                bits += f"{symbols[0].index(s):08b}" + b
                run = 0
                for v in f[1:]:
                    if v == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits += f"{symbols[1].index(0xF0):08b}"
                        run -= 16
                    s, b = number(v)
                    bits += f"{symbols[1].index(run << 4 | s):08b}" + b
                    run = 0
                if run:
                    bits += f"{symbols[1].index(0):08b}"
    return out + _bytes(bits + "1" * (-len(bits) % 8)).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


@pytest.mark.parametrize("bands", [1, 3])
def test_jpeg(bands):
    y, x = np.mgrid[0:19, 0:30]
    image = np.stack([(x * 5 + y * (3 + c)) % 200 for c in range(bands)], -1).astype(np.uint8)
    raw = _jpeg(image)
    got = np.frombuffer(jpeg.decode(raw, None, 30, 19, bands), np.uint8).reshape(19, 30, bands)
    assert np.abs(got.astype(int) - image).max() <= 2
    # shared tables go before the data
    cut = raw.index(b"\xff\xc0")
    assert jpeg.decode(b"\xff\xd8" + raw[cut:], raw[:cut] + b"\xff\xd9", 30, 19, bands) == got.tobytes()
    with pytest.raises(RasterError):
        jpeg.decode(b"\xff\xd8\xff\xd9", None, 30, 19, bands)


def _progressive(image):
    """The stream of ``_jpeg`` with the same coefficients in six scans: constant terms without and with their lowest bit, then two bands, one of them in three steps."""
    h, w, n = image.shape
    k = np.arange(8)
    dct = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    padded = np.pad(image, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(float) - 128
    blocks = {(y, x, c): np.rint(dct.T @ padded[8 * y : 8 * y + 8, 8 * x : 8 * x + 8, c] @ dct).astype(int).ravel()[jpeg._ZIGZAG] for y in range(padded.shape[0] // 8) for x in range(padded.shape[1] // 8) for c in range(n)}
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    dc, ac = list(range(13)), [*range(0, 0xF0, 0x10), 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 12))]
    table = lambda c, s: bytes([c << 4]) + bytes([0] * 7 + [len(s)] + [0] * 8) + bytes(s)
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([1] * 64)) + seg(0xC2, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n)))
    out += seg(0xC4, table(0, dc)) + seg(0xC4, table(1, ac))

    def number(v):
        s = int(abs(v)).bit_length()
        return s, f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else ""

    def scan(parts, first, last, known, left, bits):
        head = bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, last, known << 4 | left])
        return seg(0xDA, head) + _bytes(bits + "1" * (-len(bits) % 8)).replace(b"\xff", b"\xff\x00")

    def band(c, first, last, left):
        bits, ends = "", 0
        for (_, _, own), f in blocks.items():
            if own != c:
                continue
            f = np.sign(f) * (np.abs(f) >> left)
            part = f[first : last + 1]
            if not part.any():
                ends += 1
                continue
            bits, ends, run = bits + eob(ends), 0, 0
            for i, v in enumerate(part):
                if not v:
                    run += 1
                    continue
                bits += f"{ac.index(0xF0):08b}" * (run // 16)
                s, b = number(v)
                bits += f"{ac.index(run % 16 << 4 | s):08b}" + b
                run = 0
                if not part[i + 1 :].any():
                    ends = int(i + 1 < len(part))
                    break
        return scan([c], first, last, 0, left, bits + eob(ends))

    def eob(ends):
        if not ends:
            return ""
        r = ends.bit_length() - 1
        return f"{ac.index(r << 4):08b}" + (f"{ends - (1 << r):0{r}b}" if r else "")

    def refine(c, first, last, left):
        bits = ""
        for (_, _, own), f in blocks.items():
            if own != c:
                continue
            t = np.abs(f) >> left
            new = [i for i in range(first, last + 1) if t[i] == 1]
            run, held = 0, ""
            for i in range(first, last + 1):
                if not t[i]:
                    run += 1
                    continue
                while run > 15 and new and i <= new[-1]:
                    bits, held, run = bits + f"{ac.index(0xF0):08b}" + held, "", run - 16
                if t[i] > 1:
                    held += str(t[i] & 1)
                    continue
                bits, held, run = bits + f"{ac.index(run << 4 | 1):08b}" + "01"[int(f[i] > 0)] + held, "", 0
            if run or held:
                bits += f"{ac.index(0):08b}" + held
        return scan([c], first, last, left + 1, left, bits)

    bits, last = "", [0] * n
    for (_, _, c), f in blocks.items():
        s, b = number((f[0] >> 1) - last[c])
        last[c] = f[0] >> 1
        bits += f"{dc.index(s):08b}" + b
    out += scan(list(range(n)), 0, 0, 0, 1, bits) + scan(list(range(n)), 0, 0, 1, 0, "".join(str(f[0] & 1) for f in blocks.values()))
    for c in range(n):
        out += band(c, 1, 9, 2) + band(c, 10, 63, 0) + refine(c, 1, 9, 1) + refine(c, 1, 9, 0)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("bands", [1, 3])
def test_progressive_jpeg(bands):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:35, 0:42]
    smooth = np.stack([(x * 5 + y * (3 + c)) % 200 for c in range(bands)], -1).astype(np.uint8)
    flat = np.full((35, 42, bands), 77, np.uint8)
    noise = rng.integers(0, 256, (35, 42, bands)).astype(np.uint8)
    for image in (smooth, flat, noise):
        want = jpeg.decode(_jpeg(image), None, 42, 35, bands)
        assert jpeg.decode(_progressive(image), None, 42, 35, bands) == want
    with pytest.raises(RasterError):
        jpeg.decode(_progressive(smooth).replace(b"\xff\xc2", b"\xff\xc3", 1), None, 42, 35, bands)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 31), st.integers(1, 4), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_bits_and_predictor(bits, stride, pixels, seed):
    rows = np.random.default_rng(seed).integers(0, 1 << bits, (3, pixels * stride), dtype=np.uint64).astype(f"u{S.storage(bits) // 8}")
    assert (S.unpack_bits(S.pack_bits(rows, bits), rows.shape[1], bits) == rows).all()
    assert (S.undo_horizontal(S.horizontal(rows, stride, bits), stride, bits) == rows).all()


@pytest.mark.parametrize("size", [2, 4, 8])
@pytest.mark.parametrize("stride", [1, 3])
def test_float_predictor(size, stride):
    rows = np.random.default_rng(size).normal(size=(4, 12)).astype(f"f{size}")
    assert (S.undo_float(S.float_predict(rows, stride), stride, size) == rows).all()


def test_wrapping():
    x = np.array([[4095, 0, 1]], np.uint16)
    assert S.horizontal(x, 1, 12).tolist() == [[4095, 1, 1]]
    assert S.invert(x, 12).tolist() == [[0, 4095, 4094]]
    y = np.array([[0xFFFFF, 0, 1]], np.uint32)
    assert (S.undo_horizontal(S.horizontal(y, 1, 20), 1, 20) == y).all()


def test_jpeg_codes_of_any_length():
    counts, symbols = bytes([0, 1, 1, 0, 1, 0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 1]), b"abcdefg"
    codes, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes.append(f"{code:0{length}b}")
            code, k = code + 1, k + 1
        code <<= 1
    order = [0, 6, 1, 5, 2, 4, 3, 0, 6]
    text = "".join(codes[i] for i in order)
    bits = jpeg._Bits(int(text + "0" * (-len(text) % 8), 2).to_bytes(-(-len(text) // 8), "big"))
    table = jpeg._codes(counts, symbols)
    assert [bits.symbol(table) for _ in order] == [symbols[i] for i in order]
    assert jpeg._codes(counts, symbols) is table  # made once for chunks with the same
    with pytest.raises(RasterError):
        jpeg._Bits(b"\xff" * 8).symbol(table)
    with pytest.raises(IndexError):
        jpeg._codes(counts, b"abc")
