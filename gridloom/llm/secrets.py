"""Secret scans through nested encodings.

A text is a layer. Every layer is scanned with the base patterns and then
unwrapped: URL escapes and Unicode escapes are replaced within the layer,
stretches of text in decoded base64, as UTF-8 or UTF-16, become layers of their
own, whatever path or name it is joined to and wrapped or not, and decoded or escaped bytes that
are gzip, zlib, bzip2, xz or zstandard streams are decompressed, all members
of them, in pieces that overlap. New layers go onto a worklist until none is
left. A layer whose content was seen at the same place
is not taken again, so cycles end. Spans found in inner layers are mapped back
to the text, to the smallest stretch of it that the match was decoded from;
for compressed data that is the whole run.

Null and empty texts have no spans. Repeated rows are scanned each by itself.
An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textkern import slices
from gridloom.runtime import give_back, ship

# fixed values: the base patterns, in the order in which kinds are listed
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: Shorter runs of base64 cannot hold a match of the base patterns.
MIN_BASE64 = 16
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
BREAK = re.compile(r"\r?\n[ \t]*")
#: Runs of printable characters and escapes that may stand for the bytes of a compressed stream.
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
ESCAPED_BYTES = re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[\\'"0abfnrtv]|[ -\[\]-~])+""")
URL_BYTE = re.compile("%[0-9A-Fa-f]{2}")
ZLIB = re.compile(rb"[\x08\x18\x28\x38\x48\x58\x68\x78]")
ESCAPE = re.compile(r"""\\(?:x([0-9A-Fa-f]{2})|u00([0-9A-Fa-f]{2})|([\\'"0abfnrtv]))""")
PLAIN = dict(zip("\\'\"0abfnrtv", "\\'\"\0\a\b\f\n\r\t\v", strict=True))
#: Starts of compressed streams, wherever they are; the two bytes of zlib are looked for at starts only.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: UTF-8 without control characters; shorter stretches cannot hold a match of the base patterns.
STRETCH = re.compile(rb"(?:[\t-\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}+")
#: ASCII as UTF-16 of either byte order; the base patterns have nothing else.
WIDE = re.compile(rb"(?:\x00[\t-\r\x20-\x7e]){12,}+|(?:[\t-\r\x20-\x7e]\x00){12,}+")
#: Inflated data are scanned in pieces of this size that overlap by so much.
PIECE, OVERLAP = 4 << 20, 256 << 10

_CLASS = np.zeros(256, np.uint8)  # 1: hex digit in lower case, 2: base64
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = 2
_CLASS[list(b"0123456789abcdef")] = 3
_XDIGIT = np.zeros(256, bool)
_XDIGIT[list(b"0123456789abcdefABCDEF")] = True

Span = tuple[int, str, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns: leftmost and not overlapping within a kind, without those too short."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return out


class _Map:
    """Where the characters of a layer come from: pieces with their start in the layer and in the text."""

    def __init__(self, starts: list[int], origin: list[tuple[int, int, bool]], up: _Map | None):
        self.starts, self.origin, self.up = starts, origin, up

    def back(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the text for characters a to b of the layer."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, max(a, b - 1)) - 1
        x, y, plain = self.origin[i]
        low = x + (a - self.starts[i]) if plain else x
        x, y, plain = self.origin[j]
        high = x + (b - self.starts[j]) if plain else y
        return self.up.back(low, high) if self.up else (low, high)


def _replaced(text: str, found: list[tuple[int, int, str, list[int]]], up: _Map | None) -> tuple[str, _Map]:
    """The layer with some stretches replaced; each has, for its new characters, the ends of what they stand for."""
    parts, starts, origin, at, n = [], [], [], 0, 0
    for a, b, new, ends in found:
        if a > at:
            parts.append(text[at:a])
            starts.append(n)
            origin.append((at, a, True))
            n += a - at
        parts.append(new)
        x = a
        for k, y in enumerate(ends):
            starts.append(n + k)
            origin.append((x, y, False))
            x = y
        n += len(new)
        at = b
    if at < len(text) or not starts:
        parts.append(text[at:])
        starts.append(n)
        origin.append((at, len(text), True))
    return "".join(parts), _Map(starts, origin, up)


def _url(text: str) -> list[tuple[int, int, str, list[int]]]:
    out = []
    for m in URL.finditer(text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        new = raw.decode("utf-8", "surrogateescape")
        if any("\ud800" <= c <= "\udfff" for c in new):  # bytes that are no UTF-8 stay escaped
            parts, ends, at = [], [], m.start()
            for c in new:
                if "\ud800" <= c <= "\udfff":
                    parts.append(text[at : at + 3])
                    ends += [at + 1, at + 2, at + 3]
                    at += 3
                else:
                    parts.append(c)
                    at += 3 * len(c.encode())
                    ends.append(at)
            new = "".join(parts)
        else:
            ends, at = [], m.start()
            for c in new:
                at += 3 * len(c.encode())
                ends.append(at)
        if new != m[0]:
            out.append((m.start(), m.end(), new, ends))
    return out


def _unicode(text: str) -> list[tuple[int, int, str, list[int]]]:
    out = []
    for m in UNICODE.finditer(text):
        if m[3]:
            point = 0x10000 + ((int(m[3], 16) - 0xD800) << 10) + (int(m[4], 16) - 0xDC00)
        else:
            digits = next(x for x in (m[1], m[2], m[5], m[6], m[8], m[7]) if x)
            point = int(digits, 10 if m[7] else 16)
        if point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF:
            out.append((m.start(), m.end(), chr(point), [m.end()]))
    return out


def _zlib_head(raw: bytes) -> bool:
    return len(raw) > 2 and raw[0] & 0x0F == 8 and raw[0] >> 4 <= 7 and (raw[0] << 8 | raw[1]) % 31 == 0


def _opened(raw: bytes):
    """A decompressor for the stream that begins here, or None."""
    if raw[:2] == b"\x1f\x8b" or _zlib_head(raw):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    return None


_ZLIB = type(zlib.decompressobj())


def _chunks(raw: bytes, at: int) -> Iterator[bytes]:
    for a in range(at, len(raw), 1 << 16):
        yield raw[a : a + (1 << 16)]


def _decoded(body: str, at: int) -> Iterator[bytes]:
    """The bytes of base64 from a place on, a little at a time."""
    end = len(body) - ((len(body) - at) % 4 == 1)
    for a in range(at, end, 1 << 16):
        own = body[a : min(end, a + (1 << 16))]
        yield base64.b64decode(own + "=" * (-len(own) % 4))


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the members of a compressed stream hold, a little at a time; of a damaged one, what comes before the damage."""
    d, data, more, first = None, b"", True, True
    try:
        while True:
            if d is None:
                while more and len(data if first else data.lstrip(b"\0")) < 6:
                    got = next(chunks, None)
                    more, data = got is not None, data + (got or b"")
                data = data if first else data.lstrip(b"\0")  # members may be padded
                d, first = _opened(data), False
                if d is None:
                    return
            if isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                yield d.decompress(data, 1 << 20)
                data = b""
                wants = d.needs_input
            elif isinstance(d, _ZLIB):
                yield d.decompress(data, 1 << 20)
                data = d.unconsumed_tail
                wants = not data
            else:  # zstandard has no limit for what it returns; a few bytes make a block at most
                yield d.decompress(data[:64])
                data = data[64:]
                wants = not data
            if d.eof:
                data, d = d.unused_data + data, None
                if not data and not more:
                    return
            elif wants:
                got = next(chunks, None)
                if got is None:
                    return
                data = got
    except Exception:  # a damaged stream, of whatever library
        return


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The stream in pieces of bounded size, cut at line breaks where there are some, each with the end of the one before."""
    held: list[bytes] = []
    size = 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= PIECE:
            whole = b"".join(held)
            end = whole.rfind(b"\n", len(whole) - OVERLAP) + 1 or len(whole)
            yield whole[:end]
            start = max(0, end - OVERLAP)
            start = max(start, whole.find(b"\n", start, end - 1) + 1)
            held = [whole[start:]]
            size = len(held[0])
    if size:
        yield b"".join(held)


def _is_stream(raw: bytes) -> bool:
    """Whether the beginning of a large stream can be read, and does not only look like one."""
    size = 0
    for chunk in _inflated(_chunks(raw, 0)):
        size += len(chunk)
        if size >= len(raw) // 4:
            return True
    return False


def _inflated_texts(work: list[Iterator[bytes]]) -> Iterator[str]:
    """The text in compressed streams, and in those inside them, until nothing new comes."""
    seen: set[bytes] = set()
    while work:
        stream = _inflated(work.pop())
        head = b""
        while len(head) < 6 and (got := next(stream, None)) is not None:
            head += got
        begun = chain([head], stream)
        nested = _opened(head) is not None
        if nested:
            held, size = [], 0
            for chunk in begun:
                held.append(chunk)
                size += len(chunk)
                if size >= PIECE:
                    break
            whole = b"".join(held)
            begun = chain([whole], begun)
            if size >= PIECE and _is_stream(whole):  # large streams in one another are not held
                work.append(begun)
                continue
        for n, piece in enumerate(_pieces(begun)):
            digest = sha256(piece).digest()
            if digest in seen:  # scanned already, with what is in it; others may follow
                continue
            seen.add(digest)
            for m in STRETCH.finditer(piece):
                yield m[0].decode()
            for m in WIDE.finditer(piece) if b"\0" in piece else ():
                yield m[0].replace(b"\0", b"").decode()
            work += [_chunks(piece, at) for at in {m.start() for m in MAGIC.finditer(piece)} | ({0} if n == 0 and nested else set())]


def _stretches(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Stretches of text in bytes, as UTF-8 and as UTF-16, with the places at which their characters begin and the last one ends."""
    for m in STRETCH.finditer(raw):
        text = m[0].decode()
        yield text, m.start() + np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
    for m in WIDE.finditer(raw) if b"\0" in raw else ():
        yield m[0].replace(b"\0", b"").decode(), m.start() + np.arange(0, len(m[0]) + 1, 2)


def _base64(run: str) -> Iterator[tuple[str, list[tuple[int, int]] | None]]:
    """The layers in a base64 run: stretches of text with the place in the run of each character, and texts that were compressed, without.

    A run may begin before its base64 does, after a path or a name for
    instance, so each of the four alignments is decoded.
    """
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) < MIN_BASE64:
        return
    for shift in range(4):
        raw = b"".join(_decoded(body, shift))
        for text, at in _stretches(raw):
            yield text, [(shift + x * 4 // 3, min(len(run), shift + (y * 4 + 2) // 3)) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield from ((text, None) for text in _inflated_texts([_chunks(raw, m.start()) for m in MAGIC.finditer(raw)]))
    for at in [0, *(m.end() for m in re.finditer("[+/]", body))]:  # zlib, after a part that ends here
        if len(body) - at >= MIN_BASE64 and _zlib_head(base64.b64decode(body[at : at + 4])):
            yield from ((text, None) for text in _inflated_texts([_decoded(body, at)]))


def _escaped(layer: str) -> Iterator[tuple[int, int, str]]:
    """Texts of compressed streams whose bytes are escaped: start and end of the stretch, text."""
    for pattern, one, mark in ((URL_BYTES, URL_BYTE, "%"), (ESCAPED_BYTES, ESCAPE, "\\")):
        for m in pattern.finditer(layer) if mark in layer else ():
            units = [x.span() for x in one.finditer(m[0])] if mark in m[0] else []
            if not units:
                continue
            if mark == "%":
                raw = unquote_to_bytes(m[0])
            else:
                raw = ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else PLAIN[e[3]], m[0]).encode("latin-1")
            heads = {x.start() for x in MAGIC.finditer(raw)} | {x.start() for x in ZLIB.finditer(raw) if _zlib_head(raw[x.start() : x.start() + 3])}
            if not heads:
                continue
            gaps = np.zeros(len(raw) + 1, np.int64)  # characters that the bytes before each one have more than one
            at = 0
            for x, y in units:
                gaps[x - at + 1] = y - x - 1
                at += y - x - 1
            gaps = np.cumsum(gaps)
            tail = units[-1][1]
            tail += len(re.match(r"\S*", m[0][tail:])[0])
            for head in heads:
                for text in _inflated_texts([_chunks(raw, head)]):
                    yield m.start() + head + int(gaps[head]), m.start() + tail, text


def _layers(layer: str, way: _Map | None) -> Iterator[tuple[str, _Map]]:
    """The layers inside a layer."""
    for decode in (_url, _unicode):
        if ("%" in layer) if decode is _url else ("\\" in layer or "&#" in layer):
            if changed := decode(layer):
                yield _replaced(layer, changed, way)
    for a, b, text in _escaped(layer):
        yield text, _Map([0], [(a, b, False)], way)
    for m in chain(BASE64.finditer(layer), WRAPPED.finditer(layer)):
        run, place = m[0], range(m.start(), m.end())
        if "\n" in run:
            lines, place, x = [], [], m.start()
            for gap in [*BREAK.finditer(layer, *m.span()), None]:
                y = gap.start() if gap else m.end()
                lines.append(layer[x:y])
                place += range(x, y)
                x = gap.end() if gap else y
            run = "".join(lines)
        for text, ends in _base64(run):
            origin = [(*m.span(), False)] if ends is None else [(place[x], place[y - 1] + 1, False) for x, y in ends]
            yield text, _Map(list(range(len(origin))), origin, way)


def inner_spans(text: str) -> set[Span]:
    """Spans found in the layers inside a text."""
    found: set[Span] = set()
    key = lambda a, b, layer: (a, b, sha256(layer.encode("utf-8", "surrogatepass")).digest())
    seen = {key(0, len(text), text)}
    work = [_layers(text, None)]
    while work:  # the newest first, so that few layers are held
        got = next(work[-1], None)
        if got is None:
            work.pop()
            continue
        layer, way = got
        a, b = way.back(0, len(layer))
        if layer and (new := key(a, b, layer)) not in seen:
            seen.add(new)
            for x, kind, y in base_spans(layer):
                low, high = way.back(x, y)
                found.add((low, kind, high))
            work.append(_layers(layer, way))
    return found


def _joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], order[s[1]], s[2])))


def _long_runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least``."""
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    a, b = edge[::2], edge[1::2]
    ok = b - a >= least
    return a[ok], b[ok]


def scan_slice(offsets: np.ndarray, data: np.ndarray) -> list[tuple[list[Span], set[Span]]]:
    """(base spans, spans of inner layers) of each row. Only rows that can have any are looked at closely."""
    rows = len(offsets) - 1
    raw = data.tobytes()
    kind = _CLASS[data]
    maybe_base, maybe_inner = np.zeros(rows + 1, bool), np.zeros(rows + 1, bool)
    row_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    maybe_base[row_of(_long_runs(kind & 1 == 1, MIN_HEX)[0])] = True
    a, b = _long_runs((kind >= 2) | (data == 0x0A) | (data == 0x0D), MIN_BASE64)  # base64 can be wrapped
    # a run does not go on over the end of a row; those that touch one are looked for again, row by row
    first = row_of(a)
    crossing = row_of(b - 1) > first
    for r, s in zip(first[crossing].tolist(), row_of(b[crossing] - 1).tolist(), strict=True):
        maybe_base[r : s + 1] = maybe_inner[r : s + 1] = True
    maybe_inner[first] = True
    if len(data) > 2:
        escape = np.flatnonzero((data[:-2] == 0x25) & _XDIGIT[data[1:-1]] & _XDIGIT[data[2:]])
        maybe_inner[row_of(escape)] = True
    maybe_inner[row_of(np.flatnonzero(data == 0x5C))] = True
    maybe_inner[row_of(np.flatnonzero((data[:-1] == 0x26) & (data[1:] == 0x23)))] = True
    lower = raw.lower()
    for word, text in (*((w, lower) for w in KEYWORDS), (b"AKIA", raw)):
        at = text.find(word)
        while at >= 0:
            r = int(row_of(at))
            maybe_base[r] = True
            at = text.find(word, max(at + 1, int(offsets[r + 1]) - len(word) + 1))
    out: list[tuple[list[Span], set[Span]]] = [([], set())] * rows
    for r in range(rows):
        if not (maybe_base[r] or maybe_inner[r]):
            continue
        text = raw[offsets[r] : offsets[r + 1]].decode()
        out[r] = (base_spans(text) if maybe_base[r] else [], inner_spans(text))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_assign, n_access, n_hex (base matches), base_sha256, spans (all, as ``kind:start:end`` in code points), n_inner (spans added from inner layers)."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = sha256(b"").hexdigest()
        for batch in batches:
            for a, b, offsets, data in slices(batch.column("text")):
                rows = []
                for base, inner in scan_slice(offsets, data):
                    if not base and not inner:
                        rows.append((0, 0, 0, none, "", 0))
                        continue
                    n = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                    both = set(base) | inner
                    rows.append((*n, sha256(_joined(base).encode()).hexdigest(), _joined(list(both)), len(both) - len(base)))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)
        give_back()

    return picked.mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_inner bigint").withColumnRenamed("id", id_col)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mark``; overlapping spans are one. Null texts stay null, all columns and rows stay."""
    ship(docs.sparkSession)

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            for a, b, offsets, data in slices(column):
                own, live, changed = column.slice(a, b - a), column.is_valid(), False
                out: list[str | None] = []
                for r, (base, inner) in enumerate(scan_slice(offsets, data)):
                    if not live[a + r].as_py():
                        out.append(None)
                        continue
                    text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
                    parts, at = [], 0
                    for x, _, y in sorted(set(base) | inner, key=lambda s: (s[0], -s[2])):
                        if x >= at:
                            parts += [text[at:x], mark]
                        at = max(at, y)
                    changed = changed or bool(parts)
                    out.append("".join([*parts, text[at:]]) if parts else text)
                columns = [c.slice(a, b - a) for c in batch.columns]
                columns[place] = pa.array(out, own.type) if changed else own
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        give_back()

    return docs.mapInArrow(run, docs.schema)
