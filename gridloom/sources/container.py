"""Headers, directories and tag values of tagged raster files, classic or with 64-bit offsets.

Pure Python over anything that gives bytes by range. What is wrong with a file
or page is raised as ``RasterError``, whose kind names the rule.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from gridloom.functions.domains import FIELD_TYPES


class RasterError(Exception):
    def __init__(self, kind: str, detail: object = ""):
        super().__init__(f"{kind}: {detail}" if detail != "" else kind)
        self.kind, self.detail = kind, str(detail)

    def __reduce__(self):
        return RasterError, (self.kind, self.detail)


@dataclass(frozen=True)
class Limits:
    """Bytes that a result, a compressed chunk and a tag's value may take."""

    decoded: int = 256 << 20
    chunk: int = 128 << 20
    tag: int = 1 << 20


class Source:
    """Bytes by range, of a buffer or of a file that is read where needed."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read, self.size = read, size

    @classmethod
    def of(cls, raw: bytes) -> Source:
        view = memoryview(raw)
        return cls(lambda at, n: bytes(view[at : at + n]), len(view))

    @classmethod
    def open(cls, file) -> Source:
        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(n)

        size = file.seek(0, 2)
        return cls(read, size)

    def take(self, at: int, n: int) -> bytes:
        """Exactly n bytes."""
        if at < 0 or n < 0 or at + n > self.size:
            raise RasterError("IoError", f"{n} bytes at {at} of {self.size}")
        return self._read(at, n)

    def up_to(self, at: int, n: int) -> bytes:
        return self._read(at, max(0, min(n, self.size - at))) if at < self.size else b""


@dataclass(frozen=True)
class Header:
    order: str  # "<" or ">"
    big: bool
    first: int

    @property
    def byte_order(self) -> str:
        return "LittleEndian" if self.order == "<" else "BigEndian"


@dataclass(frozen=True)
class Entry:
    type: int
    count: int
    raw: bytes  # the field with the value or its offset


@dataclass
class Directory:
    offset: int
    entries: dict[int, Entry] = field(default_factory=dict)
    next: int | None = None


@dataclass(frozen=True)
class Value:
    """A decoded value: ``kind`` names the variant, ``List`` holds Values."""

    kind: str
    value: object


def read_header(src: Source) -> Header:
    head = src.take(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise RasterError("TiffSignatureNotFound")
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic == 42:
        return Header(order, False, struct.unpack(order + "I", head[4:8])[0])
    if magic != 43:
        raise RasterError("TiffSignatureInvalid")
    if struct.unpack(order + "HH", head[4:8]) != (8, 0):
        raise RasterError("TiffSignatureNotFound")
    return Header(order, True, struct.unpack(order + "Q", src.take(8, 8))[0])


def read_directory(src: Source, head: Header, at: int) -> Directory:
    """The directory at an offset. An entry of unknown type is passed over by 8 bytes, in either variant."""
    o, big = head.order, head.big
    n = struct.unpack(o + ("Q" if big else "H"), src.take(at, 8 if big else 2))[0]
    out, p = Directory(at), at + (8 if big else 2)
    if n * (4 if big else 12) > src.size:
        raise RasterError("IoError", f"a directory of {n} entries")
    for _ in range(n):
        tag, kind = struct.unpack(o + "HH", src.take(p, 4))
        if kind not in FIELD_TYPES:
            p += 12
            continue
        if big:
            (count,) = struct.unpack(o + "Q", src.take(p + 4, 8))
            raw = src.take(p + 12, 8)
            p += 20
        else:
            (count,) = struct.unpack(o + "I", src.take(p + 4, 4))
            raw = src.take(p + 8, 4)
            p += 12
        out.entries[tag] = Entry(kind, count, raw)  # the last of a tag counts
    (following,) = struct.unpack(o + ("Q" if big else "I"), src.take(p, 8 if big else 4))
    out.next = following or None
    out.entries = dict(sorted(out.entries.items()))
    return out


def directory_bytes(n: int, big: bool) -> int:
    """Size of a directory of n entries."""
    return 8 + 20 * n + 8 if big else 2 + 12 * n + 4


def walk(src: Source, head: Header, first: int | None = None) -> Iterator[Directory]:
    """The chain of directories; an offset that comes again ends it with an error."""
    at, seen = head.first if first is None else first, set()
    while at:
        if at in seen:
            raise RasterError("CycleInOffsets", at)
        seen.add(at)
        d = read_directory(src, head, at)
        yield d
        at = d.next


def swap(raw: bytes, unit: int, order_from: str, order_to: str) -> bytes:
    """Byte order changed by units; a part of a unit at the end stays."""
    if order_from == order_to or unit == 1:
        return raw
    n = len(raw) // unit * unit
    out = bytearray(n)
    for k in range(unit):
        out[k::unit] = raw[unit - 1 - k : n : unit]
    return bytes(out) + raw[n:]


# kind of one element by field type, and its struct code
_ELEMENT = {1: ("Byte", "B"), 3: ("Short", "H"), 4: ("Unsigned", "I"), 5: ("Rational", "II"), 6: ("SignedByte", "b"), 7: ("Byte", "B"), 8: ("SignedShort", "h"), 9: ("Signed", "i"), 10: ("SRational", "ii"), 11: ("Float", "f"), 12: ("Double", "d"), 13: ("Ifd", "I"), 16: ("UnsignedBig", "Q"), 17: ("SignedBig", "q"), 18: ("IfdBig", "Q")}
#: Bytes that a decoded element is reckoned at, against the limit of results.
VALUE_SIZE = 32


def value_bytes(src: Source, head: Header, e: Entry, limit: int | None = None) -> bytes:
    """The value as it is stored, in the file's byte order."""
    size = FIELD_TYPES[e.type][1] * e.count
    if size >= 1 << 64 or (limit is not None and size > limit):
        raise RasterError("LimitsExceeded", size)
    if size <= len(e.raw):
        return e.raw[:size]
    return src.take(offset_of(head, e), size)


def offset_of(head: Header, e: Entry) -> int:
    return struct.unpack(head.order + ("Q" if head.big else "I"), e.raw)[0]


def value_range(src: Source, head: Header, e: Entry, at: int, n: int) -> bytes:
    """Up to n bytes of the stored value from byte ``at`` on."""
    size = FIELD_TYPES[e.type][1] * e.count
    n = max(0, min(n, size - at))
    return e.raw[at : at + n] if size <= len(e.raw) else src.take(offset_of(head, e) + at, n)


def read_value(src: Source, head: Header, e: Entry, limits: Limits = Limits()) -> Value:
    """A tag's value: one element, a List of several or of none, or text."""
    width = FIELD_TYPES[e.type][1]
    if e.count == 0:
        return Value("List", ())
    size = width * e.count
    if size >= 1 << 64:
        raise RasterError("LimitsExceeded", size)
    inline = size <= len(e.raw)
    if e.type == 2:
        if inline:
            raw = e.raw[: e.count]
            if any(b > 127 for b in raw) or raw[-1]:
                raise RasterError("InvalidTag")
            return Value("Ascii", raw.decode("ascii").strip("\0"))
        raw = value_bytes(src, head, e, limits.tag).split(b"\0")[0]
        try:
            return Value("Ascii", raw.decode("utf-8"))
        except UnicodeDecodeError:
            raise RasterError("InvalidTag") from None
    if e.count > 1 and (size > limits.tag or e.count > limits.decoded // VALUE_SIZE):
        raise RasterError("LimitsExceeded", size)
    kind, code = _ELEMENT[e.type]
    flat = struct.unpack(f"{head.order}{e.count * len(code)}{code[0]}", value_bytes(src, head, e))
    items = flat if len(code) == 1 else list(zip(flat[::2], flat[1::2], strict=True))
    if e.count == 1:
        return Value(kind, items[0])
    return Value("List", tuple(Value(kind, x) for x in items))


# ---- coercions ------------------------------------------------------------

_UNSIGNED = {"Byte", "Short", "Unsigned", "UnsignedBig"}
_POINTER = {"Ifd", "IfdBig"}
_SIGNED = {"SignedByte", "SignedShort", "Signed", "SignedBig"}
# fixed values: accepted variants and range of each scalar coercion
SCALARS = {
    "u8": ({"Byte"}, 0, (1 << 8) - 1),
    "i8": ({"SignedByte"}, -(1 << 7), (1 << 7) - 1),
    "u16": (_UNSIGNED, 0, (1 << 16) - 1),
    "i16": (_SIGNED, -(1 << 15), (1 << 15) - 1),
    "u32": (_UNSIGNED | _POINTER, 0, (1 << 32) - 1),
    "i32": (_SIGNED, -(1 << 31), (1 << 31) - 1),
    "u64": (_UNSIGNED | _POINTER, 0, (1 << 64) - 1),
    "i64": (_SIGNED, -(1 << 63), (1 << 63) - 1),
    "f32": ({"Float"}, None, None),
    "f64": ({"Double"}, None, None),
    "ifd": ({"Unsigned"} | _POINTER, 0, (1 << 64) - 1),
    "string": ({"Ascii"}, None, None),
}


def into(v: Value, to: str) -> object:
    """One value as u8 ... i64, f32, f64, ifd or string; floats are not widened."""
    kinds, low, high = SCALARS[to]
    if v.kind not in kinds:
        raise RasterError("InvalidTypeForTag", f"{v.kind} as {to}")
    if low is not None and not low <= v.value <= high:
        raise RasterError("IntSizeError", v.value)
    return v.value


def into_list(v: Value, to: str) -> list:
    """A list or one value as a list. Text becomes its code points for u32 and u64, rationals their two parts."""
    if v.kind == "List":
        if to in ("i32", "i64"):
            return [y for x in v.value for y in (x.value if x.kind == "SRational" else (into(x, to),))]
        if to in ("u8", "u16"):
            ok = {"u8": {"Byte"}, "u16": {"Byte", "Short"}}[to]
            if all(x.kind in ok for x in v.value):
                return [x.value for x in v.value]
        return [into(x, to) for x in v.value]
    if v.kind == "Rational" and to in ("u32", "u64"):
        return list(v.value)
    if v.kind == "SRational" and to in ("i32", "i64"):
        return list(v.value)
    if v.kind == "Ascii" and to in ("u32", "u64"):
        return [ord(c) for c in v.value]
    return [into(v, to)]


class Tags:
    """Typed access to one directory."""

    def __init__(self, src: Source, head: Header, directory: Directory, limits: Limits = Limits()):
        self.src, self.head, self.directory, self.limits = src, head, directory, limits

    def entry(self, tag: int) -> Entry | None:
        return self.directory.entries.get(tag)

    def find(self, tag: int) -> Value | None:
        e = self.entry(tag)
        return None if e is None else read_value(self.src, self.head, e, self.limits)

    def get(self, tag: int) -> Value:
        v = self.find(tag)
        if v is None:
            raise RasterError("RequiredTagNotFound", tag)
        return v

    def find_as(self, tag: int, to: str) -> object | None:
        v = self.find(tag)
        return None if v is None else into(v, to)

    def find_list(self, tag: int, to: str) -> list | None:
        v = self.find(tag)
        if v is None:
            return None
        return into_list(v, to)

    def __iter__(self) -> Iterator[tuple[int, Value]]:
        for tag, e in self.directory.entries.items():
            yield tag, read_value(self.src, self.head, e, self.limits)
