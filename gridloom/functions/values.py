"""Tag values as columns: the coercions of the typed getters, on the struct ``value`` of the table of tags.

What a coercion does not accept is null; ``required`` makes null an error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.sources.container import SCALARS


def scalar(value: Column, to: str) -> Column:
    """One value as u8 ... i64 and ifd (decimal, as far as it fits), f32, f64 or string."""
    kinds, low, high = SCALARS[to]
    ok = value["kind"].isin(*sorted(kinds))
    if to == "string":
        return F.when(ok, value["str"])
    if low is None:
        return F.when(ok, F.get(value["doubles"], F.lit(0)))
    one = F.get(value["ints"], F.lit(0))
    return F.when(ok & (one >= F.lit(Decimal(low))) & (one <= F.lit(Decimal(high))), one)


def vector(value: Column, to: str) -> Column:
    """All values as a list of u8 ... i64, f32 or f64: of a list or a single value of one kind; of text its code points for u32 and u64, of rationals their parts."""
    kinds, low, high = SCALARS[to]
    names = sorted(kinds | {f"List<{k}>" for k in kinds})
    if low is None:
        return F.when(value["kind"].isin(*names), value["doubles"])
    ints = value["ints"]
    fit = F.forall(ints, lambda x: (x >= F.lit(Decimal(low))) & (x <= F.lit(Decimal(high))))
    out = F.when(value["kind"].isin(*names) & fit, ints)
    if to in ("u32", "u64", "i32", "i64"):
        kind = "Rational" if to[0] == "u" else "SRational"
        parts = F.flatten(F.transform(value["rationals"], lambda r: F.array(r["n"], r["d"])))
        out = F.when(value["kind"] == kind, parts.cast("array<decimal(20,0)>")).otherwise(out)
    if to in ("u32", "u64"):
        points = F.transform(F.split(value["str"], ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("decimal(20,0)"))
        out = F.when(value["kind"] == "Ascii", F.when(value["str"] == "", F.array().cast("array<decimal(20,0)>")).otherwise(points)).otherwise(out)
    return out


def required(value: Column, name: str) -> Column:
    """The value, or an error of the query where there is none."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"RequiredTagNotFound: {name}"))).otherwise(value)


def part(value: Column, at: int, n: int) -> Column:
    """``n`` bytes of the stored value from byte ``at`` on."""
    return F.substring(value["bytes"], at + 1, n)


def entries_of(items: Column) -> Column:
    """A map of entries from a list of structs (tag, entry), in order of tags; the last of a tag counts."""
    last = F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y["tag"] == x["tag"]))
    return F.map_from_entries(F.array_sort(F.transform(last, lambda x: F.struct(x["tag"], x["entry"]))))
