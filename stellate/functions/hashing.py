"""Hash functions as column expressions, in whole 64-bit arithmetic without overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_U32 = 0xFFFFFFFF
# fixed values of the 32-bit and the 64-bit finaliser
_M1, _M2 = 0x85EBCA6B, 0xC2B2AE35
_M3, _M4 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_DJB2 = 5381


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _mul32(x: Column, c: int) -> Column:
    """x * c mod 2**32 for 0 <= x < 2**32: the constant's halves keep products under 2**48."""
    low = x * F.lit(c & 0xFFFF)
    high = (x * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(_U32))


def murmur32(x) -> Column:
    """The 32-bit murmur finaliser of the low 32 bits, as an unsigned value in a long."""
    h = _col(x).cast("long").bitwiseAND(F.lit(_U32))
    h = h.bitwiseXOR(F.shiftright(h, 16))
    h = _mul32(h, _M1)
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = _mul32(h, _M2)
    return h.bitwiseXOR(F.shiftright(h, 16))


def _limbs(hi: Column, lo: Column) -> Column:
    """A 64-bit word of two sums under 2**63, the carry of the low one counted in."""
    return F.shiftleft((hi + F.shiftright(lo, 32)).bitwiseAND(F.lit(_U32)), 32).bitwiseOR(lo.bitwiseAND(F.lit(_U32)))


def _mul64(x: Column, c: int) -> Column:
    """x * c mod 2**64, as a signed long, by products under 2**48."""
    xl, xh = x.bitwiseAND(F.lit(_U32)), F.shiftrightunsigned(x, 32)
    c0, c1, c2, c3 = (F.lit(c >> s & 0xFFFF) for s in (0, 16, 32, 48))
    mid = xl * c1
    lo = xl * c0 + F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16)
    cross = xl * c2 + F.shiftleft((xl * c3).bitwiseAND(F.lit(0xFFFF)), 16) + xh * c0 + F.shiftleft((xh * c1).bitwiseAND(F.lit(0xFFFF)), 16)
    return _limbs(F.shiftright(mid, 16) + cross, lo)


def murmur64(x) -> Column:
    """The 64-bit murmur finaliser, as a signed long."""
    h = _col(x).cast("long")
    h = _mul64(h.bitwiseXOR(F.shiftrightunsigned(h, 30)), _M3)
    h = _mul64(h.bitwiseXOR(F.shiftrightunsigned(h, 27)), _M4)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 31))


def _bytes(raw: Column, n: Column) -> Column:
    """The first ``n`` bytes, given in hex, as longs."""
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))


def _signed(b: Column) -> Column:
    return F.when(b > 127, b - 256).otherwise(b)


def djb2(text) -> Column:
    """h = 33 h + byte from 5381, mod 2**32, over the UTF-8 bytes taken as signed; '' gives 5381."""
    raw = F.hex(_col(text).cast("binary"))
    byte = F.transform(_bytes(raw, (F.length(raw) / 2).cast("int")), _signed)
    return F.aggregate(byte, F.lit(_DJB2).cast("long"), lambda h, b: (h * 33 + b).bitwiseAND(F.lit(_U32)))


def content_checksum(*cols) -> Column:
    """An aggregate over rows, independent of their order: any changed row changes it."""
    return F.bit_xor(F.xxhash64(*[_col(c) for c in cols]))


def block_checksum(words) -> Column:
    """5381 xor the finalised low half of each 64-bit word (array<bigint>)."""
    return F.aggregate(_col(words), F.lit(_DJB2).cast("long"), lambda acc, w: acc.bitwiseXOR(murmur32(w)))


def block_checksum_agg(word) -> Column:
    """block_checksum of a column of words, as an aggregate: the order doesn't matter, so it folds before the shuffle."""
    return F.coalesce(F.bit_xor(murmur32(word)), F.lit(0)).bitwiseXOR(F.lit(_DJB2))


def buffer_checksum(buffer) -> Column:
    """block_checksum of a buffer's whole little-endian words, xor the string hash (64 bits, signed bytes) of the 1 to 7 bytes left over."""
    raw = F.hex(_col(buffer).cast("binary"))
    n = (F.length(raw) / 2).cast("int")
    b, whole = _bytes(raw, n), F.floor(n / 8).cast("int")
    at = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    low = F.transform(at, lambda i: sum((F.shiftleft(F.get(b, i * 8 + j), 8 * j) for j in (1, 2, 3)), F.get(b, i * 8)))
    tail = F.aggregate(F.transform(F.slice(b, whole * 8 + 1, F.greatest(n - whole * 8, F.lit(0))), _signed), F.lit(_DJB2).cast("long"), lambda h, x: h * 33 + x)
    return F.when(n > whole * 8, block_checksum(low).bitwiseXOR(tail)).otherwise(block_checksum(low))


def key_equals(a, b) -> Column:
    """Whether two keys are the same; null is the same as null."""
    return _col(a).eqNullSafe(_col(b))
