"""Packed bit-vectors: a sequence is an array of BIGINT chunks of 64 markers, the first marker in the
lowest bit, with its number of markers beside it. Bits past the end are always zero.

Every function takes and returns Columns, so that expressions stay in the JVM. Marker numbers start at 1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64


def _shl(a, b):
    return F.call_function("shiftleft", a, b)


def _shr(a, b):
    return F.call_function("shiftrightunsigned", a, b)


def _long(x):
    return F.lit(x).cast("long")


def _upto(n, f):
    """array of f(i) for i = 0 .. n - 1; empty for n < 1."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), f)
    return F.slice(some, 1, F.greatest(n, F.lit(0)).cast("int"))


def n_chunks(n: Column) -> Column:
    return F.ceil(n / CHUNK).cast("int")


def pack(flags: Column) -> Column:
    """Array of booleans to chunks."""
    n = F.size(flags)

    def chunk(c):
        last = F.least(F.lit(CHUNK - 1), n - 1 - c * CHUNK)
        bit = lambda i: F.when(F.get(flags, c * CHUNK + i), _shl(_long(1), i)).otherwise(_long(0))
        return F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), _long(0), lambda acc, i: acc.bitwiseOR(bit(i)))

    return _upto(n_chunks(n), chunk)


def parse(text: Column) -> Column:
    """'0'/'1' text to chunks."""
    return pack(F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: x == "1"))


def unpack(chunks: Column, n: Column) -> Column:
    """Chunks to an array of n booleans."""
    return _upto(n, lambda i: get(chunks, i + 1))


def get(chunks: Column, idx) -> Column:
    """Marker idx as a boolean."""
    i = idx if isinstance(idx, Column) else F.lit(idx)
    return _shr(F.get(chunks, F.floor((i - 1) / CHUNK).cast("int")), F.pmod(i - 1, F.lit(CHUNK)).cast("int")).bitwiseAND(_long(1)) == 1


def put(chunks: Column, idx: int, value: bool) -> Column:
    """Chunks with marker idx set to value."""
    at, bit = divmod(idx - 1, CHUNK)
    mask = 1 << bit
    mask = mask - (1 << 64) if mask >> 63 else mask
    change = (lambda x: x.bitwiseOR(_long(mask))) if value else (lambda x: x.bitwiseAND(_long(~mask)))
    return F.transform(chunks, lambda x, i: F.when(i == at, change(x)).otherwise(x))


def to_string(chunks: Column, n: Column) -> Column:
    return F.array_join(F.transform(unpack(chunks, n), lambda x: F.when(x, "1").otherwise("0")), "")


def ones(n: Column) -> Column:
    return mask_range(n, F.lit(1), n)


def zeros(n: Column) -> Column:
    return _upto(n_chunks(n), lambda c: _long(0))


def mask_range(n: Column, first: Column, last: Column) -> Column:
    """Ones at markers first .. last, of n."""

    def chunk(c):
        lo = F.greatest(first - 1 - c * CHUNK, F.lit(0))
        hi = F.least(last - c * CHUNK, F.lit(CHUNK))  # exclusive
        below = F.when(hi >= CHUNK, _long(-1)).otherwise(F.bitwise_not(_shl(_long(-1), F.greatest(hi, F.lit(0)).cast("int"))))
        return F.when(hi > lo, below.bitwiseAND(_shl(_long(-1), lo.cast("int")))).otherwise(_long(0))

    return _upto(n_chunks(n), chunk)


def not_(chunks: Column, n: Column) -> Column:
    return xor_(chunks, ones(n))


def and_(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def or_(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def xor_(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def shift(chunks: Column, n: Column, by: int) -> Column:
    """The sequence moved `by` places towards its end (towards its beginning if negative), zeros coming in."""
    part = lambda c: F.coalesce(F.get(chunks, c), _long(0))
    whole, bits = divmod(abs(by), CHUNK)

    def chunk(c):
        if by >= 0:
            low = F.when(c - whole >= 0, part(F.greatest(c - whole, F.lit(0)))).otherwise(_long(0))
            below = F.when(c - whole - 1 >= 0, part(F.greatest(c - whole - 1, F.lit(0)))).otherwise(_long(0))
            return _shl(low, F.lit(bits)).bitwiseOR(_shr(below, F.lit(CHUNK - bits)) if bits else _long(0))
        return _shr(part(c + whole), F.lit(bits)).bitwiseOR(_shl(part(c + whole + 1), F.lit(CHUNK - bits)) if bits else _long(0))

    return and_(_upto(n_chunks(n), chunk), ones(n))


def popcount(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def hamming(a: Column, b: Column) -> Column:
    return popcount(xor_(a, b))


def hamming_of(chunks: int) -> Callable[[Column, Column], Column]:
    """The Hamming distance of sequences that all have so many chunks, as one expression without lambdas, which generated code takes in."""
    return lambda a, b: reduce(add, (F.bit_count(F.get(a, F.lit(c)).bitwiseXOR(F.get(b, F.lit(c)))) for c in range(chunks)))


def left_marker(a: Column, b: Column) -> Column:
    """Whether the first markers differ, as 0 or 1."""
    return F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0))).bitwiseAND(_long(1)).cast("int")


def equal_masked(a: Column, b: Column, m1: Column, m2: Column) -> Column:
    return popcount(and_(and_(xor_(a, b), m1), m2)) == 0


def dot(chunks: Column, weights: Column) -> Column:
    """Sum of the weights at derived markers."""
    return F.aggregate(F.transform(weights, lambda w, i: F.when(get(chunks, i + 1), w.cast("double")).otherwise(F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)


def chunk_of(idx: Column) -> Column:
    """Number of the chunk that holds marker idx, from 1."""
    return F.ceil(idx / CHUNK).cast("int")


def place_in_chunk(idx: Column) -> Column:
    """Place of marker idx in its chunk, from 1 to 64."""
    return (F.pmod(idx - 1, F.lit(CHUNK)) + 1).cast("int")


def set_places(x: Column) -> Column:
    """Places (0 to CHUNK - 1, rising) of the ones of a chunk: only these are exploded by who lists them."""
    one = lambda i: F.call_function("shiftrightunsigned", x, i).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.filter(F.sequence(F.lit(0), F.lit(CHUNK - 1)), one)
