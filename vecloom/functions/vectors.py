"""Column builders for vectors and small integer formulas, which stay in the JVM, and small tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(values: Column) -> Column:
    """The sum of an array of doubles, from left to right."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Squared Euclidean distance in double precision."""
    return fold(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Inner product in double precision; with a plane of +-1 it is a projection score."""
    return fold(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def plane_sign(seed: int, plane: ColumnOrName, dim: ColumnOrName) -> Column:
    """+1 or -1 for a dimension of a plane, from an arithmetic mix that SQL engines share."""
    x = (_c(plane).cast("long") * 7919 + _c(dim).cast("long") * 104729 + F.lit(seed)) * 2654435761 % 4294967296
    return F.when(F.floor(x / 65536) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def plane(seed: int, number: ColumnOrName, dims: ColumnOrName) -> Column:
    return F.transform(F.sequence(F.lit(0), _c(dims) - 1), lambda d: plane_sign(seed, _c(number), d))


def plane_matrix(seed: int, planes: int, dim: int) -> np.ndarray:
    """The signs of plane_sign, as a matrix of dimensions x planes."""
    p, d = np.arange(planes, dtype=np.int64)[None], np.arange(dim, dtype=np.int64)[:, None]
    mixed = ((p * 7919 + d * 104729 + seed).astype(np.uint64) * np.uint64(2654435761)) % np.uint64(1 << 32)
    return np.where(mixed // np.uint64(1 << 16) % np.uint64(2) == 0, 1.0, -1.0)


def simhash_signature(v: ColumnOrName, table: ColumnOrName, bits: int, seed: int) -> Column:
    """A signature of up to 24 bits: bit b is set if the projection on plane table * bits + b is 0 or more."""
    if not 1 <= bits <= 24:
        raise ValueError("bits must be from 1 to 24")
    one = lambda b: F.when(dot(v, plane(seed, _c(table) * bits + b, F.size(_c(v)))) >= 0, F.lit(1 << b)).otherwise(F.lit(0))
    total = one(0)
    for b in range(1, bits):
        total = total + one(b)
    return total


def mix_u32(x: ColumnOrName) -> Column:
    """A 32-bit integer mixer on longs (murmur3's finalizer). Products are taken in halves, as longs are signed."""

    def times(a: Column, k: int) -> Column:
        high = (F.shiftrightunsigned(a, 16) * k).bitwiseAND(65535)
        return (F.shiftleft(high, 16) + a.bitwiseAND(65535) * k).bitwiseAND(4294967295)

    x = _c(x).cast("long").bitwiseAND(4294967295)
    x = times(x.bitwiseXOR(F.shiftrightunsigned(x, 16)), 0x85EBCA6B)
    x = times(x.bitwiseXOR(F.shiftrightunsigned(x, 13)), 0xC2B2AE35)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def pair_key(a: ColumnOrName, b: ColumnOrName) -> Column:
    """One key for an unordered pair of ids."""
    return F.struct(F.least(_c(a), _c(b)).alias("lo"), F.greatest(_c(a), _c(b)).alias("hi"))


def checksum(*cols: ColumnOrName) -> Column:
    return F.xxhash64(*map(_c, cols))


def pq_offset(m: ColumnOrName, dim: int, subspaces: int) -> Column:
    """First dimension of sub-space m of min(subspaces, dim)."""
    return (_c(m).cast("long") * dim / min(subspaces, dim)).cast("long")


def pq_offsets(dim: int, subspaces: int) -> list[int]:
    n = min(subspaces, dim)
    return [m * dim // n for m in range(n + 1)]


def evenly_spaced(count: int, want: int) -> list[int]:
    """Distinct positions from the first to the last of `count`."""
    want = min(count, want)
    return [0] * (want > 0) if want <= 1 else sorted({i * (count - 1) // (want - 1) for i in range(want)})


def sample_positions(count: int, want: int) -> list[int]:
    """Positions of an even sample for training."""
    want = min(count, want)
    return [i * count // want for i in range(want)]


def nodes_per_page(page_size: int, dim: int, degree: int, code_bytes: int) -> int:
    """Nodes that fit in a page of this size: id, degree, vector, neighbours and their codes for each, 8 bytes of head."""
    return (page_size - 8) // (8 + 4 * dim + 4 * degree + degree * code_bytes)


def aligned(n: int, to: int) -> int:
    return -(-n // to) * to
