"""Vector kernels as column expressions over array<float> or array<double>."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Unit length; left as it is if shorter than 1e-5."""
    n = F.sqrt(dot(v, v))
    return F.when(n < 1e-5, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def residual(v: Column, c: Column) -> Column:
    return F.zip_with(v, c, lambda x, y: x.cast("double") - y.cast("double"))


def sign_code(r: Column) -> Column:
    """1 where the residual is not negative."""
    return F.transform(r, lambda x: F.when(x >= 0, 1).otherwise(0))


def grid_width(v: Column, bits: int) -> Column:
    return (F.array_max(v).cast("double") - F.array_min(v).cast("double")) / (2**bits - 1)


def grid_quantise(v: Column, bits: int) -> Column:
    """Levels of an even grid from the smallest to the largest component, rounded half away from zero; all 0 on a flat vector."""
    w, low = grid_width(v, bits), F.array_min(v).cast("double")
    return F.transform(v, lambda x: F.when(w > 0, F.floor((x.cast("double") - low) / w + 0.5).cast("int")).otherwise(0))


def snap_to_grid(bits: Column, dimension: int) -> Column:
    """(2 b - 1) / sqrt(dimension) for each code bit."""
    return F.transform(bits, lambda b: (b * 2 - 1) / F.lit(float(np.sqrt(dimension))))


def pack_bits(codes: np.ndarray) -> bytes:
    """Code bits, lowest first, padded with zeros to whole 64-bit words."""
    c = np.asarray(codes, np.uint8)
    return np.packbits(np.pad(c, (0, -len(c) % 64)), bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n]


def pack_words(codes: np.ndarray, width: int = 8, signed: bool = False) -> list[int]:
    """One-byte codes in little-endian groups of ``width`` bytes; the length must divide."""
    c = np.asarray(codes, np.uint8)
    if len(c) % width:
        raise ValueError(f"{len(c)} codes don't fill groups of {width}")
    return [int.from_bytes(c[i : i + width].tobytes(), "little", signed=signed) for i in range(0, len(c), width)]


def unpack_words(words: list[int], width: int = 8, signed: bool = False) -> np.ndarray:
    return np.frombuffer(b"".join(int(w).to_bytes(width, "little", signed=signed) for w in words), np.uint8)
