"""Decoding of packed vectors, shared by the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 128
WORDS = DIM // 8
SAMPLE = 65_536  # rows at most that models of the vectors are fitted on


def sound(entries: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, scale, n2, code, *extra): one row per sound entry.

    Corrupt entries (packed_vector null, not 16 words, or with a null word) and
    entries without id are left out, as are those whose scale is null, not
    finite or zero: they decode to no direction. Of repeated rows the smallest
    (by packed words, then the other columns) stays. ``code`` holds
    one byte per coordinate, the sign of the factor taken in; the vector is
    ``scale * (2 * byte - 255)``, and ``n2`` the sum of squares of these odd integers.
    """
    ok = (F.size("packed_vector") == WORDS) & ~F.exists("packed_vector", lambda x: x.isNull())
    s = F.col("scaling_factor").cast("double")
    rows = entries.where(ok & F.col("vec_id").isNotNull() & s.isNotNull() & ~F.isnan(s) & (s != 0) & (F.abs(s) < float("inf")))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("packed_vector", "scaling_factor", *extra)).alias("m"))
    flat = one.select("vec_id", F.col("m.packed_vector").alias("packed"), F.col("m.scaling_factor").cast("double").alias("f"), *[F.col(f"m.{x}").alias(x) for x in extra])
    fields = [f for f in flat.schema.fields if f.name in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            words = b.column("packed").flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
            codes = words.view(np.uint8).reshape(n, DIM).astype(np.int16) * 2 - 255
            f = b.column("f").to_numpy(zero_copy_only=False)
            codes *= np.where(f > 0, -1, 1).astype(np.int16)[:, None]
            n2 = np.einsum("ij,ij->i", codes, codes, dtype=np.int64)
            cols = [b.column("vec_id"), pa.array(np.abs(f) / 2), pa.array(n2), packed(codes), *[b.column(x) for x in extra]]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "scale", "n2", "code", *extra])

    return flat.mapInArrow(run, "vec_id bigint, scale double, n2 bigint, code binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields))


def packed(codes: np.ndarray) -> pa.Array:
    """Rows of int16 codes as bytes: one byte each holds ``(code + 255) // 2``."""
    raw = ((codes + 255) // 2).astype(np.uint8)
    n = len(raw)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * DIM, DIM, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def codes_of(column) -> np.ndarray:
    """int16 codes of a sequence of byte strings."""
    n = len(column)
    raw = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(n, DIM)
    return raw.astype(np.int16) * 2 - 255


def unit(codes: np.ndarray) -> np.ndarray:
    """float32 rows of length one; odd codes are never all zero."""
    x = codes.astype(np.float32)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def rotation(seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((DIM, DIM)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def sample_units(rows: DataFrame, n_rows: int, key: str = "vec_id", most: int = SAMPLE) -> np.ndarray:
    """Unit vectors of at most ``most`` rows, chosen by a hash of the id; for fitting models only."""
    h = F.xxhash64(F.col(key), F.lit(11))
    if n_rows > most:
        rows = rows.where(F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * 1.1 * most / n_rows) + 1)
    got = rows.orderBy(h, key).limit(most).select("code").toArrow()
    return unit(codes_of(got.column("code").to_pylist())) if got.num_rows else np.zeros((0, DIM), np.float32)


def spherical_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centres by k-means on cosines; an empty centre is put on the worst-placed row."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        lab, best = nearest_centre(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, lab, x)
        size = np.bincount(lab, minlength=k)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            sums[empty] = x[np.argsort(best)[: len(empty)]]
        c = sums / np.maximum(np.sqrt((sums**2).sum(1)), 1e-9)[:, None]
    return c.astype(np.float32)


def nearest_centre(x: np.ndarray, c: np.ndarray, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    lab, best = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for i in range(0, len(x), step):
        s = x[i : i + step] @ c.T
        lab[i : i + step] = s.argmax(1)
        best[i : i + step] = s.max(1)
    return lab, best
