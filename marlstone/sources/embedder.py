"""Embedding services as plain callables, and the checks on what they return."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence

from urllib.error import HTTPError
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class EmbeddingError(RuntimeError):
    pass


def hash_embedder(dimension: int) -> Embedder:
    """Deterministic unit vectors from word hashes, for tests and dry runs; texts that share words are near."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in t.lower().split() or [""]:
                v += np.random.default_rng(int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")).standard_normal(dimension)
            out.append((v / max(np.linalg.norm(v), 1e-9)).tolist())
        return out

    return embed


def http_embedder(url: str, dimension: int, timeout_s: float = 30.0, tries: int = 3) -> Embedder:
    """A service over HTTP: POST ``{"payloads": [...], "dimensions": n}``, answer ``{"embeddings": [[...], ...]}`` in the same order.

    Other keys of the answer are ignored; no texts make no request. A busy or
    unreachable service is tried again, then it is an error.
    """

    def embed(texts: Sequence[str]) -> list[list[float]]:
        if not len(texts):
            return []
        body = json.dumps({"payloads": list(texts), "dimensions": dimension}).encode()
        for left in range(tries - 1, -1, -1):
            try:
                with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=timeout_s) as answer:
                    return json.load(answer)["embeddings"]
            except (OSError, ValueError, KeyError) as e:
                refused = isinstance(e, HTTPError) and e.code < 500 and e.code != 429
                if refused or not left:
                    raise EmbeddingError(f"embedding service: {e}") from None
                time.sleep(0.2 * (tries - left))
        raise AssertionError

    return embed


def checked(embed: Embedder, texts: Sequence[str], dimension: int) -> np.ndarray:
    """Vectors in the order of the texts; another number of vectors or another dimension is an error."""
    got = list(embed(list(texts))) if len(texts) else []
    if len(got) != len(texts):
        raise EmbeddingError(f"{len(got)} vectors for {len(texts)} texts")
    if any(len(v) != dimension for v in got):
        raise EmbeddingError(f"a vector hasn't {dimension} dimensions")
    return np.array(got, np.float32).reshape(len(got), dimension)


def probe(embed: Embedder, dimension: int) -> float:
    """Norm of a test vector, so that a service of the wrong size or scale is noticed at the start."""
    return float(np.linalg.norm(checked(embed, ["probe"], dimension)[0]))


def embed_column(df: DataFrame, text: str, embed: Embedder, dimension: int, batch: int = 64) -> DataFrame:
    """``df`` with a column ``embedding``; one call for each ``batch`` texts of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [checked(embed, pdf[text].iloc[i : i + batch].tolist(), dimension) for i in range(0, len(pdf), batch)]
            yield pdf.assign(embedding=[v for p in parts for v in p])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, embedding array<float>")
