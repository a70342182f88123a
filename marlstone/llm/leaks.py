"""Problem 8: held-out passages inside a corpus.

Method: latent semantic retrieval. Documents are cut into overlapping passages;
a randomised SVD of their TF-IDF matrix (a random start, one power iteration
over the corpus, the small eigenproblem in the driver), distributed over the
corpus, gives a latent space in which passages of documents and of test items
are compared by cosine. Item passages lie in inverted lists, and a document
passage is compared with those of the lists near it. Candidate pairs are then
aligned word by word: the longest common subsequence along a band must hold at
least half of the item with at most one word in ten differing.

The corpus' own topics would fill a small latent space, so the items' passages
enter the decomposition with the same total weight as the corpus' passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import Table, spread

DIMS = 1 << 14  # hashed vocabulary
RANK = 64
COSINE = 0.55  # least latent cosine of a candidate
PART, DIFFER = 2, 10  # at least 1/PART of the item's words, at most 1 in DIFFER differs
BAND = 7  # words that may be missing or added on the way, more in items of over 140 words: one in DIFFER of the least stretch
WIDTHS = (24, 12, 6, 4)  # words of a passage; an item is searched by the widest of which its least stretch holds any at least once
ITEMS, ITEM_WORDS = 4000, 1_000_000  # items, and their words, that are searched in one pass; more are searched in blocks
BATCH_WORDS = 1 << 17  # words whose passages are taken at once; longer texts are cut into overlapping parts
LIST_ITEMS = 64  # item passages of an inverted list, on average
GRAM_WORDS, SIEVE = 1 << 20, np.uint64((1 << 20) - 1)  # words in which runs are sought at once; bits by which a run is looked up first
LEAST_LISTS, FAR = 2, 0.1  # lists probed in any case; the quantile of a list's members, by nearness to its centre, that stands for the farther ones
SLICES = 16  # in which partial sums of the decomposition are added up
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,6});|[\u00ad\u200b-\u200d\u2060\ufeff]")
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; tags, entities and invisible characters are left out."""
    if "<" in text or "&" in text or not text.isascii():
        text = MARKUP.sub(lambda m: " " if m[0][0] in "<&" else "", text)
    return WORD.findall(text.lower())


def hashed(text: str) -> np.ndarray:
    return np.array([crc32(w.encode()) for w in words(text)], np.uint32)


def hashed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, w): 32-bit word hashes of whole texts; null texts and ids are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "w": [hashed(t).tobytes() for t in pdf["text"]]})

    return spread(docs.select("doc_id", "text").where("doc_id is not null and text is not null")).mapInPandas(run, "doc_id bigint, w binary")


class Passages:
    """Passages of two neighbouring blocks of ``step`` words each, of many texts at once; the last block of a text may be shorter."""

    def __init__(self, texts: list[np.ndarray], step: int, owners: list[int] | None = None) -> None:
        some = [i for i, t in enumerate(texts) if len(t)]
        size = np.array([len(texts[i]) for i in some], np.int64)
        words = np.concatenate([texts[i] for i in some]) if some else np.zeros(0, np.uint32)
        self.dims = (words * np.uint32(2654435761)) >> np.uint32(32 - 14)
        n = -(-size // step)  # blocks of each text
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(first[-1]) - np.repeat(first[:-1], n)
        self.grid = np.full((len(at), step), DIMS, np.int32)  # dimensions of the words of each block; DIMS where there is none
        word = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        self.grid[np.repeat(first[:-1], size) + word // step, word % step] = self.dims
        last = np.zeros(len(at), bool)
        last[first[1:] - 1] = True
        self.left = np.flatnonzero(~last | (np.repeat(n, n) == 1))  # first block of each passage
        self.right = np.where(last[self.left], self.left, self.left + 1)
        ids = np.array(owners if owners is not None else range(len(texts)), np.int64)
        self.owner = np.repeat(ids[some], n)[self.left] if some else np.zeros(0, np.int64)

    def project(self, weighted: np.ndarray) -> np.ndarray:
        """TF-IDF rows times a basis that already carries the IDF weights."""
        zero = np.concatenate([weighted, np.zeros((1, weighted.shape[1]), np.float32)])
        per = zero[self.grid[:, 0]]
        for i in range(1, self.grid.shape[1]):
            per += zero[self.grid[:, i]]
        return np.where((self.left != self.right)[:, None], per[self.left] + per[self.right], per[self.left])

    def back(self, z: np.ndarray) -> np.ndarray:
        """The transposed term-frequency matrix times ``z``."""
        per = np.zeros((len(self.grid), z.shape[1]), np.float32)
        per[self.left] += z  # no block is the first, or the second, of two passages
        two = self.left != self.right
        per[self.right[two]] += z[two]
        block = np.repeat(np.arange(len(self.grid)), (self.grid < DIMS).sum(1))
        return np.stack([np.bincount(self.dims, column[block], DIMS) for column in np.ascontiguousarray(per.T)], 1)


def batches_of(texts: list[np.ndarray], step: int) -> Iterator[Passages]:
    """Passages of all texts, BATCH_WORDS or so at a time; ``owner`` is the place of the text."""
    got: list[np.ndarray] = []
    whose: list[int] = []
    n, most = 0, BATCH_WORDS // step * step
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - step), most - step):  # parts overlap by a block
            part = t[at : at + most]
            got.append(part)
            whose.append(i)
            n += len(part)
            if n >= BATCH_WORDS:
                yield Passages(got, step, whose)
                got, whose, n = [], [], 0
    if got:
        yield Passages(got, step, whose)


def _texts(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in column.to_pylist()]


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of partial matrices that come in slices: (slice, part) to DIMS x width numbers."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float64) for x in pdf["part"]], axis=0)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": [total.tobytes()]})

    got = dict(rows.groupBy("slice").applyInPandas(add, "slice int, part binary").collect())  # SLICES rows, DIMS x width numbers
    none = np.zeros(DIMS // SLICES * width)
    return np.concatenate([np.frombuffer(got[i], np.float64) if i in got else none for i in range(SLICES)]).reshape(DIMS, width)


def _sliced(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(m, SLICES)], pa.binary())], names=["slice", "part"])


def document_frequency(docs: DataFrame) -> np.ndarray:
    """Documents in which each hashed dimension occurs, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((DIMS, 1))
        for b in batches:
            for w in _texts(b.column("w")):
                df[np.unique((w * np.uint32(2654435761)) >> np.uint32(32 - 14)), 0] += 1
        yield _sliced(df)

    return _summed(docs.select("w").mapInArrow(run, "slice int, part binary"), 1)[:, 0]


def _gram(rows: DataFrame, basis: np.ndarray, idf: np.ndarray, step: int) -> np.ndarray:
    """A'A times a basis, for the TF-IDF matrix A of all passages of ``rows``; one pass over them."""
    shared = rows.sparkSession.sparkContext.broadcast((basis * idf[:, None]).astype(np.float32))  # DIMS x RANK numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, total = shared.value, np.zeros((DIMS, RANK))
        for b in batches:
            for p in batches_of(_texts(b.column("w")), step):
                total += p.back(p.project(weighted))
        yield _sliced(total)

    return _summed(rows.select("w").mapInArrow(run, "slice int, part binary"), RANK) * idf[:, None]


def latent_basis(docs: DataFrame, items: DataFrame, idf: np.ndarray, step: int = WIDTHS[0] // 2) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (DIMS x RANK) and singular values of the passages of corpus and items, both of the same total weight.

    Randomised: A'A is applied to a random start, the result is made
    orthonormal, A'A is applied once more, and the small matrix that this gives
    is solved. Two passes over the corpus, whatever the number of items.
    """
    size = None

    def apply(basis: np.ndarray) -> np.ndarray:
        nonlocal size
        parts = [_gram(rows, basis, idf, step) for rows in (docs, items)]
        if size is None:
            size = [np.sqrt((m**2).sum()) or 1.0 for m in parts]
        return sum(m / x for m, x in zip(parts, size))

    q, _ = np.linalg.qr(apply(np.random.default_rng(3).standard_normal((DIMS, RANK))))
    small = q.T @ apply(q)
    value, u = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)
    return q @ u[:, order], np.sqrt(np.maximum(value[order], 0))


def _unit(z: np.ndarray) -> np.ndarray:
    return (z / np.maximum(np.sqrt((z**2).sum(1)), 1e-9)[:, None]).astype(np.float32)


def run_length(n: int) -> int:
    """Words in a row that must be equal in any stretch that counts, for an item of n words."""
    least = n
    for length in range(max(1, -(-n // PART)), n + 1):
        d = length // DIFFER
        least = min(least, -(-(length - d) // (d + 1)))
    return max(1, least)


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of k words in a row."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def aligned(item: np.ndarray, doc: np.ndarray, shift: int) -> bool:
    """Whether a stretch near the diagonal ``doc position = item position + shift`` counts.

    Runs of equal words inside the band are chained; a gap costs the longer of
    its two sides. A chain of L item words with d differing may be lengthened
    at its ends by differing words while one word in DIFFER allows it.
    """
    n = len(item)
    need = -(-n // PART)
    band = max(BAND, need // DIFFER + 1)
    lo, hi = max(0, shift - band), min(len(doc), shift + n + band)
    seg = np.full(n + 2 * band, 1 << 32, np.uint64)  # words of the document on the band; a value no word has elsewhere
    seg[lo - shift + band : hi - shift + band] = doc[lo:hi]
    same = sliding_window_view(seg, n) == item  # one row for each diagonal
    count = np.concatenate([[0], np.cumsum(same.any(0))])
    if (count[need:] - count[:-need]).max(initial=0) < need - need // DIFFER - 2:
        return False
    runs: list[tuple[int, int, int]] = []  # item start, doc start, length
    for row, s in zip(same, range(shift - band, shift + band + 1)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        runs += [(a, a + s, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= 3 or s == shift]
    runs.sort()
    for f, (i0, j0, _) in enumerate(runs):
        if n - i0 < need * (DIFFER - 1) // DIFFER - 1:
            break
        cost = {f: 0}
        for t in range(f, len(runs)):
            if t not in cost:
                ends = [(cost[p] + max(runs[t][0] - runs[p][0] - runs[p][2], runs[t][1] - runs[p][1] - runs[p][2])) for p in cost if runs[p][0] + runs[p][2] <= runs[t][0] and runs[p][1] + runs[p][2] <= runs[t][1]]
                if not ends:
                    continue
                cost[t] = min(ends)
            length = runs[t][0] + runs[t][2] - i0
            spare = length - DIFFER * cost[t]
            if spare < 0:
                continue
            j1 = runs[t][1] + runs[t][2]
            room = min(i0, j0) + min(n - i0 - length, len(doc) - j1)
            if length + min(spare // (DIFFER - 1), room) >= need:
                return True
    return False


def width_of(n: int) -> int:
    """The passage width for an item of n words: with blocks of half of it, any least stretch holds a whole passage."""
    half = -(-n // PART)
    return next((w for w in WIDTHS if 2 * half >= 3 * w), WIDTHS[-1])


class Lists:
    """Passages of items in latent space, in inverted lists around centres."""

    def __init__(self, z: np.ndarray, owner: np.ndarray) -> None:
        k = max(1, len(z) // LIST_ITEMS)
        rng = np.random.default_rng(4)
        c = z[rng.choice(len(z), k, replace=False)]
        for _ in range(6):
            lab = (z @ c.T).argmax(1)
            c = np.stack([z[lab == i].sum(0) if (lab == i).any() else c[i] for i in range(k)])
            c = _unit(c)
        lab = (z @ c.T).argmax(1)
        self.centres = c
        self.members = [(z[lab == i], owner[lab == i]) for i in range(k)]
        self.inside = np.array([float(np.quantile(m @ c[i], FAR)) if len(m) else 9.0 for i, (m, _) in enumerate(self.members)])

    def near(self, z: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of z, item) pairs with a cosine of at least ``cosine``, from the nearest lists and those whose centre is as near as one of their farther members at that cosine is expected to make it."""
        s = z @ self.centres.T
        k = min(LEAST_LISTS, s.shape[1])
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if len(s) else np.zeros(0)
        rows, items = [], []
        for i, (m, owner) in enumerate(self.members):
            at = np.flatnonzero((s[:, i] >= cosine * self.inside[i]) | (s[:, i] >= least))
            if len(at):
                r, j = np.nonzero(z[at] @ m.T >= cosine)
                rows.append(at[r])
                items.append(owner[j])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(items)


class Items:
    """Test items, their passages in latent space, and their word runs in order."""

    def __init__(self, ids: list[int], texts: list[np.ndarray]) -> None:
        self.ids, self.texts = ids, texts
        by: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, t in enumerate(texts):
            k = run_length(len(t))
            g = grams(t, k)
            by.setdefault(k, []).append((g, np.full(len(g), i), np.arange(len(g))))
        self.runs = {}
        for k, parts in by.items():
            g, i, at = (np.concatenate(x) for x in zip(*parts))
            o = np.argsort(g, kind="stable")
            some = np.zeros(int(SIEVE) + 1, bool)
            some[g & SIEVE] = True
            self.runs[k] = (g[o], i[o], at[o], some)

    def latent(self, weighted: np.ndarray) -> dict[int, Lists]:
        """Per passage width the items of that width; their passages begin at every sixth of it, so one of them lies nearly as a document's does."""
        out = {}
        for width in WIDTHS:
            mine = [i for i, t in enumerate(self.texts) if width_of(len(t)) == width]
            step, shift = width // 2, max(1, width // 6)
            cut = [(i, self.texts[i][at:]) for i in mine for at in range(0, step, shift) if at == 0 or len(self.texts[i]) - at >= width]
            if cut:
                p = Passages([t for _, t in cut], step, [i for i, _ in cut])
                out[width] = Lists(_unit(p.project(weighted)), p.owner)
        return out

    def leaked(self, doc: np.ndarray, candidates: np.ndarray) -> list[int]:
        """Ids of the candidate items (rows, as mask) of which the document holds a stretch that counts."""
        return [i for _, i in self.leaked_each([doc], candidates[None])]

    def leaked_each(self, texts: list[np.ndarray], candidates: np.ndarray) -> list[tuple[int, int]]:
        """(place of the text, item id) of all texts and their candidate items (texts x items, as mask)."""
        rows = np.flatnonzero(candidates.any(1))
        size = np.array([len(texts[r]) for r in rows], np.int64)
        part = np.cumsum(size) // GRAM_WORDS  # texts whose runs of words are sought at once
        out = []
        for p in np.unique(part):
            out += self._leaked(rows[part == p], texts, candidates)
        return out

    def _leaked(self, rows: np.ndarray, texts: list[np.ndarray], candidates: np.ndarray) -> list[tuple[int, int]]:
        size = np.array([len(texts[r]) for r in rows], np.int64)
        words = np.concatenate([texts[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        found: set[tuple[int, int, int]] = set()
        for k, (g, item, at, some) in self.runs.items():
            h = grams(words, k)
            x = np.flatnonzero(some[h & SIEVE])
            x = x[owner[x] == owner[x + k - 1]]
            lo, n = np.searchsorted(g, h[x], "left"), np.searchsorted(g, h[x], "right")
            n -= lo
            y = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            x = np.repeat(x, n)
            keep = candidates[rows[owner[x]], item[y]]
            x, y = x[keep], y[keep]
            found |= set(zip(owner[x].tolist(), item[y].tolist(), (place[x] - at[y]).tolist()))
        done: set[tuple[int, int]] = set()
        for r, i, shift in sorted(found):
            if (r, i) not in done and aligned(self.texts[i], texts[rows[r]], shift):
                done.add((r, i))
        return [(int(rows[r]), self.ids[i]) for r, i in sorted(done)]


def leaks(docs: DataFrame, items: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id): documents that hold an unbroken stretch of at least half of an item.

    Items are the stated query set; they go to every task in blocks of about
    ITEMS items and ITEM_WORDS words. Null texts or ids take no part, an item
    without words leaks nowhere, and repeated rows count once. Document
    statistics, the decomposition and the search cover whole texts of all
    documents; the decomposition is made once for all items.
    """
    spark = docs.sparkSession
    hashes = Table(hashed_words(docs), "words").df
    asked = hashed_words(items.select(F.col("item_id").alias("doc_id"), "text").distinct()).where(F.octet_length("w") > 0)
    asked = Table(asked, "items").df
    n_items, n_words = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("w")), F.lit(0)) / 4).first()
    if not n_items:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    n = hashes.count()
    idf = np.log((n + 1) / (document_frequency(hashes) + 1)) + 0.1
    weighted = (latent_basis(hashes, asked, idf)[0] * idf[:, None]).astype(np.float32)
    blocks = max(-(-n_items // ITEMS), -(-int(n_words) // ITEM_WORDS))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("doc_id", "w"), F.lit(blocks)) == block).orderBy("doc_id", "w").collect()  # about ITEMS rows, see above
        it = Items([r[0] for r in rows], [np.frombuffer(r[1], np.uint32) for r in rows])
        shared = spark.sparkContext.broadcast((it, weighted, it.latent(weighted)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            it, weighted, lists = shared.value
            for b in batches:
                ids, texts = b.column("doc_id").to_pylist(), _texts(b.column("w"))
                hits = np.zeros((len(texts), len(it.ids)), bool)
                for width, near in lists.items():
                    for p in batches_of(texts, width // 2):
                        row, item = near.near(_unit(p.project(weighted)), cosine)
                        hits[p.owner[row], item] = True
                got = [(ids[x], i) for x, i in it.leaked_each(texts, hits)]
                if got:
                    a, c = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "item_id"])

        here = hashes.mapInArrow(run, "doc_id bigint, item_id bigint")
        found = here if found is None else found.unionByName(here)
    return found.distinct()
