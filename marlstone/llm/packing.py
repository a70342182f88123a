"""Problem 7: filling fixed-capacity containers with documents measured in tokens.

Method: hierarchical multi-length packing. Documents are routed to tiers of
context sizes (the capacity, its half, its quarter, ...): the smallest window
that holds them. From the longest tier to the shortest, a tier's documents first
fill gaps of windows of longer tiers, best fit first; what finds no gap opens
windows of the tier's own size. Filled windows, each as large as what is in it,
are then combined into containers, best fit first, and containers are dealt into
step groups of nearly equal token counts.

Lengths are small integers, so the whole plan is made from their histogram (at
most ``capacity`` numbers) and describes runs of equal windows and containers;
documents are then ranked within their length, in many tasks, and looked up in
the plan.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.runtime import Table, spread

CAPACITY = 2048
TIERS = 6
GROUP = 64  # containers of a step group
SPREAD, PART_ROWS = 256, 100_000  # documents of one length are ranked in SPREAD parts, in more from SPREAD x PART_ROWS documents on
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how text is cut before byte pairs are merged (letters, digits, other signs, white space).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """The tokenizer of a vocabulary of byte-pair ranks, made once in each Python worker."""
    key = (crc32(vocabulary), len(vocabulary), pattern)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; a null text has 0 tokens, rows without id are left out.

    The driver reads the vocabulary file and ships it with the job.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # one vocabulary file, about a megabyte

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return spread(docs.select("doc_id", "text").where("doc_id is not null")).mapInPandas(run, "doc_id bigint, n_tokens int")


def tier_of(length: int, capacity: int, tiers: int = TIERS) -> int:
    """0 for lengths above half the capacity, 1 above a quarter, ... the last tier takes all shorter ones."""
    t = 0
    while t < tiers - 1 and length * 2 ** (t + 1) <= capacity:
        t += 1
    return t


class Shelf:
    """Open windows as runs (gap, first, last + 1) of equal gaps, so the work grows with the number of lengths, not of items."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, last rank + 1, first window, items per window
        self.gaps: list[tuple[int, int, int]] = []
        self.made = 0
        self.opened: list[tuple[int, int, int]] = []  # size, first window, last + 1

    def _keep(self, gap: int, a: int, b: int) -> None:
        if gap > 0 and b > a:
            insort(self.gaps, (gap, a, b))

    def put(self, length: int, left: int, size: int) -> None:
        """``left`` items of one length: into the least gaps that hold them, the rest into new windows of ``size``."""
        rank = 0
        while left:
            i = bisect_left(self.gaps, (length, -1, -1))
            if i == len(self.gaps):
                break
            gap, a, b = self.gaps.pop(i)
            per = gap // length
            n = min(b - a, left // per)
            if n:
                self.runs.append((length, rank, rank + n * per, a, per))
                rank, left = rank + n * per, left - n * per
                self._keep(gap - per * length, a, a + n)
            if n < b - a and left:  # fewer than fill one more window
                self.runs.append((length, rank, rank + left, a + n, left))
                self._keep(gap - left * length, a + n, a + n + 1)
                rank, left, n = rank + left, 0, n + 1
            self._keep(gap, a + n, b)
        if left:
            per = size // length
            full, rest = divmod(left, per)
            self.opened.append((size, self.made, self.made + full + (rest > 0)))
            if full:
                self.runs.append((length, rank, rank + full * per, self.made, per))
                self._keep(size - per * length, self.made, self.made + full)
            if rest:
                self.runs.append((length, rank + full * per, rank + left, self.made + full, rest))
                self._keep(size - rest * length, self.made + full, self.made + full + 1)
            self.made += full + (rest > 0)

    def contents(self) -> list[tuple[int, int, int]]:
        """(content, first, last + 1) of all windows, in order of the windows."""
        gap = {(a, b): g for g, a, b in self.gaps}
        marks = sorted({x for _, a, b in self.opened for x in (a, b)} | {x for ab in gap for x in ab})
        sizes = iter(self.opened)
        size, _, end = next(sizes, (0, 0, 0))
        open_ = {a: (g, b) for (a, b), g in gap.items()}
        out, g, until = [], 0, -1
        for a, b in zip(marks, marks[1:]):
            while a >= end:
                size, _, end = next(sizes)
            if a in open_:
                g, until = open_[a]
            out.append((size - (g if a < until else 0), a, b))
        return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, tiers: int = TIERS) -> tuple[list[tuple[int, int, int, int, int, int, int, int]], int]:
    """Runs (length, first rank, last rank + 1, window, per, wfirst, wper, container) and the number of containers.

    The item of rank r in a run lies in window ``window + (r - first) // per``,
    and window w in container ``container + (w - wfirst) // wper``. Containers
    are numbered by falling content.
    """
    inner, outer = Shelf(), Shelf()
    by_tier: list[list[int]] = [[] for _ in range(tiers)]
    for x in sorted(histogram, reverse=True):
        by_tier[tier_of(x, capacity, tiers)].append(x)
    for tier, lengths in enumerate(by_tier):
        for length in lengths:
            inner.put(length, histogram[length], max(length, capacity >> tier))
    alike: dict[int, list[tuple[int, int]]] = {}
    for content, a, b in inner.contents():
        alike.setdefault(content, []).append((a, b))
    for content in sorted(alike, reverse=True):
        outer.put(content, sum(b - a for a, b in alike[content]), capacity)
    at, places = 0, []  # (first container, last + 1, new number of the first), by falling content
    for _, a, b in sorted(outer.contents(), key=lambda r: (-r[0], r[1])):
        places.append((a, b, at))
        at += b - a
    places.sort()
    starts = [p[0] for p in places]
    windows: list[tuple[int, int, int, int, int]] = []  # first, last + 1, wfirst, wper, container
    for content, a, b, c, wper in sorted(outer.runs):
        rank = 0
        for x, y in alike[content]:  # the part of this run of ranks that these windows have
            lo, hi = max(a, rank), min(b, rank + y - x)
            base, rank0, rank = x - rank, rank, rank + y - x
            while lo < hi:
                k = c + (lo - a) // wper
                first, last, new = places[bisect_right(starts, k) - 1]
                stop = min(hi, a + (last - c) * wper)
                windows.append((base + lo, base + stop, base + a + (k - c) * wper, wper, new + k - first))
                lo = stop
    windows.sort()
    begins = [w[0] for w in windows]
    out = []
    for length, a, b, w, per in inner.runs:
        lo = a
        while lo < b:
            k = w + (lo - a) // per
            _, last, wfirst, wper, container = windows[bisect_right(begins, k) - 1]
            stop = min(b, a + (last - w) * per)
            out.append((length, lo, stop, k, per, wfirst, wper, container))
            lo = stop
    return out, outer.made


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, tiers: int = TIERS, group: int = GROUP) -> DataFrame:
    """(doc_id, piece_no, n_tokens, tier, window_id, container_id, step_group): every document in a container of ``capacity`` tokens.

    A document is split only if it alone exceeds the capacity, into full
    pieces and a rest (``piece_no`` from 0, else 0). Documents without tokens
    have one row without window and container. Repeated ids are separate
    documents. Step groups hold ``group`` containers each, dealt out by
    content.
    """
    counted = Table(token_counts(docs, vocabulary), "tokens").df
    pieces = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece_no"))
    pieces = pieces.select("doc_id", "piece_no", F.least(F.col("n_tokens") - F.col("piece_no") * capacity, F.lit(capacity)).alias("n_tokens"))
    parts = max(SPREAD, -(-counted.count() // PART_ROWS))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int"))
    per = Table(pieces.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n")), "lengths").df
    histogram = {int(r[0]): int(r[1]) for r in per.where("n_tokens > 0").groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs, made = plan(histogram, capacity, tiers)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(runs or [], "n_tokens int, first bigint, last bigint, window bigint, per bigint, wfirst bigint, wper bigint, container bigint"))  # at most a few runs per length
    before = F.sum("n").over(W.partitionBy("n_tokens").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offset = per.select("n_tokens", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.withColumn("r", F.row_number().over(W.partitionBy("n_tokens", "part").orderBy("doc_id", "piece_no")))
    ranked = ranked.join(offset, ["n_tokens", "part"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    placed = ranked.join(table, "n_tokens", "left").where("first is null or (rank >= first and rank < last)")
    placed = placed.withColumn("window_id", F.col("window") + F.floor((F.col("rank") - F.col("first")) / F.col("per")))
    container = F.col("container") + F.floor((F.col("window_id") - F.col("wfirst")) / F.col("wper"))
    level = sum((F.when(F.col("n_tokens") * 2 ** (t + 1) <= capacity, 1).otherwise(0) for t in range(tiers - 1)), F.lit(0))
    groups = max(1, -(-made // group))
    # Containers are numbered by falling content; dealing them back and forth evens out the groups' tokens.
    turn = F.pmod(F.col("container_id"), F.lit(2 * groups))
    step = F.when(turn < groups, turn).otherwise(2 * groups - 1 - turn)
    out = placed.select("doc_id", "piece_no", "n_tokens", F.when(F.col("n_tokens") > 0, level).cast("int").alias("tier"), "window_id", container.cast("bigint").alias("container_id"))
    return out.withColumn("step_group", step.cast("bigint"))


def fill(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, unused_share) of an assignment."""
    own = assigned.where("container_id is not null")
    one = own.agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return one.select("containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"))


def step_balance(assigned: DataFrame) -> DataFrame:
    """(step_groups, fewest, most): step groups, and tokens of the lightest and heaviest."""
    per = assigned.where("step_group is not null").groupBy("step_group").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("step_groups"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def checked(assigned: DataFrame, capacity: int = CAPACITY, least_free: float = 0.01) -> DataFrame:
    """One row of what must hold: numbers of violations, and whether little is left unused and step groups differ by less than two containers.

    One container more than the tokens need is always granted. For tables of unique ids.
    """
    load = assigned.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    over = load.agg(F.count_if(F.col("n") > capacity).alias("over_capacity"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("made"))
    docs = assigned.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.countDistinct("piece_no").alias("p"))
    docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("k") != F.col("p")) | (F.col("k") != F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)))).alias("split_wrongly"))
    lost = assigned.agg(F.count_if((F.col("n_tokens") > 0) != F.col("container_id").isNotNull()).alias("unplaced"))
    one = over.crossJoin(docs).crossJoin(lost).crossJoin(step_balance(assigned))  # one row each
    tight = F.col("made") <= F.col("tokens") / (capacity * (1 - least_free)) + 1
    return one.select("documents", "over_capacity", "split_wrongly", "unplaced", tight.alias("little_unused"), F.coalesce(F.col("most") - F.col("fewest") < 2 * capacity, F.lit(True)).alias("steps_balanced"))
