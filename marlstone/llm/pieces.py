"""Problem 3: cutting oversized texts at natural boundaries.

Method: a recursive hierarchy of separators (section, paragraph, sentence,
word, character). A unit that fits stays whole; one that doesn't is split at
the next level. The units, whatever their level, are packed greedily to the
limit; every piece but the first begins with the end of the piece before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 100
LEVELS = ("section", "paragraph", "sentence", "word", "none")
#: Ends of units at each level, as patterns whose match end is where the next unit begins.
ENDS = (
    re.compile(r"\f\s*|\n(?=#{1,6} )|\n(?:[-=*_]{3,})[^\S\n]*\n"),
    re.compile(r"\n(?:[^\S\n]*\n)+|\r(?:[^\S\r\n]*\r)+"),
    re.compile(r"[.!?](?=\s|$)\s*|[。！？]\s*"),
    re.compile(r"\s+"),
)
_BLANK_LINES = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?=\r|\n)")


def spans(text: str, a: int, b: int, level: int) -> list[tuple[int, int]]:
    """Units of ``text[a:b]`` at a level; separators go with the unit before them."""
    cuts = [a]
    for m in ENDS[level].finditer(text, a, b):
        if cuts[-1] < m.end() < b:
            cuts.append(m.end())
    return list(zip(cuts, [*cuts[1:], b]))


def _trimmed(text: str, a: int, b: int) -> int:
    return len(text[a:b].strip())


def cut_level(text: str, limit: int = LIMIT) -> str:
    """The first of paragraph, sentence, word at which every trimmed unit fits the limit, else none."""
    left = [(0, len(text))]
    for level in (1, 2, 3):
        left = [u for a, b in left for u in spans(text, a, b, level) if _trimmed(text, *u) > limit]
        if not left:
            return LEVELS[level]
    return "none"


def _units(text: str, a: int, b: int, level: int, room: int) -> Iterator[tuple[int, int]]:
    """Units in order, each the largest that fits in ``room`` without the white space at its end."""
    if level == 4:
        yield from ((i, min(i + room, b)) for i in range(a, b, room))
        return
    for u in spans(text, a, b, level):
        if len(text[u[0] : u[1]].rstrip()) <= room:
            yield u
        else:
            yield from _units(text, *u, level + 1, room)


def overlap_start(text: str, low: int, end: int, overlap: int) -> int:
    """Where the repeated end begins: ``overlap`` characters back, moved forward to the start of a whole word.

    A run without any white space there is repeated by characters.
    """
    at = max(low, end - overlap)
    if low < at < end and not text[at - 1].isspace() and not text[at].isspace():
        m = re.compile(r"\s+").search(text, at, end)
        if m and m.end() < end:
            return m.end()
    return at


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of a text as (begin, begin of what is new, end) in characters.

    ``text[begin:end]`` is a piece, at most ``limit`` long; the new parts laid
    end to end are the whole text. Texts within the limit are one piece; the
    empty text has none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out: list[tuple[int, int, int]] = []
    begin = new = 0

    def close(end: int) -> None:
        nonlocal begin, new
        if end > new:
            out.append((begin, new, end))
            begin, new = overlap_start(text, new, end, overlap), end

    at = 0
    for a, b in _units(text, 0, len(text), 0, limit - overlap):
        if b - begin > limit and at > new:
            close(at)
        while b - begin > limit:  # only white space can be too much here
            close(min(b, begin + limit))
        at = b
    close(at)
    return out


def live_entries(queue: DataFrame, at_least: int | None = None) -> DataFrame:
    """(queue_id, text) of the latest entry for each namespace and key.

    Latest is the largest ``enqueued_at`` (null is earliest), then the largest
    ``queue_id``. Null namespaces and keys are keys of their own. Only narrow
    columns enter the aggregation; texts follow for the winners, and with
    ``at_least`` only texts longer than that leave the scan.
    """
    rows = queue.select("queue_id", "namespace", "doc_key", "enqueued_at")
    last = rows.groupBy("namespace", "doc_key").agg(F.max(F.struct("enqueued_at", "queue_id")).alias("m")).select(F.col("m.queue_id").alias("queue_id"))
    texts = queue.select("queue_id", "text").where(F.col("text").isNotNull())
    if at_least is not None:
        texts = texts.where(F.length("text") > at_least)
    return texts.join(last, "queue_id", "left_semi")


def pieces(queue: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(queue_id, cut_level, n_pieces, piece_no, n_new, piece) of live entries over the limit.

    ``piece_no`` counts from 0; the last ``n_new`` characters of a piece are
    new. Null and short texts give no rows. Extra columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, t in zip(pdf["queue_id"], pdf["text"]):
                got, how = cut(t, limit, overlap), cut_level(t, limit)
                rows += [(q, how, len(got), i, e - n, t[b:e]) for i, (b, n, e) in enumerate(got)]
            yield pd.DataFrame(rows, columns=["queue_id", "cut_level", "n_pieces", "piece_no", "n_new", "piece"])

    return live_entries(queue, limit).mapInPandas(run, "queue_id bigint, cut_level string, n_pieces int, piece_no int, n_new int, piece string")


def checked(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(texts, characters, over_limit, wrong_overlaps, inside_the_next): all characters are new once, and three numbers that must be 0."""
    w = W.partitionBy("queue_id").orderBy("piece_no")
    again = F.length("piece") - F.col("n_new")
    repeated = F.expr("left(piece, length(piece) - n_new)")
    p = pieces.withColumns({"before": F.lag("piece").over(w), "next": F.lead("piece").over(w), "again": again, "repeated": repeated})
    wrong = F.when(F.col("piece_no") == 0, F.col("again") != 0).otherwise((F.col("again") > overlap) | ~F.endswith("before", "repeated"))
    inside = F.coalesce(F.col("next").contains(F.col("piece")), F.lit(False))
    return p.agg(
        F.countDistinct("queue_id").alias("texts"), F.sum("n_new").alias("characters"), F.count_if(F.length("piece") > limit).alias("over_limit"), F.count_if(wrong).alias("wrong_overlaps"), F.count_if(inside).alias("inside_the_next")
    )
