"""Problem 9: languages of documents and of segments in other languages.

Method: language-bitmask n-gram filters. A bit-sliced Bloom filter holds, at each
of its places, one bit per language; the conjunction of the places of an n-gram
gives all languages that contain it. Per sentence the bits are counted for each
language, corrected for false positives, and the largest count decides.

The filter is fitted on a bounded sample of labelled documents (SAMPLE_DOCS for
each language). A wrong label does little harm: an n-gram belongs to a language
only if it is in a fair share of its documents, compared with the language where
it is most at home.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.runtime import spread

#: Usual codes and names of languages.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "ms": "ms msa may zsm malay melayu bahasa_melayu",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 zhongwen",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "id": "id ind indonesian bahasa_indonesia",
    "ja": "ja jpn japanese 日本語",
    "ko": "ko kor korean 한국어",
    "ru": "ru rus russian русский",
    "ar": "ar ara arabic العربية",
    "hi": "hi hin hindi हिन्दी",
    "ta": "ta tam tamil தமிழ்",
    "sv": "sv swe swedish svenska",
    "da": "da dan danish dansk",
    "no": "no nor nb nob nn nno norwegian norsk",
    "fi": "fi fin finnish suomi",
    "pl": "pl pol polish polski",
    "tr": "tr tur turkish türkçe",
    "vi": "vi vie vietnamese",
    "th": "th tha thai",
}
CODES = {name: code for code, names in NAMES.items() for name in names.split()}
SAMPLE_DOCS = 1500
LENGTHS = (2, 3, 4)  # of n-grams, in characters
HASHES = 3
PLACES = 1 << 21
AT_HOME, LEAST_SHARE = 0.25, 0.02  # share of a language's documents against the largest share, and in itself
SAME = 0.9  # part of a language's n-grams that are at home in a language of more documents too, above which it is that language under a wrong label
LEAST_WORDS, LEAST_HAN = 6, 15
ENDS = re.compile(r"[.!?](?=\s|$)|[。！？]|\n[^\S\n]*\n")
#: A line that is a field, such as ``Agency: ...`` or ``key=value; key=value``, is no part of a sentence.
FIELD = re.compile(r"^[^\S\n]*[^\W\d][\w/ -]{0,24}[^\S\n]*[:=：](?!//)[^\n]*$", re.M)
OTHER = re.compile(r"[\W\d_]+")
WORDS = re.compile(r"[^\W_]+")
HAN = re.compile(r"[㐀-鿿豈-﫿]")


def label_code(label: Column) -> Column:
    """Two-letter code a label names, in any usual code or name, with or without region; else null."""
    whole = F.regexp_replace(F.trim(F.lower(label)), r"\s+", "_")
    table = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    first = F.regexp_extract(whole, r"^([\p{L}\p{M}]+)(?:[-_(,. ].*)?$", 1)
    return F.coalesce(F.try_element_at(table, whole), F.try_element_at(table, first))


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of sentences without white space around them; blank lines and lines that are fields end one too."""
    out, a = [], 0
    lines = [x for m in FIELD.finditer(text) if not ENDS.search(m[0]) for x in m.span()]
    for b in sorted({m.end() for m in ENDS.finditer(text)} | set(lines) | {len(text)}):
        s = text[a:b]
        t = s.strip()
        if t:
            i = a + s.index(t[0])
            out.append((i, i + len(t)))
        a = b
    return out


def is_whole(sentence: str) -> bool:
    """At least six words, or 15 characters of Chinese; fields don't count."""
    if FIELD.fullmatch(sentence) and not ENDS.search(sentence):
        return False
    han = len(HAN.findall(sentence))
    return han >= LEAST_HAN if 2 * han > len(sentence.replace(" ", "")) * 0.6 else len(WORDS.findall(sentence)) >= LEAST_WORDS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all n-grams of letters in lower case, other runs being one space; none reaches over a text's end."""
    clean = [f" {OTHER.sub(' ', t.lower()).strip()} " for t in texts]
    size = np.array([len(c) for c in clean], np.int64)
    if not len(size):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chars = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(clean)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # characters to the end of the text
    hs, rs = [], []
    for n in LENGTHS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + chars[i : len(chars) - n + 1 + i] + np.uint64(1)
        ok = left[: len(h)] >= n
        hs.append(_mix(h[ok]))
        rs.append(row[: len(h)][ok])
    return np.concatenate(hs) if hs else np.zeros(0, np.uint64), np.concatenate(rs) if rs else np.zeros(0, np.int64)


class Filter:
    """A Bloom filter with one slice for each language: ``bits[place]`` has bit L if language L set it."""

    def __init__(self, langs: list[str], hashes: np.ndarray, masks: np.ndarray) -> None:
        self.langs = langs
        self.bits = np.zeros(PLACES, np.uint64)
        for p in self._places(hashes):
            np.bitwise_or.at(self.bits, p, masks)
        full = np.array([np.mean(self.bits >> np.uint64(i) & np.uint64(1)) for i in range(len(langs))])
        self.false = full**HASHES

    @staticmethod
    def _places(h: np.ndarray) -> list[np.ndarray]:
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        return [((a + np.uint64(i) * b) % np.uint64(PLACES)).astype(np.int64) for i in range(HASHES)]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the n-grams found, less the false positives to be expected; and all n-grams of the text."""
        h, row = ngrams(texts)
        m = np.full(len(h), ~np.uint64(0))
        for p in self._places(h):
            m &= self.bits[p]
        n = np.bincount(row, minlength=len(texts)).astype(float)
        got = np.stack([np.bincount(row, weights=(m >> np.uint64(i) & np.uint64(1)).astype(float), minlength=len(texts)) for i in range(len(self.langs))], 1) if self.langs else np.zeros((len(texts), 0))
        return np.maximum(got - n[:, None] * self.false, 0) / (1 - np.minimum(self.false, 0.99)), n

    def decide(self, texts: list[str]) -> tuple[list[str | None], np.ndarray]:
        """Language and confidence of each text: the lead over the second language, weighed by the part of n-grams found."""
        c, n = self.counts(texts)
        if not self.langs:
            return [None] * len(texts), np.zeros(len(texts))
        o = np.sort(c, axis=1)
        best, second = o[:, -1], o[:, -2] if c.shape[1] > 1 else np.zeros(len(c))
        which = c.argmax(1)
        lead = np.where(best > 0, (best - second) / np.maximum(best, 1e-9), 0)
        conf = np.round(np.sqrt(lead * best / np.maximum(n, 1)), 4)
        return [self.langs[w] if b > 0 else None for w, b in zip(which, best)], conf


def fit(docs: DataFrame) -> Filter:
    """The filter of the languages that labels name, from at most SAMPLE_DOCS documents of each, whole texts."""
    rows = docs.select("doc_id", "text", label_code(F.col("lang")).alias("code")).where("code is not null and text is not null and doc_id is not null")
    w = W.partitionBy("code").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id")
    ids = rows.select("doc_id", "code").withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE_DOCS).select("doc_id", "code")
    few = rows.select("doc_id", "text").join(ids, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[np.ndarray]] = {}
        for pdf in batches:
            for code, t in zip(pdf["code"], pdf["text"]):
                sums.setdefault(code, []).append(np.unique(ngrams([t])[0]))
        for code, parts in sums.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"code": code, "h": h.view(np.int64), "n": n})

    seen = few.mapInPandas(run, "code string, h bigint, n bigint").groupBy("code", "h").agg(F.sum("n").alias("n"))
    sizes = {r[0]: r[1] for r in ids.groupBy("code").count().collect()}
    langs = sorted(sizes)
    if len(langs) > 64:
        raise ValueError(f"{len(langs)} languages don't fit in a filter of 64 slices")
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(1.0 / v))]) if sizes else F.lit(None)
    if not langs:
        return Filter([], np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    bit = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))])
    part = seen.where("n > 1").select("h", "code", (F.col("n") * share[F.col("code")]).alias("s"))
    kept = part.groupBy("h").agg(F.max("s").alias("top"), F.collect_list(F.struct("code", "s")).alias("all"))
    home = F.filter("all", lambda e: (e["s"] >= AT_HOME * F.col("top")) & (e["s"] >= LEAST_SHARE))
    mask = F.aggregate(home, F.lit(0).cast("bigint"), lambda m, e: m.bitwiseOR(F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), bit[e["code"]]).cast("bigint")))
    got = kept.select("h", mask.alias("mask")).where("mask <> 0").toArrow()  # bounded by the sample
    hashes, masks = got.column("h").to_numpy().view(np.uint64), got.column("mask").to_numpy().view(np.uint64)
    bits = (masks[:, None] >> np.arange(len(langs), dtype=np.uint64)) & np.uint64(1)
    shared = bits.T.astype(np.float32) @ bits.astype(np.float32)
    part = shared / np.maximum(np.diag(shared), 1)[:, None]
    more = np.array([[sizes[m] > sizes[k] for m in langs] for k in langs])
    keep = ~((part >= SAME) & more).any(1)  # else the label is wrong on all its documents, they are in the other language
    masks = (bits[:, keep] << np.arange(keep.sum(), dtype=np.uint64)).sum(1, dtype=np.uint64)
    return Filter([k for k, ok in zip(langs, keep) if ok], hashes[masks > 0], masks[masks > 0])


def segments(docs: DataFrame, model: Filter | None = None) -> DataFrame:
    """(doc_id, begin, end, seg_lang, confidence, whole): neighbouring sentences of one language as one segment.

    ``whole`` tells whether a sentence in it has at least six words (Chinese: 15
    characters). Sentences that are too short to tell, or in which nothing is
    known, join the segment before them (else the one after). Blank and null
    texts have no segments; whole texts are read.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PLACES words, fixed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                cuts = [sentences(t) for t in part["text"]]
                flat = [t[a:b] for t, c in zip(part["text"], cuts) for a, b in c]
                langs, conf = model.decide(flat)
                out, k = [], 0
                for doc, t, c in zip(part["doc_id"], part["text"], cuts):
                    segs: list[list] = []
                    for a, b in c:
                        whole = is_whole(t[a:b])
                        lang, cf = langs[k], conf[k]
                        k += 1
                        if segs and (lang == segs[-1][2] or not whole or lang is None or not segs[-1][4] and segs[-1][2] is None):
                            s = segs[-1]
                            if s[2] is None:
                                s[2] = lang
                            s[1], s[4] = b, s[4] or (whole and lang is not None and lang == s[2])
                            if whole and lang == s[2]:
                                s[3] += cf * (b - a)
                                s[5] += b - a
                        else:
                            if segs and not segs[-1][4]:  # what stood before was too short to tell
                                a = segs.pop()[0]
                            segs.append([a, b, lang, cf * (b - a), whole and lang is not None, b - a])
                    out += [(doc, a, b, lang, round(x / max(n, 1), 4), w) for a, b, lang, x, w, n in segs]
                yield pd.DataFrame(out, columns=["doc_id", "begin", "end", "seg_lang", "confidence", "whole"])

    rows = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    return spread(rows).mapInPandas(run, "doc_id bigint, begin int, end int, seg_lang string, confidence double, whole boolean")


def documents(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, confidence, n_langs): the language with most text, its part of the text times its confidence, and how many have a whole sentence."""
    seg = (segments(docs) if found is None else found).where("seg_lang is not null")
    per = seg.groupBy("doc_id", "seg_lang").agg(F.sum(F.col("end") - F.col("begin")).alias("n"), F.sum((F.col("end") - F.col("begin")) * F.col("confidence")).alias("x"), F.max("whole").alias("w"))
    one = per.groupBy("doc_id").agg(F.max(F.struct("n", "x", "seg_lang")).alias("m"), F.sum("n").alias("all"), F.count_if("w").alias("n_langs"))
    return one.select("doc_id", F.col("m.seg_lang").alias("lang"), F.round(F.col("m.x") / F.col("all"), 4).alias("confidence"), "n_langs")


def mislabelled(docs: DataFrame) -> DataFrame:
    """(doc_id, seg_lang): for documents with a missing or wrong label or several languages, each language with a whole sentence.

    A label is wrong if it names a language in which the text has no whole
    sentence. Texts without any whole sentence give no rows.
    """
    seg = segments(docs).where("whole and seg_lang is not null").select("doc_id", "seg_lang").distinct()
    label = docs.select("doc_id", label_code(F.col("lang")).alias("code"))
    both = seg.join(label, "doc_id")
    per = both.groupBy("doc_id").agg(F.collect_set("seg_lang").alias("langs"), F.max("code").alias("code"))
    bad = per.where(F.col("code").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("code")))
    return bad.select("doc_id", F.explode("langs").alias("seg_lang"))
