"""Problem 4: variant spellings of names typed by people.

Method: a trie join. The words of all spellings are sharded into tries (two words
one edit apart share a half), a Levenshtein automaton walks each trie and lists
the words within one edit (insertion, deletion, substitution, swap of
neighbours); abbreviations of common words are listed beside them. Endings that
only name a seat ("... head office") are learned from the names. A name whose words, in any order, can be replaced
by such words so that another name results is linked to that name.

Bounds, alike at every size: a word differs by one edit, a name in at most three
words of which at most two by an edit; words under four letters have no edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import Table, scratch, spread

#: English function words, which carry no identity.
FILLERS = ("the", "of", "for", "and", "in", "on", "at", "a")
#: A word is common if it makes up at least this part of all words of all rows; so there are at most COMMON_SHARE.
COMMON_SHARE = 20_000
MAX_CHANGED, MAX_EDITED = 3, 2
#: An edit, a likely abbreviation, and one that keeps most letters and some vowels.
EDIT_COST, SHORT_COST, LOOSE_COST = 3, 1, 5
#: An acronym of a whole name is linked if its most frequent reading has so many times the rows of the next; a name without a seat has so many times those with it.
CLEAR = 5
SHARD_WORDS = 4096  # words of a trie and words sought in it at once; larger shards are split in both
ROOT_NAMES = 1000  # spellings of one organisation in a part; each part meets all of its spellings
PRODUCT = 20_000  # rewritings of a name that are listed in one step; names with more are split by the options of a word


def spelling(c: Column) -> Column:
    """Lower case, each run of other than letters and digits made one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def spellings(df: DataFrame, column: str) -> DataFrame:
    """(name, n): distinct spellings with their rows; null and empty ones are left out."""
    raw = df.select(F.col(column).alias("raw")).where("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return raw.select(spelling(F.col("raw")).alias("name"), "n").where("name <> ''").groupBy("name").agg(F.sum("n").alias("n"))


def words_of(name: Column) -> Column:
    """Words that carry identity, in order; a name of fillers alone keeps them."""
    parts = F.filter(F.split(name, " "), lambda w: ~w.isin(*FILLERS))
    return F.when(F.size(parts) > 0, parts).otherwise(F.split(name, " "))


def without_seats(names: DataFrame) -> DataFrame:
    """(name, n, core): names less a learned ending of one or two words; at least two words stay.

    An ending names a seat if at least half of the names that have it are far
    less frequent (CLEAR) than the same name without it.
    """
    w = F.split("name", " ")
    ends = F.filter(F.array(*[F.when(F.size("w") >= k + 2, F.struct(F.lit(k).alias("k"), F.array_join(F.slice("w", F.size("w") - k + 1, k), " ").alias("end"), F.array_join(F.slice("w", 1, F.size("w") - k), " ").alias("core"))) for k in (1, 2)]), lambda e: e.isNotNull())
    every = names.select("name", "n", w.alias("w")).select("name", "n", F.explode(ends).alias("e")).select("name", "n", "e.*")
    known = names.select(F.col("name").alias("core"), F.col("n").alias("m"))
    per = every.join(known, "core", "left").groupBy("end").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("m") >= CLEAR * F.col("n")).alias("some"))
    seats = Table(per.where((F.col("some") > 0) & (2 * F.col("some") >= F.col("all"))).select("end"), "seats").df
    best = every.join(seats, "end").groupBy("name").agg(F.max_by("core", "k").alias("core"))
    return names.join(best, "name", "left").select("name", "n", F.coalesce("core", "name").alias("core"))


class Trie:
    """Words in nested dictionaries; the empty string marks the end of a word."""

    def __init__(self, words) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = True

    @staticmethod
    def _rest(node: dict, w: str, i: int) -> bool:
        for ch in w[i:]:
            node = node.get(ch)
            if node is None:
                return False
        return "" in node

    def near(self, w: str) -> set[str]:
        """Words exactly one edit or swap away: the automaton's states are (node, place in w, edit used)."""
        out: set[str] = set()
        node: dict | None = self.root
        n = len(w)
        for i in range(n + 1):
            head = w[:i]
            for ch, child in node.items():
                if ch == "":
                    continue
                if self._rest(child, w, i):  # a letter more
                    out.add(head + ch + w[i:])
                if i < n and ch != w[i] and self._rest(child, w, i + 1):  # another letter
                    out.add(head + ch + w[i + 1 :])
            if i < n:
                if self._rest(node, w, i + 1):  # a letter less
                    out.add(head + w[i + 1 :])
                if i + 1 < n and w[i] != w[i + 1]:
                    child = node.get(w[i + 1])
                    child = child.get(w[i]) if child else None
                    if child is not None and self._rest(child, w, i + 2):
                        out.add(head + w[i + 1] + w[i] + w[i + 2 :])
                node = node.get(w[i])
                if node is None:
                    break
        out.discard(w)
        return out


def is_short_for(short: str, full: str) -> bool:
    """Same first letter, letters in order, at most three quarters as long."""
    if not (2 <= len(short) and 4 * len(short) <= 3 * len(full) and short[0] == full[0]):
        return False
    it = iter(full)
    return all(ch in it for ch in short)


def short_cost(short: str, full: str) -> int:
    likely = full.startswith(short) or 2 * len(short) <= len(full) + 2 or not set(short[1:]) & set("aeiou")
    return SHORT_COST if likely else LOOSE_COST


def shards_of(n: Column, word: Column) -> Column:
    """Shards of a word of n letters, as array of text.

    Let m be the length of the shorter of two words one edit apart. Either the
    first m // 2 letters of both agree or the last m - m // 2, or two
    neighbours in the middle are swapped and both have the same letters.
    """
    out = [F.concat(F.lit("="), F.array_join(F.array_sort(F.split(word, "")), ""))]
    for m in (n, n - 1):  # the word may be the shorter one, or the longer
        half = F.floor(m / 2).cast("int")
        keys = [F.concat(F.lit("<"), m, F.lit(":"), F.left(word, half)), F.concat(F.lit(">"), m, F.lit(":"), F.right(word, m - half))]
        out += [F.when(m >= 4, k) for k in keys]
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def edits(words: DataFrame) -> DataFrame:
    """(word, to): words one edit apart, ``to`` being the one with more rows (ties: the larger by code point)."""
    rows = words.where(F.length("word") >= 4).select("word", "w", F.explode(shards_of(F.length("word"), F.col("word"))).alias("shard"))
    size = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("shard", F.ceil(F.col("k") / SHARD_WORDS).cast("int").alias("c"))
    rows = rows.join(size, "shard").withColumn("mine", F.pmod(F.xxhash64("word"), F.col("c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    base = rows.select("shard", F.col("mine").alias("i"), other.alias("j"), "word", "w", F.lit(True).alias("held"))
    asked = rows.select("shard", other.alias("i"), F.col("mine").alias("j"), "word", "w", F.lit(False).alias("held")).where("i <> j")  # a part's own words are held and asked for
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sorted_ = base.unionByName(asked).repartition(tasks, "shard", "i", "j").sortWithinPartitions("shard", "i", "j")

    def walk(key: tuple, held: dict[str, int], sought: dict[str, int]) -> list[tuple[str, str]]:
        shard, i, j = key
        back = shard.startswith(">")
        trie = Trie(x[::-1] if back else x for x in held)
        out = []
        for x, n in (held if i == j else sought).items():
            for y in trie.near(x[::-1] if back else x):
                y = y[::-1] if back else y
                if (held[y], y) > (n, x):
                    out.append((x, y))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, sought, out = None, {}, {}, []
        for pdf in batches:
            for shard, i, j, x, n, h in zip(pdf["shard"], pdf["i"], pdf["j"], pdf["word"], pdf["w"], pdf["held"]):
                if (shard, i, j) != now:
                    if now is not None:
                        out += walk(now, held, sought)
                    now, held, sought = (shard, i, j), {}, {}
                (held if h else sought)[x] = n
            yield pd.DataFrame(out, columns=["word", "to"])
            out = []
        if now is not None:
            yield pd.DataFrame(walk(now, held, sought), columns=["word", "to"])

    return sorted_.mapInPandas(run, "word string, to string").distinct()


def shortened(words: DataFrame, common: list[tuple[str, int]]) -> DataFrame:
    """(word, to, cost): common words that a word may abbreviate. ``common`` is bounded by COMMON_SHARE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, list[tuple[str, int]]] = {}
        for full, n in common:
            by.setdefault(full[0], []).append((full, n))
        for pdf in batches:
            out = [(x, full, short_cost(x, full)) for x, n in zip(pdf["word"], pdf["w"]) for full, m in by.get(x[0], ()) if m > n and is_short_for(x, full)]
            yield pd.DataFrame(out, columns=["word", "to", "cost"])

    return words.where("length(word) between 2 and 9").mapInPandas(run, "word string, to string, cost int")


def rewritten(sig: str, words: list[str], options: dict[str, list[tuple[str, int]]], must: str | None = None) -> dict[str, int]:
    """Sorted word lists that result from changing up to three words, with the least cost of each; with ``must`` that word is among them."""
    places = [i for i, w in enumerate(words) if w in options]
    out: dict[str, int] = {}
    for k in range(1, min(MAX_CHANGED, len(places)) + 1):
        for which in combinations(places, k):
            if must is not None and all(words[i] != must for i in which):
                continue
            for to in product(*(options[words[i]] for i in which)):
                if sum(c in (EDIT_COST, EDIT_COST + SHORT_COST, EDIT_COST + LOOSE_COST) for _, c in to) > MAX_EDITED:
                    continue
                new = list(words)
                for i, (t, _) in zip(which, to):
                    new[i] = t
                key, cost = " ".join(sorted(new)), sum(c for _, c in to)
                if key != sig and cost < out.get(key, 1 << 30):
                    out[key] = cost
    return out


def _targets(sigs: DataFrame, options: DataFrame) -> DataFrame:
    """(sig, target, cost) for every rewriting of every sig that has a word with options.

    A sig with more than PRODUCT rewritings is several rows, each with a part
    of the options of its word with most of them, so no task lists them all.
    """
    at = sigs.select("sig", "words", F.explode(F.array_distinct("words")).alias("word"))
    per = at.join(options, "word").groupBy("sig").agg(F.first("words").alias("words"), F.sort_array(F.collect_list(F.struct(F.size("to").alias("n"), "word", "to")), False).alias("o"))
    most = F.aggregate(F.slice("o", 1, MAX_CHANGED), F.lit(1.0), lambda p, x: p * (x["n"] + 1))
    parts = F.least(F.ceil(most / PRODUCT), F.col("o")[0]["n"].cast("bigint")).cast("int")
    cut = per.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    step = F.ceil(F.col("o")[0]["n"] / F.col("parts")).cast("int")
    first = F.col("o")[0]
    mine = F.concat(F.array(F.struct(first["n"].alias("n"), first["word"].alias("word"), F.slice(first["to"], F.col("part") * step + 1, step).alias("to"))), F.slice("o", 2, F.greatest(F.size("o") - 1, F.lit(0))))
    rows = spread(cut.select("sig", "words", "part", mine.alias("o")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sig, words, part, o in zip(pdf["sig"], pdf["words"], pdf["part"], pdf["o"]):
                opt = {x["word"]: [(y["to"], int(y["cost"])) for y in x["to"]] for x in o}
                out += [(sig, t, c) for t, c in rewritten(sig, list(words), opt, o[0]["word"] if part else None).items()]
                if len(out) >= PRODUCT:
                    yield pd.DataFrame(out, columns=["sig", "target", "cost"])
                    out = []
            yield pd.DataFrame(out, columns=["sig", "target", "cost"])

    return rows.mapInPandas(run, "sig string, target string, cost int").groupBy("sig", "target").agg(F.min("cost").alias("cost"))


def _acronyms(free: DataFrame) -> DataFrame:
    """(sig, parent) of names written as initials: of the whole name, or of all but a first or last word that is kept."""
    full = free.where("size(words) >= 3")
    ini = lambda c: F.array_join(F.transform(c, lambda w: F.substring(w, 1, 1)), "")
    n = F.size("words")
    keys = F.array(
        F.concat(F.lit("|"), ini(F.col("words"))),
        F.concat(F.col("words")[0], F.lit("|"), ini(F.slice("words", 2, n - 1))),
        F.concat(F.element_at("words", -1), F.lit("|"), ini(F.slice("words", 1, n - 1))),
    )
    known = full.select(F.col("sig").alias("parent"), "n", F.explode(keys).alias("key"))
    w = F.col("words")
    asked = free.where("size(words) <= 2").select(
        "sig",
        F.explode(F.when(F.size(w) == 1, F.array(F.concat(F.lit("|"), w[0]))).otherwise(F.array(F.concat(w[0], F.lit("|"), w[1]), F.concat(w[1], F.lit("|"), w[0])))).alias("key"),
    )
    met = asked.join(known, "key").where("sig <> parent")
    best = met.groupBy("sig", "key").agg(F.max(F.struct("n", "parent")).alias("b"))
    others = met.join(best, ["sig", "key"]).where("parent <> b.parent").groupBy("sig", "key").agg(F.max("n").alias("next"))
    clear = best.join(others, ["sig", "key"], "left").where(F.col("b.n") >= CLEAR * F.coalesce("next", F.lit(0)))
    return clear.groupBy("sig").agg(F.max("b").alias("b")).select("sig", F.col("b.parent").alias("parent"))


def _left_out(sigs: DataFrame, free: DataFrame) -> DataFrame:
    """(sig, parent) of names that lack one word of a more frequent name (the most frequent such)."""
    without = F.expr("transform(sequence(0, size(w) - 1), i -> array_join(filter(w, (x, j) -> j != i), ' '))")
    longer = sigs.where("size(words) >= 3").select(F.col("sig").alias("parent"), F.col("n").alias("m"), F.split("sig", " ").alias("w"))
    known = longer.select("parent", "m", F.explode(F.array_distinct(without)).alias("sig"))
    met = free.where("size(words) >= 2").select("sig", "n").join(known, "sig").where("m > n")
    return met.groupBy("sig").agg(F.max(F.struct("m", "parent")).alias("b")).select("sig", F.col("b.parent").alias("parent"))


def links(names: DataFrame) -> DataFrame:
    """(name, root): every spelling with the word list of the organisation it means.

    Spellings with the same words in another order, or with fillers and learned
    endings more or less, meet at once. Each other word list has at most one parent:
    the existing list that costs least to reach (then the one with most rows),
    else the reading of its initials, else a more frequent list of which it
    lacks one word, else a list that no one wrote but that at
    least two lists lead to. Words only change towards more frequent ones, so
    parents form a forest; its roots are found by pointer doubling over written
    tables.
    """
    spark = names.sparkSession
    w = words_of(F.col("core"))
    named = Table(without_seats(Table(names, "spellings").df).select("name", "n", w.alias("words"), F.array_join(F.array_sort(w), " ").alias("sig")), "names")
    sigs = Table(named.df.groupBy("sig").agg(F.sum("n").alias("n"), F.max(F.struct("n", "words")).alias("m")).select("sig", "n", F.col("m.words").alias("words")), "sigs").df
    words = Table(sigs.select(F.explode("words").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("w")), "words").df
    total = words.agg(F.sum("w")).first()[0] or 0
    common = [(r[0], r[1]) for r in words.where(F.length("word") >= 4).where(F.col("w") * COMMON_SHARE >= total).select("word", "w").collect()]
    typo = Table(edits(words), "edits").df
    short = Table(shortened(words, common), "short").df
    both = typo.select("word", F.col("to").alias("mid")).join(short.select(F.col("word").alias("mid"), "to", "cost"), "mid").select("word", "to", "cost")
    one = (
        typo.select("word", "to", F.lit(EDIT_COST).alias("cost"))
        .unionByName(short)
        .unionByName(both.select("word", "to", (F.col("cost") + EDIT_COST).alias("cost")))
    )
    best = one.groupBy("word", "to").agg(F.min("cost").alias("cost"))
    options = best.groupBy("word").agg(F.collect_list(F.struct("to", "cost")).alias("to"))
    targets = Table(_targets(sigs, options), "targets").df
    existing = targets.join(sigs.select(F.col("sig").alias("target"), "n"), "target")
    parent = existing.groupBy("sig").agg(F.min(F.struct("cost", (-F.col("n")).alias("m"), "target")).alias("b")).select("sig", F.col("b.target").alias("parent"))
    parent = Table(parent, "parent").df
    free = sigs.join(parent, "sig", "left_anti")
    acr = Table(_acronyms(free), "acr").df
    parent = parent.unionByName(acr)
    parent = Table(parent.unionByName(_left_out(sigs, free.join(acr, "sig", "left_anti"))), "parent").df
    lonely = targets.join(parent, "sig", "left_anti")
    meant = lonely.groupBy("target").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    imagined = lonely.join(meant, "target").groupBy("sig").agg(F.min(F.struct("cost", (-F.col("k")).alias("k"), "target")).alias("b")).select("sig", F.col("b.target").alias("parent"))
    up = Table(parent.unionByName(imagined), "up")
    while True:
        over = up.df.select(F.col("sig").alias("parent"), F.col("parent").alias("root"))
        nxt = Table(up.df.join(over, "parent", "left").select("sig", F.coalesce("root", "parent").alias("parent"), F.col("root").isNotNull().alias("moved")), "up")
        moved = nxt.df.where("moved").limit(1).count()
        up.drop()
        up = Table(nxt.df.select("sig", "parent"), "up") if moved else nxt
        if not moved:
            break
    roots = up.df.select("sig", F.col("parent").alias("root"))
    return named.df.select("name", "sig").join(roots, "sig", "left").select("name", F.coalesce("root", "sig").alias("root"))


def _links(df: DataFrame, column: str) -> DataFrame:
    with scratch():
        return Table(links(spellings(df, column)), "links", keep=True).df


def linked(df: DataFrame, column: str) -> DataFrame:
    """(name, root, n_links): one row per spelling with its class and how many other spellings it has."""
    got = _links(df, column)
    size = got.groupBy("root").agg((F.count(F.lit(1)) - 1).cast("bigint").alias("n_links"))
    return got.join(size, "root").select("name", "root", "n_links")


def pairs(df: DataFrame, column: str) -> DataFrame:
    """(name_a, name_b): all pairs of different spellings of one organisation, name_a < name_b by code point.

    Nulls and names without letter or digit take no part; repeated rows count
    once; an empty table gives no pairs.
    """
    got = _links(df, column)
    size = got.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / ROOT_NAMES).cast("int").alias("c")).where("c > 1")  # roots with many spellings meet part by part
    got = got.join(size, "root", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    a = got.select("root", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), F.col("c")).cast("int").alias("part"))
    b = got.select("root", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("part"))
    return a.join(b, ["root", "part"]).where("name_a < name_b").select("name_a", "name_b")
