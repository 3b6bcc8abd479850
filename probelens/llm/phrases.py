"""Phrase collocations by contiguous pattern growth (after PrefixSpan, Pei et al., 2001), scored by their weakest cut.

Texts are cut into pieces at punctuation and into words. Two passes over the texts:

1. Words are counted for each language. Each pack of texts also names the words and the pairs that are more than one in
   ``SHARE`` of it; what passes one in ``SHARE`` of all, at most ``SHARE`` of each, is *hot*.
2. Every occurrence of a word is a pointer: the projected database of a prefix holds what follows its occurrences, here
   up to ``longest`` - 1 words. Packs merge equal pointers with their count and deal them out by prefix, many prefixes to
   a bucket: by the first word; where that is hot, by the first two; where these are hot, by three. So the buckets' number
   grows with the words and no prefix fills one. In a bucket, ``_grow`` extends each prefix to the right, depth first,
   for as long as its occurrences reach ``least``.

A hot prefix is counted in several buckets, which are added up; every other phrase lies in one bucket whole.
What is left are phrases and counts: scores, drops and ranks are joins of these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelens.llm.common import written

SHARE = 2048
#: words that a task looks at together
HELD = 1_000_000
#: pointers a bucket is made for
BUCKET = 1_500_000
#: pieces end at . , ; : ! ? and at line breaks; a tab is a space
_CUT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_TOKENS = re.compile(rb"[^ \n]+|\n")


def _packs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, distinct words, places) for some hundred thousand words of a language; places number the words, -1 ends a piece."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for pdf in batches:
        for lang, raw in zip(pdf["lang"], pdf["raw"]):
            if raw:
                own = held.setdefault(lang, [])
                before = len(own)
                own += _TOKENS.findall(raw.translate(_CUT))
                own.append(b"\n")
                size += len(own) - before
                if size > HELD:
                    yield from map(_coded, held.items())
                    held, size = {}, 0
    yield from map(_coded, held.items())


def _coded(item: tuple[str, list[bytes]]) -> tuple[str, list[bytes], np.ndarray]:
    lang, tokens = item
    code, names = pd.factorize(np.array([b"\n", *tokens], dtype=object))
    return lang, list(names[1:]), code[1:].astype(np.int64) - 1


def _pairs(at: np.ndarray, n: int) -> np.ndarray:
    """Number of each place's word and the next, -1 where there is none."""
    after = np.append(at[1:], -1)
    return np.where((at >= 0) & (after >= 0), at * n + after, -1)


def _most(numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(numbers[numbers >= 0], return_counts=True)
    return found[n > least], n[n > least]


def word_counts(rows: DataFrame) -> DataFrame:
    """rows(lang, raw) -> (lang, k, phrase, n): counts of words (k 1), and of the pairs (k 2) that many packs hold often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, names, at in _packs(batches):
            n = np.bincount(at[at >= 0], minlength=len(names))
            yield pd.DataFrame({"lang": lang, "k": 1, "phrase": names, "n": n})
            pair, times = _most(_pairs(at, len(names)), len(at) // SHARE)
            if len(pair):
                yield pd.DataFrame({"lang": lang, "k": 2, "phrase": [names[p // len(names)] + b" " + names[p % len(names)] for p in pair.tolist()], "n": times})

    found = rows.mapInPandas(run, "lang string, k int, phrase binary, n long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def _deal(lang: str, names: list[bytes], at: np.ndarray, longest: int, hot: tuple[set, set], buckets: int) -> Iterator[tuple]:
    """Rows (bucket, lang, words, pointers) of a pack: distinct pointers with their counts, dealt out by prefix."""
    n, k = len(names), longest
    follow = [at]
    for _ in range(1, k):
        now = np.append(follow[-1][1:], -1)
        follow.append(np.where(follow[-1] >= 0, now, -1))  # nothing follows the end of a piece
    rows = np.stack(follow)[:, at >= 0]
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    rows, times = rows[:, first], np.diff(np.append(first, rows.shape[1]))
    digest = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
    mix = lambda a, b: (a ^ b) * np.uint64(0x9E3779B97F4A7C15) ^ (a >> np.uint64(29))
    start = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    home = mix(np.full(rows.shape[1], start), digest[rows[0]])
    words = {x: i for i, x in enumerate(names)}
    often = np.array([words[w] for (x, w) in hot[0] if x == lang and w in words], np.int64)
    deep = np.isin(rows[0], often)
    for d in range(1, k):
        told = np.where(rows[d] >= 0, digest[rows[d]], np.uint64(d))
        home = np.where(deep, mix(home, told), home)
        if d == 1:
            split = (x.split(b" ") for (y, x) in hot[1] if y == lang)
            pairs = np.array([words[a] * n + words[b] for a, b in split if a in words and b in words], np.int64)
            deep = deep & np.isin(np.where(rows[1] >= 0, rows[0] * n + rows[1], -1), pairs)
        elif d == 2:
            break
    home = (home >> np.uint64(20)) % np.uint64(buckets)
    by = np.argsort(home, kind="stable")
    cut = np.concatenate(([0], np.flatnonzero(np.diff(home[by])) + 1, [len(by)]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if a == b:
            continue
        own = by[a:b]
        used, local = np.unique(rows[:, own], return_inverse=True)
        local = local.reshape(k, -1).astype("<i4") - int(used[0] < 0)  # -1: nothing follows
        listed = b"\n".join([names[i] for i in used[used >= 0].tolist()])
        packed = np.concatenate([local.ravel(), times[own].astype("<i4")]).tobytes()
        yield int(home[own[0]]), lang, len(listed), len(packed), pa.compress(listed, "zstd", asbytes=True), pa.compress(packed, "zstd", asbytes=True)


def _grow(rows: np.ndarray, times: np.ndarray, least: int, partial: set, prefix: tuple = ()) -> Iterator[tuple[tuple, int]]:
    """(phrase, count) of all phrases of two words or more that begin with prefix and reach least, or that are partial.

    rows: sorted pointers of the prefix, their next word first; times: how often each occurs.
    """
    if not len(rows):
        return
    first = np.concatenate(([0], np.flatnonzero(np.diff(rows[0])) + 1))
    total = np.add.reduceat(times, first)
    last = np.append(first[1:], len(times))
    depth = len(prefix)
    wanted = [p[depth] for p in partial if len(p) > depth and p[:depth] == prefix]
    go = (total >= least) | np.isin(rows[0, first], wanted) if wanted else total >= least
    for i in np.flatnonzero(go & (rows[0, first] >= 0)).tolist():
        a, b = int(first[i]), int(last[i])
        phrase = (*prefix, int(rows[0, a]))
        if depth:
            yield phrase, int(total[i])
        if len(rows) > 1:
            yield from _grow(rows[1:, a:b], times[a:b], least, partial, phrase)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """docs(lang, text) -> (words, phrases), both (lang, phrase, n): all words with their count, and all contiguous phrases
    of 2 to longest words within pieces that occur least times; overlapping occurrences count.

    A null language is ``und``; null and empty texts have no words. Further columns don't matter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("raw"))
    counted = written(word_counts(rows), "words")
    words = counted.where("k = 1").select("lang", "phrase", "n")
    total = words.agg(F.sum("n")).first()[0] or 0  # one number
    limit = max(total // SHARE, BUCKET // 4)  # at most SHARE words, or pairs, are above it
    hot = (set(), set())
    for r in counted.where(F.col("n") > limit).select("lang", "k", "phrase").collect():
        hot[r["k"] - 1].add((r["lang"], bytes(r["phrase"])))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET), 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, names, at in _packs(batches):
            out = pd.DataFrame(list(_deal(own, names, at, longest, hot, buckets)), columns=["bucket", "lang", "n_words", "n_rows", "words", "rows"])
            for a in range(0, len(out), 256):
                yield out.iloc[a : a + 256]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, part in pdf.groupby("lang", sort=False):
            number: dict[bytes, int] = {}
            columns, counts = [], []
            for nw, nr, listed, packed in zip(part["n_words"], part["n_rows"], part["words"], part["rows"]):
                local = pa.decompress(listed, nw, "zstd", asbytes=True).split(b"\n")
                known = np.array([*[number.setdefault(x, len(number)) for x in local], -1], np.int64)
                got = np.frombuffer(pa.decompress(packed, nr, "zstd", asbytes=True), "<i4").reshape(longest + 1, -1)
                columns.append(known[got[:-1]])
                counts.append(got[-1])
            at, times = np.concatenate(columns, axis=1), np.concatenate(counts).astype(np.int64)
            order = np.lexsort(at[::-1])
            pairs = {tuple(number.get(w, -1) for w in x.split(b" ")) for (y, x) in hot[1] if y == own}
            pairs = {p for p in pairs if min(p) >= 0}
            names = list(number)
            out += [(own, b" ".join([names[i] for i in p]), n) for p, n in _grow(at[:, order], times[order], least, pairs)]
        return pd.DataFrame(out, columns=["lang", "phrase", "n"])

    dealt = rows.mapInPandas(deal, "bucket int, lang string, n_words int, n_rows int, words binary, rows binary")
    found = dealt.groupBy("bucket").applyInPandas(grow, "lang string, phrase binary, n long")
    return words, written(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")


def _part(first: int, n: int):
    return F.array_join(F.slice("_w", first, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, most: int = 2000, scale: int = 1_000_000, share: int = 50) -> DataFrame:
    """docs(lang, text) -> (lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases by score.

    A phrase of a occurrences that is cut into parts of l and r occurrences scores floor(scale a^2 / (l r)); its lowest cut
    counts, of equal ones the first. A phrase goes where a longer candidate around it has share % of its occurrences or
    more. Order: score and a descending, then the phrase by its bytes. n: all words of the language. Products are decimals
    of 38 digits, exact for counts below 10^15. Empty tables give no rows; repeated rows count each time.
    """
    words, found = phrases(docs, text, lang, longest, least)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    cand = found.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a")).withColumn("_w", F.split("phrase", " "))
    known = words.where(F.col("n") >= least).unionByName(found).select("lang", F.col("phrase").cast("string").alias("part"), F.col("n").alias("f"))
    k = F.explode(F.sequence(F.lit(1), F.size("_w") - 1))
    cuts = cand.withColumn("k", k).withColumns({"first": _part(1, F.col("k")), "rest": _part(F.col("k") + 1, F.size("_w"))})
    cuts = cuts.join(known.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(known.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_num", (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(scale).cast("decimal(7,0)")).withColumn("_den", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("_num div _den"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("_b")).select("lang", "phrase", "a", "_b.*")
    inner = cand.where(F.size("_w") > 2).withColumn("_len", F.explode(F.sequence(F.lit(2), F.size("_w") - 1)))
    inner = inner.withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_len") + 1))).select("lang", _part(F.col("_at"), F.col("_len")).alias("phrase"), F.col("a").alias("_long"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("_long").alias("_long"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("_long").isNull() | (100 * F.col("_long") < share * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= most)  # each task passes on ``most`` rows of a language at most
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
