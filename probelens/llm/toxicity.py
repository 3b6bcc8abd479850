"""Toxicity from class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary training text, count a word once for each text that has it. Either takes
the discounts of modified Kneser-Ney smoothing (Chen and Goodman, 1999), estimated from its own counts of counts, and
gives what they free to one shared backoff: how many different words a word follows, counted over both classes. So an
expression that is rare in either class is smoothed alike.

A document is compared by the length-normalised difference of its two log-likelihoods, kept apart by sign: what speaks
for the toxic class and what speaks for the ordinary one, each divided by the number of words. A word counts with what
its own difference has beyond ``floor`` nats; a logistic curve weighs the two sides into 0..1. The floor is that of
``floors`` under which curves fitted on one half of the training rows give the other half the least log-loss, scores
always coming from models counted on the half a row is not in. Words are runs of A-Z (lower-cased), digits and
non-ASCII bytes, known by their 64-bit hashes. Counts cover all labelled training text, different predecessors are told
apart over all of it, and the tables grow with the corpus; the curve sees at most about ``max_fit_rows`` rows.

Words whose difference is within the floor need no entry. Up to ``max_words`` entries are sent to the executors; a
larger table is joined with the words of the distinct texts instead, with the same scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.llm.common import written

_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")
PACK = 300_000
#: words that a task of the counts holds before it hands their counts on
HELD = 1_000_000
#: labelled texts whose different word pairs one task of the counts brings together, on average
TEXTS_A_BUCKET = 1024
#: what stands before a text's first word
START = 0
#: mass that the shared backoff adds to each word
ADDED = 0.1


def tokens(raw: bytes | None) -> np.ndarray:
    found = _TOKEN.findall((raw or b"").lower())
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)).view(np.int64)


def _packs(texts) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(positions of the texts, their words' hashes end to end, their sizes), some hundred thousand words at a time."""
    where, pool, sizes, n = [], [], [], 0
    for i, raw in enumerate(texts):
        own = tokens(raw)
        where.append(i)
        pool.append(own)
        sizes.append(len(own))
        n += len(own)
        if n > PACK:
            yield where, np.concatenate(pool), np.array(sizes)
            where, pool, sizes, n = [], [], [], 0
    if where:
        yield where, np.concatenate(pool), np.array(sizes)


def _folded(word: np.ndarray, other: np.ndarray, value: np.ndarray, fold: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, other) with their values folded."""
    order = np.lexsort((other, word))
    word, other, value = word[order], other[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (other[1:] != other[:-1]))))
    return word[first], other[first], fold.reduceat(value, first)


def _bucket(word: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """Of a pair: pairs of one word are spread over all buckets."""
    x = (word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ before.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


COUNTS = "word long, c0 long, c1 long, c2 long, c3 long, n0 long, n1 long, n2 long"


def count(rows: DataFrame, n: int = 1) -> DataFrame:
    """rows(raw binary, cls 0/1, half 0/1), about n of them -> (word, c0 .. c3, n0, n1, n2), a row for each word.

    c: texts with the word, by 2 * half + cls; n: the word's different predecessors in half 0, in half 1 and in both
    together. Tasks fold what they can hold and hand it on in packed buckets of pairs, whose number grows with n; a
    bucket tells its pairs apart and leaves a row for each word.
    """
    buckets = -(-max(1, n) // TEXTS_A_BUCKET)

    def handed(words, befores, halves, once, kinds):
        """The pairs of a bucket: words, how many predecessors each has, these, and the halves that have them."""
        if not words:
            return
        word, before, bits = _folded(np.concatenate(words), np.concatenate(befores), np.concatenate(halves), np.bitwise_or)
        at = _bucket(word, before, buckets)
        order = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) > 0, [True])))
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            own = order[a:b]
            start = np.flatnonzero(np.concatenate(([True], word[own][1:] != word[own][:-1])))
            out.append((int(at[own[0]]), word[own][start].tobytes(), np.diff(np.append(start, len(own))).astype("<u4").tobytes(), before[own].tobytes(), bits[own].astype(np.uint8).tobytes()))
        yield pd.DataFrame(out, columns=["b", "words", "sizes", "befores", "bits"])
        had, kind, texts = _folded(np.concatenate(once), np.concatenate(kinds), np.ones(sum(map(len, once)), np.int64), np.add)
        at = _bucket(had, np.zeros_like(had), buckets)
        order = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) > 0, [True])))
        out = [(int(at[order[a]]), had[order[a:b]].tobytes(), texts[order[a:b]].astype("<u4").tobytes(), None, kind[order[a:b]].astype(np.uint8).tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        yield pd.DataFrame(out, columns=["b", "words", "sizes", "befores", "bits"])

    def run(batches):
        held, n = ([], [], [], [], []), 0
        for pdf in batches:
            for raw, cls, half in zip(pdf["raw"], pdf["cls"], pdf["half"]):
                own = tokens(raw)
                if not len(own):
                    continue
                distinct = np.unique(own)
                for x, part in zip(held, (own, np.concatenate(([START], own[:-1])), np.full(len(own), 1 << half, np.int64), distinct, np.full(len(distinct), 2 * half + cls, np.int64))):
                    x.append(part)
                n += len(own)
                if n > HELD:
                    yield from handed(*held)
                    held, n = ([], [], [], [], []), 0
        yield from handed(*held)

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        """Packed rows of one bucket -> its words with their texts and different predecessors."""
        of = lambda c, t, which: np.concatenate([np.frombuffer(x, t) for x in pdf[c][which]] or [np.zeros(0, t)])
        pairs = pdf["befores"].notna()
        word = np.repeat(of("words", "<i8", pairs), of("sizes", "<u4", pairs))
        out = []
        if len(word):
            word, _, bits = _folded(word, of("befores", "<i8", pairs), of("bits", np.uint8, pairs).astype(np.int64), np.bitwise_or)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out.append(pd.DataFrame({"word": word[first]} | {f"n{i}": np.add.reduceat((bits & m > 0).astype(np.int64), first) for i, m in enumerate((1, 2, 3))}))
        had, kind, texts = of("words", "<i8", ~pairs), of("bits", np.uint8, ~pairs), of("sizes", "<u4", ~pairs).astype(np.int64)
        out.append(pd.DataFrame({"word": had} | {f"c{i}": np.where(kind == i, texts, 0) for i in range(4)}))
        return pd.concat(out).fillna(0).groupby("word", as_index=False).sum().astype(np.int64)[["word", "c0", "c1", "c2", "c3", "n0", "n1", "n2"]]

    packed = rows.mapInPandas(run, "b int, words binary, sizes binary, befores binary, bits binary")
    names = [c.split()[0] for c in COUNTS.split(", ")[1:]]
    return written(packed.groupBy("b").applyInPandas(told, COUNTS).groupBy("word").agg(*[F.sum(c).alias(c) for c in names]), "words")


class Model:
    """What scoring needs of one pair of class models: differences of log-likelihoods; ``rest`` is that of a word without an entry."""

    def __init__(self, words: np.ndarray, diff: np.ndarray, rest: float):
        order = np.argsort(words)
        self.words, self.diff, self.rest = words[order], diff[order].astype(np.float32), rest

    def of(self, pool: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(pool), self.rest)
        at = np.minimum(np.searchsorted(self.words, pool), len(self.words) - 1)
        return np.where(self.words[at] == pool, self.diff[at], self.rest)

    def sides(self, texts, floors: list[float]) -> np.ndarray:
        """Floors x texts x 2: evidence by word for the toxic and for the ordinary class, on a square-root scale; 0 for texts without words."""
        out = np.zeros((len(floors), len(texts), 2))
        for where, pool, sizes in _packs(texts):
            diff = self.of(pool).astype(np.float64)
            ends = np.cumsum(sizes)
            for f, floor in enumerate(floors):
                for side, x in enumerate((diff, -diff)):
                    sums = np.concatenate(([0.0], np.cumsum(np.maximum(x - floor, 0))))
                    out[f, where, side] = np.sqrt(np.maximum(sums[ends] - sums[ends - sizes], 0) / np.maximum(sizes, 1))
        return out


def discounts(counted: list[float]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more, from the numbers of words counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = counted
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    return [min(max(j - (j + 1) * y * b / a, 0.0), float(j)) if a else y for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def differences(table: DataFrame) -> list[tuple[Column, float]]:
    """For half 0, half 1 and both, from count(): a word's log-likelihood in the toxic model less that in the ordinary one, and that of a word never seen."""
    own = [[F.col("c0"), F.col("c1")], [F.col("c2"), F.col("c3")], [F.col("c0") + F.col("c2"), F.col("c1") + F.col("c3")]]
    sums = [F.count_if(F.col(f"n{m}") > 0) for m in range(3)] + [F.sum(f"n{m}") for m in range(3)]
    sums += [x for cs in own for c in cs for x in (F.sum(c), *[F.count_if(c == j) for j in (1, 2, 3, 4)], F.count_if(c > 2))]
    got = [float(x or 0) for x in table.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]
    out = []
    for m, cs in enumerate(own):
        shared = (F.col(f"n{m}") + F.lit(ADDED)) / F.lit(got[3 + m] + ADDED * (got[m] + 1))  # one more word for all never seen
        logs, free = [], []
        for c, own_sums in zip(cs, (got[6 + 12 * m : 12 + 12 * m], got[12 + 12 * m : 18 + 12 * m])):
            total, counted, more = max(1.0, own_sums[0]), own_sums[1:5], own_sums[5]
            d = discounts(counted)
            taken = F.when(c > 2, F.lit(d[2])).when(c == 2, F.lit(d[1])).when(c == 1, F.lit(d[0])).otherwise(F.lit(0.0))
            free.append((d[0] * counted[0] + d[1] * counted[1] + d[2] * more) / total if own_sums[0] else 1.0)
            logs.append(F.log((c - taken) / F.lit(total) + F.lit(max(free[-1], 1e-9)) * shared))
        out.append((logs[1] - logs[0], math.log(max(free[1], 1e-9)) - math.log(max(free[0], 1e-9))))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> np.ndarray:
    """Weights of the columns of x, and an intercept, by Newton steps on standardised columns."""
    if not len(x) or y.min() == y.max():
        return np.append(np.zeros(x.shape[1]), -4.0 if not len(x) or y.max() == 0 else 4.0)
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + l2 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + l2 * np.eye(len(w)), grad)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _maybe_marked(docs: DataFrame, marked: DataFrame, n: int) -> DataFrame:
    """docs without most of those whose id is not among the n of marked, by a bit map of hashed ids, 16 bits for each: fewer texts are shuffled."""
    if docs.schema["doc_id"].dataType != marked.schema["doc_id"].dataType:
        return docs
    spot = F.pmod(F.xxhash64("doc_id"), F.lit((n * 16 // 32768 + 1) * 32768))
    block, bit = F.floor(spot / 32768), F.pmod(spot, F.lit(32768))
    maps = marked.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    return docs.withColumn("_block", block).join(F.broadcast(maps), "_block").where(held).drop("_block", "_map")


class Fitted(NamedTuple):
    """words(word, diff): the words beyond the floor; rest: the difference of all others; weights of the sides, and intercept."""

    words: DataFrame
    rest: float
    floor: float
    weights: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", floors: tuple = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0), max_fit_rows: int = 4000) -> Fitted:
    """Counts over all rows of docs that labels (doc_id, label 0/1) covers; floor and curve from at most about max_fit_rows of them.

    Other label values and null ids are ignored; an id labelled twice takes the larger label. Without both classes the
    curve is flat (0.02, or 0.98 if every label is 1). Only doc_id and the text of docs are read.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("cls"))
    half = F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string")).cast("binary"))
    n = marked.count()
    train = _maybe_marked(docs.select("doc_id", F.col(text).cast("binary").alias("raw")), marked, n).join(marked.hint("merge"), "doc_id").select("raw", "cls", (half % 2).cast("int").alias("half"), F.shiftright(half, 1).alias("h"))
    table = count(train, n)
    found = differences(table)
    rate = min(1.0, max_fit_rows / max(1, n))
    sample = train.where(F.pmod("h", F.lit(1 << 20)) < int(rate * (1 << 20))).select("raw", "cls", "half").limit(2 * max_fit_rows).toPandas()  # bounded by the limit
    raws, y, side = list(sample["raw"]), sample["cls"].to_numpy(float), sample["half"].to_numpy()
    x = np.zeros((len(floors), len(raws), 2))
    if len(raws):
        asked = pd.DataFrame({"word": np.unique(np.concatenate([tokens(r) for r in raws] or [np.zeros(0, np.int64)]))})
        asked = docs.sparkSession.createDataFrame(pa.Table.from_pandas(asked))  # the words of the sample
        for k in range(2):
            diff, rest = found[1 - k]
            own = np.flatnonzero(side == k)
            known = table.where(F.col(f"n{1 - k}") > 0).join(asked, "word", "left_semi").select("word", diff.alias("diff")).toArrow()
            x[:, own] = Model(known["word"].to_numpy(), known["diff"].to_numpy(), rest).sides([raws[i] for i in own], list(floors))
    losses = []
    for f in range(len(floors)):
        p = np.full(len(y), 0.5)
        for k in range(2):
            p[side == k] = _chance(x[f][side == k], _logistic(x[f][side != k], y[side != k]))
        p = np.clip(p, 1e-9, 1 - 1e-9)
        losses.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    best = int(np.argmin(losses)) if len(y) else 0
    diff, rest = found[2][0].cast("float"), float(np.float32(found[2][1]))  # one type, sent or joined
    floor = float(floors[best])
    inside = F.lit(rest) if abs(rest) > floor else F.lit(0.0)
    words = table.select("word", diff.alias("diff")).where((F.abs("diff") > floor) | (F.abs(inside) > floor))
    return Fitted(written(words, "differences"), rest, floor, _logistic(x[best], y))


def score(docs: DataFrame, model: Fitted, text: str = "text", cut: float = 0.7, max_words: int = 8 << 20) -> DataFrame:
    """docs -> its columns but the text, score (0..1), predicted (score >= cut). A null or wordless text has no evidence for either side.

    Columns of docs named score or predicted give way to these.
    """
    rest = [c for c in docs.columns if c not in (text, "score", "predicted")]
    if model.words.count() > max_words:
        return _joined(docs, model, text, rest, cut)
    known = model.words.toArrow()  # at most max_words
    sent = docs.sparkSession.sparkContext.broadcast((Model(known["word"].to_numpy(), known["diff"].to_numpy(), model.rest), model.floor, model.weights))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, floor, weights = sent.value
        for raw in batches:
            yield pd.Series(_chance(table.sides(list(raw), [floor])[0], weights))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = docs.select(*rest, F.pandas_udf(run, "double")(F.col(text).cast("binary")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def _joined(docs: DataFrame, model: Fitted, text: str, rest: list[str], cut: float) -> DataFrame:
    """The same by joins: words of each distinct text (known by its hash) with the table, then texts with their scores."""

    def run(batches):
        for pdf in batches:
            for key, raw in zip(pdf["_t"], pdf["_raw"]):
                word, n = np.unique(tokens(raw), return_counts=True)
                yield pd.DataFrame({"_t": np.full(len(word), key, np.int64), "word": word, "n": n})

    rows = docs.withColumn("_t", F.xxhash64(text))
    words = rows.select("_t", F.col(text).cast("binary").alias("_raw")).dropDuplicates(["_t"]).mapInPandas(run, "_t long, word long, n long")
    diff = F.coalesce(F.col("diff").cast("double"), F.lit(model.rest))
    sides = [F.sqrt(F.sum(F.greatest(x - F.lit(model.floor), F.lit(0.0)) * F.col("n")) / F.sum("n")) for x in (diff, -diff)]
    found = words.join(model.words.hint("merge"), "word", "left").groupBy("_t").agg(*[x.alias(f"_s{i}") for i, x in enumerate(sides)])
    z = F.lit(float(model.weights[-1])) + sum(F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) * F.lit(float(model.weights[i])) for i in range(2))
    out = rows.join(found, "_t", "left").select(*rest, (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
