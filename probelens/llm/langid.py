"""Language identification as mixture inference.

Each language has a byte 4-gram model over A-Z lower-cased words with a space on either side, counted over all
training documents in hashed cells. For a document, expectation-maximisation over its words estimates the proportion of
each language, until the likelihood's slopes prove that less than 0.001 nats are missing; sets of its likeliest languages are compared by log-likelihood less
a penalty for each further language. Sets grow as long as a larger one could still win; the likelihood is concave in the
proportions, so bounds from its gradient at the best single language and from its maximum over all languages tell that
exactly, and most documents in one language need no iteration.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.llm.common import SPARSE, gathered, sparse_rows

CELLS = 1 << 18
GRAM = 4
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - 18)


def gram_cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 4-gram cells of the words joined by spaces, and where each word's begin; a word owns at least one."""
    buf = np.frombuffer(b"  " + b"  ".join(words) + b"  ", np.uint8).astype(np.uint32)
    code = (buf[:-3] << np.uint32(24)) | (buf[1:-2] << np.uint32(16)) | (buf[2:-1] << np.uint32(8)) | buf[3:]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return ((code * _MIX) >> _SHIFT).astype(np.int64), starts


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, cells x languages log-probabilities). Counts cover every row with a text and a language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    langs = sorted(r[0] for r in rows.select(lang).distinct().collect())  # language names, not rows

    def count(batches):
        total = np.zeros((len(langs), CELLS), np.int64)
        place = {x: i for i, x in enumerate(langs)}
        for pdf in batches:
            for name, own in pdf.groupby(lang, sort=False)["raw"]:
                pool: list[bytes] = []
                for i, raw in enumerate(own):
                    pool += raw.lower().split()
                    if len(pool) > 50_000 or i == len(own) - 1:
                        if pool:
                            total[place[name]] += np.bincount(gram_cells(pool)[0], minlength=CELLS)
                        pool = []
        for i in range(len(langs)):
            yield sparse_rows(i, total[i])

    if not langs:
        return [], np.zeros((CELLS, 0), np.float32)
    table = gathered(rows.select(lang, F.col(text).cast("binary").alias("raw")).mapInPandas(count, SPARSE), len(langs), CELLS).astype(np.float64)
    return langs, np.log((table + smooth) / (table.sum(1, keepdims=True) + smooth * CELLS)).T.astype(np.float32)


def _em(like: np.ndarray, mass: np.ndarray, sizes: np.ndarray, share: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document and their log-likelihood, at most gain below its maximum over the languages that share holds.

    like: a row for each (document, word), scaled to a maximum of 1. The likelihood is concave in the proportions, so its
    maximum lies no further than the largest of its slopes less the words above where it is; a document is done when
    that is no more than gain.
    """
    share, value = share.copy(), np.full(len(sizes), -np.inf)
    held = share > 0
    active = np.arange(len(sizes))
    while len(active):
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.maximum((like * share[active][doc]).sum(1), 1e-300)
        total = np.add.reduceat(mass, starts)
        slope = np.add.reduceat(like * (mass / sums)[:, None], starts, axis=0)
        value[active] = np.add.reduceat(mass * np.log(sums), starts)
        goes = np.where(held[active], slope, 0).max(1) - total > gain
        share[active[goes]] *= slope[goes] / total[goes][:, None]
        if not goes.all():
            keep = goes[doc]
            like, mass, sizes, active = like[keep], mass[keep], sizes[goes], active[goes]
    return share, value


def mixtures(bags: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray, penalty: float, gain: float = 1e-3) -> list[np.ndarray]:
    """Proportions for bags of (word rows in logs, counts), zero outside the selected set."""
    sizes = np.array([len(x) for x, _ in bags])
    mass = np.concatenate([c for _, c in bags]).astype(np.float64)
    rows = logs[np.concatenate([x for x, _ in bags])].astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n_lang, base = rows.shape[1], rows.max(1)
    scaled = rows - base[:, None]
    single = np.add.reduceat(mass[:, None] * scaled, starts, axis=0)
    best_lang, value = single.argmax(1), single.max(1)
    best = np.zeros((len(bags), n_lang))
    best[np.arange(len(bags)), best_lang] = 1
    total = np.add.reduceat(mass, starts)
    cost = penalty * np.log(total + 1)
    doc = np.repeat(np.arange(len(bags)), sizes)
    own = scaled[np.arange(len(scaled)), best_lang[doc]]
    slope = np.add.reduceat(mass[:, None] * np.exp(np.minimum(scaled - own[:, None], 700)), starts, axis=0).max(1) - total
    open_ = np.flatnonzero((slope > cost) & (-value > cost))  # others: no proportions gain what a second language costs
    if not len(open_):
        return list(best)
    keep = np.isin(doc, open_)
    like, mass, sizes = np.exp(scaled[keep]), mass[keep], sizes[open_]
    share, most = _em(like, mass, sizes, np.full((len(open_), n_lang), 1 / n_lang), gain)
    order = np.argsort(-share, axis=1, kind="stable")
    cost, value = cost[open_], value[open_]
    for k in range(2, n_lang + 1):
        could = np.flatnonzero(most + gain - cost * (k - 1) > value)
        if not len(could):
            break
        allowed = np.zeros((len(could), n_lang))
        np.put_along_axis(allowed, order[could, :k], 1 / k, axis=1)
        mine = np.isin(np.repeat(np.arange(len(open_)), sizes), could)
        got, ll = _em(like[mine], mass[mine], sizes[could], allowed, gain)
        ll = ll - cost[could] * (k - 1)
        better = ll > value[could]
        best[open_[could[better]]] = got[better]
        value[could] = np.maximum(value[could], ll)
    return list(best)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", penalty: float = 4.0, gain: float = 1e-3) -> DataFrame:
    """docs -> its columns but the text's, lang_pred, score (share of lang_pred in 0..1), langs: array of (lang, share).

    A null text, one without a letter, or a model without languages gives und with score 0 and no langs. Columns of docs
    named lang_pred, score or langs give way to these. gain: nats that the likelihood of the proportions may lack of its maximum.
    """
    names, table = model
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(table)  # CELLS x languages, whatever the corpus

    @F.pandas_udf("lang_pred string, score double, langs array<struct<lang:string,share:double>>")
    def run(batches):
        logs = np.zeros((1024, len(names)), np.float32)
        seen: dict[bytes, int] = {}
        for texts in batches:
            out = [("und", 0.0, [])] * len(texts)
            held, where, size = [], [], 0
            for i, t in enumerate(texts):
                words = t.encode().lower().split() if names and t is not None and _LETTER.search(t) else []
                if words:
                    held.append(words)
                    where.append(i)
                    size += len(words)
                if held and (size > 40_000 or i == len(texts) - 1):
                    fresh = list({w for ws in held for w in ws if w not in seen})
                    if len(seen) + len(fresh) > 120_000:  # forget, to stay small
                        seen.clear()
                        fresh = list({w for ws in held for w in ws})
                    if fresh:
                        base = len(seen)
                        while base + len(fresh) > len(logs):
                            logs = np.concatenate([logs, np.zeros_like(logs)])
                        for a in range(0, len(fresh), 20_000):
                            cells, starts = gram_cells(fresh[a : a + 20_000])
                            logs[base + a : base + a + len(starts)] = np.add.reduceat(sent.value[cells], starts, axis=0)
                        seen.update(zip(fresh, range(base, base + len(fresh))))
                    bags = [np.unique(np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws)), return_counts=True) for ws in held]
                    for j, share in zip(where, mixtures(bags, logs, penalty, gain)):
                        top = np.argsort(-share, kind="stable")
                        out[j] = (names[top[0]], min(1.0, float(share[top[0]])), [(names[x], float(share[x])) for x in top if share[x] > 0])
                    held, where, size = [], [], 0
            yield pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "langs": [[{"lang": a, "share": b} for a, b in x[2]] for x in out]})

    from collections.abc import Iterator

    run = F.pandas_udf(_typed(run.func, Iterator), run.returnType)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score", "langs")]
    out = docs.select(F.struct(*rest).alias("d"), run(F.col(text)).alias("r")) if rest else docs.select(run(F.col(text)).alias("r"))
    return out.select(*[F.col("d")[c].alias(c) for c in rest], "r.lang_pred", "r.score", "r.langs")


def _typed(f, iterator):
    def run(batches):
        yield from f(batches)

    run.__annotations__ = {"batches": iterator[pd.Series], "return": iterator[pd.DataFrame]}
    return run
