"""Quality from a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes run over the whole text; their rectified responses are max-pooled over overlapping
chunks, and the chunks' features (their maximum and their mean over the document) combine into one probability.
Filters act on byte pairs through tables at inference, which is the same sum with half the look-ups.
Training is Adam on at most ``max_fit_rows`` labelled rows, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, FILTERS = 4, 12
CELL, CHUNK, STEP = 64, 4, 3  # bytes of a cell; cells of a chunk, and from one chunk to the next


class Net:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.top = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.base = np.float32(0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to the first and the last two bytes of a window, by byte pair."""
        f = self.filters
        return (f[0][:, None] + f[1][None]).reshape(65536, -1), (f[2][:, None] + f[3][None] + self.bias).reshape(65536, -1)

    def cells(self, buf: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Maximal responses by cell of a buffer that is a multiple of CELL, with WIDTH more bytes behind."""
        pair = buf[:-1].astype(np.uint16) << np.uint16(8) | buf[1:]
        n = len(buf) - WIDTH
        got = first[pair[:n]]
        got += second[pair[2 : n + 2]]
        return got.reshape(-1, CELL, FILTERS).max(1)


def _padded(raw: bytes | None) -> bytes:
    """Zero bytes up to a multiple of CELL, one cell at least."""
    raw = raw or b""
    return raw.ljust(max(CELL, -(-len(raw) // CELL) * CELL), b"\0")


def _chunks(n: int) -> list[tuple[int, int]]:
    """Overlapping ranges of cells that cover 0..n."""
    return [(a, min(a + CHUNK, n)) for a in range(0, max(1, n - (CHUNK - STEP)), STEP)]


def _features(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, mean) over chunks of a document's cell maxima, rectified."""
    starts = np.arange(0, max(1, len(cells) - (CHUNK - STEP)), STEP)
    pooled = cells[starts]
    for k in range(1, CHUNK):
        pooled = np.maximum(pooled, cells[np.minimum(starts + k, len(cells) - 1)])
    pooled = np.maximum(pooled, 0)
    return pooled.max(0), pooled.mean(0)


def predict(net: Net, texts: list[bytes | None]) -> np.ndarray:
    first, second = net.pairs()
    out = np.zeros(len(texts))
    held: list[bytes] = []
    where: list[int] = []
    size = 0

    def flush():
        buf = np.frombuffer(b"".join(held) + b"\0" * WIDTH, np.uint8)
        cells = net.cells(buf, first, second)
        at = 0
        for i, x in zip(where, held):
            n = len(x) // CELL - 1
            big, mean = _features(cells[at : at + n])
            out[i] = big @ net.top[:FILTERS] + mean @ net.top[FILTERS:] + net.base
            at += n + 1

    for i, raw in enumerate(texts):
        held.append(_padded(raw) + b"\0" * CELL)  # a text's last windows read zeros, not the next text
        where.append(i)
        size += len(held[-1])
        if size > 1 << 19:
            flush()
            held, where, size = [], [], 0
    if held:
        flush()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[bytes], y: np.ndarray, epochs: int = 12, rate: float = 0.02, batch: int = 32, seed: int = 0) -> Net:
    """Adam on the log-loss with equal weight for either class, then the intercept moved to the classes' true odds.

    The gradient of a maximum goes to the window that made it.
    """
    net = Net(seed)
    if not len(y) or y.min() == y.max():
        net.top[:] = 0
        net.base = np.float32(-4 if len(y) and y.max() == 0 else 4)
        return net
    rng = np.random.default_rng(seed)
    pads = [np.frombuffer(_padded(x) + b"\0" * WIDTH, np.uint8) for x in texts]
    spans = [np.array(_chunks((len(p) - WIDTH) // CELL)) for p in pads]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    state = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("filters", "bias", "top", "base")}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            grads = {k: np.zeros_like(getattr(net, k)) for k in state}
            first, second = net.pairs()
            for i in order[a : a + batch]:
                p = pads[i]
                pair = p[:-1].astype(np.uint16) << np.uint16(8) | p[1:]
                n = len(p) - WIDTH
                got = (first[pair[:n]] + second[pair[2 : n + 2]]).reshape(-1, CELL, FILTERS)
                in_cell = got.argmax(1)
                cells = np.take_along_axis(got, in_cell[:, None], 1)[:, 0]
                where = in_cell + np.arange(len(cells))[:, None] * CELL
                span = spans[i]
                pooled = np.full((len(span), FILTERS), -np.inf, np.float32)
                at = np.zeros((len(span), FILTERS), np.int64)
                for k in range(CHUNK):
                    c = np.minimum(span[:, 0] + k, span[:, 1] - 1)
                    more = cells[c] > pooled
                    pooled = np.where(more, cells[c], pooled)
                    at = np.where(more, where[c], at)
                live = pooled > 0
                relu = np.maximum(pooled, 0)
                big_at, big, mean = relu.argmax(0), relu.max(0), relu.mean(0)
                z = float(big @ net.top[:FILTERS] + mean @ net.top[FILTERS:] + net.base)
                d = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / batch)
                grads["top"] += d * np.concatenate([big, mean])
                grads["base"] += d
                back = np.broadcast_to(d * net.top[FILTERS:] / len(span), pooled.shape).copy()
                back[big_at, np.arange(FILTERS)] += d * net.top[:FILTERS]
                back *= live
                grads["bias"] += back.sum(0)
                cols = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(WIDTH):
                    np.add.at(grads["filters"][j], (p[at + j], cols), back)
            step += 1
            for k, (m, v) in state.items():
                m *= 0.9
                m += 0.1 * grads[k]
                v *= 0.99
                v += 0.01 * grads[k] ** 2
                now = rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - now).astype(np.float32))
                state[k] = [m, v]
    net.base = np.float32(net.base + np.log(y.mean() / (1 - y.mean())))
    return net


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", max_fit_rows: int = 1200, **options) -> Net:
    """Fit on at most about max_fit_rows rows that labels (doc_id, label 0/1) covers, half of either class where there are so many.

    Only the sampled rows' texts meet the labels: the sample is drawn from the labels, by a hash of the id.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    there = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    h = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20))
    rate = {c: min(1.0, max_fit_rows / 2 / n) for c, n in there.items()}
    cut = F.lit(0)
    for c, r in rate.items():
        cut = F.when(F.col("y") == c, int(r * (1 << 20))).otherwise(cut)
    chosen = marked.where(h < cut).limit(2 * max_fit_rows)
    got = docs.select("doc_id", F.col(text).cast("binary").alias("raw")).join(F.broadcast(chosen), "doc_id").limit(4 * max_fit_rows).toPandas()  # bounded by the limit above
    got = got.sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(float) if len(got) else np.zeros(0)
    net = train(list(got["raw"]), y, **options)
    if 0 < sum(y) < len(y):  # to the odds among all labels
        net.base = np.float32(net.base - np.log(y.mean() / (1 - y.mean())) + np.log(there[1] / there[0]))
    return net


def score(docs: DataFrame, net: Net, text: str = "text", cut: float = 0.3) -> DataFrame:
    """docs -> its columns but the text, score (0..1), predicted (score >= cut). A null text is read as an empty one.

    Columns of docs named score or predicted give way to these. Rows may repeat or lack an id: a score depends on the
    text alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series(predict(sent.value, list(raw)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rest = [c for c in docs.columns if c not in (text, "score", "predicted")]
    out = docs.select(*rest, F.pandas_udf(run, "double")(F.col(text).cast("binary")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
