"""Probes as (train, rows) -> rows with score: train and rows have item_id, truth and vec; train is one group.

Linear probes learn by sums over the executors, so no table is collected. The networks (an unsupervised contrast probe and a
multilayer perceptron) learn from at most ``max_fit_rows`` rows, drawn by a hash of the key and read on the driver;
all of them score on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.functions.draws import h32
from probelens.functions.scalars import cosine, dot, minus, norm, sigmoid
from probelens.functions.stage import staged
from probelens.operators.fitted import logistic, with_scores


def moments(rows: DataFrame, vec: str = "vec", by: tuple = ()) -> DataFrame:
    """(by, mean, sd) of every dimension; a spread under 1e-8 counts as 1."""
    each = rows.select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("p", "x")).groupBy(*by, "p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    whole = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("p", "m", F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s")).alias("s")))).alias("_a"))  # as many as dimensions
    return whole.select(*by, F.transform("_a", lambda a: a["m"]).alias("mean"), F.transform("_a", lambda a: a["s"]).alias("sd"))


def standardised(train: DataFrame, rows: DataFrame, vec: str = "vec") -> DataFrame:
    """rows with vec less train's means, over its spreads."""
    m = F.broadcast(moments(train, vec))  # one row
    z = F.zip_with(F.zip_with(F.col(vec).cast("array<double>"), F.col("mean"), lambda x, a: x - a), F.col("sd"), lambda x, s: x / s)
    return rows.crossJoin(m).withColumn(vec, z).drop("mean", "sd")


def mass_mean(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Along the difference of the classes' means of standardised vectors, as a probability."""
    fit, at = standardised(train, train), standardised(train, rows)
    each = fit.select("truth", F.posexplode("vec").alias("p", "x")).groupBy("p").agg((F.avg(F.when(F.col("truth"), F.col("x"))) - F.avg(F.when(~F.col("truth"), F.col("x")))).alias("d"))
    theta = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda a: a["d"]).alias("_t"))  # as many as dimensions
    return at.crossJoin(F.broadcast(theta)).withColumn("score", sigmoid(dot(F.col("vec"), F.col("_t")))).drop("_t")


def logistic_probe(train: DataFrame, rows: DataFrame, l2: float = 1.0, steps: int = 25) -> DataFrame:
    """Plain logistic regression on standardised vectors."""
    fit = staged(standardised(train, train).select("truth", "vec"), "standardised")  # each step reads it
    return with_scores(standardised(train, rows), logistic(fit, (), l2=l2, steps=steps), ())


def drift_vectors(rows: DataFrame, taps: int = 4, differencing: bool = True, vec: str = "vec") -> DataFrame:
    """rows whose vec (taps end to end) becomes, for each pair of taps, their difference, cosine and distance."""
    widths = rows.select(F.size(vec).alias("n")).distinct().limit(2).collect()  # one width
    if any(r["n"] % taps for r in widths) or len(widths) > 1:
        raise ValueError(f"a vector must be {taps} taps of one width")
    if not differencing or not widths:
        return rows
    d = widths[0]["n"] // taps
    tap = [F.slice(F.col(vec).cast("array<double>"), i * d + 1, d) for i in range(taps)]
    parts = [F.concat(minus(tap[b], tap[a]), F.array(cosine(tap[a], tap[b]), norm(minus(tap[b], tap[a])))) for a in range(taps) for b in range(a + 1, taps)]
    return rows.withColumn(vec, F.concat(*parts))


def drift(train: DataFrame, rows: DataFrame, taps: int = 4, differencing: bool = True, c: float = 0.01) -> DataFrame:
    """Logistic regression on how the representation moves between layers; differencing False: on the layers themselves."""
    return logistic_probe(drift_vectors(train, taps, differencing), drift_vectors(rows, taps, differencing), l2=1 / c)


def drift_concat(train: DataFrame, rows: DataFrame, taps: int = 4) -> DataFrame:
    return drift(train, rows, taps, False)


def sides(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows (…, polarity, vec) of affirmed (1) and negated (-1) halves of vec; an odd width is an error."""
    odd = rows.where(F.size(vec) % 2 == 1).limit(1).count()
    if odd:
        raise ValueError("a vector must be an affirmed and a negated half")
    half = (F.size(vec) / 2).cast("int")
    x = F.col(vec).cast("array<double>")
    both = F.array(F.struct(F.lit(1).alias("polarity"), F.slice(x, F.lit(1), half).alias("v")), F.struct(F.lit(-1).alias("polarity"), F.slice(x, half + 1, half).alias("v")))
    rest = [c for c in rows.columns if c != vec]
    return rows.select(*rest, F.explode(both).alias("_s")).select(*rest, "_s.polarity", F.col("_s.v").alias(vec))


def _centred(rows: DataFrame, by: tuple = ("topic",), vec: str = "vec") -> DataFrame:
    each = rows.select(*by, F.posexplode(vec).alias("p", "x")).groupBy(*by, "p").agg(F.avg("x").alias("m"))
    means = each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda a: a["m"]).alias("_m"))  # as many as dimensions
    return rows.join(F.broadcast(means), list(by)).withColumn(vec, minus(F.col(vec), F.col("_m"))).drop("_m")


def truth_directions(train: DataFrame) -> tuple[list[float], list[float]]:
    """(t_G, t_P) of affirmed and negated statements, centred by topic: least squares of a vector on tau t_G + tau p t_P.

    tau is 1 for what is true as it stands, p the polarity. Two columns of signs: a closed form from four sums a dimension.
    """
    rows = _centred(sides(train)).withColumn("tau", F.when(F.col("truth"), F.col("polarity")).otherwise(-F.col("polarity")).cast("double"))
    rows = rows.withColumn("tp", F.col("tau") * F.col("polarity"))
    each = rows.select("tau", "tp", F.posexplode("vec").alias("p", "x")).groupBy("p").agg(F.sum(F.col("tau") * F.col("x")).alias("a"), F.sum(F.col("tp") * F.col("x")).alias("b"))
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.col("tau") * F.col("tp")).alias("c")).first()
    got = each.orderBy("p").toPandas()  # a row for each dimension
    n, c = float(sums["n"]), float(sums["c"])
    det = n * n - c * c
    a, b = got["a"].to_numpy(), got["b"].to_numpy()
    return ((n * a - c * b) / det).tolist(), ((n * b - c * a) / det).tolist()


def ttpd(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Truth and polarity directions: a logistic regression on the projections on t_G and on the direction that tells
    affirmed from negated. vec: affirmed and negated vector end to end; rows have topic. Scores are of the affirmed half."""
    t_g, _ = truth_directions(train)
    both = _centred(sides(train)).withColumn("tau", F.when(F.col("truth"), F.col("polarity")).otherwise(-F.col("polarity")) > 0).withColumn("affirmed", F.col("polarity") > 0)
    both = staged(both.select("tau", "affirmed", "vec"), "sides")  # each step reads it
    polarity = logistic(both, (), "affirmed", steps=25).first()["weights"][:-1]  # one model
    seen = lambda df: df.withColumn("vec", F.array(dot(F.col("vec"), F.lit(t_g)), dot(F.col("vec"), F.lit(polarity))))
    model = logistic(seen(both), (), "tau", steps=25)
    affirmed = _centred(sides(rows).where("polarity = 1"))
    return with_scores(seen(affirmed), model, ()).drop("polarity")


def _sampled(train: DataFrame, max_fit_rows: int, seed) -> pd.DataFrame:
    """At most about max_fit_rows rows, drawn by a hash of the key; sorted, so that fits don't depend on partitions."""
    rows = train.select("item_id", "truth", "vec").where("truth is not null and vec is not null")
    n = rows.count()
    if n > max_fit_rows:
        rows = rows.where(h32(f"{seed}:fit", F.col("item_id")) < int(2**32 * max_fit_rows / n)).limit(2 * max_fit_rows)
    return rows.toPandas().sort_values("item_id", kind="stable")


def _scored(rows: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    @F.pandas_udf("double")
    def run(vec: pd.Series) -> pd.Series:
        return pd.Series(predict(np.stack(vec.to_numpy()).astype(float)) if len(vec) else [], dtype="float64")

    return rows.withColumn("score", run(F.col("vec").cast("array<double>")))


def _adam(state: dict, name: str, value: np.ndarray, grad: np.ndarray, step: int, rate: float, decay: float = 0.0) -> np.ndarray:
    m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
    m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
    state[name] = (m, v)
    return value * (1 - rate * decay) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def ccs(train: DataFrame, rows: DataFrame, epochs: int = 1000, rate: float = 1e-3, decay: float = 0.1, seed=0, max_fit_rows: int = 20_000) -> DataFrame:
    """Contrast-consistent search: a direction under which a statement and its negation get complementary, decided
    probabilities. Either side is standardised by itself. Labels decide the sign only."""
    if train.where(F.size("vec") % 2 == 1).limit(1).count():
        raise ValueError("a vector must be an affirmed and a negated half")
    got = _sampled(train, max_fit_rows, seed)
    x = np.stack(got["vec"].to_numpy()).astype(float)
    d = x.shape[1] // 2
    stats = []
    for part in (x[:, :d], x[:, d:]):
        sd = part.std(0)
        stats.append((part.mean(0), np.where(sd < 1e-8, 1.0, sd)))
    pos, neg = ((p - m) / s for p, (m, s) in zip((x[:, :d], x[:, d:]), stats))
    rng = np.random.default_rng(seed)
    w, b, state = rng.uniform(-1, 1, d) / np.sqrt(d), 0.0, {}
    for step in range(1, epochs + 1):
        p, q = (1 / (1 + np.exp(-np.clip(z @ w + b, -60, 60))) for z in (pos, neg))
        agree, low = p + q - 1, np.where(p < q, p, q)
        dp = (2 * agree + np.where(p < q, 2 * low, 0)) / len(p) * p * (1 - p)
        dq = (2 * agree + np.where(p < q, 0, 2 * low)) / len(p) * q * (1 - q)
        w = _adam(state, "w", w, pos.T @ dp + neg.T @ dq, step, rate, decay)
        b = float(_adam(state, "b", np.array(b), np.array((dp + dq).sum()), step, rate, decay))
    y = got["truth"].to_numpy(bool)
    p = 1 / (1 + np.exp(-np.clip(pos @ w + b, -60, 60)))
    if ((p > 0.5) == y).mean() < 0.5:
        w, b = -w, -b
    mean, sd = stats[0]
    return _scored(rows, lambda z: 1 / (1 + np.exp(-np.clip((z[:, :d] - mean) / sd @ w + b, -60, 60))))


def mlp(train: DataFrame, rows: DataFrame, hidden: tuple = (256, 128, 64), epochs: int = 200, patience: int = 12, batch: int = 512, rate: float = 1e-3, held: float = 0.1, seed=0, max_fit_rows: int = 20_000) -> DataFrame:
    """Multilayer perceptron on standardised vectors: Adam on the log-loss, stopped when a held-out tenth has not
    improved for ``patience`` epochs; the weights of its best epoch hold."""
    got = _sampled(train, max_fit_rows, seed)
    x, y = np.stack(got["vec"].to_numpy()).astype(float), got["truth"].to_numpy(float)
    mean, sd = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / sd
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    n_val = max(1, int(held * len(x)))
    val, fit = order[:n_val], order[n_val:]
    shape = (x.shape[1], *hidden, 1)
    net = [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(shape, shape[1:])]

    def forward(net, z):
        acts = [z]
        for i, (w, b) in enumerate(net):
            z = z @ w + b
            z = np.maximum(z, 0) if i < len(net) - 1 else z
            acts.append(z)
        return acts

    def loss(net, at):
        z = forward(net, x[at])[-1][:, 0]
        return float(np.mean(np.logaddexp(0, z) - y[at] * z))

    best, kept, waited, state, step = np.inf, net, 0, {}, 0
    for _ in range(epochs):
        for a in range(0, len(fit), batch):
            at = fit[a : a + batch]
            acts = forward(net, x[at])
            back = ((1 / (1 + np.exp(-np.clip(acts[-1][:, 0], -60, 60))) - y[at]) / len(at))[:, None]
            step += 1
            new = []
            for i in range(len(net) - 1, -1, -1):
                w, b = net[i]
                gw, gb = acts[i].T @ back, back.sum(0)
                back = (back @ w.T) * (acts[i] > 0) if i else back
                new.append((_adam(state, f"w{i}", w, gw, step, rate), _adam(state, f"b{i}", b, gb, step, rate)))
            net = new[::-1]
        fit = rng.permutation(fit)
        now = loss(net, val)
        best, kept, waited = (now, net, 0) if now < best - 1e-9 else (best, kept, waited + 1)
        if waited >= patience:
            break
    return _scored(rows, lambda z: 1 / (1 + np.exp(-np.clip(forward(kept, (z - mean) / sd)[-1][:, 0], -60, 60))))


def frequency_only(train: DataFrame, rows: DataFrame) -> DataFrame:
    """A detector that reads nothing but the entity's frequency."""
    return rows.withColumn("score", F.col("logf").cast("double"))


def perplexity_only(train: DataFrame, rows: DataFrame) -> DataFrame:
    """A detector that reads nothing but the text's loss: minus its perplexity."""
    return rows.withColumn("score", -F.exp("nll"))


#: probes by name; others are registered by adding them here
PROBES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"mass_mean": mass_mean, "logistic": logistic_probe, "ccs": ccs, "ttpd": ttpd, "drift": drift, "drift_concat": drift_concat, "mlp": mlp, "frequency": frequency_only, "perplexity": perplexity_only}


def probe_named(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    if name not in PROBES:
        raise KeyError(f"no probe {name}; there are {', '.join(sorted(PROBES))}")
    return PROBES[name]


def layer_sweep(acts: DataFrame, names: tuple = ("mass_mean", "logistic"), model: str = "vectors", share: float = 0.8, seed=0) -> DataFrame:
    """(model, probe, layer, in_dist, off, gap) of every probe at every layer: AUROC on held-out diagonal rows and off it."""
    from probelens.operators.audit import split_diagonal
    from probelens.operators.ranks import auroc

    out = None
    for layer in [r["layer"] for r in acts.select("layer").distinct().orderBy("layer").collect()]:  # a number for each layer
        parts = staged(split_diagonal(acts.where(F.col("layer") == layer), share, seed), "parts")
        for name in names:
            scored = probe_named(name)(parts.where("part = 'train'"), parts.where("part <> 'train'"))
            got = auroc(scored, ("part",)).agg(F.max(F.when(F.col("part") == "held", F.col("auroc"))).alias("in_dist"), F.max(F.when(F.col("part") == "off", F.col("auroc"))).alias("off"))
            one = got.select(F.lit(model).alias("model"), F.lit(name).alias("probe"), F.lit(layer).alias("layer"), "in_dist", "off", (F.col("in_dist") - F.col("off")).alias("gap"))
            out = one if out is None else out.unionByName(one)
    return out


def pooled(tokens: DataFrame, how: str = "mean", by: tuple = ("item_id", "layer"), pos: str = "pos", vec: str = "vec") -> DataFrame:
    """(by, vec): the mean vector over an item's tokens, or the last token's."""
    if how == "last":
        return tokens.groupBy(*by).agg(F.max_by(F.col(vec).cast("array<double>"), pos).alias(vec))
    each = tokens.select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("_p", "_x")).groupBy(*by, "_p").agg(F.avg("_x").alias("_m"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda a: a["_m"]).alias(vec))  # as many as dimensions


def taps(n_layers: int, fractions: tuple = (0.6, 0.7, 0.8, 0.85)) -> tuple[int, ...]:
    """Layers at fixed depths; halves go to the even layer."""
    return tuple(round(f * (n_layers - 1)) for f in fractions)


def tap_layers(n_layers: Column, fractions: tuple = (0.6, 0.7, 0.8, 0.85)) -> Column:
    """taps() of a column of numbers of layers."""
    return F.array(*[F.bround(F.lit(f) * (n_layers - 1), 0).cast("int") for f in fractions])
