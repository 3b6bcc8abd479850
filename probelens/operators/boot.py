"""Bootstraps by Poisson(1) weights: a replicate is a hash of (seed, replicate, unit), so rows need no numbering, no
join and no sampling order.

For AUROCs rows are shuffled once, into value buckets; a bucket draws all its rows' weights as arrays and leaves three
numbers for each replicate, which a running sum over buckets joins. Rows are never multiplied by replicates. A value that
many rows share is a bucket of its own and needs no order inside, so its rows are dealt out further.

Weights are what takes the time. Where a stratified gap's edges are values that many rows share, they are the same in all
replicates but few, so the bands of all rows are told beforehand, their weights drawn once, and it is checked afterwards
which replicates have other edges. Only those, and groups whose edges move, need a pass over the weights for the edges.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions.draws import POISSON, meet, poisson, uniform
from probelens.functions.md5 import pair_heads
from probelens.functions.stage import staged
from probelens.operators.ranks import auroc, passed, quantiles, spearman


def replicates(rows: DataFrame, n_boot: int, seed, unit: str) -> DataFrame:
    """rows for each replicate b with their weight w > 0. unit: what is drawn (an item, or the cluster it belongs to)."""
    each = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    return each.withColumn("_u", uniform(seed, F.col("b"), F.col(unit))).where(F.col("_u") >= POISSON[0]).withColumn("w", poisson(F.col("_u"))).drop("_u")


#: rows whose weights a task holds at once
CHUNK = 1024
#: draws that are mixed at once: few enough for a core's cache
SMALL = 32_768
#: rows of one value that a task gets
SALTED = 16_384
#: rows of a group that a bucket has at least, on average
FILLED = 512


def weights(units, n_boot, seed, draw: str = "md5") -> np.ndarray:
    """Units x replicates of Poisson weights: by md5 those that replicates() gives, which SQL can follow; by mix, draws of a
    counter hashed by splitmix64, some hundred times faster. n_boot: how many replicates, or the numbers of those asked for."""
    numbers = np.arange(1, n_boot + 1) if np.ndim(n_boot) == 0 else np.asarray(n_boot)
    out = np.zeros((len(units), len(numbers)), np.uint8)
    if draw == "mix":
        own = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{u}".encode(), digest_size=8).digest(), "little") for u in units], np.uint64)
        step, n = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), max(1, SMALL // max(1, len(numbers)))
        room = np.empty((2, n, len(numbers)), np.uint64)
        for a in range(0, len(own), n):
            part = own[a : a + n, None]
            x, y = room[:, : len(part)]
            np.add(part, step, out=x)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                np.right_shift(x, np.uint64(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint64(factor), out=x)
            np.right_shift(x, np.uint64(31), out=y)
            np.bitwise_xor(x, y, out=x)
            np.right_shift(x, np.uint64(32), out=x)
            _count(x.astype(np.uint32), [int(c * 2**32) for c in POISSON], out[a : a + n])
        return out
    before, after = [f"{seed}:{b}:".encode() for b in numbers], [str(u).encode() for u in units]
    for a in range(0, len(after), CHUNK // 2):
        _count(pair_heads(before, after[a : a + CHUNK // 2]), [math.ceil(c * 2**32 - 0.5) for c in POISSON], out[a : a + CHUNK // 2])  # (h + 0.5) / 2^32 >= c
    return out


def _count(h: np.ndarray, cuts: list, out: np.ndarray) -> None:
    """To out, zeros, how many of the cuts each draw has reached; few draws reach the fourth and are looked at alone."""
    flag = np.empty(h.shape, bool)
    for c in cuts[:3]:
        np.greater_equal(h, np.uint32(c), out=flag)
        np.add(out, flag.view(np.uint8), out=out)
    far = np.nonzero(np.greater_equal(h, np.uint32(cuts[3]), out=flag))
    drawn = h[far]
    out[far] += sum((drawn >= np.uint32(c)).astype(np.uint8) for c in cuts[3:])


def _dealt(rows: DataFrame, value: str, unit: str, by: tuple = ()) -> DataFrame:
    """rows with _b, _salt: buckets in the order of value. A value that has a bucket's share of the rows is a bucket of its
    own, an odd number, whose rows are dealt further by unit; others hold about as many rows each.

    There are only as many buckets as leave a group FILLED rows in each, since a bucket leaves its replicates' numbers."""
    n = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = F.approx_count_distinct(F.struct(*by)) if by else F.lit(1)
    every = F.least(F.lit(n), F.ceil(F.lit(n * FILLED) * groups / F.greatest(F.count("*"), F.lit(1))))  # cuts of which one is kept
    bounds = rows.agg(F.percentile_approx(value, F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000).alias("_c"), every.cast("long").alias("_every"), F.count("*").alias("_n"))  # one row of n - 1 numbers
    bounds = bounds.withColumn("_c", F.filter("_c", lambda c, i: (i + 1) % F.col("_every") == 0))
    at = rows.crossJoin(F.broadcast(bounds))
    at = at.withColumn("_below", passed(F.col("_c"), F.col(value), n - 1, equal=False))
    at = at.withColumn("_same", passed(F.col("_c"), F.col(value), n - 1) - F.col("_below"))
    salt = F.pmod(F.xxhash64(unit), F.ceil(F.col("_same") * F.col("_every") / n * F.col("_n") / SALTED).cast("long"))
    return at.select(*rows.columns, (2 * F.col("_below") + (F.col("_same") > 1).cast("int")).alias("_b"), F.when(F.col("_same") > 1, salt).otherwise(F.lit(0)).cast("int").alias("_salt"))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by keys into as many parts as a shuffle has, however few bytes they are: a row costs n_boot draws. Parts
    are some times as many as cores, since buckets fall into them unevenly."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


class _Pairs:
    """Weights of the true (p), of the false (q), and pairs that the true win (u), added up in rising order of value: for each
    of ``sets`` of rows, which may share rows."""

    def __init__(self, sets: int, n_boot: int):
        self.p, self.q, self.twice, self.vp, self.vq = (np.zeros((sets, n_boot)) for _ in range(5))
        self.value: list = [None] * sets

    def add(self, i: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Rows of set i in rising order of x, from its last value on, with their weights: at most some thousand rows."""
        if not len(x):
            return
        of = lambda rows: w[rows].sum(0, dtype=np.int64)
        neg, pos = np.flatnonzero(~y), np.flatnonzero(y)
        below, upto = np.searchsorted(x[neg], x[pos], "left"), np.searchsorted(x[neg], x[pos], "right")
        q = np.zeros((len(neg) + 1, w.shape[1]), np.int32)
        np.cumsum(w[neg], axis=0, out=q[1:])
        won = q[below]
        won += q[upto] if (below != upto).any() else won
        won *= w[pos]
        p = of(pos)
        self.twice[i] += won.sum(0, dtype=np.int64) + 2 * p * self.q[i]
        again = self.value[i] == x[0]
        if again:  # pairs within the value that goes on
            self.twice[i] += self.vp[i] * of(neg[x[neg] == x[0]]) - of(pos[x[pos] == x[0]]) * self.vq[i]
        self.p[i] += p
        self.q[i] += q[-1]
        goes_on = again and x[0] == x[-1]
        self.vp[i] = of(pos[x[pos] == x[-1]]) + (self.vp[i] if goes_on else 0)
        self.vq[i] = of(neg[x[neg] == x[-1]]) + (self.vq[i] if goes_on else 0)
        self.value[i] = x[-1]

    def band(self, x: np.ndarray, y: np.ndarray, t: np.ndarray, w: np.ndarray, edges: np.ndarray) -> None:
        """Rows as in add(), to the last set all of them, to the others their bands: how many of the edges, each a number or
        one for each replicate, t has reached. Only rows between an edge's ends have other bands in other replicates."""
        last = len(edges) + 1
        self.add(last, x, y, w)
        low, high = ((t >= e[:, None]).sum(0) for e in (edges.max(1), edges.min(1)))
        moving = np.flatnonzero(low < high)
        band = (t[moving, None, None] >= edges).sum(1) if len(moving) else None
        for k in range(last):
            rows = np.flatnonzero((low <= k) & (k <= high))
            own = w[rows]
            if len(moving):
                own[low[rows] < high[rows]] *= (band == k)[(low[moving] <= k) & (k <= high[moving])]
            self.add(k, x[rows], y[rows], own)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.p.tobytes(), self.q.tobytes(), (self.twice / 2).tobytes()


def _whole(pdf: pd.DataFrame, shape: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, u) of a group from its buckets; the parts of a single value's bucket are added up first."""
    p, q, u = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for b, part in pdf.sort_values("_b").groupby("_b"):
        bp, bq, bu = (sum(np.frombuffer(x).reshape(shape) for x in part[c]) for c in ("p", "q", "u"))
        u += (bp * bq / 2 if b % 2 else bu) + bp * q
        p += bp
        q += bq
    return p, q, u


def _head(rows: DataFrame, by: tuple) -> str:
    return "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)


def _keyed(key, by: tuple, *values) -> list:
    return [(*[key[c] for c in by], *values)]


def auroc_replicates(rows: DataFrame, by: tuple, n_boot: int, seed, unit: str, score: str, label: str, draw: str = "md5") -> DataFrame:
    """(by, b, auroc), a row for each replicate that has both classes. A unit's weights are the same in every group."""
    kept = rows.select(*by, F.col(score).cast("double").alias("_s"), F.col(label).cast("boolean").alias("_y"), F.col(unit).cast("string").alias("_u")).dropna(subset=["_s", "_y", "_u"])  # NaN too

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        key, pdf, got = pdf.iloc[0], pdf.sort_values("_s", kind="stable"), _Pairs(1, n_boot)
        for a in range(0, len(pdf), CHUNK):
            part = pdf.iloc[a : a + CHUNK]
            got.add(0, part["_s"].to_numpy(), part["_y"].to_numpy(bool), weights(part["_u"], n_boot, seed, draw))
        return pd.DataFrame(_keyed(key, by, int(key["_b"]), *got.packed()), columns=[*by, "_b", "p", "q", "u"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, u = _whole(pdf, (n_boot,))
        ok = np.flatnonzero((p > 0) & (q > 0))
        out = pd.DataFrame({"b": (ok + 1).astype(np.int32), "auroc": u[ok] / (p[ok] * q[ok])})
        for c in reversed(by):
            out.insert(0, c, [pdf[c].iloc[0]] * len(out))
        return out

    sums = _spread(_dealt(kept, "_s", "_u", by), *by, "_b", "_salt").groupBy(*by, "_b", "_salt").applyInPandas(bucket, _head(kept, by) + "_b int, p binary, q binary, u binary")
    return sums.groupBy(*by).applyInPandas(joined, _head(kept, by) + "b int, auroc double")


def interval(values: DataFrame, value: str, by: tuple = (), alpha: float = 0.05) -> DataFrame:
    """(by, lo, hi, n_boot): percentile interval over replicates that have a value."""
    cuts = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))  # of as many values as replicates
    return values.where(F.col(value).isNotNull()).groupBy(*by).agg(cuts.alias("_c"), F.count("*").alias("n_boot")).select(*by, F.col("_c")[0].alias("lo"), F.col("_c")[1].alias("hi"), "n_boot")


def side_gaps(aurocs: DataFrame, side: str, by: tuple) -> DataFrame:
    """(by, auroc_a, auroc_b, gap) of the AUROCs of two sides: that where side is true less that where it is false."""
    both = aurocs.groupBy(*by).agg(F.max(F.when(F.col(side), F.col("auroc"))).alias("auroc_a"), F.max(F.when(~F.col(side), F.col("auroc"))).alias("auroc_b"))
    return both.withColumn("gap", F.col("auroc_a") - F.col("auroc_b"))


def auroc_ci(rows: DataFrame, by: tuple = (), n_boot: int = 1000, seed=0, unit: str = "item_id", score: str = "score", label: str = "truth", draw: str = "md5") -> DataFrame:
    point = auroc(rows, by, score, label)
    ci = interval(auroc_replicates(rows, by, n_boot, seed, unit, score, label, draw), "auroc", by)
    return point.join(ci, list(by), "left") if by else point.crossJoin(ci)


def gap_ci(rows: DataFrame, side: str, by: tuple = (), n_boot: int = 1000, seed=0, unit: str = "item_id", score: str = "score", label: str = "truth", draw: str = "md5") -> DataFrame:
    """AUROC where side is true less AUROC where it is false, the sides drawn independently: (by, auroc_a, auroc_b, gap, lo, hi)."""
    point = side_gaps(auroc(rows, (*by, side), score, label), side, by)
    reps = side_gaps(auroc_replicates(rows, (*by, side), n_boot, seed, unit, score, label, draw), side, (*by, "b"))
    ci = interval(reps, "gap", by)
    return point.join(ci, list(by)) if by else point.crossJoin(ci)


def paired_ci(rows: DataFrame, score_a: str, score_b: str, n_boot: int = 1000, seed=0, unit: str = "item_id", label: str = "truth") -> DataFrame:
    """AUROC(a) less AUROC(b) on the same draws, with a verdict."""
    long = rows.select(unit, label, F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col(score_a).cast("double").alias("score")), F.struct(F.lit(False).alias("first"), F.col(score_b).cast("double").alias("score")))).alias("s")).select(unit, label, "s.first", "s.score")
    got = gap_ci(long, "first", (), n_boot, seed, unit, "score", label)
    return got.withColumn("verdict", F.when(F.col("lo") > 0, "BEATS").when(F.col("hi") < 0, "loses").otherwise("tie"))


def clustered_spearman(rows: DataFrame, x: str, y: str, cluster: str, n_boot: int = 1000, seed=0) -> DataFrame:
    """rho with an interval over draws of clusters; a cluster drawn w times counts w times."""
    drawn = replicates(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), n_boot, seed, cluster)
    many = drawn.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("w"))))
    return spearman(rows, x, y).crossJoin(interval(spearman(many, x, y, ("b",)), "rho"))


def pearson_ci(rows: DataFrame, x: str, y: str, unit: str, n_boot: int = 1000, seed=0) -> DataFrame:
    drawn = replicates(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), n_boot, seed, unit)
    many = drawn.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("w"))))
    return rows.agg(F.corr(x, y).alias("r"), F.count("*").alias("n")).crossJoin(interval(many.groupBy("b").agg(F.corr(x, y).alias("r")), "r"))


def _banded(rows: DataFrame, typicality: str, n_bands: int, by: tuple, weight: str | None) -> DataFrame:
    """rows with band: how many inner quantile edges of its group's typicality are not above its own."""
    edges = quantiles(rows, typicality, tuple(i / n_bands for i in range(1, n_bands)), by, weight)
    edges = edges.select(*[F.col(c).alias(f"_e_{c}") for c in by], F.array(*[f"q{i}" for i in range(n_bands - 1)]).alias("_e"))
    alike = F.lit(True)
    for c in by:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    got = rows.join(F.broadcast(staged(edges, "edges")), alike)  # a row for each replicate
    return got.withColumn("band", F.size(F.filter("_e", lambda e: e <= F.col(typicality)))).select(*rows.columns, "band")


def bands(rows: DataFrame, typicality: str, n_bands: int = 4, least: int = 5, score: str = "score", label: str = "truth", by: tuple = (), weight: str | None = None) -> DataFrame:
    """(by, band, n, n_pos, n_neg, auroc) within quantile bands of typicality; no AUROC below ``least`` rows of a class."""
    kept = rows.dropna(subset=[score, label, typicality])
    got = auroc(_banded(kept, typicality, n_bands, by, weight), (*by, "band"), score, label, weight)
    return got.select(*by, "band", (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", "n_neg", F.when(F.least("n_pos", "n_neg") >= least, F.col("auroc")).alias("auroc"))


def _replicate_edges(kept: DataFrame, qs: tuple, by: tuple, numbers: list, seed, draw: str) -> DataFrame:
    """(by, edges): for each group qs x replicates weighted quantiles of _t, packed; linear between the two next ranks.

    Buckets of values add up their rows' weights; their running sums tell in which bucket a rank of a replicate lies, and
    only there the rows are looked at again.
    """
    dealt, head, n, n_boot = staged(_dealt(kept, "_t", "_u", by), "dealt"), _head(kept, by), len(qs), len(numbers)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        key, w = pdf.iloc[0], np.zeros(n_boot, np.int64)
        for a in range(0, len(pdf), CHUNK):
            w += weights(pdf["_u"].iloc[a : a + CHUNK], numbers, seed, draw).sum(0, dtype=np.int64)
        return pd.DataFrame(_keyed(key, by, int(key["_b"]), float(key["_t"]), w.tobytes()), columns=[*by, "_b", "_t", "w"])

    def asked(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows (by, _b, slots, ranks, values): ranks within a bucket that edges need; values where the bucket is one value."""
        numbers, first = np.unique(pdf["_b"].to_numpy(), return_index=True)
        one = pdf["_t"].to_numpy()[first]
        w = np.stack([sum(np.frombuffer(x, np.int64) for x in pdf["w"][(pdf["_b"] == b).to_numpy()]) for b in numbers])
        upto = np.cumsum(w, axis=0)
        at = np.array(qs)[:, None] * np.maximum(upto[-1] - 1, 0)
        ranks = np.stack([np.floor(at), np.ceil(at)]).astype(np.int64).reshape(-1, n_boot)
        out = []
        place = np.minimum((upto[None] <= ranks[:, None]).sum(1), len(numbers) - 1)
        for i in np.unique(place):
            slots = np.flatnonzero(place.ravel() == i)
            inside = ranks.ravel()[slots] - (upto[i] - w[i])[slots % n_boot]
            out += _keyed(pdf.iloc[0], by, int(numbers[i]), slots.tobytes(), inside.tobytes(), np.full(len(slots), one[i]).tobytes() if numbers[i] % 2 else None)
        return pd.DataFrame(out, columns=[*by, "_b", "slots", "ranks", "found"])

    def found(rows: pd.DataFrame, need: pd.DataFrame) -> pd.DataFrame:
        if not len(need) or not len(rows):
            return pd.DataFrame([], columns=[*by, "slots", "found"])
        rows, key = rows.sort_values("_t", kind="stable"), need.iloc[0]
        slots, ranks = np.frombuffer(key["slots"], np.int64), np.frombuffer(key["ranks"], np.int64)
        values, base, t = np.full(len(slots), rows["_t"].iloc[-1]), np.zeros(n_boot, np.int64), rows["_t"].to_numpy()
        left = np.arange(len(slots))
        for a in range(0, len(rows), CHUNK):
            upto = base + np.cumsum(weights(rows["_u"].iloc[a : a + CHUNK], numbers, seed, draw), axis=0, dtype=np.int64)
            here = left[ranks[left] < upto[-1, slots[left] % n_boot]]
            for c in range(0, len(here), 1024):
                h = here[c : c + 1024]
                values[h] = t[a + (upto[:, slots[h] % n_boot] > ranks[h]).argmax(0)]
            left, base = np.setdiff1d(left, here), upto[-1]
        return pd.DataFrame(_keyed(key, by, slots.tobytes(), values.tobytes()), columns=[*by, "slots", "found"])

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        flat, total = np.zeros(2 * n * n_boot), np.zeros(n_boot)
        for slots, values in zip(pdf["slots"], pdf["found"]):
            if slots is None:
                total = np.frombuffer(values)
            else:
                flat[np.frombuffer(slots, np.int64)] = np.frombuffer(values)
        low, high = flat.reshape(2, n, n_boot)
        at = np.array(qs)[:, None] * np.maximum(total - 1, 0)
        return pd.DataFrame(_keyed(pdf.iloc[0], by, (low + (high - low) * (at - np.floor(at))).tobytes()), columns=[*by, "edges"])

    def size(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(x, np.int64) for x in pdf["w"]).astype(float)
        return pd.DataFrame(_keyed(pdf.iloc[0], by, None, whole.tobytes()), columns=[*by, "slots", "found"])

    sums = staged(_spread(dealt, *by, "_b", "_salt").groupBy(*by, "_b", "_salt").applyInPandas(total, head + "_b int, _t double, w binary"), "sums")
    need = staged(sums.groupBy(*by).applyInPandas(asked, head + "_b int, slots binary, ranks binary, found binary"), "need")
    pair = head + "slots binary, found binary"
    open_ = need.where("found is null")
    looked = _spread(dealt.where("_b % 2 = 0"), *by, "_b").groupBy(*by, "_b").cogroup(_spread(open_, *by, "_b").groupBy(*by, "_b")).applyInPandas(found, pair)
    every = looked.unionByName(need.where("found is not null").select(*by, "slots", "found")).unionByName(sums.groupBy(*by).applyInPandas(size, pair))
    return every.groupBy(*by).applyInPandas(edges, head + "edges binary")


def _shared_edges(kept: DataFrame, qs: tuple, by: tuple, numbers: list, seed, draw: str) -> DataFrame:
    """_replicate_edges(), once for all groups whose rows have the same units and _t, such as the scores of several probes.
    Such groups are told by their number of rows and two sums of 64-bit hashes."""
    hashes = [F.sum(F.xxhash64("_u", "_t", F.lit(i)).cast("decimal(38,0)")).cast("string") for i in range(2)]
    alike = kept.groupBy(*by).agg(F.concat_ws(":", F.count("*").cast("string"), *hashes).alias("_like"))
    alike = staged(alike, "alike")  # a row for each group
    first = alike.groupBy("_like").agg(F.min(F.struct(*by)).alias("_by")).select("_like", "_by.*") if by else alike
    rows = meet(kept.select(*by, "_u", "_t"), F.broadcast(first), by).select("_like", "_u", "_t")
    edges = staged(_replicate_edges(rows, qs, ("_like",), numbers, seed, draw), "edges")
    return meet(alike, edges, ("_like",)).select(*by, "edges")


def _guessed(kept: DataFrame, qs: tuple, by: tuple, sigmas: float = 4.0) -> DataFrame:
    """(by, edges, tied): an array of qs quantiles of _t, and whether each is a value that so many rows share that all
    replicates but few have it too: its first and last ranks are ``sigmas`` deviations of a replicate's rank away."""
    point = quantiles(kept, "_t", qs, by).withColumnRenamed("n", "_n")
    names = [f"q{i}" for i in range(len(qs))]
    point = staged(point, "point")  # a row for each group
    sides = [f(F.col("_t"), F.col(c)) for c in names for f in (lambda t, e: F.count_if(t < e), lambda t, e: F.count_if(t == e))]
    counts = meet(kept.select(*by, "_t"), F.broadcast(point), by).groupBy(*by).agg(F.array(*sides).alias("_k"))
    tied = F.lit(True)
    for i, q in enumerate(qs):
        rank, below, far = q * (F.col("_n") - 1), F.col("_k")[2 * i], sigmas * F.sqrt(F.col("_n") * q * (1 - q))
        tied = tied & (below + far < rank) & (rank + 1 + far < below + F.col("_k")[2 * i + 1])
    return meet(point, counts, by).select(*by, F.array(*names).alias("edges"), F.coalesce(tied, F.lit(False)).alias("tied"))


def _banded_sums(kept: DataFrame, edges: DataFrame, n_bands: int, by: tuple, numbers: list, seed, draw: str) -> DataFrame:
    """(by, _b, p, q, u, at): sums of the buckets of _s for each band and for all rows; at: weights of the rows at each edge,
    where edges are the same in all replicates. edges: (by, edges), packed for each edge and replicate, or an array of edges."""
    dealt, head, n_boot = staged(_dealt(kept, "_s", "_u", by), "dealt"), _head(kept, by), len(numbers)
    where = staged(dealt.select(*by, "_b", "_salt").distinct(), "buckets")
    sent = meet(where, edges, by)  # the edges of a group for each of its buckets

    def bucket(rows: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        if not len(cut):
            return pd.DataFrame([], columns=[*by, "_b", "p", "q", "u", "at"])
        key, rows, got = rows.iloc[0], rows.sort_values("_s", kind="stable"), _Pairs(n_bands + 1, n_boot)
        e = cut["edges"].iloc[0]
        e = (np.frombuffer(e) if isinstance(e, bytes) else np.asarray(e, float)).reshape(n_bands - 1, -1)
        fixed = e.shape[1] == 1
        at = np.zeros((n_bands - 1 if fixed else 0, n_boot))
        for a in range(0, len(rows), CHUNK):
            part = rows.iloc[a : a + CHUNK]
            w, t = weights(part["_u"], numbers, seed, draw), part["_t"].to_numpy()
            got.band(part["_s"].to_numpy(), part["_y"].to_numpy(bool), t, w, e)
            for i in range(len(at)):
                at[i] += w[t == e[i, 0]].sum(0, dtype=np.int64)
        return pd.DataFrame(_keyed(key, by, int(key["_b"]), *got.packed(), at.tobytes()), columns=[*by, "_b", "p", "q", "u", "at"])

    keys = (*by, "_b", "_salt")
    return _spread(dealt, *keys).groupBy(*keys).cogroup(_spread(sent, *keys).groupBy(*keys)).applyInPandas(bucket, head + "_b int, p binary, q binary, u binary, at binary")


def _gaps(sums: DataFrame, n_bands: int, least: int, by: tuple, numbers: list) -> DataFrame:
    """(by, b, gap, sure) of _banded_sums(). sure: the edges are those of the replicate; there is no gap where they are not."""
    n_boot = len(numbers)
    qs = np.arange(1, n_bands)[:, None] / n_bands

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, u = _whole(pdf, (n_bands + 1, n_boot))
        with np.errstate(divide="ignore", invalid="ignore"):
            auc, n = u / (p * q), p + q
        ok = np.minimum(p, q) >= least
        ok[-1] = np.minimum(p, q)[-1] > 0
        weight = np.where(ok[:-1], n[:-1], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = auc[-1] - (weight * np.where(ok[:-1], auc[:-1], 0)).sum(0) / weight.sum(0)
        whole, sure = ok[-1] & ok[:-1].any(0), np.ones(n_boot, bool)
        if len(pdf["at"].iloc[0]):
            at = sum(np.frombuffer(x).reshape(n_bands - 1, n_boot) for x in pdf["at"])
            rank, below = qs * np.maximum(n[-1] - 1, 0), np.cumsum(n[:-1], axis=0)[:-1]
            sure = ((below <= np.floor(rank)) & (np.ceil(rank) < below + at)).all(0)
        at = np.flatnonzero(whole | ~sure)
        out = pd.DataFrame({"b": np.array(numbers, np.int32)[at], "gap": np.where(sure, gap, np.nan)[at], "sure": sure[at]})
        for c in reversed(by):
            out.insert(0, c, [pdf[c].iloc[0]] * len(out))
        return out

    return sums.groupBy(*by).applyInPandas(joined, _head(sums, by) + "b int, gap double, sure boolean")


def stratified_replicates(kept: DataFrame, n_bands: int, least: int, by: tuple, n_boot: int, seed, draw: str) -> DataFrame:
    """(by, b, gap) of rows (by, _u, _s, _y, _t): pooled AUROC less that within bands, whose edges each replicate draws anew."""
    qs, every = tuple(i / n_bands for i in range(1, n_bands)), list(range(1, n_boot + 1))
    guess = staged(_guessed(kept, qs, by), "guess")

    def drawn(rows: DataFrame, numbers: list) -> DataFrame:
        edges = _shared_edges(rows, qs, by, numbers, seed, draw)
        return _gaps(_banded_sums(rows, edges, n_bands, by, numbers, seed, draw), n_bands, least, by, numbers).select(*by, "b", "gap")

    def of(groups: DataFrame) -> DataFrame:
        return meet(kept, F.broadcast(groups.select(*by)), by) if by else kept

    kinds = {r["tied"] for r in guess.select("tied").distinct().collect()}
    if True not in kinds:
        return drawn(kept, every)
    tied = guess.where("tied")
    told = staged(_gaps(_banded_sums(of(tied), tied.select(*by, "edges"), n_bands, by, every, seed, draw), n_bands, least, by, every), "told")
    got = told.where("sure").select(*by, "b", "gap")
    if False in kinds:
        got = got.unionByName(drawn(of(guess.where("not tied")), every))
    missed = told.where("not sure").select(*by, "b")
    numbers = sorted(r["b"] for r in missed.select("b").distinct().collect())  # of replicates
    if numbers:
        got = got.unionByName(meet(drawn(of(missed.select(*by).distinct()), numbers), missed, (*by, "b")))
    return got


def stratified(rows: DataFrame, typicality: str, n_bands: int = 4, least: int = 5, n_boot: int = 1000, seed=0, unit: str = "item_id", score: str = "score", label: str = "truth", by: tuple = (), draw: str = "md5") -> DataFrame:
    """(by, pooled, within, n_usable, gap, lo, hi, n_boot): pooled AUROC, mean AUROC within bands weighted by their rows, and
    their difference with an interval over draws for each of which edges and bands are made anew.

    Rows are never multiplied by replicates. Rows with a null are left out; groups without rows give none.
    """
    kept = rows.select(*by, F.col(unit).cast("string").alias("_u"), F.col(score).cast("double").alias("_s"), F.col(label).cast("boolean").alias("_y"), F.col(typicality).cast("double").alias("_t"))
    kept = staged(kept.dropna(subset=["_u", "_s", "_y", "_t"]), "scored")
    inner = bands(kept, "_t", n_bands, least, "_s", "_y", by).where("auroc is not null")
    inner = inner.groupBy(*by).agg((F.sum(F.col("n") * F.col("auroc")) / F.sum("n")).alias("within"), F.count("*").alias("n_usable"))
    whole = auroc(kept, by, "_s", "_y").select(*by, F.col("auroc").alias("pooled"))
    point = meet(whole, inner, by).withColumn("gap", F.col("pooled") - F.col("within"))
    return meet(point, interval(stratified_replicates(kept, n_bands, least, by, n_boot, seed, draw), "gap", by), by)


def spearman_floors(pairs: DataFrame, cluster: str = "model", floors: tuple = (0.0, 0.85, 0.9), n_boot: int = 4000, seed=0) -> DataFrame:
    """(floor, rho, n, lo, hi, n_boot): clustered_spearman() of in_dist and off at or above each floor."""
    out = None
    for f in floors:
        one = clustered_spearman(pairs.where(F.col("in_dist") >= f), "in_dist", "off", cluster, n_boot, seed).withColumn("floor", F.lit(float(f)))
        out = one if out is None else out.unionByName(one)
    return out
