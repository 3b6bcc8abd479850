"""Fitted probes, one for each group: logistic probes by Newton steps over sums, folds, cross-fitting, erasure.

A Newton step adds up gradient and curvature of every group on the executors (one pass, no shuffle of rows) and solves
the small systems on the driver: groups x dimensions^2 numbers, whatever the number of rows. A row trains the models of
several folds or replicates by being listed under each of their keys, which no exchange carries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from probelens.functions.draws import hash_fold, meet, uniform
from probelens.functions.scalars import dot, sigmoid
from probelens.functions.stage import staged
from probelens.operators.cells import halves
from probelens.operators.ladder import listed_rungs
from probelens.operators.linear import mediation
from probelens.operators.ranks import auroc, quantiles

SALTS = 32
#: dimensions up to which curvature is added up too
NEWTON = 512
#: numbers of directions that are sent to the executors: 64 MB
SENT = 8 << 20


def _totals(partials: DataFrame, by: tuple, schema: str) -> DataFrame:
    """Packed arrays added up for each group, in two levels. A task adds up many groups: no more than the driver gets."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for *key, _, packed in pdf.itertuples(index=False, name=None):
                key = tuple(None if v is None or v != v else v for v in key)  # pandas' missing values
                sums[key] = sums[key] + np.frombuffer(packed) if key in sums else np.frombuffer(packed)
        yield pd.DataFrame([(*k, 0, v.tobytes()) for k, v in sums.items()], columns=[*by, "salt", "sums"])

    once = partials.repartition(*by, "salt").mapInPandas(add, schema)
    return (once.repartition(*by) if by else once.repartition(1)).mapInPandas(add, schema)


def _off(u, d: int) -> np.ndarray:
    """The matrix that takes their part in the orthonormal u from d - 1 weights, and leaves the intercept."""
    keep = np.eye(d)
    if u is not None and len(u):
        keep[:-1, :-1] -= keep[:-1, :-1] if len(u) >= d - 1 else np.transpose(u) @ np.asarray(u)  # no rounding where nothing is left
    return keep


def logistic(train: DataFrame, by: tuple = ("layer",), label: str = "truth", vec: str = "vec", l2: float = 1.0, steps: int = 8, more: tuple = (), each: tuple = ((),), off: Callable | None = None) -> DataFrame:
    """(by, more, weights): L2-regularised logistic weights, the intercept last, of all rows with a label and a vector.

    Newton steps; vectors longer than NEWTON go by gradients alone. A row trains a model under each of the keys ``each``,
    whose fields are ``more``. off: a function from (by, more) to the orthonormal directions that the model's weights keep
    off, or None. Its fit is that of vectors without their part in these directions, none of which is rewritten.
    """
    spark = train.sparkSession
    one = train.where(F.col(vec).isNotNull()).select(F.size(vec).alias("n")).first()
    if one and one["n"] > NEWTON:
        return logistic_by_gradients(train, by, label, vec, l2, more=more, each=each, off=off) if off else logistic_by_gradients(train, by, label, vec, l2)
    rows = train.select(*by, F.col(label).cast("double").alias("_y"), F.col(vec).cast("array<double>").alias("_x")).where("_y is not null and _x is not null")
    keys = [*[rows.schema[c] for c in by], *more]
    names = tuple(f.name for f in keys)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["salt int", "sums binary"])
    weights: dict[tuple, np.ndarray] = {}
    for _ in range(steps):

        def partial(batches: Iterator[pd.DataFrame], w=weights) -> Iterator[pd.DataFrame]:
            sums: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for key, part in pdf.groupby(list(by), sort=False, dropna=False) if by else [((), pdf)]:
                    x, y = np.column_stack([np.stack(part["_x"].to_numpy()), np.ones(len(part))]), part["_y"].to_numpy()
                    for one in ((*key, *e) for e in each):
                        p = 1 / (1 + np.exp(-np.clip(x @ w.get(one, np.zeros(x.shape[1])), -30, 30)))
                        got = np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
                        sums[one] = sums[one] + got if one in sums else got
            salt = TaskContext.get().partitionId() % SALTS
            yield pd.DataFrame([(*k, salt, v.tobytes()) for k, v in sums.items()], columns=[*names, "salt", "sums"])

        merged = _totals(rows.mapInPandas(partial, schema), names, schema).collect()  # a row for each model
        after = {}
        for r in merged:
            key, s = tuple(r[c] for c in names), np.frombuffer(r["sums"])
            d = int((np.sqrt(4 * len(s) + 1) - 1) / 2)
            w, ridge = weights.get(key, np.zeros(d)), np.diag([l2] * (d - 1) + [1e-6])
            g, h = s[:d], s[d:].reshape(d, d)
            if off:
                keep = _off(off(key), d)
                g, h = keep @ g, keep @ h @ keep
            after[key] = w + np.linalg.solve(h + ridge, g - ridge @ w)
        settled = all(np.allclose(after[k], weights[k], atol=1e-9) for k in after) if weights else not after
        weights = after
        if settled:
            break
    return spark.createDataFrame([(*k, w.tolist()) for k, w in weights.items()], StructType([*keys, StructField("weights", ArrayType(DoubleType()))]))


def _direction(g: np.ndarray, pairs: list) -> np.ndarray:
    """Minus the gradient under the curvature that the last steps have shown (L-BFGS)."""
    q, kept = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(kept)):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def logistic_by_gradients(train: DataFrame, by: tuple = ("layer",), label: str = "truth", vec: str = "vec", l2: float = 1.0, steps: int = 200, tol: float = 1e-7, memory: int = 8, more: tuple = (), each: tuple = ((),), off: Callable | None = None) -> DataFrame:
    """logistic() for thousands of dimensions: a pass sends loss and gradient of each group to the driver, dimensions + 2
    numbers, and the next point of the groups that still move back. All groups step in the same passes.

    Ends where no gradient is above tol, or after ``steps`` passes.
    """
    spark = train.sparkSession
    rows = train.select(*by, F.col(label).cast("double").alias("_y"), F.col(vec).cast("array<double>").alias("_x")).where("_y is not null and _x is not null")
    keys = [*[rows.schema[c] for c in by], *more]
    names = tuple(f.name for f in keys)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["salt int", "sums binary"])
    at: dict[tuple, dict] = {}
    trial: dict[tuple, np.ndarray] | None = None
    for _ in range(steps):
        sent = spark.sparkContext.broadcast(trial)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for key, part in pdf.groupby(list(by), sort=False, dropna=False) if by else [((), pdf)]:
                    moving = [one for one in ((*key, *e) for e in each) if sent.value is None or one in sent.value]  # others have settled
                    if not moving:
                        continue
                    x, y = np.column_stack([np.stack(part["_x"].to_numpy()), np.ones(len(part))]), part["_y"].to_numpy()
                    for one in moving:
                        z = x @ (sent.value[one] if sent.value is not None else np.zeros(x.shape[1]))
                        got = np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], x.T @ (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)])
                        sums[one] = sums[one] + got if one in sums else got
            salt = TaskContext.get().partitionId() % SALTS
            yield pd.DataFrame([(*k, salt, v.tobytes()) for k, v in sums.items()], columns=[*names, "salt", "sums"])

        moves = {}
        for r in _totals(rows.mapInPandas(partial, schema), names, schema).collect():  # a row for each model that moves
            key, got = tuple(r[c] for c in names), np.frombuffer(r["sums"])
            ridge = np.append(np.full(len(got) - 2, l2), 1e-6)
            own = at.setdefault(key, {"w": np.zeros(len(ridge)), "f": np.inf, "pairs": [], "t": 1.0, "p": None})
            w = trial[key] if trial is not None else own["w"]
            f, g = got[0] + 0.5 * (ridge * w) @ w, got[1:] + ridge * w
            if off and (u := off(key)) is not None and len(u):
                g[:-1] -= g[:-1] if len(u) >= len(g) - 1 else np.transpose(u) @ (np.asarray(u) @ g[:-1])
            if own["p"] is None or f <= own["f"] + 1e-4 * own["t"] * (own["g"] @ own["p"]) + 1e-12 * abs(own["f"]):
                if own["p"] is not None:
                    s, y = w - own["w"], g - own["g"]
                    if s @ y > 1e-14:
                        own["pairs"] = [*own["pairs"], (s, y)][-memory:]
                own.update(w=w, f=f, g=g, p=_direction(g, own["pairs"]), t=1.0 if own["pairs"] else 1 / max(1.0, np.linalg.norm(g)))
                if np.abs(g).max() <= tol:
                    continue
            else:
                own["t"] /= 2
                if own["t"] < 1e-12:
                    continue
            moves[key] = own["w"] + own["t"] * own["p"]
        sent.unpersist()
        trial = moves
        if not moves:
            break
    return spark.createDataFrame([(*k, v["w"].tolist()) for k, v in at.items()], StructType([*keys, StructField("weights", ArrayType(DoubleType()))]))


def with_scores(rows: DataFrame, models: DataFrame, by: tuple = ("layer",), vec: str = "vec", out: str = "score") -> DataFrame:
    """rows with the probability under their group's model; rows of a group without one go. Models, which the driver has
    held, are sent to the rows: a shuffle by group would bring all of a group's rows to one task."""
    n = F.size("weights")
    score = sigmoid(dot(F.col(vec).cast("array<double>"), F.slice("weights", 1, n - 1)) + F.element_at("weights", n))
    models = F.broadcast(models)
    joined = rows.join(models, list(by)) if by else rows.crossJoin(models)  # one model
    return joined.withColumn(out, score).drop("weights")


def _folded(rows: DataFrame, k: int, seed, key: str) -> DataFrame:
    return rows.withColumn("fold", hash_fold(seed, key, k))


def _fit_folds(rows: DataFrame, by: tuple, k: int, label: str, **options) -> DataFrame:
    """(by, fold, weights): the model of a fold has learnt from all other folds."""
    others = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(k - 1)), F.array("fold")))
    return logistic(rows.withColumn("fold", others), (*by, "fold"), label, **options)


def out_of_fold(rows: DataFrame, by: tuple = ("layer",), k: int = 5, seed=0, key: str = "item_id", label: str = "truth", **options) -> DataFrame:
    """rows with fold and score: every row is scored by the model that has not seen its fold."""
    rows = _folded(rows, k, seed, key)
    return with_scores(rows, _fit_folds(rows, by, k, label, **options), (*by, "fold"))


def fielded(rows: DataFrame, by: tuple = ("layer",), k: int = 5, seed=0, key: str = "item_id", label: str = "truth", **options) -> DataFrame:
    """rows with score: out of fold on the diagonal (TT, FA), the mean of all k models off it; models learn on the diagonal."""
    rows = _folded(rows, k, seed, key).withColumn("_diag", F.col("cell").isin("TT", "FA"))
    models = _fit_folds(rows.where("_diag"), by, k, label, **options)
    every = models.groupBy(*by).agg(F.collect_list(F.struct("fold", "weights")).alias("_m"))  # k models
    n = F.size(F.element_at("_m", 1)["weights"])
    x = F.col("vec").cast("array<double>")
    one = F.transform("_m", lambda m: F.struct(m["fold"].alias("fold"), sigmoid(dot(x, F.slice(m["weights"], 1, n - 1)) + F.element_at(m["weights"], n)).alias("p")))
    kept = F.filter("_p", lambda p: ~F.col("_diag") | (p["fold"] == F.col("fold")))
    mean = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["p"]) / F.size(kept)
    return rows.join(F.broadcast(every), list(by)).withColumn("_p", one).withColumn("score", mean).drop("_m", "_p", "_diag")


def cross_fitted(rows: DataFrame, by: tuple = ("layer",), k: int = 5, seed=0, key: str = "item_id", typicality: str = "logf", half: str | None = None, **options) -> DataFrame:
    """(by, half, n, recoverability, off_diagonal): what truth adds beyond typicality to out-of-fold scores of one half of
    every cell, and the AUROC off the diagonal of fielded scores on the other half. Halves are swapped; average over half.

    Halves are equal in every cell, by places in a seeded order; half: a column that has them already.
    """
    halved = rows.withColumnRenamed(half, "half") if half else halves(rows, f"{seed}:half", (*by, "cell"), key).withColumn("half", F.col("first_half").cast("int")).drop("first_half")
    by2 = (*by, "half")
    found = mediation(out_of_fold(halved, by2, k, seed, key, **options), by2, typicality=typicality).select(*by2, "n", F.col("beta_joint").alias("recoverability"))
    off = auroc(fielded(halved, by2, k, seed, key, **options).where(~F.col("cell").isin("TT", "FA")), by2)
    return found.join(off.select(*by, (1 - F.col("half")).cast("int").alias("half"), F.col("auroc").alias("off_diagonal")), list(by2))


def ladder(rows: DataFrame, rungs: tuple, reps: int = 5, by: tuple = ("layer",), seed=0, key: str = "item_id", design: str = "crossfit", typicality: str = "logf", **options) -> DataFrame:
    """(by, rung, rep, n, recoverability, off_diagonal) of logistic probes on nested rungs of n // 4 rows of each cell."""
    keys = (*by, "rung", "rep")
    drawn = staged(listed_rungs(rows, rungs, reps, design, seed, key), "rungs")
    if design == "same":
        found = mediation(out_of_fold(drawn, keys, seed=seed, key=key, **options), keys, typicality=typicality).select(*keys, "n", F.col("beta_joint").alias("recoverability"))
        off = auroc(fielded(drawn, keys, seed=seed, key=key, **options).where(~F.col("cell").isin("TT", "FA")), keys)
        return found.join(off.select(*keys, F.col("auroc").alias("off_diagonal")), list(keys), "left")
    got = cross_fitted(drawn, keys, seed=seed, key=key, typicality=typicality, half="half", **options)
    return got.groupBy(*keys).agg(F.sum("n").alias("n"), F.avg("recoverability").alias("recoverability"), F.avg("off_diagonal").alias("off_diagonal"))


def fit_stability(rows: DataFrame, replicates: int = 60, dropped: float = 0.1, by: tuple = ("layer",), seed=0, key: str = "item_id", **options) -> DataFrame:
    """(by, n, lo, mid, hi, sd) of the AUROC off the diagonal over refits on the diagonal that each leave out a tenth."""
    diag = F.col("cell").isin("TT", "FA")
    kept = rows.where(diag).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).where(uniform(seed, F.col("rep"), F.col(key)) >= dropped)
    models = logistic(kept, (*by, "rep"), **options)
    scores = with_scores(rows.where(~diag), models, by)
    q = F.percentile("auroc", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    got = auroc(scores, (*by, "rep")).groupBy(*by).agg(F.count("auroc").alias("n"), q.alias("_q"), F.stddev("auroc").alias("sd"))
    return got.select(*by, "n", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("mid"), F.col("_q")[2].alias("hi"), "sd")


def off_subspace(vec: Column, basis: Column, mean: Column | None = None) -> Column:
    """vec without its part in the orthonormal basis (an array of vectors); with mean, that part becomes mean's."""
    x = vec.cast("array<double>")
    shift = x if mean is None else F.zip_with(x, mean, lambda a, b: a - b)
    return F.aggregate(basis, x, lambda v, u: F.zip_with(v, u, lambda a, b: a - dot(shift, u) * b))


def null_directions(rows: DataFrame, rounds: int = 12, by: tuple = ("layer",), label: str = "typical", vec: str = "vec", **options) -> DataFrame:
    """(by, basis): orthonormal directions that told label, found one after another in what the earlier ones leave.

    The driver holds groups x rounds x dimensions numbers. A group in which label takes one value only has no direction of use.
    """
    basis: dict[tuple, list] = {}
    spark, keys = rows.sparkSession, [rows.schema[c] for c in by]
    schema = StructType([*keys, StructField("basis", ArrayType(ArrayType(DoubleType())))])

    def table() -> DataFrame:
        return spark.createDataFrame([(*k, b) for k, b in basis.items()], schema)

    for _ in range(rounds):
        for r in logistic(rows, by, label, vec, off=lambda key: basis.get(key), **options).collect():  # a row for each group
            key, w = tuple(r[c] for c in by), np.array(r["weights"][:-1])
            for _again in range(2):  # rounding leaves a little of the old directions in w
                for u in basis.get(key, []):
                    w = w - (w @ np.array(u)) * np.array(u)
            if len(basis.get(key, [])) < len(w) and np.linalg.norm(w) > 1e-8:
                basis.setdefault(key, []).append((w / np.linalg.norm(w)).tolist())
    return table()


def without(rows: DataFrame, bases: DataFrame, by: tuple = ("layer",), vec: str = "vec", numbers: int | None = None) -> DataFrame:
    """rows with vec less its part in its group's basis; rows of a group without one stay.

    numbers: how many numbers bases hold. Up to SENT of them, bases are sent to the rows, which then aren't shuffled.
    """
    if numbers is not None and numbers <= SENT:
        bases = F.broadcast(bases)
    kept = F.when(F.col("basis").isNull(), F.col(vec).cast("array<double>")).otherwise(off_subspace(F.col(vec), F.col("basis")))
    return meet(rows, bases, by, "left").withColumn(vec, kept).drop("basis")


def erase(rows: DataFrame, rounds: int = 12, by: tuple = ("layer",), label: str = "typical", vec: str = "vec", **options) -> DataFrame:
    """rows with vec projected off the directions that told label, found one after another (iterative null space)."""
    return without(rows, null_directions(rows, rounds, by, label, vec, **options), by, vec)


def erasure_study(rows: DataFrame, ks: tuple = (4, 8, 12, 16, 24), by: tuple = ("layer",), label: str = "typical", seed: int = 0, key: str = "item_id", steps: int = 4, **options) -> DataFrame:
    """(by, design, k, on, off, read): what is left of a probe and of label after k directions are erased from vec.

    on and off: AUROC of the fielded truth probe on and off the diagonal; read: how well label is told out of fold.
    Designs: none (k = 0); label, directions learnt on all rows; diagonal, learnt on the diagonal alone, where label and
    truth are one; random. The k directions are the first of one search, so they are nested; a group with fewer loses
    all it has. All designs and k are groups of the same fits: the number of jobs doesn't grow with them. A direction is
    searched for by ``steps`` Newton steps; the probes are fitted to their optimum.
    """
    rows = staged(rows.where("vec is not null and cell is not null").select(*by, key, "cell", "truth", label, "vec"), "vectors")
    d = rows.agg(F.max(F.size("vec"))).first()[0] or 0  # one number
    if not d:
        raise ValueError("there are no vectors")
    diag = F.col("cell").isin("TT", "FA")
    taught = rows.withColumn("design", F.explode(F.when(diag, F.array(F.lit("label"), F.lit("diagonal"))).otherwise(F.array(F.lit("label")))))
    found = null_directions(taught, min(d, max(ks)), (*by, "design"), label, steps=steps, **options).collect()  # a row for each group and design
    bases = {tuple(r[c] for c in (*by, "design")): r["basis"] for r in found}
    drawn, n = random_basis(d, min(d, max(ks)), seed), len(by)

    def off(key: tuple) -> list | None:  # of (by, target, fold, design, k)
        design, k = key[-2:]
        return (drawn if design == "random" else bases.get((*key[:n], design), []))[:k] if k else None

    each = (("none", 0), *[(design, k) for design in ("label", "diagonal", "random") for k in ks])
    more = (StructField("design", StringType()), StructField("k", IntegerType()))
    folded = _folded(rows.where(F.col("truth").isNotNull() | F.col(label).isNotNull()), 5, seed, key)
    targets = F.when(diag, F.array(F.lit("truth"), F.lit("read"))).otherwise(F.array(F.lit("read")))  # truth is learnt on the diagonal
    listed = folded.withColumn("target", F.explode(targets)).withColumn("_label", F.when(F.col("target") == "truth", F.col("truth").cast("double")).otherwise(F.col(label).cast("double")))
    models = _fit_folds(staged(listed.select(*by, "target", "fold", "_label", "vec"), "listed"), (*by, "target"), 5, "_label", more=more, each=each, off=off, **options)
    scored = staged(_told(folded.withColumn("_diag", diag), models, by, label, each), "scored")
    sides = auroc(scored, (*by, "design", "k", "measure"), label="label")
    side = lambda m: F.max(F.when(F.col("measure") == m, F.col("auroc"))).alias(m)
    both = F.max(F.col("measure") == "read") & F.max(F.col("measure") != "read")
    return sides.groupBy(*by, "design", "k").agg(side("on"), side("off"), side("read"), both.alias("_both")).where("_both").drop("_both")


def _told(rows: DataFrame, models: DataFrame, by: tuple, label: str, each: tuple) -> DataFrame:
    """rows of (by, fold, truth, label, vec, _diag) -> (by, design, k, measure, label, score), two for each of the keys ``each``:
    truth on or off the diagonal, fielded, and label (read) out of fold. A score is NaN where no model is."""
    found = models.collect()  # folds x keys for each group, which the driver has held
    sent = rows.sparkSession.sparkContext.broadcast({tuple(r[c] for c in (*by, "target", "fold", "design", "k")): np.array(r["weights"]) for r in found})
    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    rows = rows.select(*by, "fold", "_diag", F.col("truth").cast("boolean").alias("_t"), F.col(label).cast("boolean").alias("_l"), F.col("vec").cast("array<double>").alias("_x"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby(list(by), sort=False, dropna=False) if by else [((), pdf)]:
                x, fold, diag = np.column_stack([np.stack(part["_x"].to_numpy()), np.ones(len(part))]), part["fold"].to_numpy(), part["_diag"].to_numpy(bool)
                one = part[list(by)]
                for design, k in each:
                    p = {}
                    for target in ("truth", "read"):
                        w = [sent.value.get((*key, target, f, design, k)) for f in range(5)]
                        z = x @ np.column_stack([np.full(x.shape[1], np.nan) if v is None else v for v in w])
                        p[target] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    own = {t: v[np.arange(len(x)), fold] for t, v in p.items()}
                    n = np.isfinite(p["truth"]).sum(1)
                    truth = np.where(diag, own["truth"], np.nansum(p["truth"], 1) / np.where(n, n, np.nan))
                    yield one.assign(design=design, k=k, measure=np.where(diag, "on", "off"), label=part["_t"], score=truth)
                    yield one.assign(design=design, k=k, measure="read", label=part["_l"], score=own["read"])

    return rows.mapInPandas(told, head + "design string, k int, measure string, label boolean, score double")


def frequency_basis(rows: DataFrame, k: int = 4, value: str = "logf", vec: str = "vec", bins: int = 20) -> list[list[float]]:
    """The k main directions of the mean vectors of quantile bins of value: bins x dimensions numbers on the driver."""
    inner = [i / bins for i in range(1, bins)]
    edges = quantiles(rows, value, tuple(inner)).first()  # one row
    if edges is None:
        return []
    place = sum((F.when(F.col(value) >= edges[f"q{i}"], 1).otherwise(0) for i in range(len(inner))), F.lit(0))
    dims = rows.where(F.col(value).isNotNull()).select(place.alias("bin"), F.posexplode(vec).alias("pos", "x")).groupBy("bin", "pos").agg(F.avg("x").alias("m"))
    wide = dims.toPandas().pivot(index="bin", columns="pos", values="m").to_numpy()
    return np.linalg.svd(wide - wide.mean(0), full_matrices=False)[2][:k].tolist()


def random_basis(dimensions: int, k: int, seed: int = 0) -> list[list[float]]:
    """k orthonormal directions at random."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, k)))[0].T.tolist()


def eigen_score(samples: DataFrame, key: str = "item_id", vec: str = "vec", alpha: float = 1e-3) -> DataFrame:
    """(key, k, score): mean log eigenvalue of the centred Gram matrix of an item's k sampled vectors; null below two.
    The number of samples an item has is set by the sampling, so a group is small."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf[vec].to_numpy()).astype(float)
        z = z - z.mean(0)
        lam = np.linalg.eigvalsh(z @ z.T / len(z)).clip(0)
        return pd.DataFrame({key: pdf[key].iloc[:1], "k": [len(z)], "score": [float(np.log(lam + alpha).mean()) if len(z) > 1 else None]})

    return samples.where(F.col(vec).isNotNull()).select(key, vec).groupBy(key).applyInPandas(score, f"`{key}` {samples.schema[key].dataType.simpleString()}, k long, score double")


def eigen_scores(samples: DataFrame, by: tuple = ("item_id",), vec: str = "vec", alpha: float = 1e-3) -> DataFrame:
    """(by, k, score) like eigen_score(), from added second moments: a group is never collected, whatever its samples.

    The centred Gram matrix of k samples and the covariance of d dimensions have the same eigenvalues but for zeros; d^2
    numbers a group are added up, so this is for d below some hundreds, eigen_score() for long vectors and few samples.
    """
    rows = samples.where(F.col(vec).isNotNull()).select(*by, F.col(vec).cast("array<double>").alias("_x"))
    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = TaskContext.get().partitionId() % SALTS
        for pdf in batches:
            x = np.stack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, 0))
            code, _ = pd.factorize(pd.MultiIndex.from_frame(pdf[list(by)])) if len(by) > 1 else pd.factorize(pdf[by[0]], use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) > 0))) if len(pdf) else np.zeros(0, int)
            sums = []
            for a, b in zip(first, np.append(first[1:], len(pdf))):
                z = x[order[a:b]]
                sums.append(np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()]).tobytes())
            yield pdf[list(by)].iloc[order[first]].assign(salt=salt, sums=sums)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Items by the thousand: their matrices are solved together."""
        for pdf in batches:
            sums = [np.sum([np.frombuffer(b) for b in parts], axis=0) for parts in pdf["sums"]]
            ks, values = np.array([int(s[0]) for s in sums], np.int64), np.full(len(sums), None, object)
            for size in {len(s) for s in sums}:
                at = np.array([i for i, s in enumerate(sums) if len(s) == size and ks[i] > 1], int)
                if not len(at):
                    continue
                s, d = np.stack([sums[i] for i in at]), int((np.sqrt(4 * size - 3) - 1) / 2)
                k, m = s[:, 0], s[:, 1 : d + 1] / s[:, :1]
                lam = np.linalg.eigvalsh(s[:, d + 1 :].reshape(-1, d, d) / k[:, None, None] - m[:, :, None] * m[:, None]).clip(0)[:, ::-1]
                own = np.where(np.arange(d) < k[:, None], np.log(lam + alpha), 0).sum(1) + np.maximum(0, k - d) * np.log(alpha)
                values[at] = own / k
            yield pdf[list(by)].assign(k=ks, score=pd.Series(values, pdf.index).astype("float64"))

    parts = rows.mapInPandas(partial, head + "salt int, sums binary").groupBy(*by).agg(F.collect_list("sums").alias("sums"))  # as many as parts of the samples
    return parts.mapInPandas(score, head + "k long, score double").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
