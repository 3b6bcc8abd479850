"""How much of a probe's response is carried by a subspace: natural indirect over total effects, for nested subspaces at once.

A counterfactual takes a fooled row's part in span(u_1..u_k) to the reference cell's mean. With a linear response it
changes by the sum of (u_i x - u_i mean) (u_i w), so the running sum over i gives all k in one pass over the rows, and what
doesn't depend on the row is worked out once for each group. Groups (layers) are keys of one plan, not a loop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions.draws import meet
from probelens.functions.scalars import dot
from probelens.operators.assembled import moments
from probelens.operators.fitted import logistic, random_basis
from probelens.operators.ranks import quantiles

#: fooled cell and the cell of its truth that it is compared with: the error, and its control
CONTRASTS = (("FT", "FA"), ("TT", "TA"))
DOUBLES = "array<double>"


def standard(rows: DataFrame, by: tuple = ("layer",), vec: str = "vec") -> DataFrame:
    """rows with vec less its group's means, over its spreads; a spread under 1e-8 counts as 1."""
    z = F.zip_with(F.zip_with(F.col(vec).cast(DOUBLES), F.col("mean"), lambda x, a: x - a), F.col("sd"), lambda x, s: x / s)
    return meet(rows, moments(rows, vec, by), by).withColumn(vec, z).drop("mean", "sd")


def manifold(rows: DataFrame, k: int = 16, value: str = "logf", by: tuple = ("layer",), vec: str = "vec", bins: int = 20) -> DataFrame:
    """(by, basis): the main k orthonormal directions in which the mean vector of quantile bins of value moves, for each group.

    Edges are exact quantiles by running counts. A group's task holds bins x dimensions numbers. Rows without a value go.
    """
    kept = rows.where(F.col(value).isNotNull())
    edges = quantiles(kept, value, tuple(i / bins for i in range(1, bins)), by).select(*by, F.array(*[f"q{i}" for i in range(bins - 1)]).alias("_e"))
    binned = meet(kept, edges, by).withColumn("_bin", F.size(F.filter("_e", lambda e: e <= F.col(value))))
    means = moments(binned, vec, (*by, "_bin"))
    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)

    def main(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf.sort_values("_bin")["mean"].to_numpy())
        out = pdf[list(by)].iloc[:1].copy()
        out["basis"] = [np.linalg.svd(m - m.mean(0), full_matrices=False)[2][:k].tolist()]
        return out

    return means.groupBy(*by).applyInPandas(main, head + "basis array<array<double>>")


def axes(rows: DataFrame, k: int, by: tuple = ("layer",), vec: str = "vec") -> DataFrame:
    """(by, basis): the first k coordinates."""
    d = rows.groupBy(*by).agg(F.max(F.size(vec)).alias("_d"))
    unit = lambda i: F.transform(F.sequence(F.lit(0), F.col("_d") - 1), lambda j: F.when(i == j, 1.0).otherwise(0.0))
    return d.select(*by, F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_d")) - 1), unit).alias("basis"))


def random_subspaces(groups: DataFrame, dimensions: int, k: int, reps: int = 5, seed: int = 0) -> DataFrame:
    """(groups' columns, name, basis): the null, ``reps`` orthonormal subspaces at random, the same for every group."""
    drawn = [(f"random {r}", random_basis(dimensions, min(k, dimensions), seed + r)) for r in range(reps)]
    return groups.crossJoin(groups.sparkSession.createDataFrame(drawn, "name string, basis array<array<double>>"))


def nested_effects(rows: DataFrame, models: DataFrame, bases: DataFrame, ks: tuple = (1, 2, 4, 8, 16), by: tuple = ("layer",), contrasts: tuple = CONTRASTS, vec: str = "vec") -> DataFrame:
    """(by, name, fooled, k, total_effect, indirect_effect, fraction) between medians of the linear response.

    models: (by, weights), the intercept last. bases: (by, name, basis). A subspace of fewer than k directions counts whole.
    fraction is null where the total effect is within 1e-6 of 0. Medians are exact, by running counts of distinct values.
    """
    w, n = F.slice("weights", 1, F.size("weights") - 1), F.size("weights")
    refs = F.create_map(*[F.lit(x) for pair in contrasts for x in pair])
    scored = meet(rows.select(*by, "cell", F.col(vec).cast(DOUBLES).alias(vec)).dropna(subset=["cell", vec]), models, by).withColumn("f", dot(F.col(vec), w) + F.element_at("weights", n)).drop("weights")
    means = moments(rows, vec, (*by, "cell")).select(*by, F.col("cell").alias("ref"), "mean")
    fixed = meet(meet(bases, models, by), means, by)  # a row for each group, basis and cell
    fixed = fixed.select(*by, "name", "ref", "basis", F.transform("basis", lambda u: dot(u, w)).alias("_w"), F.transform("basis", lambda u: dot(u, F.col("mean"))).alias("_m"))
    fooled = scored.withColumn("ref", refs[F.col("cell")]).where(F.col("ref").isNotNull())
    at = meet(fooled, fixed, (*by, "ref"))
    at = at.withColumn("_s", F.transform("basis", lambda u, i: (dot(F.col(vec), u) - F.get("_m", i)) * F.get("_w", i))).drop("basis", "_m", "_w", vec)
    moved = lambda k: F.aggregate(F.slice("_s", 1, k), F.lit(0.0), lambda a, x: a + x)
    each = at.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("f") - moved(k)).alias("v")) for k in ks]))).select(*by, "name", F.col("cell").alias("fooled"), "ref", "_k.k", "_k.v")
    after = quantiles(each, "v", (0.5,), (*by, "name", "fooled", "ref", "k")).withColumnRenamed("q0", "_cf").drop("n")
    plain = quantiles(scored, "f", (0.5,), (*by, "cell")).drop("n")
    both = meet(after, plain.select(*by, F.col("cell").alias("fooled"), F.col("q0").alias("_f")), (*by, "fooled"))
    both = meet(both, plain.select(*by, F.col("cell").alias("ref"), F.col("q0").alias("_r")), (*by, "ref"))
    total, part = F.col("_f") - F.col("_r"), F.col("_f") - F.col("_cf")
    return both.select(*by, "name", "fooled", "k", total.alias("total_effect"), part.alias("indirect_effect"), F.when(F.abs(total) > 1e-6, part / total).alias("fraction"))


def subspace_run(acts: DataFrame, value: str = "logf", ks: tuple = (1, 2, 4, 8, 16), reps: int = 5, bins: int = 20, seed: int = 0, by: tuple = ("layer",), **options) -> DataFrame:
    """(by, k, error, null, control, total_effect): the fraction of the fielded probe's error (FT against FA) that the
    frequency manifold carries, the median fraction of random subspaces, and the manifold's for TT against TA.

    The probe is logistic, fitted on the standardised diagonal; acts have cell, truth, value and vec of one width.
    """
    z = standard(acts, by)
    models = logistic(z.where(F.col("cell").isin("TT", "FA")), by, **options)
    d = acts.agg(F.max(F.size("vec"))).first()[0] or 0  # one number
    if not d:
        raise ValueError("there are no vectors")
    main = manifold(z, max(ks), value, by, bins=bins).withColumn("name", F.lit("manifold")).select(*by, "name", "basis")
    null = random_subspaces(models.select(*by), d, max(ks), reps, seed)
    got = nested_effects(z, models, main.unionByName(null), ks, by)
    pick = lambda c, name, cell: F.max(F.when((F.col("name") == name) & (F.col("fooled") == cell), F.col(c)))
    drawn = F.when(F.col("name").startswith("random") & (F.col("fooled") == "FT"), F.col("fraction"))
    return got.groupBy(*by, "k").agg(pick("fraction", "manifold", "FT").alias("error"), F.percentile(drawn, 0.5).alias("null"), pick("fraction", "manifold", "TT").alias("control"), pick("total_effect", "manifold", "FT").alias("total_effect"))
