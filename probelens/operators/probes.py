"""Probes that need no Python: the mass-mean direction, and change features of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions.scalars import cosine, dot, minus, norm
from probelens.operators.ranks import auroc


def layers(rows: DataFrame, vec: str, width: int, key: str = "item_id") -> DataFrame:
    """rows for each block of width dimensions: (rows' columns but vec, layer, vec)."""
    blocks = F.transform(F.sequence(F.lit(0), (F.size(vec) / width).cast("int") - 1), lambda i: F.struct(i.alias("layer"), F.slice(vec, i * width + 1, width).alias("vec")))
    rest = [c for c in rows.columns if c != vec]
    return rows.select(*rest, F.explode(blocks).alias("_l")).select(*rest, "_l.layer", "_l.vec")


def mass_mean(train: DataFrame, by: tuple = ("layer",), label: str = "truth") -> DataFrame:
    """(by, theta): mean of the true less mean of the false, for each dimension; summed before it is shuffled."""
    each = train.select(*by, label, F.posexplode("vec").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    dims = each.groupBy(*by, "pos").agg((F.avg(F.when(F.col(label), F.col("x"))) - F.avg(F.when(~F.col(label), F.col("x")))).alias("d"))
    return dims.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "d"))), lambda p: p["d"]).alias("theta"))  # as many as dimensions


def mass_mean_scores(acts: DataFrame, by: tuple = ("layer",)) -> DataFrame:
    """acts(by, truth, cell, vec) with score along the direction learnt on the diagonal."""
    theta = mass_mean(acts.where(F.col("cell").isin("TT", "FA")), by)
    return acts.join(theta, list(by)).withColumn("score", dot(F.col("vec"), F.col("theta"))).drop("theta")


def curves(acts: DataFrame, model: str = "vectors", probe: str = "massmean") -> DataFrame:
    """(model, probe, layer, in_dist, off): AUROC on and off the diagonal for each layer."""
    scored = mass_mean_scores(acts).withColumn("diag", F.col("cell").isin("TT", "FA"))
    got = auroc(scored, ("layer", "diag")).groupBy("layer").agg(F.max(F.when(F.col("diag"), F.col("auroc"))).alias("in_dist"), F.max(F.when(~F.col("diag"), F.col("auroc"))).alias("off"))
    return got.select(F.lit(model).alias("model"), F.lit(probe).alias("probe"), "layer", "in_dist", "off")


def change_features(acts: DataFrame, key: str = "item_id", taps: tuple = (0, 1, 2, 3)) -> DataFrame:
    """(key, a, b, cos, length) for every pair of taps a < b: how a representation moves between layers."""
    wide = acts.where(F.col("layer").isin(*taps)).groupBy(key).agg(*[F.max(F.when(F.col("layer") == t, F.col("vec"))).alias(f"v{t}") for t in taps])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cosine(F.col(f"v{a}"), F.col(f"v{b}")).alias("cos"), norm(minus(F.col(f"v{b}"), F.col(f"v{a}"))).alias("length")) for i, a in enumerate(taps) for b in taps[i + 1 :]]
    return wide.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")


def centered(acts: DataFrame, by: tuple = ("topic", "layer")) -> DataFrame:
    """vec less its group's mean vector."""
    rest = [c for c in acts.columns if c != "vec"]
    dims = acts.select(*by, F.posexplode("vec").alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = dims.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("_m"))
    return acts.join(means, list(by)).select(*rest, minus(F.col("vec"), F.col("_m")).alias("vec"))
