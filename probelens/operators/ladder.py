"""Training-size ladders: rungs are prefixes of one seeded order inside each cell, so a larger rung holds the smaller ones.

Rung n has n // 4 items of each cell, or all there are. Designs: ``same`` reads recoverability and the AUROC off the
diagonal from the same items; ``crossfit`` from the two halves of every cell in turn, and averages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions.draws import hash_fold, meet, placed
from probelens.functions.scalars import diagonal, dot
from probelens.functions.stage import staged
from probelens.operators.linear import mediation
from probelens.operators.ranks import auroc

DESIGNS = ("same", "crossfit")


def strata(items: DataFrame, rungs: tuple, reps: int = 5, design: str = "same", seed=0, key: str = "item_id") -> DataFrame:
    """items(key, cell) -> (key, rep, band, half): in each replicate the index of the smallest rung that holds the item;
    items that none holds are left out. Halves are by turns in the order, so they are equal in every cell and rung."""
    if design not in DESIGNS:
        raise ValueError(f"designs are {', '.join(DESIGNS)}")
    each = items.select(key, "cell").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_k", F.concat_ws(":", F.col("rep").cast("string"), F.col(key).cast("string")))
    quota = F.array(*[F.lit(max(1, r // 4)) for r in sorted(rungs)])
    ranked = placed(each, seed, "_k", ("rep", "cell")).withColumn("band", F.size(F.filter(quota, lambda q: q < F.col("_r"))))
    half = F.pmod(F.col("_r"), F.lit(2)).cast("int") if design == "crossfit" else F.lit(0)
    return ranked.where(F.col("band") < len(rungs)).select(key, "rep", "band", half.alias("half"))


def _listed(rows: DataFrame, rungs: tuple) -> DataFrame:
    """rows under every rung that holds them."""
    return rows.withColumn("_i", F.explode(F.sequence(F.col("band"), F.lit(len(rungs) - 1))))


def mass_mean_ladder(acts: DataFrame, rungs: tuple = (100, 200, 300, 450, 608), reps: int = 5, design: str = "same", by: tuple = ("layer",), folds: int = 5, seed=0, key: str = "item_id", typicality: str = "logf") -> DataFrame:
    """(by, rung, rep, n, recoverability, off_diagonal) of the mass-mean probe.

    Sums of vectors by band, fold and class are made once; a rung's sums are those of its bands, a fold's direction is the
    whole less the fold. So directions of all rungs, replicates and folds cost one pass over the vectors.
    Recoverability: what truth adds beyond typicality to scores out of fold. off_diagonal: AUROC of the diagonal's direction.
    """
    rungs = tuple(sorted(rungs))
    drawn = strata(acts, rungs, reps, design, seed, key)
    rows = staged(acts.select(key, *by, "truth", "cell", typicality, "vec").join(drawn, key).withColumn("fold", hash_fold(seed, key, folds)), "drawn")
    dims = rows.select(*by, "rep", "band", "half", "fold", "truth", diagonal(F.col("cell")).alias("_d"), F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x"))
    pick = lambda f, c: f(F.when(c, F.col("x")))
    t, d = F.col("truth"), F.col("_d")
    named = {"s1": (F.sum, t), "n1": (F.count, t), "s0": (F.sum, ~t), "n0": (F.count, ~t), "ds1": (F.sum, t & d), "dn1": (F.count, t & d), "ds0": (F.sum, ~t & d), "dn0": (F.count, ~t & d)}
    bands = dims.groupBy(*by, "rep", "band", "half", "fold", "pos").agg(*[F.coalesce(pick(f, c), F.lit(0)).alias(n) for n, (f, c) in named.items()])
    at = (*by, "rep", "_i", "half")
    upto = staged(_listed(bands, rungs).groupBy(*at, "fold", "pos").agg(*[F.sum(n).alias(n) for n in named]), "sums")
    whole = upto.groupBy(*at, "pos").agg(*[F.sum(n).alias(n) for n in named])
    mean = lambda s, n: F.try_divide(s, n)
    vector = lambda df, keys: df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("theta"))  # noqa: E731  as many as dimensions
    fielded = vector(whole.withColumn("v", mean(F.col("ds1"), F.col("dn1")) - mean(F.col("ds0"), F.col("dn0"))), at)
    left = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    own = upto.select(*at, "fold", "pos", *[F.col(n).alias(f"_{n}") for n in ("s1", "n1", "s0", "n0")])
    left = meet(left, own, (*at, "fold", "pos"), "left")
    rest = lambda n: F.col(n) - F.coalesce(F.col(f"_{n}"), F.lit(0))
    fair = vector(left.withColumn("v", mean(rest("s1"), rest("n1")) - mean(rest("s0"), rest("n0"))), (*at, "fold"))
    listed = _listed(rows, rungs)
    score = dot(F.col("vec").cast("array<double>"), F.col("theta"))
    out_of_fold = meet(listed, fair, (*at, "fold")).withColumn("score", score)
    found = mediation(out_of_fold, at, typicality=typicality).select(*at, "n", F.col("beta_joint").alias("recoverability"))
    off = auroc(meet(listed.where(~diagonal(F.col("cell"))), fielded, at).withColumn("score", score), at).select(*at, F.col("auroc").alias("off_diagonal"))
    both = meet(found, off, at, "left").groupBy(*by, "rep", "_i").agg(F.sum("n").alias("n"), F.avg("recoverability").alias("recoverability"), F.avg("off_diagonal").alias("off_diagonal"))
    return both.select(*by, F.get(F.array(*[F.lit(r) for r in rungs]), F.col("_i")).alias("rung"), "rep", "n", "recoverability", "off_diagonal")


def listed_rungs(rows: DataFrame, rungs: tuple, reps: int = 5, design: str = "same", seed=0, key: str = "item_id") -> DataFrame:
    """rows under every replicate and rung that holds them: (rows' columns, rung, rep, half)."""
    rungs = tuple(sorted(rungs))
    got = _listed(rows.join(strata(rows, rungs, reps, design, seed, key), key), rungs)
    return got.select(*rows.columns, F.get(F.array(*[F.lit(r) for r in rungs]), F.col("_i")).alias("rung"), "rep", "half")
