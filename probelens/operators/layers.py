"""Audits of every layer under every probe in one plan: the number of jobs doesn't grow with the layers.

Items are split, folded and weighted once, by hashes and places of their keys, so all layers and probes see the same
draws. A layer's models of all designs are fitted together: a row is listed under each model that learns from it, and
groups are (layer, model) keys of one fit. Scores are long rows (probe, layer, design, item), and every measure is one grouped pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.functions.draws import hash_fold, meet
from probelens.functions.scalars import diagonal, dot, excludes_zero, sigmoid
from probelens.functions.stage import staged
from probelens.operators.assembled import moments
from probelens.operators.audit import split_diagonal
from probelens.operators.boot import auroc_replicates, interval, side_gaps, stratified
from probelens.operators.fitted import eigen_scores, logistic
from probelens.operators.linear import mediation
from probelens.operators.probes import mass_mean as mean_direction
from probelens.operators.ranks import auroc

#: designs: scores out of fold by models of all cells; out of fold on the diagonal, by all its models off it; by a model of a
#: share of the diagonal, on the rest
ALL, FIELDED, SPLIT = "allcell", "fielded", "adversarial"


def _linear_mean(train: DataFrame, by: tuple) -> DataFrame:
    """(by, weights) of the mass-mean direction in raw vectors: that of standardised ones, with the scaling taken in."""
    m = moments(train, "vec", by)
    z = meet(train, m, by).withColumn("vec", F.zip_with(F.zip_with(F.col("vec").cast("array<double>"), F.col("mean"), lambda x, a: x - a), F.col("sd"), lambda x, s: x / s))
    both = meet(mean_direction(z.select(*by, "truth", "vec"), by), m, by)
    w = F.zip_with("theta", "sd", lambda t, s: t / s)
    return both.withColumn("_w", w).select(*by, F.concat("_w", F.array(-dot(F.col("_w"), F.col("mean")))).alias("weights"))


def _linear_logistic(train: DataFrame, by: tuple, l2: float = 1.0, steps: int = 12) -> DataFrame:
    """(by, weights) of logistic regression on standardised vectors, with the scaling taken in."""
    m = moments(train, "vec", by)
    z = meet(train, m, by).withColumn("vec", F.zip_with(F.zip_with(F.col("vec").cast("array<double>"), F.col("mean"), lambda x, a: x - a), F.col("sd"), lambda x, s: x / s))
    both = meet(logistic(staged(z.select(*by, "truth", "vec"), "standardised"), by, l2=l2, steps=steps), m, by)
    n = F.size("weights")
    both = both.withColumn("_w", F.zip_with(F.slice("weights", 1, n - 1), "sd", lambda t, s: t / s))
    return both.select(*by, F.concat("_w", F.array(F.element_at("weights", n) - dot(F.col("_w"), F.col("mean")))).alias("weights"))


#: linear probes that are fitted for many groups at once: (train, by) -> (by, weights), the intercept last
FITS = {"mass_mean": _linear_mean, "logistic": _linear_logistic}


def designed(acts: DataFrame, by: tuple = ("layer",), folds: int = 5, share: float = 0.8, seed=0, key: str = "item_id") -> DataFrame:
    """acts with fold and part (train, held, off): the same for an item in every group."""
    items = acts.select(key, "cell").distinct()
    parts = split_diagonal(items, share, seed, key).select(key, "part").withColumn("fold", hash_fold(seed, key, folds))
    return acts.join(parts, key)


def _under(folds: int) -> Column:
    """The models that learn from a row: 'all:f' and 'diag:f' of other folds f, and 'split'."""
    others = F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("fold"))
    names = lambda kind: F.transform(others, lambda f: F.concat(F.lit(f"{kind}:"), f.cast("string")))
    none = F.array().cast("array<string>")
    diag = F.when(diagonal(F.col("cell")), names("diag")).otherwise(none)
    return F.concat(names("all"), diag, F.when(F.col("part") == "train", F.array(F.lit("split"))).otherwise(none))


def design_scores(rows: DataFrame, fit, by: tuple = ("layer",), folds: int = 5) -> DataFrame:
    """rows of designed() -> rows with design and score, a row for each design that scores it."""
    listed = rows.select(*by, "truth", "vec", F.explode(_under(folds)).alias("model"))
    models = fit(staged(listed.dropna(subset=["truth", "vec"]), "listed"), (*by, "model"))
    sets = models.groupBy(*by).agg(F.collect_list(F.struct("model", "weights")).alias("_m"))  # 2 folds + 1 models
    x = F.col("vec").cast("array<double>")
    response = lambda w: sigmoid(dot(x, F.slice(w, 1, F.size(w) - 1)) + F.element_at(w, F.size(w)))
    own = F.col("fold").cast("string")
    asked = lambda name: (  # noqa: E731  of a row, about half the models
        (name == F.concat(F.lit("all:"), own)) | (name == F.concat(F.lit("diag:"), own)) | (name.startswith("diag:") & ~diagonal(F.col("cell"))) | ((name == "split") & (F.col("part") != "train"))
    )
    scored = meet(rows, F.broadcast(sets), by).withColumn("_p", F.transform(F.filter("_m", lambda m: asked(m["model"])), lambda m: F.struct(m["model"].alias("model"), response(m["weights"]).alias("p"))))
    mean = lambda keep: F.aggregate(F.filter("_p", keep), F.lit(0.0), lambda a, p: a + p["p"]) / F.nullif(F.size(F.filter("_p", keep)), F.lit(0))
    designs = {
        ALL: mean(lambda p: p["model"] == F.concat(F.lit("all:"), own)),
        FIELDED: mean(lambda p: p["model"].startswith("diag:") & (~diagonal(F.col("cell")) | (p["model"] == F.concat(F.lit("diag:"), own)))),
        SPLIT: F.when(F.col("part") != "train", mean(lambda p: p["model"] == "split")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("design"), v.alias("score")) for k, v in designs.items()]))
    rest = [c for c in rows.columns if c != "vec"]
    return scored.select(*rest, each.alias("_d")).select(*rest, "_d.*").where(F.col("score").isNotNull())


def layer_audit(acts: DataFrame, probes: tuple = ("mass_mean", "logistic"), by: tuple = ("layer",), typicality: str = "logf", folds: int = 5, share: float = 0.8, n_boot: int = 1000, seed=0, key: str = "item_id") -> DataFrame:
    """(probe, by, design, measure, value, lo, hi, n): every measure of every layer under every probe, never the best alone.

    Measures: auroc_off, of rows off the diagonal, for all designs; auroc_held and gap (held less off) of the split; for the
    other two stratified_gap, truth_beta_marginal and truth_beta_partialled by typicality; mean_<cell> of fielded scores.
    lo, hi: intervals over draws of items, where there are any. Every row of a layer that lacks a class drops out.
    """
    if set(probes) - FITS.keys():
        raise KeyError(f"no grouped fit of {sorted(set(probes) - FITS.keys())}; there are {sorted(FITS)}")
    rows = staged(designed(acts, by, folds, share, seed, key), "designed")
    scored = None
    for name in probes:  # a fit for each probe, none for each layer
        one = design_scores(rows, FITS[name], by, folds).withColumn("probe", F.lit(name))
        scored = one if scored is None else scored.unionByName(one)
    scored = staged(scored.select("probe", *by, "design", key, "truth", "cell", "part", typicality, "score"), "scored")
    side = scored.where("part = 'off' or design = 'adversarial'").withColumn("side", F.when(F.col("part") == "off", "off").otherwise("held"))
    return measured(side, F.col("design") == SPLIT, scored.where(F.col("design") != SPLIT), scored.where(F.col("design") == FIELDED), ("probe", *by, "design"), typicality, n_boot, seed, key)


def measured(sides: DataFrame, split: Column, whole: DataFrame, fielded: DataFrame, at: tuple, typicality: str, n_boot: int, seed, key: str) -> DataFrame:
    """(at, measure, value, lo, hi, n): AUROCs of the sides held and off, their gap in groups where split, stratified gap and
    coefficients of truth in whole, and the cells' means in fielded. One grouped pass for each measure; gaps take the
    replicates of the sides' AUROCs."""
    null, out = F.lit(None).cast("double"), []

    def add(df, measure, value, lo=null, hi=null, n=None):
        out.append(df.select(*at, (measure if isinstance(measure, Column) else F.lit(measure)).alias("measure"), value.cast("double").alias("value"), lo.alias("lo"), hi.alias("hi"), (F.lit(None) if n is None else n).cast("long").alias("n")))

    points = staged(auroc(sides, (*at, "side")), "points")
    reps = staged(auroc_replicates(sides, (*at, "side"), n_boot, seed, key, "score", "truth", "mix"), "replicates")
    each = points.join(interval(reps, "auroc", (*at, "side")), [*at, "side"], "left")
    add(each, F.concat(F.lit("auroc_"), F.col("side")), F.col("auroc"), F.col("lo"), F.col("hi"), F.col("n_pos") + F.col("n_neg"))
    held = lambda df: df.where(split).withColumn("_held", F.col("side") == "held")
    gap = side_gaps(held(points), "_held", at).join(interval(side_gaps(held(reps), "_held", (*at, "b")), "gap", at), list(at))
    add(gap, "gap", F.col("gap"), F.col("lo"), F.col("hi"))
    inner = stratified(whole, typicality, n_boot=n_boot, seed=seed, unit=key, by=at, draw="mix")
    add(inner, "stratified_gap", F.col("gap"), F.col("lo"), F.col("hi"), F.col("n_boot"))
    beta = mediation(whole, at, typicality=typicality)
    add(beta, "truth_beta_marginal", F.col("beta_marginal"), n=F.col("n"))
    add(beta, "truth_beta_partialled", F.col("beta_joint"), n=F.col("n"))
    means = fielded.groupBy(*at, "cell").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    add(means, F.concat(F.lit("mean_"), F.col("cell")), F.col("m"), n=F.col("n"))
    got = out[0]
    for one in out[1:]:
        got = got.unionByName(one)
    return got


def eigen_audit(samples: DataFrame, items: DataFrame, by: tuple = ("layer",), typicality: str = "logf", alpha: float = 1e-3, n_boot: int = 1000, seed=0, key: str = "item_id") -> DataFrame:
    """(by, measure, value, lo, hi, n) of minus the eigenvalue score of an item's samples, which needs no training: held is
    the diagonal. samples: (by, key, vec); items: (key, truth, cell, typicality). Items of fewer than two samples drop out."""
    score = eigen_scores(samples, (*by, key), alpha=alpha).where(F.col("score").isNotNull()).select(*by, key, (-F.col("score")).alias("score"))
    rows = staged(score.join(items.select(key, "truth", "cell", typicality), key), "scored").withColumn("side", F.when(diagonal(F.col("cell")), "held").otherwise("off"))
    return measured(rows, F.lit(True), rows, rows, by, typicality, n_boot, seed, key)


def verdicts(audit: DataFrame, by: tuple = ("layer",)) -> DataFrame:
    """(probe, by, in_dist, off, gap, lo, hi, excludes_zero, verdict) of a layer_audit()."""
    split = audit.where(F.col("design") == SPLIT)
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    got = split.groupBy("probe", *by).agg(pick("auroc_held", "value").alias("in_dist"), pick("auroc_off", "value").alias("off"), pick("gap", "value").alias("gap"), pick("gap", "lo").alias("lo"), pick("gap", "hi").alias("hi"))
    got = got.withColumn("excludes_zero", excludes_zero(F.col("lo"), F.col("hi")))
    return got.withColumn("verdict", F.when(F.col("lo") > 0, "CONFOUNDED").otherwise("NOT DISTINGUISHABLE FROM UNCONFOUNDED"))
