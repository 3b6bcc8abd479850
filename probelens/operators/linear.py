"""Closed-form fits: mediation by correlations, and hinge, step and linear shapes by grouped least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelens.functions.draws import h32, normal
from probelens.functions.intervals import student_quantile
from probelens.functions.scalars import aic
from probelens.operators.boot import replicates


def mediation(rows: DataFrame, by: tuple = (), score: str = "score", truth: str = "truth", typicality: str = "typicality") -> DataFrame:
    """Standardised coefficients of score on truth, and on truth and typicality: (by, n, beta_marginal, beta_joint,
    beta_typicality, shrinkage, r2). One pass: three correlations fix all of them. shrinkage is null for a marginal of about 0."""
    x = rows.select(*by, F.col(score).cast("double").alias("s"), F.col(truth).cast("int").cast("double").alias("t"), F.col(typicality).cast("double").alias("c")).dropna(subset=["s", "t", "c"])
    got = x.groupBy(*by).agg(F.count("*").alias("n"), F.corr("s", "t").alias("a"), F.corr("s", "c").alias("b"), F.corr("t", "c").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    joint, other = (a - b * c) / (1 - c * c), (b - a * c) / (1 - c * c)
    return got.select(*by, "n", a.alias("beta_marginal"), joint.alias("beta_joint"), other.alias("beta_typicality"), F.when(F.abs(a) > 1e-9, 1 - joint / a).alias("shrinkage"), (joint * a + other * b).alias("r2"))


def mediation_full(rows: DataFrame, covariates: tuple = (), score: str = "score", truth: str = "truth", typicality: str = "typicality", alpha: float = 0.05) -> DataFrame:
    """Standardised least squares of score on truth, and on truth, typicality and covariates, as rows:

    (term, beta_marginal, marginal_lo, marginal_hi, beta_joint, joint_lo, joint_hi, n, shrinkage, r2_marginal, r2_joint).
    Intervals are by Student's t. One pass adds up the cross products of all columns; the rest are matrices as small as
    the number of columns. A column that does not vary is left as zeros; shrinkage is null for a marginal of about 0.
    """
    names = [truth, typicality, *covariates]
    x = rows.select(F.col(score).cast("double").alias("c0"), *[F.col(c).cast("double").alias(f"c{i + 1}") for i, c in enumerate(names)]).dropna()
    k = len(names) + 1
    shift = x.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)])  # one row: products of deviations keep their digits
    dev = x.crossJoin(F.broadcast(shift)).select(*[(F.col(f"c{i}") - F.col(f"m{i}")).alias(f"c{i}") for i in range(k)])
    row = dev.agg(F.count("*").alias("n"), *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    n = row["n"]
    if n < k + 1:
        raise ValueError("fewer rows than terms")
    cross = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    sd = np.sqrt(np.diag(cross) / n)
    sd[sd <= 0] = 1.0
    corr = cross / np.outer(sd, sd) / n

    def fit(used: list[int]):
        a, b = corr[np.ix_(used, used)], corr[used, 0]
        inverse = np.linalg.pinv(a)
        beta = inverse @ b
        left = max(corr[0, 0] - beta @ b, 0.0)
        free = n - len(used) - 1
        width = student_quantile(1 - alpha / 2, free) * np.sqrt(np.maximum(left / free * np.diag(inverse), 0))
        return beta, beta - width, beta + width, (1 - left / corr[0, 0]) if corr[0, 0] > 0 else 0.0

    one, joint = fit([1]), fit(list(range(1, k)))
    shrink = float(1 - joint[0][0] / one[0][0]) if abs(one[0][0]) > 1e-9 else None
    out = []
    for i, c in enumerate(names):
        marginal = [float(v[0]) for v in one[:3]] if i == 0 else [None] * 3
        out.append((c, *marginal, *[float(v[i]) for v in joint[:3]], n, shrink if i == 0 else None, float(one[3]), float(joint[3])))
    return rows.sparkSession.createDataFrame(out, "term string, beta_marginal double, marginal_lo double, marginal_hi double, beta_joint double, joint_lo double, joint_hi double, n long, shrinkage double, r2_marginal double, r2_joint double")


def _sums(x: str, y: str, w: str | None = None) -> list:
    one = F.col(w).cast("double") if w else F.lit(1.0)
    return [F.sum(one).alias("n"), *[F.sum(one * e).alias(n) for n, e in (("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) * F.col(x)), ("sxy", F.col(x) * F.col(y)), ("syy", F.col(y) * F.col(y)))]]


def _line(sums: DataFrame) -> DataFrame:
    """slope, intercept, sse from sums; no slope where x does not vary."""
    vx, vy, vxy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    slope = F.when(vx > 1e-12, vxy / vx)
    return sums.withColumn("slope", slope).withColumns({"intercept": (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"), "sse": vy - F.col("slope") * vxy})


def hinge(points: DataFrame, by: tuple = (), x: str = "x", y: str = "y", low: float = 0.05, high: float = 0.945, step: float = 0.005, weight: str | None = None) -> DataFrame:
    """y = floor + slope max(0, x - knee) over a grid of knees: (by, n, knee, floor, slope, sse), the first knee of the least sse.

    Knees below every x are all one line, knees with a single x above them all one step: of either kind the first stands
    for the rest, which differ from it by the rounding of sums alone.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(round((high - low) / step))), lambda i: F.lit(low) + i * F.lit(step))
    kept = [*by, *([weight] if weight else [])]
    each = points.select(*kept, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.explode(grid).alias("knee")).withColumn("h", F.greatest(F.lit(0.0), F.col("x") - F.col("knee")))
    above = F.when(F.col("h") > 0, F.col("x"))
    kind = F.when((F.min("x") >= F.col("knee")) & (F.count("x") == F.count("*")), -1.0).when(F.min(above) == F.max(above), -2.0).otherwise(F.col("knee"))
    fits = _line(each.groupBy(*by, "knee").agg(*_sums("h", "y", weight), kind.alias("_kind"))).where("slope is not null")
    firsts = fits.groupBy(*by, "_kind").agg(F.min(F.struct("knee", F.round("sse", 12).alias("e"), "intercept", "slope", "n", "sse")).alias("f"))
    best = firsts.groupBy(*by).agg(F.min(F.struct("f.e", "f.knee", "f.intercept", "f.slope", "f.n", "f.sse")).alias("m"))
    return best.select(*by, F.col("m.n").cast("long").alias("n"), "m.knee", F.col("m.intercept").alias("floor"), "m.slope", "m.sse")


def linear(points: DataFrame, by: tuple = (), x: str = "x", y: str = "y") -> DataFrame:
    return _line(points.groupBy(*by).agg(*_sums(x, y))).select(*by, F.col("n").cast("long").alias("n"), "slope", "intercept", "sse")


def step(points: DataFrame, by: tuple = (), x: str = "x", y: str = "y", least: int = 2) -> DataFrame:
    """Two levels parted at one of the x, at least ``least`` points on each side: (by, n, at, sse)."""
    order = Window.partitionBy(*by).orderBy("x")
    whole = Window.partitionBy(*by)
    at = points.groupBy(*by, F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    at = at.select(*by, "x", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"l{c}") for c in ("n", "s")], *[F.sum(c).over(whole).alias(f"t{c}") for c in ("n", "s", "ss")])
    rn, rs = F.col("tn") - F.col("ln"), F.col("ts") - F.col("ls")
    fit = at.where((F.col("ln") >= least) & (rn >= least)).withColumn("sse", F.col("tss") - F.col("ls") * F.col("ls") / F.col("ln") - rs * rs / rn)
    best = fit.groupBy(*by).agg(F.min(F.struct(F.round("sse", 12).alias("e"), "x", "sse", "tn")).alias("m"))
    return best.select(*by, F.col("m.tn").alias("n"), F.col("m.x").alias("at"), "m.sse")


def shapes(points: DataFrame, by: tuple = (), **grid) -> DataFrame:
    """(by, shape, sse, aic, preferred) of hinge (3 parameters), step (3) and linear (2); hinge is preferred where its AIC is the least, else linear."""
    each = [f.withColumn("shape", F.lit(s)).select(*by, "shape", "sse", aic(F.col("sse"), F.col("n"), k).alias("aic")) for s, f, k in (("hinge", hinge(points, by, **grid), 3), ("step", step(points, by), 3), ("linear", linear(points, by), 2))]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    whole = Window.partitionBy(*by)  # three rows
    own, others = F.min(F.when(F.col("shape") == "hinge", F.col("aic"))).over(whole), F.min(F.when(F.col("shape") != "hinge", F.col("aic"))).over(whole)
    return rows.withColumn("preferred", F.when(F.round(own, 2) < F.round(others, 2), "hinge").otherwise("linear"))


def hinge_ci(points: DataFrame, unit: str, by: tuple = (), n_boot: int = 2000, seed=0, alpha: float = 0.05, **grid) -> DataFrame:
    """(by, n_boot, and lo and hi of knee, floor and slope) over draws of units; draws with fewer than 4 different x are left out."""
    drawn = replicates(points, n_boot, seed, unit)
    wide = drawn.groupBy(*by, "b").agg(F.count_distinct("x").alias("_d")).where("_d >= 4").select(*by, "b")
    fits = hinge(drawn.join(wide, [*by, "b"]), (*by, "b"), weight="w", **grid)
    cut = lambda c: F.percentile(c, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    got = fits.groupBy(*by).agg(F.count("*").alias("n_boot"), *[cut(c).alias(f"_{c}") for c in ("knee", "floor", "slope")])
    return got.select(*by, "n_boot", *[F.col(f"_{c}")[i].alias(f"{c}_{e}") for c in ("knee", "floor", "slope") for i, e in enumerate(("lo", "hi"))])


def rung_means(ladder: DataFrame) -> DataFrame:
    """ladder(model, rung, rep, x, y) -> (model, rung, x, y, sd): means over replicates, and the spread of x."""
    return ladder.groupBy("model", "rung").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.stddev_samp("x").alias("sd"))


def dilution(full: DataFrame, rungs: DataFrame, draws: int = 400, seed=20260814, **grid) -> DataFrame:
    """Does noise in x alone move the knee as observed? full(model, x), rungs as rung_means() gives them.

    For each rung, x of full with normal noise of the rung's mean spread is fitted ``draws`` times against the rung's y:
    (rung, sd, knee, knee_lo, knee_mid, knee_hi, knee_inside, and the same for slope).
    """
    spread = rungs.groupBy("rung").agg(F.avg("sd").alias("sd"))
    seen = hinge(rungs, ("rung",), **grid).select("rung", "knee", "slope")
    each = rungs.select("model", "rung", "y").join(full.select("model", F.col("x").cast("double").alias("x")), "model").join(F.broadcast(spread), "rung").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    noisy = each.withColumn("x", F.col("x") + F.col("sd") * normal(seed, F.col("rung"), F.col("b"), F.col("model")))
    fits = hinge(noisy, ("rung", "b"), **grid)
    cut = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    sims = fits.groupBy("rung").agg(cut("knee").alias("_k"), cut("slope").alias("_s"))
    got = spread.join(seen, "rung").join(sims, "rung")
    part = lambda c, a: [F.col(c), *[F.col(a)[i].alias(f"{c}_{n}") for i, n in enumerate(("lo", "mid", "hi"))], F.col(c).between(F.col(a)[0], F.col(a)[2]).alias(f"{c}_inside")]
    return got.select("rung", "sd", *part("knee", "_k"), *part("slope", "_s"))


def dilution_verdict(rows: DataFrame) -> DataFrame:
    """BOTH, ONE or NEITHER of knee and slope lie inside the simulated interval at every rung."""
    got = rows.agg(F.bool_and("knee_inside").alias("knee_inside"), F.bool_and("slope_inside").alias("slope_inside"))
    hits = F.col("knee_inside").cast("int") + F.col("slope_inside").cast("int")
    return got.withColumn("verdict", F.when(hits == 2, "BOTH").when(hits == 1, "ONE").otherwise("NEITHER"))


def broken_pairs(ladder: DataFrame, draws: int = 500, seed=20260814, **grid) -> DataFrame:
    """Does noise that x and y share hold the slope up? Each model's x meets the y of the same replicate, or of another.

    (rung, r, paired_lo, paired_mid, paired_hi, broken_lo, broken_mid, broken_hi): slopes over draws of replicates; r:
    correlation of the deviations from a model's means. rep counts from 0 without gaps; a model with one replicate at a rung is left out there.
    """
    own = Window.partitionBy("model", "rung")
    dev = ladder.withColumns({"_dx": F.col("x") - F.avg("x").over(own), "_dy": F.col("y") - F.avg("y").over(own)})
    r = dev.groupBy("rung").agg(F.corr("_dx", "_dy").alias("r"))
    sizes = ladder.groupBy("model", "rung").agg((F.max("rep") + 1).alias("_m")).where("_m > 1")
    drawn = sizes.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_i", h32(seed, "i", F.col("rung"), F.col("b"), F.col("model")) % F.col("_m"))
    drawn = drawn.withColumn("_j", (F.col("_i") + 1 + h32(seed, "j", F.col("rung"), F.col("b"), F.col("model")) % (F.col("_m") - 1)) % F.col("_m"))
    xs = ladder.select("model", "rung", F.col("rep").alias("_i"), "x")
    ys = ladder.select("model", "rung", F.col("rep").alias("_k"), "y")
    each = drawn.join(xs, ["model", "rung", "_i"]).withColumn("_w", F.explode(F.array(F.struct(F.lit("paired").alias("how"), F.col("_i").alias("_k")), F.struct(F.lit("broken").alias("how"), F.col("_j").alias("_k")))))
    each = each.select("model", "rung", "b", "x", "_w.how", "_w._k").join(ys, ["model", "rung", "_k"])
    fits = hinge(each, ("rung", "how", "b"), **grid)
    cuts = fits.groupBy("rung", "how").agg(F.percentile("slope", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    names = [F.max(F.when(F.col("how") == h, F.col("q")[i])).alias(f"{h}_{e}") for h in ("paired", "broken") for i, e in enumerate(("lo", "mid", "hi"))]
    return r.join(cuts.groupBy("rung").agg(*names), "rung")
