"""Exact rank statistics over distinct values.

Rows are first compressed to a weight for each (group, value, class), so what is sorted are distinct values. Running
sums are taken in value buckets: sums within a bucket, and a short running sum over buckets, so one huge group is not
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelens.functions.intervals import correlation_p

BUCKETS = 64


def passed(cuts: Column, value: Column, most: int, equal: bool = True) -> Column:
    """How many of the rising cuts, ``most`` at most, value has passed, or with equal reached: by halving, since a look at
    each of them would cost a row more the more buckets there are. 0 where either is null."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])

    def further(at: Column, step: Column) -> Column:
        cut = F.get(cuts, at + step - 1)
        return F.when(cut <= value if equal else cut < value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def running(rows: DataFrame, by: tuple, order: str, values: tuple) -> DataFrame:
    """rows with before_<v>: the sum of v over the group's rows with a smaller order value. (by, order) must be unique."""
    cuts = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    bounds = rows.agg(F.percentile_approx(order, cuts, 2000).alias("_cuts"))  # one row of BUCKETS - 1 numbers
    placed = rows.crossJoin(F.broadcast(bounds)).withColumn("_b", passed(F.col("_cuts"), F.col(order), BUCKETS - 1)).drop("_cuts")
    sums = placed.groupBy(*by, "_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    over = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate((*by, "_b"))], *[F.coalesce(F.sum(f"_s_{v}").over(over), F.lit(0)).alias(f"_base_{v}") for v in values])
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    alike = F.lit(True)
    for i, c in enumerate((*by, "_b")):
        alike = alike & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    got = placed.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(base, alike)
    return got.select(*rows.columns, *[(F.col(f"_in_{v}") + F.col(f"_base_{v}")).alias(f"before_{v}") for v in values])


def quantiles(rows: DataFrame, value: str, qs: tuple, by: tuple = (), weight: str | None = None) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles with linear interpolation, from counts of distinct values in running order.

    weight: how often a row counts.
    """
    at = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.sum(weight if weight else F.lit(1)).cast("long").alias("_n"))
    ran = running(at, by, "_v", ("_n",))
    total = at.groupBy(*by).agg(F.sum("_n").alias("n"))
    alike = F.lit(True)
    total = total.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(by)], "n")
    for i, c in enumerate(by):
        alike = alike & F.col(c).eqNullSafe(F.col(f"_t{i}"))
    both = ran.join(F.broadcast(total) if not by else total, alike)
    picks = []
    for i, q in enumerate(qs):
        at_q = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.floor(at_q), F.ceil(at_q)
        holds = lambda k: (F.col("before__n") <= k) & (k < F.col("before__n") + F.col("_n"))
        picks += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_l{i}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_h{i}")]
    got = both.groupBy(*by, "n").agg(*picks)
    part = lambda q: F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1))
    return got.select(*by, "n", *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * part(q)).alias(f"q{i}") for i, q in enumerate(qs)])


def finite(rows: DataFrame, *names: str) -> DataFrame:
    """rows with a value in each of the columns: neither null nor, of a fraction type, NaN."""
    for c in names:
        rows = rows.where(F.col(c).isNotNull())
        if rows.select(c).schema[0].dataType.typeName() in ("float", "double"):
            rows = rows.where(~F.isnan(c))
    return rows


def auroc(rows: DataFrame, by: tuple = (), score: str = "score", label: str = "truth", weight: str | None = None) -> DataFrame:
    """(by, auroc, n_pos, n_neg): tie-averaged; null where a class is missing. Null or NaN scores and null labels are left out."""
    w = F.col(weight) if weight else F.lit(1)
    kept = finite(rows, score, label)
    at = kept.groupBy(*by, F.col(score).cast("double").alias("_v")).agg(F.sum(F.when(F.col(label), w).otherwise(0)).alias("p"), F.sum(F.when(F.col(label), 0).otherwise(w)).alias("q"))
    got = running(at, by, "_v", ("q",)).groupBy(*by).agg(F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2.0)).alias("_u"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return got.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg").cast("double")))).drop("_u")


def mid_ranks(rows: DataFrame, value: str, by: tuple = (), out: str = "rank") -> DataFrame:
    """Average ranks from 1."""
    at = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running(at, by, value, ("_n",)).select(*by, value, (F.col("before__n") + (F.col("_n") + 1) / 2.0).alias(out))
    return rows.join(ranked, [*by, value])


def spearman(rows: DataFrame, x: str, y: str, by: tuple = ()) -> DataFrame:
    """(by, rho, n): correlation of mid-ranks over pairwise complete rows; null below 3 rows."""
    kept = finite(rows, x, y).select(*by, x, y)
    ranked = mid_ranks(mid_ranks(kept, x, by, "_rx"), y, by, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n")).withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))


def axis_agreement(rows: DataFrame, x: str, y: str, by: tuple = ()) -> DataFrame:
    """(by, rho, p, n, coverage): spearman() with a two-sided p by Student's t, and the share of rows that have both values."""
    got = spearman(rows, x, y, by)
    total = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    both = got.join(total, list(by)) if by else got.crossJoin(total)
    return both.select(*by, "rho", correlation_p(F.col("rho"), F.col("n")).alias("p"), "n", (F.col("n") / F.col("_n")).alias("coverage"))


def cliffs_delta(rows: DataFrame, by: tuple, value: str, group: str) -> DataFrame:
    """(by, delta, z): group true against false, by ranks instead of pairs; z: the tie-corrected normal deviate of U."""
    got = auroc(rows, by, value, group)
    ties = finite(rows, value, group).groupBy(*by, value).agg(F.count("*").cast("double").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    both = got.join(ties, list(by)) if by else got.crossJoin(ties)
    n, m = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    var = n * m / 12 * (n + m + 1 - F.col("ties") / ((n + m) * (n + m - 1)))
    return both.select(*by, (2 * F.col("auroc") - 1).alias("delta"), (((F.col("auroc") - 0.5) * n * m) / F.sqrt(var)).alias("z"), "n_pos", "n_neg")
