"""The data behind figures: distributions by cell on shared edges, a dissociation by cell, frequency reads beside headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions.scalars import short_model


def violins(rows: DataFrame, value: str, by: tuple = ("cell",), bins: int = 40) -> DataFrame:
    """(by, bin, x, n, density): counts of each group in bins of equal width over the whole range, the same edges for all
    groups, and a Gaussian kernel density at the bins' middles, convolved from the counts.

    The kernel's width is the group's sample SD times n^(-1/5), a bin's width where that is 0. What is kept is bins rows a
    group, whatever the rows. Null and NaN values are left out; where all are equal they share the first bin.
    """
    v = F.col(value).cast("double")
    kept = rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    span = kept.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))  # one row
    at = kept.crossJoin(F.broadcast(span))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0))
    at = at.withColumn("_w", width).withColumn("bin", F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int"))
    counts = at.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    groups = at.groupBy(*by).agg(F.count("*").alias("_n"), F.stddev_samp("_v").alias("_sd"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
    h = F.coalesce(F.nullif(F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)), F.lit(0.0)), F.col("_w"))
    grid = groups.withColumn("_h", h).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("x", F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w"))
    listed = counts.groupBy(*by).agg(F.collect_list(F.struct("bin", "n")).alias("_c"))  # at most bins
    both = grid.join(listed, list(by)) if by else grid.crossJoin(listed)
    kernel = lambda c: c["n"] * F.exp(-0.5 * F.pow((F.col("bin") - c["bin"]) * F.col("_w") / F.col("_h"), F.lit(2.0)))
    density = F.aggregate(F.array_sort("_c"), F.lit(0.0), lambda a, c: a + kernel(c)) / (F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi()))
    own = F.aggregate(F.filter("_c", lambda c: c["bin"] == F.col("bin")), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return both.select(*by, "bin", "x", own.alias("n"), density.alias("density"))


def answering(readouts: DataFrame, most: float = 0.15, cell: str = "FA") -> DataFrame:
    """readouts(model, cell, probe, behaviour) of the models that do the judgment task: a behaviour below ``most`` in cell FA.
    A model without that cell, or with a null there, does not."""
    fit = readouts.where((F.col("cell") == cell) & (F.col("behaviour") < most)).select("model").distinct()
    return readouts.join(fit, "model", "left_semi")


def dissociations(readouts: DataFrame, most: float = 0.15) -> DataFrame:
    """(model, cell, probe, behaviour, apart): both readouts of answering() models by cell, and how far they lie apart."""
    each = answering(readouts, most).groupBy("model", "cell").agg(F.avg("probe").alias("probe"), F.avg("behaviour").alias("behaviour"))
    return each.withColumn("apart", F.col("probe") - F.col("behaviour"))


def spectrum(reads: DataFrame, audits: DataFrame) -> DataFrame:
    """(model, frequency_read, headline): reads(model, frequency_read) beside the held-out diagonal AUROC of each audit's own
    headline layer; audits(model, layer, headline_layer, headline). Models are matched by their short names; those that lack
    either are left out."""
    own = audits.where(F.col("layer") == F.col("headline_layer")).select(short_model(F.col("model")).alias("model"), "headline")
    return reads.select(short_model(F.col("model")).alias("model"), "frequency_read").join(own, "model")


def cache_summary(freq: DataFrame, cnt: str = "cnt") -> DataFrame:
    """(n, unresolved, zero, nonzero, median_nonzero): null counts are unresolved, which is not zero; the median is exact."""
    from probelens.operators.ranks import quantiles

    c = F.col(cnt)
    got = freq.agg(F.count("*").alias("n"), F.count_if(c.isNull()).alias("unresolved"), F.count_if(c == 0).alias("zero"), F.count_if(c > 0).alias("nonzero"))
    middle = quantiles(freq.where(c > 0).select(c.cast("double").alias("_c")), "_c", (0.5,)).select(F.col("q0").alias("median_nonzero"))
    return got.join(middle, how="left")
