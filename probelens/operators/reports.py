"""Layer curves, tie sets, selection rules, tallies and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelens.functions.intervals import correlation_p
from probelens.functions.scalars import gap_text, interval_text, short_model
from probelens.operators.boot import interval, replicates
from probelens.operators.ranks import auroc, quantiles, spearman


def tie_sets(curves: DataFrame, tolerances: tuple = (0.0, 0.01, 0.02)) -> DataFrame:
    """(model, probe, tol, n_tied, off_min, off_max, spread): layers within tol of the best in_dist."""
    best = F.max("in_dist").over(Window.partitionBy("model", "probe"))
    each = curves.withColumn("_best", best).withColumn("tol", F.explode(F.array(*[F.lit(float(t)) for t in tolerances]))).where(F.col("in_dist") >= F.col("_best") - F.col("tol") - F.lit(1e-12))
    return each.groupBy("model", "probe", "tol").agg(F.count("*").alias("n_tied"), F.min("off").alias("off_min"), F.max("off").alias("off_max")).withColumn("spread", F.col("off_max") - F.col("off_min"))


def layer_rules(curves: DataFrame, depths: tuple = (0.6, 0.7, 0.8, 0.85)) -> DataFrame:
    """(model, probe, rule, layer, in_dist, off, off_below_best): best, earliest95, mid and fixed depths; ties go to the lowest layer."""
    by = ("model", "probe")
    top = F.max("in_dist").over(Window.partitionBy(*by))
    last = F.max("layer").over(Window.partitionBy(*by))
    rows = curves.withColumns({"_top": top, "_last": last, "_off": F.max("off").over(Window.partitionBy(*by))})
    wants = [("best", -F.col("in_dist")), ("earliest95", F.when(F.col("in_dist") >= 0.95 * F.col("_top"), F.col("layer").cast("double"))), ("mid", F.abs(F.col("layer") - F.floor(F.col("_last") / 2)).cast("double"))]
    wants += [(f"depth{d:g}", F.abs(F.col("layer") - F.lit(d) * F.col("_last"))) for d in depths]
    each = rows.withColumn("r", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), k.alias("k")) for n, k in wants]))).where("r.k is not null")
    got = each.groupBy(*by, "r.rule").agg(F.min(F.struct("r.k", "layer", "in_dist", "off", "_off")).alias("m"))
    return got.select(*by, "rule", "m.layer", "m.in_dist", "m.off", (F.col("m._off") - F.col("m.off")).alias("off_below_best"))


def rule_costs(rules: DataFrame) -> DataFrame:
    """(rule, n, mean_off, mean_shortfall) over models and probes."""
    return rules.groupBy("rule").agg(F.count("*").alias("n"), F.avg("off").alias("mean_off"), F.avg("off_below_best").alias("mean_shortfall"))


def median_tied(curves: DataFrame, tol: float = 0.02) -> DataFrame:
    """(model, probe, median_off, layer): median off over tied layers and the tied layer nearest it."""
    by = ["model", "probe"]
    best = F.max("in_dist").over(Window.partitionBy(*by))
    tied = curves.withColumn("_best", best).where(F.col("in_dist") >= F.col("_best") - tol - F.lit(1e-12)).drop("_best")
    med = tied.groupBy(*by).agg(F.median("off").alias("median_off"))
    near = tied.join(med, by).groupBy(*by, "median_off").agg(F.min(F.struct(F.round(F.abs(F.col("off") - F.col("median_off")), 12).alias("d"), "layer")).alias("m"))
    return near.select(*by, "median_off", "m.layer")


def at_floors(rows: DataFrame, floors: tuple) -> DataFrame:
    """rows at or above each in_dist floor, once for each."""
    return rows.withColumn("floor", F.explode(F.array(*[F.lit(float(f)) for f in floors]))).where("in_dist >= floor")


def floor_tallies(curves: DataFrame, floors: tuple = (0.0, 0.85, 0.9), upper: str | None = None) -> DataFrame:
    """(floor, n, n_below): layers at or above each in_dist floor, and how many of them are below chance off the diagonal.

    upper: the upper limit of off; then also n_with, rows that have one, and n_strict, those where it is below chance.
    """
    more = [F.count(upper).alias("n_with"), F.count_if(F.col(upper) < 0.5).alias("n_strict")] if upper else []
    return at_floors(curves, floors).groupBy("floor").agg(F.count("*").alias("n"), F.count_if(F.col("off") < 0.5).alias("n_below"), *more)


def floor_correlations(pairs: DataFrame, floors: tuple = (0.0, 0.85, 0.9)) -> DataFrame:
    """(floor, n, rho, p, off_min, off_max, n_below): does in_dist still order off among what a benchmark would endorse?"""
    rows = at_floors(pairs, floors)
    rho = spearman(rows, "in_dist", "off", ("floor",)).drop("n")
    tally = rows.groupBy("floor").agg(F.count("*").alias("n"), F.min("off").alias("off_min"), F.max("off").alias("off_max"), F.count_if(F.col("off") < 0.5).alias("n_below"))
    return tally.join(rho, "floor", "left").withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def widest(rows: DataFrame, value: str, k: int = 6) -> DataFrame:
    """The k rows of the largest value, by the row's other columns where it ties."""
    return rows.orderBy(F.desc(value), *[c for c in rows.columns if c != value]).limit(k)


def summary(rows: DataFrame, value: str, by: tuple = ()) -> DataFrame:
    """(by, n, mean, low, high) of a metric; nulls are left out."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def called_true(items: DataFrame, score: str = "score", by: tuple = ("cell",)) -> DataFrame:
    """(by, n, called): share of rows whose score is above one half."""
    return items.groupBy(*by).agg(F.count(score).alias("n"), F.avg((F.col(score) > 0.5).cast("double")).alias("called"))


def separation(items: DataFrame, score: str = "score", label: str = "truth", by: tuple = ()) -> DataFrame:
    """(by, separation): difference of the classes' means over the standard deviation of all."""
    mean = lambda t: F.avg(F.when(F.col(label) == t, F.col(score)))
    return items.groupBy(*by).agg(F.try_divide(mean(True) - mean(False), F.stddev_pop(score)).alias("separation"))


def disowned(rows: DataFrame, probe: str = "probe", behaviour: str = "behaviour") -> DataFrame:
    """What a probe says of statements their own author holds false (behaviour below one half); null means where there are none."""
    out, p = F.col(behaviour) < 0.5, F.col(probe)
    avg = lambda c: F.avg(c.cast("double"))
    return rows.agg(F.count_if(out).alias("n_disowned"), F.avg(F.when(out, p)).alias("probe_mean"), F.avg(F.when(out, F.col(behaviour))).alias("behaviour_mean"), avg(F.when(out, p > 0.5)).alias("called_true"), avg((p > 0.5) & out).alias("probe_true_author_false"), avg((p < 0.5) & ~out).alias("probe_false_author_true"))


def detection(rows: DataFrame, score: str, correct: str = "correct") -> DataFrame:
    """AUROC of a score for being right: (auroc, n_pos, n_neg), no row unless both classes are there."""
    return auroc(rows, (), score, correct).where("n_pos > 0 and n_neg > 0")


def entropy_by_frequency(rows: DataFrame, entropy: str = "entropy", freq: str = "freq", correct: str = "correct", least: int = 11) -> DataFrame:
    """Does entropy rise on rare entities among what was answered right?

    (median, n_rare, rare_mean, n_common, common_mean, difference, auroc, corr): split at the exact median frequency of
    the correct rows; nulls below ``least`` of them. corr is over all rows.
    """
    good = rows.where(F.col(correct))
    mid = quantiles(good, freq, (0.5,)).select(F.when(F.col("n") >= least, F.col("q0")).alias("median"))  # one row at most
    split = good.crossJoin(F.broadcast(mid)).withColumn("_rare", F.col(freq) < F.col("median"))
    rare = lambda t, c: F.avg(F.when(F.col("_rare") == t, F.col(c)))
    means = split.agg(F.max("median").alias("median"), F.count_if(F.col("_rare")).alias("n_rare"), rare(True, entropy).alias("rare_mean"), F.count_if(~F.col("_rare")).alias("n_common"), rare(False, entropy).alias("common_mean"))
    tells = auroc(split, (), entropy, "_rare").select("auroc")
    every = rows.agg(F.corr(entropy, freq).alias("corr"))
    return means.withColumn("difference", F.col("rare_mean") - F.col("common_mean")).join(tells, F.lit(True), "left").crossJoin(every)


def always_below(curves: DataFrame) -> DataFrame:
    """(model, all_below, best_probe, best_off)."""
    return curves.groupBy("model").agg(F.bool_and(F.col("off") < 0.5).alias("all_below"), F.max_by("probe", F.struct("off", "probe")).alias("best_probe"), F.max("off").alias("best_off"))


def composition(items: DataFrame, fields: tuple, truth: str = "truth", cell: str = "cell") -> DataFrame:
    """(field, side, value, n, frac_true) for each field on and off the diagonal, in one pass over the items."""
    side = F.when(F.col(cell).isin("TT", "FA"), "diagonal").otherwise("off")
    each = items.select(truth, side.alias("side"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f"))
    return each.groupBy("f.field", "side", "f.value").agg(F.count("*").alias("n"), F.avg(F.col(truth).cast("double")).alias("frac_true"))


def mechanism(curves: DataFrame, recoverability: DataFrame, floor: float = 0.0, by: tuple = ("probe",)) -> DataFrame:
    """(by, n, r, p): does a model's recoverability order its probes' off-diagonal AUROC?

    recoverability(name, rec) meets curves(model, ...) by short name, whatever its case; rows below floor are left out.
    """
    keyed = recoverability.select(short_model(F.col("name")).alias("_m"), "rec")
    rows = curves.where(F.col("in_dist") >= floor).withColumn("_m", short_model(F.col("model"))).join(keyed, "_m")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rec", "off").alias("r")).withColumn("p", correlation_p(F.col("r"), F.col("n")))


def layer_report(curves: DataFrame, heads: DataFrame, floor: float = 0.85, tol: float = 0.02) -> DataFrame:
    """(model, probe, headline_layer, headline_in, headline_off, selected_layer, selected_off, n_tied, moved, powered).

    headline: at the layer that heads(model, headline_layer) gives; selected: the layers within tol of the best in_dist,
    by their median off. moved: selected less headline. powered: in_dist of the headline layer reaches floor. A model
    without a headline layer has nulls there and is not powered. Layers without both AUROCs are left out.
    """
    known = curves.where("in_dist is not null and off is not null").select("model", "probe", "layer", "in_dist", "off")
    selected = median_tied(known, tol).withColumnsRenamed({"median_off": "selected_off", "layer": "selected_layer"})
    tied = tie_sets(known, (tol,)).select("model", "probe", "n_tied")
    at = with_headline(known, heads).where(F.col("headline").isNotNull())
    at = at.select("model", "probe", F.col("layer").alias("headline_layer"), F.col("in_dist").alias("headline_in"), F.col("off").alias("headline_off"))
    got = selected.join(tied, ["model", "probe"]).join(at, ["model", "probe"], "left")
    return got.select("model", "probe", "headline_layer", "headline_in", "headline_off", "selected_layer", "selected_off", "n_tied", (F.col("selected_off") - F.col("headline_off")).alias("moved"), F.coalesce(F.col("headline_in") >= floor, F.lit(False)).alias("powered"))


def mechanism_by_probe(report: DataFrame, recoverability: DataFrame, n_boot: int = 1000, seed=0, least: int = 3) -> DataFrame:
    """(probe, rule, subset, n, r, p, lo, hi, n_boot): does a model's recoverability still order off, by either layer rule?

    report: of layer_report(); recoverability(name, rec) meets it by short name. rule: headline or selected; subset: all
    models, or the powered ones. Intervals over draws of models; groups and draws with fewer than ``least`` models are left out.
    """
    keyed = recoverability.select(short_model(F.col("name")).alias("_m"), "rec")
    sides = F.array(F.struct(F.lit("headline").alias("rule"), F.col("headline_off").alias("off")), F.struct(F.lit("selected").alias("rule"), F.col("selected_off").alias("off")))
    subsets = F.when(F.col("powered"), F.array(F.lit("all"), F.lit("powered"))).otherwise(F.array(F.lit("all")))
    rows = report.withColumn("_m", short_model(F.col("model"))).join(keyed, "_m").select("model", "probe", "rec", subsets.alias("_s"), F.explode(sides).alias("_o"))
    rows = rows.select("model", "probe", "rec", F.explode("_s").alias("subset"), "_o.rule", "_o.off").where("off is not null and rec is not null")
    by = ["probe", "rule", "subset"]
    r = F.try_divide(F.covar_pop("rec", "off"), F.stddev_pop("rec") * F.stddev_pop("off")).alias("r")  # null where all are alike
    point = rows.groupBy(*by).agg(F.count("*").alias("n"), r).where(F.col("n") >= least)
    many = replicates(rows, n_boot, seed, "model").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("w"))))
    drawn = many.groupBy(*by, "b").agg(r, F.count_distinct("model").alias("_d")).where(F.col("_d") >= least)
    return point.withColumn("p", correlation_p(F.col("r"), F.col("n"))).join(interval(drawn, "r", tuple(by)), by, "left")


def with_headline(curves: DataFrame, heads: DataFrame) -> DataFrame:
    """curves with headline: the off-diagonal AUROC at the model's headline layer, null at others and where it has none."""
    at = heads.select(F.col("model").alias("_m"), F.col("headline_layer").alias("_l"))
    got = curves.join(at, (F.col("model") == F.col("_m")) & (F.col("layer") == F.col("_l")), "left")
    return got.withColumn("headline", F.when(F.col("_l").isNotNull(), F.col("off"))).drop("_m", "_l")


def diagnosis(rows: DataFrame) -> DataFrame:
    """(model, probe, headline, controlled, gap, verdict) as text, by model and probe: rows of adversarial() with names."""
    ordered = rows.orderBy("model", "probe")
    return ordered.select("model", "probe", interval_text(F.col("headline_auroc"), F.col("headline_lo"), F.col("headline_hi")).alias("headline"), interval_text(F.col("controlled_auroc"), F.col("controlled_lo"), F.col("controlled_hi")).alias("controlled"), gap_text(F.col("gap"), F.col("gap_lo"), F.col("gap_hi")).alias("gap"), F.when(F.col("gap_lo") > 0, "CONFOUNDED").otherwise("not distinguishable").alias("verdict"))


def manifest(runs: DataFrame) -> DataFrame:
    """(key, file, run_date) of current artifacts, by key."""
    return runs.where("current").select("key", "file", "run_date").orderBy("key")


def artifact_counts(runs: DataFrame, by: tuple = ("detector",)) -> DataFrame:
    """(by, n, n_current, n_problem) of artifacts."""
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("current").alias("n_current"), F.count_if("problem").alias("n_problem"))


def categorical_fields(items: DataFrame, most: int = 20) -> list[str]:
    """Names of string and boolean fields (one level into structs) that are complete and have 2..most values; one action."""
    names = []
    for f in items.schema:
        inner = f.dataType.fields if f.dataType.typeName() == "struct" else None
        names += [f"{f.name}.{g.name}" for g in inner if g.dataType.typeName() in ("string", "boolean")] if inner else [f.name] * (f.dataType.typeName() in ("string", "boolean"))
    if not names:
        return []
    row = items.agg(F.count("*").alias("n"), *[F.struct(F.count(c).alias("c"), F.count_distinct(F.col(c)).alias("d")).alias(f"f{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[f"f{i}"]["c"] == row["n"] and 1 < row[f"f{i}"]["d"] <= most]


def shortcut_scores(items: DataFrame, field: str, unseen: float = 0.5) -> DataFrame:
    """Off-diagonal items with score: P(true) of their value of field, learnt on the diagonal."""
    rates = items.where(F.col("cell").isin("TT", "FA")).groupBy(field).agg(F.avg(F.col("truth").cast("double")).alias("_p"))
    return items.where(F.col("cell").isin("TA", "FT")).join(rates, field, "left").withColumn("score", F.coalesce("_p", F.lit(unseen))).drop("_p")


def cell_quantiles(items: DataFrame, score: str = "score") -> DataFrame:
    """(cell, n, mean, q10, q50, q90), exact: no cell's values are held in one task."""
    cuts = quantiles(items, score, (0.1, 0.5, 0.9), ("cell",)).select("cell", F.col("q0").alias("q10"), F.col("q1").alias("q50"), F.col("q2").alias("q90"))
    return items.groupBy("cell").agg(F.count("*").alias("n"), F.avg(score).alias("mean")).join(cuts, "cell", "left")


def ladder_verdict(knees: DataFrame, width: float = 0.23, least: int = 3) -> DataFrame:
    """knees(rung, knee) -> (shift, steps, verdict): how far the knee moves over the rungs, by the registered rule."""
    order = Window.orderBy("rung")  # a handful of rungs
    got = knees.withColumn("d", F.col("knee") - F.lag("knee").over(order)).agg((F.max_by("knee", "rung") - F.min_by("knee", "rung")).alias("shift"), F.greatest(F.count_if(F.col("d") > 0), F.count_if(F.col("d") < 0)).alias("steps"))
    far = F.abs("shift")
    return got.withColumn("verdict", F.when((far > width) & (F.col("steps") >= least), "MIGRATED").when((far > 0.5 * width) | (F.col("steps") < least), "INDETERMINATE").otherwise("NO MIGRATION"))


def cluster_entropy(rows: DataFrame, by: tuple, cluster: str) -> DataFrame:
    """(by, n, n_clusters, entropy) of the clusters' shares."""
    per = rows.groupBy(*by, cluster).agg(F.count("*").cast("double").alias("_c"))
    got = per.groupBy(*by).agg(F.sum("_c").alias("n"), F.count("*").alias("n_clusters"), F.sum(F.col("_c") * F.log("_c")).alias("cl"))
    return got.select(*by, F.col("n").cast("long").alias("n"), "n_clusters", (F.log("n") - F.col("cl") / F.col("n")).alias("entropy"))


def dissociation(rows: DataFrame, low_below: float) -> DataFrame:
    """Correct and wrong rows by low and high frequency: one pass of filtered aggregates; empty groups give null means."""
    low = F.col("logf") < low_below
    out = []
    for name, cond in (("err_low", ~F.col("correct") & low), ("err_high", ~F.col("correct") & ~low), ("ok_low", F.col("correct") & low), ("ok_high", F.col("correct") & ~low)):
        out += [F.count_if(cond).alias(f"n_{name}"), F.avg(F.when(cond, F.col("score"))).alias(f"mean_{name}")]
    return rows.agg(*out)
