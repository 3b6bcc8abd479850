"""Data quality gates: each gives one row (gate, pass, metric) from one aggregation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.functions.draws import sample_within
from probelens.functions.intervals import normal_p
from probelens.functions.scalars import includes_half
from probelens.operators.boot import auroc_ci
from probelens.operators.ranks import cliffs_delta, quantiles
from probelens.operators.reports import shortcut_scores


def _gate(name: str, ok: Column, metric: Column) -> list:
    return [F.lit(name).alias("gate"), ok.alias("pass"), metric.cast("double").alias("metric")]


def duplicates(items: DataFrame, text: str = "text") -> DataFrame:
    """No repeated text; the metric is the number of rows beyond the first of each."""
    per = items.groupBy(text).agg(F.count("*").alias("n"))
    got = per.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("extra"))
    return got.select(*_gate("duplicates", F.col("extra") == 0, F.col("extra")))


def domain_share(items: DataFrame, most: float = 0.5) -> DataFrame:
    got = items.groupBy("domain").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("top"), F.count("*").alias("k"))
    return got.select(*_gate("domain_share", (F.col("top") <= most) | (F.col("k") == 1), F.col("top")))


def edit_balance(items: DataFrame, most: float = 0.02) -> DataFrame:
    got = items.groupBy("cell").agg(F.avg(F.col("edited").cast("double")).alias("p")).agg((F.max("p") - F.min("p")).alias("spread"))
    return got.select(*_gate("edit_balance", F.col("spread") <= most, F.col("spread")))


def edit_independence(items: DataFrame, most: float = 0.05) -> DataFrame:
    p = lambda t: F.avg(F.when(F.col("truth") == t, F.col("edited").cast("double")))
    return items.agg(F.abs(p(True) - p(False)).alias("gap")).select(*_gate("edit_independence", F.col("gap") <= most, F.col("gap")))


def ft_yield(items: DataFrame, least: float = 0.15) -> DataFrame:
    got = items.agg(F.count_if(F.col("cell") == "FT").alias("k"), F.count("*").alias("n"))
    return got.select(*_gate("ft_yield", (F.try_divide("k", "n") >= least) & (F.col("k") >= 2), F.try_divide("k", "n")))


def frequency_coverage(items: DataFrame, most: float = 0.05) -> DataFrame:
    got = items.agg(F.try_divide(F.count_if(F.col("cnt").isNull()), F.count("*")).alias("missing"))
    return got.select(*_gate("frequency_coverage", F.col("missing") <= most, F.col("missing")))


def crossing(items: DataFrame, least: float = 0.5, z: float = 3.0902) -> DataFrame:
    """Typical against atypical frequency in each truth class: Cliff's delta and a one-sided deviate (0.001: 3.0902)."""
    got = cliffs_delta(items, ("truth",), "logf", "typical")
    one = got.agg(F.min("delta").alias("d"), F.min("z").alias("z"), F.count("*").alias("k"))
    return one.select(*_gate("crossing", (F.col("d") >= least) & (F.col("z") >= z) & (F.col("k") == 2), F.col("d")))


def crossing_report(items: DataFrame, freq: str = "logf", ppl: str | None = None, least: float = 0.5, most: float = 0.001) -> DataFrame:
    """(truth, n_typical, n_atypical, delta, p, ppl_typical, ppl_atypical, pass) for either truth class.

    pass: Cliff's delta and the one-sided p of the frequency; a class with fewer than two rows on a side fails. The
    medians of ppl (null without it) are a cross-check and decide nothing.
    """
    got = cliffs_delta(items, ("truth",), freq, "typical").withColumn("p", normal_p(F.col("z")))
    if ppl:
        cuts = quantiles(items, ppl, (0.5,), ("truth", "typical")).groupBy("truth").agg(F.max(F.when(F.col("typical"), F.col("q0"))).alias("ppl_typical"), F.max(F.when(~F.col("typical"), F.col("q0"))).alias("ppl_atypical"))
        got = got.join(cuts, "truth", "left")
    else:
        got = got.withColumns({"ppl_typical": F.lit(None).cast("double"), "ppl_atypical": F.lit(None).cast("double")})
    ok = F.coalesce((F.least("n_pos", "n_neg") >= 2) & (F.col("delta") >= least) & (F.col("p") <= most), F.lit(False))
    return got.select("truth", F.col("n_pos").alias("n_typical"), F.col("n_neg").alias("n_atypical"), "delta", "p", "ppl_typical", "ppl_atypical", ok.alias("pass"))


def crossed(report: DataFrame) -> DataFrame:
    """crossing_report() as a gate: both classes there, and both pass."""
    one = report.agg(F.bool_and("pass").alias("ok"), F.count("*").alias("k"), F.min("delta").alias("d"))
    return one.select(*_gate("crossing", F.coalesce(F.col("ok"), F.lit(False)) & (F.col("k") == 2), F.col("d")))


def duplicate_report(items: DataFrame, text: str = "text", k: int = 3) -> DataFrame:
    """(n, n_unique, n_repeated, n_statements, examples): rows, different texts, rows beyond the first of each, texts that repeat, and the first k of these."""
    per = items.groupBy(text).agg(F.count("*").alias("n"))
    got = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_statements"))
    some = per.where("n > 1").orderBy(text).limit(k).agg(F.sort_array(F.collect_list(text)).alias("examples"))  # k texts
    return got.crossJoin(some).select("n", "n_unique", (F.col("n") - F.col("n_unique")).alias("n_repeated"), "n_statements", "examples")


def domain_report_top(items: DataFrame, most: float = 0.5) -> DataFrame:
    """(domain, n, share, top): domains with their shares; top marks the largest, by name where it ties."""
    per = items.groupBy("domain").agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("_t"), F.max(F.struct("n", "domain")).alias("_m"))  # one row
    return per.crossJoin(F.broadcast(whole)).select("domain", "n", (F.col("n") / F.col("_t")).alias("share"), (F.col("domain") == F.col("_m.domain")).alias("top"))


def edit_report(items: DataFrame) -> DataFrame:
    """(cell_spread, truth_gap): how far P(edited) differs over cells, and between true and false."""
    p = F.avg(F.col("edited").cast("double")).alias("p")
    cells = items.groupBy("cell").agg(p).agg((F.max("p") - F.min("p")).alias("cell_spread"))
    return cells.crossJoin(items.groupBy("truth").agg(p).agg((F.max("p") - F.min("p")).alias("truth_gap")))


def composition_canary(items: DataFrame, fields: dict[str, bool | None], n_boot: int = 1000, seed=0, unit: str = "item_id") -> DataFrame:
    """(field, auroc, lo, hi, shortcut, text_visible, pass) for each field, with whether it can be read from the text.

    A field is a shortcut if P(true) by value, learnt on the diagonal, orders truth off it: the interval excludes one
    half. It fails if it is also visible in the text. Fields that give fewer than two scores are left out.
    """
    out = None
    for name, visible in fields.items():
        scored = shortcut_scores(items, name).withColumn("score", F.round("score", 9))
        one = auroc_ci(scored, (), n_boot, seed, unit).crossJoin(scored.agg(F.count_distinct("score").alias("_k"))).where("_k > 1")
        short = ~includes_half(F.col("lo"), F.col("hi"))
        one = one.select(F.lit(name).alias("field"), "auroc", "lo", "hi", short.alias("shortcut"), F.lit(visible).cast("boolean").alias("text_visible"))
        one = one.withColumn("pass", ~(F.col("shortcut") & F.coalesce("text_visible", F.lit(False))))
        out = one if out is None else out.unionByName(one)
    return out


def composed(report: DataFrame) -> DataFrame:
    """composition_canary() as a gate; the metric is the number of fields that fail."""
    failed = F.count_if(~F.col("pass"))
    return report.agg(failed.alias("k")).select(*_gate("composition", F.col("k") == 0, F.col("k")))


def canary(scored: DataFrame, name: str, label: str, n_boot: int = 1000, seed=0, unit: str = "item_id") -> DataFrame:
    """Gate: a held-out score must not tell a label; the interval of its AUROC includes one half."""
    got = auroc_ci(scored, (), n_boot, seed, unit, "score", label)
    return got.select(*_gate(name, F.coalesce(includes_half(F.col("lo"), F.col("hi")), F.lit(False)), F.col("auroc")))


def recheck(cache: DataFrame, fresh: DataFrame, key: str, value: str, n: int = 25, seed=0) -> DataFrame:
    """Gate: n cached values, drawn by a seeded order, equal those counted anew; the metric is the number that differ."""
    drawn = sample_within(cache.select(key, F.col(value).alias("_was")), (), n, seed, key)
    got = drawn.join(fresh.select(key, F.col(value).alias("_now")), key, "left").agg(F.count_if(~F.col("_was").eqNullSafe(F.col("_now"))).alias("k"))
    return got.select(*_gate("recheck", F.col("k") == 0, F.col("k")))


def banned_words(rows: DataFrame, text: str, words: tuple) -> DataFrame:
    """Rows whose text has one of the words, whole and in any case, with the first of them."""
    found = F.regexp_extract(F.lower(text), r"(?<![\p{L}\p{N}])(" + "|".join(re.escape(w.lower()) for w in words) + r")(?![\p{L}\p{N}])", 1)
    return rows.withColumn("banned", F.nullif(found, F.lit(""))).where("banned is not null")


def round_trip(acts: DataFrame, path: str, key: tuple = ("item_id", "layer"), vec: str = "vec") -> DataFrame:
    """Gate: activations written as Parquet and read again are the same; the metric is the number of rows that differ."""
    acts.select(*key, vec).write.mode("overwrite").parquet(path)
    mark = lambda df: df.groupBy(*key).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(vec)).alias("h"))
    a, b = mark(acts), mark(acts.sparkSession.read.parquet(path)).withColumnsRenamed({"n": "_n", "h": "_h"})
    got = a.join(b, list(key), "full_outer").agg(F.count_if(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("h").eqNullSafe(F.col("_h")))).alias("k"))
    return got.select(*_gate("round_trip", F.col("k") == 0, F.col("k")))


def minimum_rows(items: DataFrame, least: int = 80) -> DataFrame:
    return items.agg(F.count("*").alias("n")).select(*_gate("minimum_rows", F.col("n") >= least, F.col("n")))


def sign_off(items: DataFrame, name: str | None) -> DataFrame:
    return items.sparkSession.createDataFrame([("sign_off", bool(name and name.strip()), None)], "gate string, pass boolean, metric double")


def tensor_rows(acts: DataFrame, n_items: int) -> DataFrame:
    """(model, layer, n, fit): whether each layer has a row for every item."""
    return acts.groupBy("model", "layer").agg(F.count_distinct("item_id").alias("n")).withColumn("fit", F.col("n") == n_items)


def substrate(acts: DataFrame, vec: str = "vec") -> DataFrame:
    """(model, layer, n, one_width, finite, varied): shape, finite values, not all rows alike."""
    bad = F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return acts.groupBy("model", "layer").agg(F.count("*").alias("n"), (F.min(F.size(vec)) == F.max(F.size(vec))).alias("one_width"), F.bool_and(~bad).alias("finite"), (F.min(F.xxhash64(vec)) != F.max(F.xxhash64(vec))).alias("varied"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that name a node that is not there."""
    known = nodes.select("id")
    ends = edges.select("*", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(known, "id", "left_anti").select("src", "dst", "id")


def corpus_audit(items: DataFrame, fields: dict[str, bool | None], text: str = "text", freq: str = "logf", n_boot: int = 1000, more: list[DataFrame] = ()) -> DataFrame:
    """All gates of a crossed corpus, a row for each: the six that need data only, and what is given in more (canaries)."""
    report = composition_canary(items, fields, n_boot)
    checks = [crossed(crossing_report(items, freq)), ft_yield(items), composed(report) if report is not None else None, duplicates(items, text), domain_share(items), edit_balance(items), *more]
    return reduce(DataFrame.unionByName, [c for c in checks if c is not None])


def verdict_of(checks: DataFrame, with_canaries: bool) -> DataFrame:
    """(n_checks, n_failed, failed, verdict): USABLE only where the canaries on activations ran as well."""
    bad = ~F.coalesce("pass", F.lit(False))
    got = checks.agg(F.count("*").alias("n_checks"), F.count_if(bad).alias("n_failed"), F.array_join(F.sort_array(F.collect_list(F.when(bad, F.col("gate")))), ",").alias("failed"))  # as many as gates
    return got.withColumn("verdict", F.when(F.col("n_failed") > 0, "CONFOUNDED / UN-BUILDABLE").otherwise("USABLE" if with_canaries else "USABLE (data-only checks)"))


def roll_up(gates: list[DataFrame], skip: tuple = ()) -> DataFrame:
    """(n_checks, n_failed, verdict): a check without a result counts as failed."""
    rows = reduce(DataFrame.unionByName, gates).where(~F.col("gate").isin(*skip) if skip else F.lit(True))
    failed = F.count_if(~F.coalesce("pass", F.lit(False)))
    return rows.agg(F.count("*").alias("n_checks"), failed.alias("n_failed")).withColumn("verdict", F.when(F.col("n_failed") == 0, "USABLE (data-only checks)").otherwise("CONFOUNDED"))
