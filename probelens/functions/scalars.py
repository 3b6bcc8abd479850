"""Scalar functions of the audits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_freq(count: Column) -> Column:
    """log10(1 + count); null stays null: unresolved is not zero."""
    return F.log10(count + F.lit(1.0))


def perplexity_score(nll: Column) -> Column:
    """Minus the perplexity, so that higher is more typical."""
    return -F.exp(nll)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def true_share(p_true: Column, p_false: Column) -> Column:
    return p_true / (p_true + p_false + F.lit(1e-12))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side has no length."""
    den = norm(a) * norm(b)
    return F.when(den > 1e-12, dot(a, b) / den).otherwise(F.lit(0.0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def zscore(x: Column, mean: Column, sd: Column, least: float = 1e-8) -> Column:
    """Population SD; an SD below least counts as 1."""
    return (x - mean) / F.when(sd < least, F.lit(1.0)).otherwise(sd)


def cell_code(truth: Column, typical: Column) -> Column:
    return F.concat(F.when(truth, "T").otherwise("F"), F.when(typical, "T").otherwise("A"))


def diagonal(cell: Column) -> Column:
    return cell.isin("TT", "FA")


def content_id(payload: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(payload, 256), 1, n)


def excludes_zero(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)


def includes_half(lo: Column, hi: Column) -> Column:
    return (lo <= 0.5) & (hi >= 0.5)


def aic(sse: Column, n: Column, k: int) -> Column:
    return n * F.log(sse / n) + F.lit(2.0 * k)


def gap_text(gap: Column, lo: Column, hi: Column) -> Column:
    return F.format_string("%+.3f [%+.3f, %+.3f]%s", F.bround(gap, 3), F.bround(lo, 3), F.bround(hi, 3), F.when(excludes_zero(lo, hi), "*").otherwise(""))


def interval_text(value: Column, lo: Column, hi: Column) -> Column:
    """0.123 [0.100, 0.200]; a dash for a null value, the value alone without limits."""
    return F.when(value.isNull(), "—").when(lo.isNull() | hi.isNull(), F.format_string("%.3f", F.bround(value, 3))).otherwise(F.format_string("%.3f [%.3f, %.3f]", F.bround(value, 3), F.bround(lo, 3), F.bround(hi, 3)))


def short_model(model: Column) -> Column:
    return F.lower(F.element_at(F.split(model, "/"), -1))


def file_date(path: Column) -> Column:
    return F.try_to_date(F.regexp_extract(path, r"_(\d{8})\.json$", 1), "yyyyMMdd")
