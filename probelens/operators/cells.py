"""Crossed truth x typicality designs: frequency join, rank terciles, cells, admission, balancing, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelens.functions.draws import meet, placed
from probelens.functions.scalars import cell_code, log_freq
from probelens.functions.stage import staged
from probelens.operators.ranks import running


def entity_frequency(df: DataFrame, entity: str) -> DataFrame:
    """(entity, cnt, logf): native counts in place of a count service."""
    return df.groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("cnt")).withColumn("logf", log_freq(F.col("cnt")))


def with_frequency(items: DataFrame, freq: DataFrame) -> DataFrame:
    """items(entity) with logf; an entity without a count keeps a null.

    Both sides grow with the input: merged, since by its file's size a table may look small enough to be sent to all."""
    return items.join(freq.select("entity", "cnt", "logf").hint("merge"), "entity", "left")


def mean_frequency(items: DataFrame, freq: DataFrame, key: str = "item_id", entities: str = "entities") -> DataFrame:
    """(key, logf, n_missing): mean over the entities that have one."""
    each = items.select(key, F.explode_outer(entities).alias("entity")).join(freq, "entity", "left")
    return each.groupBy(key).agg(F.avg("logf").alias("logf"), F.count_if(F.col("logf").isNull() & F.col("entity").isNotNull()).alias("n_missing"))


def terciles(items: DataFrame, value: str = "logf", key: str = "item_id", by: tuple = ()) -> DataFrame:
    """typical true for the top n // 3 ranks of each group, false for the bottom n // 3; the middle and nulls are dropped.

    The order is (value, key). Running counts of distinct values place every value; only rows of the one or two values
    that a border cuts are placed by their key, which is a number, in value buckets too. No task holds a group. The
    result is a written table, since audits read it many times.
    """
    rows = items.where(F.col(value).isNotNull() & ~F.isnan(value))
    at = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ran = running(at, by, value, ("_n",))
    total = at.groupBy(*by).agg(F.sum("_n").alias("_t"))
    ran = meet(ran, total, by)
    third = F.floor(F.col("_t") / 3)
    upper = F.col("_t") - third
    end = F.col("before__n") + F.col("_n")
    cuts = lambda x: (F.col("before__n") < x) & (x < end)
    ran = ran.select(*by, value, "before__n", third.alias("_third"), upper.alias("_upper"), (cuts(third) | cuts(upper)).alias("_cut"), F.when(end <= third, False).when(F.col("before__n") >= upper, True).alias("_all"))
    ran = staged(ran.where("_cut or _all is not null"), "borders")
    both = meet(rows, ran, (*by, value))
    one = running(both.where("_cut").withColumn("_one", F.lit(1)), (*by, value), key, ("_one",))
    place = F.col("before__n") + F.col("before__one") + 1
    cut = one.withColumn("typical", F.when(place <= F.col("_third"), False).when(place > F.col("_upper"), True)).where("typical is not null")
    return staged(both.where("not _cut").select(*rows.columns, F.col("_all").alias("typical")).unionByName(cut.select(*rows.columns, "typical")), "terciles")


def with_cells(items: DataFrame) -> DataFrame:
    return items.withColumn("cell", cell_code(F.col("truth"), F.col("typical")))


def domain_report(celled: DataFrame, least: int = 20) -> DataFrame:
    """(domain, n, n_TT, n_TA, n_FT, n_FA, admitted, reason)."""
    counts = [F.count_if(F.col("cell") == c).alias(f"n_{c}") for c in ("TT", "TA", "FT", "FA")]
    got = celled.groupBy("domain").agg(F.count("*").alias("n"), *counts)
    low = F.least("n_TT", "n_TA", "n_FT", "n_FA")
    reason = F.when(F.col("n") < 4 * least, "too few rows").when(low < least, "a cell is too small")
    return got.withColumn("admitted", reason.isNull()).withColumn("reason", reason)


def balanced(celled: DataFrame, seed=0, key: str = "item_id", halves: bool = True, top_share: float = 0.5) -> DataFrame:
    """The same number of rows in every (domain, cell, edited) of a domain; no domain above top_share of all.

    Caps come from counts, rows from a seeded order inside their group: groups, not the table, are sorted.
    """
    by = ("domain", "cell", "edited") if halves else ("domain", "cell")
    sizes = celled.groupBy(*by).agg(F.count("*").alias("n"))
    full = 8 if halves else 4
    caps = sizes.groupBy("domain").agg(F.when(F.count("*") == full, F.min("n")).otherwise(F.lit(0)).alias("cap"))
    whole = Window.partitionBy()  # a row for each domain
    others = F.sum("cap").over(whole) - F.col("cap")
    share = top_share / (1 - top_share)
    limit = F.when(F.count("*").over(whole) == 1, F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(others * share)))
    caps = caps.withColumn("per", limit).select("domain", "per")
    ranked = placed(celled, seed, key, by).join(caps, "domain")
    return ranked.where(F.col("_r") <= F.col("per")).drop("_r", "per")


def matched(rows: DataFrame, bucket: tuple, cls: str, classes: tuple, seed=0, key: str = "item_id") -> DataFrame:
    """In every bucket as many rows of each class as the rarest class has there, absent classes counting 0."""
    counts = rows.groupBy(*bucket).agg(F.least(*[F.count_if(F.col(cls) == c) for c in classes]).alias("_k"))
    ranked = placed(rows, seed, key, (*bucket, cls))
    return meet(ranked, counts, bucket).where("_r <= _k").select(*rows.columns)


def balanced_cells(celled: DataFrame, seed=0, key: str = "item_id") -> DataFrame:
    """As many rows of every cell as the smallest has, whatever their domains."""
    least = celled.groupBy("cell").agg(F.count("*").alias("n")).agg(F.min("n").alias("_k"))  # one row
    return placed(celled, seed, key, ("cell",)).crossJoin(F.broadcast(least)).where("_r <= _k").select(*celled.columns)


def admitted(celled: DataFrame, least: int = 20) -> DataFrame:
    """celled without the domains that domain_report refuses."""
    good = domain_report(celled, least).where("admitted").select("domain")
    return celled.join(good, "domain", "left_semi")


def tops(counted: DataFrame, by: tuple = (), value: str = "cnt", key: str = "object") -> DataFrame:
    """counted with tier: common for the first max(1, n // 3) by falling value, rare for as many last; others null.

    Equal values are ordered by key. Of a small pool a member may be in both tiers: it has a row for each.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(value), key)
    rows = counted.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*by))})
    third = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    tier = F.array_compact(F.array(F.when(F.col("_r") <= third, "common"), F.when(F.col("_r") > F.col("_n") - third, "rare")))
    return rows.withColumn("tier", F.explode_outer(tier)).drop("_r", "_n")


def halves(rows: DataFrame, seed=0, by: tuple = ("cell",), key: str = "item_id") -> DataFrame:
    """rows with first_half: true for the first n // 2 of each group in seeded order."""
    ranked = placed(rows, seed, key, by)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    return meet(ranked, sizes, by).select(*rows.columns, (F.col("_r") <= F.floor(F.col("_n") / 2)).alias("first_half"))
