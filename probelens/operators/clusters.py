"""Semantic clusters of sampled answers: each joins the first cluster whose representative it entails and is entailed by.

The relation is any function (a, b) -> Column, one way; a pair belongs together if it holds both ways. It need not be
transitive, so the order of the samples counts: a sample that fits no representative becomes one. Equal texts are one
sample with a count, which changes nothing for a relation that holds between a text and itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.functions.draws import meet
from probelens.functions.stage import staged
from probelens.functions.text import cluster_norm

Relation = Callable[[Column, Column], Column]


def same_text(a: Column, b: Column) -> Column:
    """Exact clusters: equal up to case and punctuation."""
    return cluster_norm(a) == cluster_norm(b)


def covers(share: float = 0.5) -> Relation:
    """a entails b if it has at least a share of b's words; a b without words follows from what has none."""

    def holds(a: Column, b: Column) -> Column:
        wa, wb = (F.array_distinct(F.filter(F.split(cluster_norm(x), " +"), lambda w: w != "")) for x in (a, b))
        return F.when(F.size(wb) == 0, F.size(wa) == 0).otherwise(F.size(F.array_intersect(wa, wb)) >= share * F.size(wb))

    return holds


def first_match(samples: DataFrame, relation: Relation = same_text, by: tuple = ("conv_id",), order: str = "turn", text: str = "text", held: int = 4096) -> DataFrame:
    """(by, text, pos, times, label): the cluster of each distinct text of a group, numbered from 0 in order of appearance.

    Groups of up to ``held`` distinct texts are folded in a row. Larger ones go by rounds: the first text without a label
    is the next representative, and all texts without one that fit it get its label; that is the same, and no task holds the
    group. Null texts are left out; of equal places the smaller text comes first.
    """
    both = lambda a, b: relation(a, b) & relation(b, a)
    rows = samples.where(F.col(text).isNotNull()).groupBy(*by, F.col(text).alias("text")).agg(F.min(order).alias("pos"), F.count("*").alias("times"))
    rows = staged(rows, "samples")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    sized = meet(rows, sizes, by)
    small = sized.where(F.col("_n") <= held).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "text", "times"))).alias("_x"))  # at most held
    start = F.struct(F.array().cast("array<string>").alias("reps"), F.array().cast("array<int>").alias("labels"))

    def step(state: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(state["reps"], lambda r: both(x["text"], r)), F.lit(True)).cast("int")
        label = F.when(hit > 0, hit - 1).otherwise(F.size(state["reps"]))
        return F.struct(F.when(hit > 0, state["reps"]).otherwise(F.concat(state["reps"], F.array(x["text"]))).alias("reps"), F.concat(state["labels"], F.array(label)).alias("labels"))

    folded = small.withColumn("_l", F.aggregate("_x", start, step)["labels"])
    out = folded.select(*by, F.explode(F.arrays_zip("_x", "_l")).alias("_z")).select(*by, "_z._x.text", "_z._x.pos", "_z._x.times", F.col("_z._l").alias("label"))
    left, label = staged(sized.where(F.col("_n") > held).drop("_n"), "large"), 0
    while left.limit(1).count():
        reps = left.groupBy(*by).agg(F.min(F.struct("pos", "text")).alias("_r")).select(*by, F.col("_r.text").alias("_rep"))
        told = staged(meet(left, reps, by).withColumn("_in", (F.col("text") == F.col("_rep")) | both(F.col("text"), F.col("_rep"))), "round")
        out = out.unionByName(told.where("_in").drop("_in", "_rep").withColumn("label", F.lit(label)))
        left, label = told.where("not coalesce(_in, false)").drop("_in", "_rep"), label + 1
    return out


def cluster_entropy(samples: DataFrame, relation: Relation = same_text, by: tuple = ("conv_id",), **options) -> DataFrame:
    """(by, n, n_clusters, entropy): natural entropy of the shares of a group's clusters."""
    each = first_match(samples, relation, by, **options).groupBy(*by, "label").agg(F.sum("times").alias("k"))
    got = each.groupBy(*by).agg(F.sum("k").alias("n"), F.count("*").alias("n_clusters"), F.sum(F.col("k") * F.log(F.col("k").cast("double"))).alias("_s"))
    return got.select(*by, "n", "n_clusters", (F.log(F.col("n").cast("double")) - F.col("_s") / F.col("n")).alias("entropy"))
