"""Probe audits on a crossed corpus, in one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions.draws import placed
from probelens.functions.scalars import diagonal, excludes_zero
from probelens.functions.stage import staged
from probelens.operators.boot import auroc_ci, gap_ci, stratified
from probelens.operators.linear import mediation_full

#: learns from the first table and gives the second with a column score
Probe = Callable[[DataFrame, DataFrame], DataFrame]
CELLS = ("TT", "TA", "FT", "FA")


def split_diagonal(rows: DataFrame, share: float = 0.8, seed=0, key: str = "item_id") -> DataFrame:
    """rows with part: train for the first floor(share n) of the diagonal in seeded order, held for its rest, off for the other cells."""
    diag = rows.where(diagonal(F.col("cell")))
    n = F.broadcast(diag.agg(F.count("*").alias("_n")))  # one row
    train = placed(diag, seed, key).crossJoin(n).withColumn("part", F.when(F.col("_r") <= F.floor(F.lit(share) * F.col("_n")), "train").otherwise("held"))
    off = rows.where(~diagonal(F.col("cell"))).withColumn("part", F.lit("off"))
    return train.select(*rows.columns, "part").unionByName(off)


def adversarial(rows: DataFrame, probe: Probe, share: float = 0.8, n_boot: int = 1000, seed=0, key: str = "item_id") -> DataFrame:
    """One row: n_train; headline, controlled and gap AUROC with their intervals; mean score of TA and FT.

    The probe learns from a share of the diagonal; headline is on the rest of the diagonal, controlled off it. Without
    rows on either side of the corpus an error.
    """
    parts = staged(split_diagonal(rows, share, seed, key), "parts")
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # three rows
    if not sizes.get("off") or not sizes.get("held") or not sizes.get("train"):
        raise ValueError("a corpus needs rows on and off the diagonal")
    scored = probe(parts.where("part = 'train'"), parts.where("part <> 'train'")).select(key, "part", "cell", "truth", "score").withColumn("held", F.col("part") == "held")
    scored = staged(scored, "scored")
    each = auroc_ci(scored, ("part",), n_boot, seed, key)
    sides = [F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{n}_{c}") for p, n in (("held", "headline"), ("off", "controlled")) for c in ("auroc", "lo", "hi")]
    gap = gap_ci(scored, "held", (), n_boot, seed, key).select("gap", F.col("lo").alias("gap_lo"), F.col("hi").alias("gap_hi"))
    means = scored.agg(*[F.avg(F.when((F.col("part") == "off") & (F.col("cell") == c), F.col("score"))).alias(f"mean_{c}") for c in ("TA", "FT")])
    return each.agg(*sides).crossJoin(gap).crossJoin(means).withColumn("n_train", F.lit(sizes["train"]))


def verdict(row: DataFrame, lo: str = "gap_lo") -> DataFrame:
    """row with verdict: CONFOUNDED only where the lower limit of the gap is above 0."""
    return row.withColumn("verdict", F.when(F.col(lo) > 0, "CONFOUNDED").otherwise("NOT DISTINGUISHABLE FROM UNCONFOUNDED"))


def audit(rows: DataFrame, probe: Probe, typicality: str = "logf", n_boot: int = 1000, seed=0, key: str = "item_id") -> DataFrame:
    """One row: adversarial() with a verdict, and for scores of a probe fielded on the whole diagonal the mean and count
    of each cell, the stratified gap with its interval, and the coefficients of truth alone and beside typicality."""
    fielded = staged(probe(rows.where(diagonal(F.col("cell"))), rows).select(key, "cell", "truth", "score", typicality), "fielded")
    cells = fielded.agg(F.count("*").alias("n"), *[F.avg(F.when(F.col("cell") == c, F.col("score"))).alias(f"fielded_{c}") for c in CELLS], *[F.count_if(F.col("cell") == c).alias(f"n_{c}") for c in CELLS])
    within = stratified(fielded, typicality, n_boot=n_boot, seed=seed, unit=key).select(F.col("gap").alias("stratified_gap"), F.col("lo").alias("stratified_lo"), F.col("hi").alias("stratified_hi"))
    terms = mediation_full(fielded, (), "score", "truth", typicality).where("term = 'truth'").select("beta_marginal", "beta_joint", "shrinkage")
    out = adversarial(rows, probe, n_boot=n_boot, seed=seed, key=key)
    return verdict(out.crossJoin(cells).crossJoin(within).crossJoin(terms)).withColumn("gap_excludes_zero", excludes_zero(F.col("gap_lo"), F.col("gap_hi")))


def layer_audit(acts: DataFrame, probe: Probe, n_boot: int = 1000, seed=0, key: str = "item_id", typicality: str = "logf") -> DataFrame:
    """audit() of every layer of acts, a row for each: never the best one alone."""
    out = None
    for layer in [r["layer"] for r in acts.select("layer").distinct().orderBy("layer").collect()]:  # a number for each layer
        one = audit(acts.where(F.col("layer") == layer), probe, typicality, n_boot, seed, key).withColumn("layer", F.lit(layer))
        out = one if out is None else out.unionByName(one)
    return out


def leave_one_out(rows: DataFrame, probe: Probe, topic: str = "topic", by: tuple = ()) -> DataFrame:
    """(by, topic, auroc, n_pos, n_neg): each topic scored by a probe that has seen all others only."""
    from probelens.operators.ranks import auroc

    out = None
    for name in [r[0] for r in rows.select(topic).distinct().orderBy(topic).collect()]:  # names of topics
        held = F.col(topic).eqNullSafe(F.lit(name))
        one = auroc(probe(rows.where(~held), rows.where(held)), (*by, topic))
        out = one if out is None else out.unionByName(one)
    return out


def transfer(foreign: DataFrame, corpus: DataFrame, probe: Probe, topic: str = "topic", entity: str = "entity", share: float = 0.8, reps: int = 3, n_boot: int = 200, seed=0, key: str = "item_id") -> DataFrame:
    """Does a probe learnt on a foreign labelled set hold on the crossed corpus? (check, name, n_train, auroc, lo, hi)

    foreign loses the corpus's subjects and repeated texts' later rows first. Checks: split, a held-out share of foreign;
    corpus, the crossed corpus on, off and over both sides of its diagonal; topic, each foreign topic left out; size,
    the corpus after training on as many rows as its own diagonal has, drawn ``reps`` times.
    """
    from probelens.operators.joins import without_leakage

    clean = without_leakage(foreign, corpus, entity)
    shared = [c for c in (key, "truth", "vec", "cell") if c in clean.columns or c == "cell"]
    pool = (clean if "cell" in clean.columns else clean.withColumn("cell", F.lit(None).cast("string"))).select(*shared, topic)
    pool = staged(pool, "pool")
    total = pool.count()
    ranked = placed(pool, seed, key)
    first = F.col("_r") <= F.lit(int(share * total))
    rows = []

    def add(check, name, n, scored):
        got = auroc_ci(staged(scored.select(key, "truth", "score"), "scored"), (), n_boot, seed, key)
        rows.append(got.select(F.lit(check).alias("check"), F.lit(str(name)).alias("name"), F.lit(n).cast("long").alias("n_train"), "auroc", "lo", "hi"))

    add("split", "held out", int(share * total), probe(ranked.where(first), ranked.where(~first)))
    target = corpus.select(*shared)
    scored = staged(probe(pool, target).select(key, "cell", "truth", "score"), "scored")
    diag = diagonal(F.col("cell"))
    for name, part in (("all", scored), ("diagonal", scored.where(diag)), ("off", scored.where(~diag))):
        add("corpus", name, total, part)
    for name in [r[0] for r in pool.select(topic).distinct().orderBy(topic).collect()]:  # names of topics
        held = F.col(topic).eqNullSafe(F.lit(name))
        add("topic", name, total - pool.where(held).count(), probe(pool.where(~held), pool.where(held)))
    size = min(total, corpus.where(diag).count())
    for rep in range(reps):
        drawn = placed(pool, f"{seed}:{rep}", key).where(F.col("_r") <= size)
        add("size", f"draw {rep}", size, probe(drawn, target))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
