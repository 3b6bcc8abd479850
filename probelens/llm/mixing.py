"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Each source has a schedule: its share of demand over training time t in [0, 1], linear between knots. Integrating it
gives the cumulative demand, scaled to the source's target. A source's documents lie end to end in a keyed order,
repeated as often as the target asks; inverting the cumulative demand at a document's start gives the time at which it
is due, and range-sorting by that time gives the training order.

Targets: the total is dealt by weight; a target stops at ``cap`` times its source's size and the excess is dealt again
by weight until none is above. In closed form: with sources ordered by cap / weight, the first k are at their caps,
for the smallest k at which the rest's even level lies below the next cap.

Only (source, bucket) sums are ordered source by source; documents are ordered inside buckets of a keyed hash, so a
source with a third of all rows spreads over as many tasks as its size asks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelens.llm.common import WORD, written

#: phases of the default curriculum, by the source's place in code point order: (t, multiple of its weight)
RAMPS = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
ROWS_A_BUCKET = 2048


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(s_null, s, source_size), a row for each source -> the same with place, weight, target.

    The windows without a partition see one row for each source, never documents.
    """
    order = Window.orderBy("s_null", "s")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight)
    placed = placed.withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    upto = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("limit").over(upto), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = placed.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - capped) / rest)
    chosen = level.withColumn("even", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"])
    return chosen.withColumn("target", F.when(F.col("even").isNull() | (F.col("ratio") <= F.col("even")), F.col("limit")).otherwise(F.col("even") * F.col("weight"))).select("s_null", "s", "source_size", "place", "weight", "target")


def due(used: Column, knots: Column) -> Column:
    """Time at which the integral of a schedule reaches the part ``used`` (0 to 1) of its whole.

    knots: array of (c0, c1, t0, t1, w0, w1), the pieces with their integrals so far, as parts of the whole; w as density.
    """
    piece = F.element_at(F.filter(knots, lambda k: k["c0"] <= used), -1)
    need, slope = used - piece["c0"], (piece["w1"] - piece["w0"]) / (piece["t1"] - piece["t0"])
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * slope * need, F.lit(0.0)))
    return F.least(piece["t0"] + F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (piece["w0"] + root)), piece["t1"])


def pieces(schedule) -> Column:
    """A schedule's knots (t, w) as the array that due() reads."""
    steps = [(t0, t1, float(w0), float(w1), (w0 + w1) / 2 * (t1 - t0)) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]) if t1 > t0]
    whole = sum(x[4] for x in steps)
    if not steps or whole <= 0 or min(min(x[2:4]) for x in steps) < 0:
        raise ValueError("a schedule needs weights >= 0 over some time, not all 0")
    out, so_far = [], 0.0
    for t0, t1, w0, w1, area in steps:
        if area > 0:
            row = dict(c0=so_far, c1=so_far + area / whole, t0=float(t0), t1=float(t1), w0=w0 / whole, w1=w1 / whole)
            out.append(F.struct(*[F.lit(v).alias(k) for k, v in row.items()]))
            so_far += area / whole
    return F.array(*out)


def mix(docs: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, schedules: tuple = RAMPS, seed: str = "mix", keep: bool = False) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, source, size, source_size, target, taken, copies), sorted by first position.

    copies: array of (position in [0, 1], words), one for each time that the mix takes the document; the last document
    that a source's target reaches is taken in part, so that each source's words are its target (rounded down). Null
    texts and texts without words have size 0 and no copies. A null source is a source of its own, after all others.
    Equal doc_ids are ordered by size, then by the text's hash; rows without a doc_id are dealt by that hash. keep: with
    docs' columns in front, carried along row by row, so that ids may repeat or be null; those named like a column of the
    mix give way to it. An empty table gives an empty result.
    """
    x = F.xxhash64("text")
    row = F.struct(*docs.columns) if keep else F.lit(None).cast("int")
    rows = docs.select("doc_id", "source", words().alias("size"), F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), x.cast("string")))).alias("h"), x.alias("x"), row.alias("_row"))
    rows = written(rows.withColumn("s_null", F.col("source").isNull()).withColumn("s", F.coalesce("source", F.lit(""))), "sizes")
    n = rows.count()
    bits = max(4, min(24, math.ceil(math.log2(max(1, n) / ROWS_A_BUCKET))))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 6), 16, 10).cast("long"), 24 - bits))
    by = ["s_null", "s", "bucket"]
    sums = rows.groupBy(*by).agg(F.sum("size").alias("n"))
    sources = targets(sums.groupBy("s_null", "s").agg(F.sum("n").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("s_null", "s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).join(sources, ["s_null", "s"]).drop("n", "weight")
    inside = Window.partitionBy(*by).orderBy("h", "doc_id", "size", "x").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).join(starts, by).withColumn("start", F.col("at") + F.col("base"))
    quota = F.floor(F.col("target") + F.lit(1e-6))
    knots = F.element_at(F.array(*[pieces(s) for s in schedules]), (F.col("place") % len(schedules) + 1).cast("int"))
    offsets = F.transform(F.sequence(F.lit(0), F.lit(max(0, math.ceil(cap) - 1))), lambda e: F.col("start") + e * F.col("source_size"))
    reached = F.when(F.col("size") > 0, F.filter(offsets, lambda x: x < quota)).otherwise(F.array().cast("array<bigint>"))
    copies = F.transform(reached, lambda x: F.struct(due(x / F.col("target"), F.col("knots")).alias("position"), F.least(F.col("size"), quota - x).alias("words")))
    out = placed.withColumn("knots", knots).withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    made = ("size", "source_size", "target", "taken", "copies", "first_position")
    names = [F.col("_row")[c].alias(c) for c in docs.columns if c not in made] if keep else ["doc_id", "source"]
    out = out.select(*names, "size", "source_size", "target", taken.alias("taken"), "copies", F.get("copies", F.lit(0))["position"].alias("first_position"))
    return out.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The stream: a row for each copy (position, words, doc_id, source), range-sorted by position, with docs' columns if given."""
    rows = mixed.select("doc_id", "source", F.explode("copies").alias("c")).select("doc_id", "source", "c.position", "c.words")
    if docs is not None:
        rows = rows.drop("source").join(docs, "doc_id")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
