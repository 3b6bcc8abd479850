"""Exact top-k by Hamming distance: incremental multi-index hashing (Norouzi et al., 2012).

A 64-bit code is cut into m segments of about log2(rows) - 2 bits, each with a hash table (a word then holds about four
codes: in an equi-join a looked-up word costs more than a code met under it). Round s looks up every word at distance s
of the first a query segments. After it, a code that was not met differs by more than s in these and by more than s - 1
in the others, so all codes within m s + a - 1 bits are known: a query is done once its k-th verified distance is within
that radius. A query with k verified distances asks only for the segments that reach the k-th.
Equal codes are one entry of the index, with the k + 1 smallest ids. The masks of a round are rows, made from those of the
round before; the driver holds none. Once the words at the next distance outnumber the codes, or a million, what is left
of the queries is compared with all codes instead, in blocks: an outlier costs one scan.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelens.llm.common import written


#: words of a round from which the rest of the queries is compared with all codes; the masks of a round are fewer
MOST_MASKS = 1 << 20


def sign_code(vector: str = "embedding") -> Column:
    """Bit i is 1 if component i is above 0 (not NaN); components beyond 64 are added to i mod 64 first. Null: null."""
    v = F.col(vector)
    plain = F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    folded = F.transform(F.sequence(F.lit(0), F.least(F.size(v), F.lit(64)) - 1), lambda i: F.aggregate(F.filter(v, lambda x, j: j % 64 == i), F.lit(0.0), lambda a, x: a + x.cast("double")))
    bits = F.transform(F.when(F.size(v) <= 64, plain).otherwise(folded), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.expr("1L")).otherwise(F.expr("0L")))
    code = F.aggregate(F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i)), F.expr("0L"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(v) > 0, code)


def _segments(m: int) -> list[tuple[int, int]]:
    edges = [round(i * 64 / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _words(code: str, segments) -> Column:
    """Array of (j, w, val): the code's segments, with their widths."""
    part = lambda at, width: F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(j).alias("j"), F.lit(width).alias("w"), part(at, width).alias("val")) for j, (at, width) in enumerate(segments)])


def _further(masks: DataFrame) -> DataFrame:
    """masks(w, mask, top) of s bits -> those of s + 1: each takes one more bit above its highest."""
    bit = F.explode(F.when(F.col("top") + 1 < F.col("w"), F.sequence(F.col("top") + 1, F.col("w") - 1)))
    return masks.select("w", "mask", bit.alias("top")).select("w", F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("top"))).alias("mask"), "top")


def _scan(index: DataFrame, todo: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(q, code, low, n, dist): for each q of todo, the k + 1 nearest codes of each part of the index. block: queries that are sent at once."""

    def nearest(sent):
        def run(batches):
            qs = sent.value
            best = None
            for pdf in batches:
                for a in range(0, len(pdf), 4096):
                    part = pdf.iloc[a : a + 4096]
                    code, low, n = (part[c].to_numpy(np.int64) for c in ("code", "low", "n"))
                    dist = np.bitwise_count(qs[:, None] ^ code.view(np.uint64)[None]).astype(np.int64)
                    new = [dist, *(np.broadcast_to(x, dist.shape) for x in (code, low, n))]
                    if best is not None:
                        new = [np.concatenate(x, axis=1) for x in zip(best, new)]
                    order = np.lexsort((new[2], new[0]), axis=1)[:, : k + 1]
                    best = [np.take_along_axis(x, order, axis=1) for x in new]
            if best is not None:
                width = best[0].shape[1]
                yield pd.DataFrame({"q": np.repeat(qs.view(np.int64), width), "code": best[1].ravel(), "low": best[2].ravel(), "n": best[3].ravel().astype(np.int32), "dist": best[0].ravel().astype(np.int32)})

        return run

    out, held = None, []
    small = index.select("code", F.element_at("ids", 1).alias("low"), F.size("ids").alias("n"))

    def met(qs):
        sent = index.sparkSession.sparkContext.broadcast(np.array(qs, np.int64).view(np.uint64))
        return small.mapInPandas(nearest(sent), "q long, code long, low long, n int, dist int")

    for r in todo.select("q").toLocalIterator():
        held.append(r["q"])
        if len(held) == block:
            out, held = met(held) if out is None else out.unionByName(met(held)), []
    return (met(held) if out is None else out.unionByName(met(held))) if held else out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code", most_words: int = 1 << 12) -> DataFrame:
    """rows(id, code), queries(id, code) -> (query_id, rank, id, distance): the k nearest rows other than the query.

    Ties go to the smaller id. Rows with a null id or code are not found and not queries; repeated rows count once.
    Fewer than k rows give fewer than k results. most_words: words that a query may look up in one round whatever the
    number of codes.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).where("id is not null and code is not null").distinct()
    few = Window.partitionBy("code").orderBy("id")
    index = written(named.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = written(queries.select(F.col(id_col).alias("query_id"), F.col(code_col).alias("q")).where("query_id is not null and q is not null").distinct(), "queries")
    size = index.count()
    m = max(1, min(16, round(64 / max(4, math.log2(max(2, size)) - 2))))
    segments = _segments(m)
    tables = index.select("code", F.element_at("ids", 1).alias("low"), F.size("ids").alias("n"), F.explode(_words("code", segments)).alias("w")).select("w.j", "w.val", "code", "low", "n")
    todo = asked.select("q").distinct().withColumns({"bound": F.lit(64), "a": F.lit(m)})
    best = None
    widest = max(w for _, w in segments)
    masks = spark.createDataFrame([(w, 0, -1) for w in sorted({w for _, w in segments})], "w int, mask long, top int")
    ranked = Window.partitionBy("q").orderBy("dist", "low")
    for s in range(widest + 1):
        if sum(math.comb(w, s) for _, w in segments) > min(max(most_words, size), MOST_MASKS):
            met = _scan(index, todo, k)
            met = (met if best is None else met.unionByName(best.select("q", "code", "low", "n", "dist"))).distinct()
            best = written(met.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).drop("r"), "best")
            break
        masks = written(_further(masks), "masks") if s else masks
        asks = todo.select("q", "bound", "a", F.explode(_words("q", segments)).alias("x")).where("x.j < a").select("q", "bound", "x.j", "x.w", "x.val")
        probes = asks.join(F.broadcast(masks), "w").select("q", "bound", "j", F.col("val").bitwiseXOR(F.col("mask")).alias("val"))  # at most MOST_MASKS
        dist = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = probes.alias("p").join(tables.alias("t"), (F.col("p.j") == F.col("t.j")) & (F.col("p.val") == F.col("t.val")) & (dist <= F.col("bound")))
        met = met.select("q", "code", "low", "n", dist.alias("dist"))
        met = (met if best is None else met.unionByName(best)).distinct()
        best = written(met.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).drop("r"), "best")
        near = best.join(todo.select("q", (F.col("a") + m * s - 1).alias("radius")), "q")
        known = near.groupBy("q").agg(F.sum(F.when(F.col("dist") <= F.col("radius"), F.col("n")).otherwise(0)).alias("sure"), F.sum("n").alias("have"), F.max("dist").alias("worst"))
        left = todo.select("q").join(known, "q", "left").where(F.coalesce("sure", F.lit(0)) < k + 1).select("q", F.when(F.col("have") >= k + 1, F.col("worst")).otherwise(F.lit(64)).alias("bound"))
        todo = written(left.withColumn("a", F.least(F.col("bound") - m * (s + 1) + 1, F.lit(m))), "todo")
        if todo.isEmpty():
            break
    found = best.join(index, "code").select("q", "dist", F.explode("ids").alias("id"))
    first = Window.partitionBy("q").orderBy("dist", "id")
    found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    mine = asked.join(found, "q").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), F.col("dist").alias("distance"))
