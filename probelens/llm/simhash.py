"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming check, components.

Fingerprints that differ in at most ``radius`` of 64 bits agree on at least ``blocks - radius`` of ``blocks``
blocks, so they meet in a bucket of one of C(blocks, radius) tables keyed by those blocks. Equal fingerprints are
folded first: copies never meet as pairs. Within a bucket the links are followed breadth first and only a spanning
star of each linked set leaves, so no bucket emits its pairs and no link between classes is lost.

A bucket above ``bucket_cap`` is not searched in one task. Its members are exchanged by midpoints instead: each
emits the words within 2 bits of it, and every member within 2 bits of a word that some member is within 1 bit of is
joined to that member (1 + 2 = 3). That finds the same sets with rows linear in the members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelens.llm.common import written
from probelens.llm.components import connected_components

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(raw: bytes | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the A-Z lower-cased word shingles; 0 for no words."""
    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    buf = b" ".join(words)
    if n <= width:
        hashes = np.array([digest(buf, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())
        hashes = np.fromiter((digest(buf[a:b], SEED) for a, b in spans), np.uint64, n - width + 1)
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ _BITS for j in range(8)])
    value = int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """docs -> (doc_id, h, fp long), h the text's hash. Null and wordless texts have fingerprint 0."""

    @F.pandas_udf("long")
    def fp(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: fingerprint(x, width), na_action=None)

    return docs.select("doc_id", F.xxhash64(text).alias("h"), fp(F.col(text).cast("binary")).alias("fp"))


def _masks(blocks: int, radius: int) -> list[int]:
    """One key mask for each choice of the blocks that may differ, as signed longs."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = [sum(parts[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _stars(fps: np.ndarray, reps: np.ndarray, radius: int) -> tuple[list, list]:
    """For each linked set of one bucket, a star from its smallest rep."""
    out_u, out_v = [], []
    left = np.arange(len(fps))
    while len(left) > 1:
        members, front, left = [left[0]], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
            if near.any():
                got = left[near].tolist()
                members += got
                front += got
                left = left[~near]
        if len(members) > 1:
            ids = reps[members]
            low = ids.min()
            out_u += ids[ids != low].tolist()
            out_v += [low] * int((ids != low).sum())
    return out_u, out_v


def _search(radius: int, cap: int):
    """Sorted rows (t, key, fp, rep) -> star links; members of a bucket above cap pass through with kind 1."""

    def run(batches):
        held = None
        over = None  # the key of a bucket that is being passed through
        for pdf in batches:
            t, key, fp, rep = (pdf[c].to_numpy() for c in ("t", "key", "fp", "rep"))
            if over is not None:
                same = (t == over[0]) & (key == over[1])
                n = len(t) if same.all() else int(np.argmin(same))
                if n:
                    yield pd.DataFrame({"kind": 1, "u": rep[:n], "v": fp[:n]})
                t, key, fp, rep = t[n:], key[n:], fp[n:], rep[n:]
                if not len(t):
                    continue
                over = None
            if held is not None:
                t, key, fp, rep = (np.concatenate(x) for x in zip(held, (t, key, fp, rep)))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cut))
            last = int(starts[-1])
            held = (t[last:], key[last:], fp[last:], rep[last:])
            yield from buckets(fp[:last], rep[:last], starts, radius, cap)
            if len(held[0]) > cap:
                over = (held[0][0], held[1][0])
                yield pd.DataFrame({"kind": 1, "u": held[3], "v": held[2]})
                held = None
        if held is not None and len(held[0]) > 1:
            yield from buckets(held[2], held[3], np.array([0, len(held[0])]), radius, cap)

    def buckets(fp, rep, starts, radius, cap):
        fps = fp.view(np.uint64)
        us, vs = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a > cap:
                yield pd.DataFrame({"kind": 1, "u": rep[a:b], "v": fp[a:b]})
            elif b - a == 2:
                if (int(fps[a]) ^ int(fps[a + 1])).bit_count() <= radius:
                    us.append(rep[a])
                    vs.append(rep[a + 1])
            elif b - a > 2:
                u, v = _stars(fps[a:b], rep[a:b], radius)
                us += u
                vs += v
        if us:
            yield pd.DataFrame({"kind": 0, "u": us, "v": vs})

    return run


def _by_midpoint(members: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded buckets, exactly, at radius 3; members(rep, fp)."""
    one = [0] + [1 << i for i in range(64)]
    two = [a | b for a, b in combinations(one[1:], 2)]
    signed = lambda xs: F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in xs])
    near = members.select("rep", "fp", F.explode(signed(one)).alias("e")).withColumn("a", F.col("rep"))
    far = members.select("rep", "fp", F.explode(signed(two)).alias("e")).withColumn("a", F.lit(None).cast("long"))
    at = near.unionByName(far).select("rep", F.col("fp").bitwiseXOR(F.col("e")).alias("z"), "a")
    hubs = at.groupBy("z").agg(F.min("a").alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1")
    return at.join(hubs, "z").where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()


def _linked(rows: DataFrame, radius: int = 3, blocks: int | None = None, bucket_cap: int = 16384) -> DataFrame:
    """rows(fp, ...) -> (fp, root), a row for each fingerprint; root is the smallest fingerprint of its component.

    Fingerprints are the nodes: what their rows are called links nothing.
    """
    if radius != 3:
        raise ValueError("crowded buckets are split exactly for radius 3 only")
    classes = rows.select("fp").distinct()
    if blocks is None:
        n = rows.count()
        blocks = 4 if n < 4 << 20 else 5 if n < 2 << 30 else 6
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(blocks, radius))])
    keyed = classes.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp", F.col("fp").alias("rep"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(keyed.repartition(parts, "t", "key").sortWithinPartitions("t", "key").mapInPandas(_search(radius, bucket_cap), "kind int, u long, v long"), "stars")
    links = found.where("kind = 0").select("u", "v")
    crowded = found.where("kind = 1")
    if not crowded.isEmpty():
        links = links.unionByName(_by_midpoint(crowded.select(F.col("u").alias("rep"), F.col("v").alias("fp")).distinct()))
    labels = connected_components(links)
    return classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 3, **options) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id), a row for each row of docs.

    component_id is the smallest doc_id reachable over fingerprints at most radius bits apart, itself included. Rows
    without a doc_id link like others but name no component. blocks None: as many as keep random buckets small (4 up
    to 4 million distinct fingerprints, then 5, then 6); every choice finds the same links.
    """
    rows = written(fingerprints(docs, text, width), "fingerprints")
    linked = rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(_linked(rows, **options), "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, nameless_apart: bool = True, **options) -> DataFrame:
    """One row of each group: of least doc_id, then text hash, then hash of the row.

    nameless_apart: of a group's rows without a doc_id one stays as well; else only in a group that has no other rows.
    Columns of docs may have any name.
    """
    rows = written(fingerprints(docs, "text", width), "fingerprints")
    nameless = F.col("doc_id").isNull().alias("_n") if nameless_apart else F.lit(False).alias("_n")
    first_named = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.struct("doc_id", "h").alias("lead")))["lead"]
    leads = rows.groupBy("fp", nameless).agg(first_named.alias("lead")).join(_linked(rows, **options), "fp")
    named = F.struct(F.col("lead.doc_id").isNull().alias("n"), "lead")
    leads = leads.groupBy("root", "_n").agg(F.min(named)["lead"].alias("lead")).select("_n", F.coalesce(F.col("lead.doc_id").cast("string"), F.lit("")).alias("_d"), F.col("lead.h").alias("_h"))
    whole = F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    keyed = docs.select(nameless, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.xxhash64("text").alias("_h"), whole.alias("_o"), F.struct(*docs.columns).alias("_row"))
    first = Window.partitionBy("_n", "_d", "_h").orderBy("_o")  # of equal texts of one id
    once = keyed.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return once.join(leads, ["_n", "_d", "_h"], "left_semi").select("_row.*")
