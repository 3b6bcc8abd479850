"""Substring deduplication: windows of ``width`` words, a count-min prefilter, then exact grouping of what may repeat.

Pass 1. Every 8-word gram is hashed; a window's anchor is the smallest gram hash inside it (winnowing, Schleimer et al.,
2003), so equal windows have equal anchors and a text has about one anchor in 22 words. Each partition adds a text's
distinct anchors to a count-min sketch; partition sketches are merged by cell. A sketch never counts too low, so a
window whose anchor counts below 2 in some row of the sketch is in one text only and is left out. The sketch grows with
the texts, to 2^28 cells a row; where it fills up, more windows pass, none is lost. A block of cells is added up in a task
of its own, and only its bits (counted twice or more) go to the driver and out to the executors.

Pass 2 groups the windows that passed by 128-bit hashes of their word sequences, which stand for the sequences. Within a partition only the smallest
doc_id of each is left open, the others are settled there; so a passage that a third of all texts share sends a row for
each partition, not for each text. The open rows meet by window, and those with a larger doc_id than the smallest are
covered. The covered spans of a text are then cut from it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: cells of a block of the sketch
BLOCK = 1 << 18
#: a row of the sketch has 2^28 cells at most: 64 MB of bits in all
MOST_BITS = 28
GRAM = 8
ROWS = 2
#: windows of which a partition settles the repeats at once
HELD = 3_000_000
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(w: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all runs of width values, by prefix sums over powers of the inverse base."""
    n = len(w)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * _powers(pow(base, -1, 1 << 64), n), dtype=np.uint64)))
    return (sums[width:] - sums[:-width]) * _powers(base, n - width + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _packs(pdf: pd.DataFrame, most: int = 400_000):
    """(positions of the texts, word hashes end to end, sizes) for the texts of some hundred thousand words together."""
    digest = xxhash.xxh64_intdigest
    where, pool, sizes = [], [], []
    for i, raw in enumerate(pdf["raw"]):
        own = list(map(digest, (raw or b"").split()))
        where.append(i)
        pool += own
        sizes.append(len(own))
        if len(pool) > most:
            yield np.array(where), np.array(pool, np.uint64), np.array(sizes)
            where, pool, sizes = [], [], []
    if where:
        yield np.array(where), np.array(pool, np.uint64), np.array(sizes)


def _windows(pool: np.ndarray, sizes: np.ndarray, width: int):
    """(window starts in pool, index of the window's text, anchors) of the windows inside texts."""
    if len(pool) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = min(GRAM, width)
    anchor = _least(_mixed(rolling(pool, gram, _B1)), width - gram + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(text[: len(anchor)] == text[width - 1 :])
    return starts, text[starts], anchor[starts]


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mixed(anchor + np.uint64((row * _B2) & (2**64 - 1))) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_cells(rows: DataFrame, width: int, bits: int) -> np.ndarray:
    """Count-min sketch over the anchors of all texts, reduced to bits: counted twice or more. ROWS x 2^bits / 8 bytes."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for pdf in batches:
            for _, pool, sizes in _packs(pdf):
                _, text, anchor = _windows(pool, sizes, width)
                cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))  # runs of one anchor first
                keep = np.concatenate((cut, [len(anchor) - 1])) if len(anchor) else cut
                text, anchor = text[keep], anchor[keep]
                order = np.lexsort((text, anchor))
                text, anchor = text[order], anchor[order]
                once = np.ones(len(anchor), bool)
                once[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                held.append(anchor[once])
                size += int(once.sum())
            if size > HELD:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    def packed(held):
        anchors = np.concatenate(held)
        for row in range(ROWS):
            at, n = np.unique(_cells(anchors, row, bits), return_counts=True)
            yield _by_block(row, at, np.minimum(n, 2))

    def add(batches):
        """Rows in order of block: one block is held at a time, whatever the number of partitions that sent a part of it."""
        now, total = None, np.zeros(BLOCK, np.uint8)
        for pdf in batches:
            out = []
            for row, blk, at, n in zip(pdf["row"], pdf["blk"], pdf["at"], pdf["n"]):
                if (row, blk) != now:
                    if now is not None:
                        out.append((*now, np.packbits(total > 1).tobytes()))
                    now, total = (row, blk), np.zeros(BLOCK, np.uint8)
                at = np.frombuffer(at, "<u4")
                total[at] = np.minimum(total[at] + np.frombuffer(n, np.uint8), 2)
            yield pd.DataFrame(out, columns=["row", "blk", "bits"])
        if now is not None:
            yield pd.DataFrame([(*now, np.packbits(total > 1).tobytes())], columns=["row", "blk", "bits"])

    parts = rows.select("raw").mapInPandas(run, "row int, blk int, at binary, n binary")
    marked = parts.repartition("row", "blk").sortWithinPartitions("row", "blk").mapInPandas(add, "row int, blk int, bits binary")
    out = np.zeros((ROWS, max(1 << bits, BLOCK) // 8), np.uint8)
    for r in marked.collect():  # bits of a block
        out[r["row"], r["blk"] * BLOCK // 8 : (r["blk"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _by_block(row: int, at: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Counted cells, in order, as packed rows of a block each."""
    blocks = at // BLOCK
    cut = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(at)]))
    out = [(row, int(blocks[a]), (at[a:b] % BLOCK).astype("<u4").tobytes(), n[a:b].astype(np.uint8).tobytes()) for a, b in zip(cut[:-1], cut[1:]) if b > a]
    return pd.DataFrame(out, columns=["row", "blk", "at", "n"])


def sketch_bits(docs: DataFrame, text: str) -> int:
    """log2 of the cells of a sketch row: about 8 for each anchor, at 6 bytes a word and an anchor in 22 words; MOST_BITS at most."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(max(20, math.ceil(math.log2(max(1, size / 16)))), MOST_BITS)


OPEN = "doc_id long, thash long, h1 long, h2 long, start int, span int"


def _candidates(sent, width: int, bits: int):
    """Rows (doc_id, thash, h1, h2, start, span): windows left open with their hashes, and settled spans with null hashes."""

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            ids, thash = pdf["doc_id"].to_numpy(), pdf["thash"].to_numpy()
            for where, pool, sizes in _packs(pdf):
                starts, text, anchor = _windows(pool, sizes, width)
                hit = np.ones(len(anchor), bool)
                for row in range(ROWS):
                    cell = _cells(anchor, row, bits)
                    hit &= ((sent.value[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)
                starts, text = starts[hit], text[hit]
                if len(starts):
                    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    h1 = rolling(pool, width, _B1)[starts]
                    h2 = rolling(_mixed(pool), width, _B2)[starts]
                    held.append((ids[where[text]], thash[where[text]], h1.view(np.int64), h2.view(np.int64), (starts - first[text]).astype(np.int32)))
                    size += len(starts)
            if size > HELD:
                yield from settle(held)
                held, size = [], 0
        if size:
            yield from settle(held)

    def settle(held):
        doc, thash, h1, h2, start = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        low = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        covered = np.zeros(len(order), bool)
        covered[order] = doc[order] > low
        at = np.flatnonzero(covered)
        if len(at):  # held in order of text and start, so that runs lie together
            go = (doc[at][1:] != doc[at][:-1]) | (thash[at][1:] != thash[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)
            begin = np.concatenate(([0], np.flatnonzero(go) + 1))
            end = np.concatenate((begin[1:], [len(at)])) - 1
            none = pd.array([None] * len(begin), "Int64")
            yield pd.DataFrame({"doc_id": doc[at][begin], "thash": thash[at][begin], "h1": none, "h2": none, "start": start[at][begin], "span": start[at][end] - start[at][begin] + width})
        at = np.flatnonzero(~covered)
        for a in range(0, len(at), 200_000):
            x = at[a : a + 200_000]
            yield pd.DataFrame({"doc_id": doc[x], "thash": thash[x], "h1": h1[x], "h2": h2[x], "start": start[x], "span": np.full(len(x), width, np.int32)})

    return run


def covered_spans(docs: DataFrame, text: str = "text", width: int = 50, bits: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, thash, start, span): words that windows seen in a smaller doc_id cover. bits: None takes sketch_bits()."""
    bits = sketch_bits(docs, text) if bits is None else bits
    raw = F.col(text).cast("binary").alias("raw")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("thash"), raw)
    sent = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs.select(raw), width, bits))  # 2^MOST_BITS cells a row at most
    found = rows.mapInPandas(_candidates(sent, width, bits), OPEN)
    # settled spans keep rows of their own: they are spread by their text, not gathered under a null window
    keyed = found.withColumn("k1", F.coalesce("h1", F.xxhash64("doc_id", "start"))).withColumn("k2", F.coalesce("h2", F.col("thash")))
    low = F.min(F.when(F.col("h1").isNotNull(), F.col("doc_id"))).over(Window.partitionBy("k1", "k2"))
    return keyed.withColumn("low", low).where("h1 is null or doc_id > low").select("doc_id", "thash", "start", "span")


def _cut(words: list[bytes], spans) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for start, span in spans:
        keep[start : start + span] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def dedup_substrings(docs: DataFrame, text: str = "text", width: int = 50, bits: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_removed, kept, kept_sha256), a row for each row of docs.

    Removes each word covered by a window of width words whose sequence also starts in a text with a smaller doc_id;
    the input decides, not what is left. kept: the words left, joined by one space. A null text has no words. A row
    without a doc_id is neither cut nor a reason to cut. Rows that share a doc_id don't cut each other.
    """
    spans = covered_spans(docs, text, width, bits).groupBy("doc_id", "thash").agg(F.collect_list(F.struct("start", "span")).alias("spans"))  # of one text

    @F.pandas_udf("n_words long, n_removed long, kept string, kept_sha256 string")
    def cut(raw: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for x, own in zip(raw, spans):
            words = (x or b"").split()
            kept = _cut(words, [(s["start"], s["span"]) for s in own]) if own is not None and len(own) else words
            joined = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), joined.decode(errors="replace"), hashlib.sha256(joined).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "kept_sha256"])

    rows = docs.select("doc_id", F.xxhash64(text).alias("thash"), F.col(text).cast("binary").alias("raw"))
    got = rows.join(spans, ["doc_id", "thash"], "left").select("doc_id", cut("raw", "spans").alias("r"))
    return got.select("doc_id", "r.*")
