"""Benchmark decontamination by size-partitioned MinHash containment search.

An item contaminates a document if the document has at least ``threshold`` of the item's distinct word shingles.
Items are partitioned by their number of shingles into powers of two (as in LSH Ensemble, Zhu et al., 2016). An item is
represented by its bottom-s MinHash sketch (its s smallest shingle hashes), and each partition has an index of its own
from sketch hashes to items; a document, however long, asks with all its shingle hashes, as in containment MinHash
(Koslicki and Zabeti, 2019), so a short item inside a long text isn't diluted, and it skips every partition whose
smallest item needs more shingles than it has. An item of q shingles may miss at most q - ceil(threshold q) of them; s
is twice that and two more, and a document is a candidate if it has all sketch hashes but that many. No contaminated
document can fail this test. Candidates are verified by exact shingle containment.

Words are runs of letters, digits and _ in the lower-cased text, so that punctuation set against a passage does not hide
it. Items of fewer words than a shingle have their whole sequence as their one shingle, which is sought as such.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokenize(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the runs of width words, one for each start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return out


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


class Partition:
    """Items of one shingle width and size class: an index from sketch hashes to items."""

    def __init__(self, members: list[tuple[int, int, np.ndarray, int]]):
        """members: (item number, hits that a candidate needs, sketch, shingles that a document needs)."""
        self.needs = np.array([n for _, n, _, _ in members])
        self.numbers = np.array([i for i, _, _, _ in members])
        self.least = min(x for _, _, _, x in members)
        hashes = np.concatenate([h for _, _, h, _ in members])
        owners = np.repeat(np.arange(len(members)), [len(h) for _, _, h, _ in members])
        order = np.argsort(hashes, kind="stable")
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.ends, self.owners = np.append(first, len(order)), owners[order]

    def candidates(self, own: np.ndarray) -> np.ndarray:
        """Item numbers that distinct shingle hashes of a document may contain."""
        if len(own) < self.least:
            return self.numbers[:0]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = at[self.keys[at] == own]
        if not len(at):
            return self.numbers[:0]
        owners = np.concatenate([self.owners[self.ends[k] : self.ends[k + 1]] for k in at])
        return self.numbers[np.bincount(owners, minlength=len(self.needs)) >= self.needs]


class Sketches:
    """One block of items: sketches by partition for the candidate test, and exact shingles for the verification."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.threshold, self.items = threshold, []
        members: dict[tuple[int, int], list] = {}
        for item_id, text in items:
            words = tokenize(text)
            if not words:
                continue
            w = min(width, len(words))
            exact = frozenset(tuple(words[i : i + w]) for i in range(len(words) - w + 1))
            hashes = np.unique(shingles(_hashes(words), w))
            least = math.ceil(threshold * len(exact) - 1e-9)
            spare = len(exact) - least
            sketch = hashes[: min(len(hashes), 2 * spare + 2)]
            members.setdefault((w, len(exact).bit_length()), []).append((len(self.items), max(1, len(sketch) - spare), sketch, least))
            self.items.append((item_id, exact))
        self.partitions: dict[int, list[Partition]] = {}
        for (w, _), own in sorted(members.items()):
            self.partitions.setdefault(w, []).append(Partition(own))

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shared shingles, item shingles) of the items that the text contains."""
        words = tokenize(text)
        hashes, found = None, []
        for w, partitions in self.partitions.items():
            if len(words) < w:
                continue
            hashes = _hashes(words) if hashes is None else hashes
            own = np.unique(shingles(hashes, w))
            there = None
            for partition in partitions:
                for i in partition.candidates(own):
                    there = set(zip(*(words[k:] for k in range(w)))) if there is None else there
                    item_id, exact = self.items[i]
                    shared = len(exact & there)
                    if shared >= self.threshold * len(exact) - 1e-9:
                        found.append((item_id, shared, len(exact)))
        return found


def _blocks(bench: DataFrame, text: str, most: int):
    """Items in blocks of at most about most characters (one item at least), read one partition at a time."""
    held, size = [], 0
    for r in bench.select(F.col("item_id").cast("string").alias("item_id"), F.col(text).alias("text")).where("item_id is not null").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matches(sent):
    def run(batches):
        for pdf in batches:
            rows = [(d, *m, m[1] / m[2]) for d, t in zip(pdf["doc_id"], pdf["text"]) for m in sent.value.search(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shared", "n_item", "containment"])

    return run


def _hit(sent):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(sent.value.search(t)), na_action=None).astype(bool)

    return hit


def contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", width: int = 5, threshold: float = 0.8, max_block_chars: int = 8 << 20) -> DataFrame:
    """docs(doc_id, text), bench(item_id, text) -> (doc_id, item_id, n_shared, n_item, containment), a row for each match.

    Ids keep their types, numbers or text. Only a block of items of bounded size is sent to the executors at once; a larger
    benchmark takes one pass over docs for each block. Null or wordless texts match nothing; repeated rows are reported once for each.
    """
    spark = docs.sparkSession
    schema = "doc_id string, item_id string, n_shared int, n_item int, containment double"
    out = spark.createDataFrame([], schema)
    for block in _blocks(bench, text, max_block_chars):
        sent = spark.sparkContext.broadcast(Sketches(block, width, threshold))

        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text"))
        out = out.unionByName(rows.mapInPandas(_matches(sent), schema))
    return out.withColumns({c: F.col(c).cast(df.schema[c].dataType) for c, df in (("doc_id", docs), ("item_id", bench))})


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", width: int = 5, threshold: float = 0.8, max_block_chars: int = 8 << 20) -> DataFrame:
    """docs without the rows that contain an item. Rows are judged where they stand: no id, no shuffle."""
    kept = docs
    for block in _blocks(bench, text, max_block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Sketches(block, width, threshold))

        kept = kept.where(~_hit(sent)(F.col(text)))
    return kept
