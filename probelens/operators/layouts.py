"""What a probe wants to be fed: plain vectors, statement and negation end to end, several layers end to end, topics.

A kind names a probe with its flags; ``prepared`` builds its input from activations by item and layer, and ``loaded`` takes
a probe from this registry or from any module by ``module:attribute``.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions.md5 import BLOCK, heads
from probelens.functions.scalars import diagonal
from probelens.functions.stage import staged
from probelens.operators import assembled, joins
from probelens.operators.audit import Probe


@dataclass(frozen=True)
class Kind:
    """run: (train, rows) -> rows with score. paired: a vector is the statement's and its negation's; topics: rows need a
    topic; taps: depths whose layers' vectors stand end to end, instead of one layer's."""

    name: str
    run: Probe
    paired: bool = False
    topics: bool = False
    taps: tuple[float, ...] = ()


DEPTHS = (0.6, 0.7, 0.8, 0.85)
KINDS = {
    k.name: k
    for k in (
        Kind("mass_mean", assembled.mass_mean),
        Kind("logistic", assembled.logistic_probe),
        Kind("mlp", assembled.mlp),
        Kind("ccs", assembled.ccs, paired=True),
        Kind("ttpd", assembled.ttpd, paired=True, topics=True),
        Kind("drift", assembled.drift, taps=DEPTHS),
        Kind("drift_concat", assembled.drift_concat, taps=DEPTHS),
        Kind("frequency", assembled.frequency_only),
    )
}


def loaded(spec: str | Kind) -> Kind:
    """A kind by its name here, or by ``module:attribute``: a Kind, or a function (train, rows) that may carry the flags
    paired, topics and taps as attributes."""
    if isinstance(spec, Kind):
        return spec
    if spec in KINDS:
        return KINDS[spec]
    module, _, attribute = spec.partition(":")
    if not attribute:
        raise KeyError(f"no probe {spec}; there are {', '.join(sorted(KINDS))}, or module:attribute")
    found = getattr(importlib.import_module(module), attribute)
    if isinstance(found, Kind):
        return found
    if not callable(found):
        raise TypeError(f"{spec} is no probe: it can't be called with (train, rows)")
    return Kind(spec, found, bool(getattr(found, "paired", False)), bool(getattr(found, "topics", False)), tuple(getattr(found, "taps", ())))


def prepared(kind: Kind, acts: DataFrame, layer: int | None = None, negated: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """A row for each item as kind wants it, with acts' other columns; acts: (key, layer, vec, ...), negated: (key, layer, vec).

    layer: which one, the middle one if None; not asked for where taps are. What a flag needs and the input lacks is an error.
    """
    if kind.topics and "topic" not in acts.columns:
        raise ValueError(f"{kind.name} needs a column topic")
    if kind.paired and negated is None:
        raise ValueError(f"{kind.name} needs the vectors of negated statements")
    n = acts.agg(F.max("layer")).first()[0]  # one number
    if n is None:
        raise ValueError("there are no layers")
    rest = [c for c in acts.columns if c not in ("layer", "vec")]

    def one(rows: DataFrame) -> DataFrame:
        if kind.taps:
            return joins.stacked_taps(rows, assembled.taps(n + 1, kind.taps), key)
        return rows.where(F.col("layer") == ((n + 1) // 2 if layer is None else layer)).select(key, "vec")

    vectors = one(acts)
    if kind.paired:
        vectors = joins.paired_vectors(vectors, one(negated), key)
    return acts.select(*rest).distinct().join(vectors.hint("merge"), key)  # vectors of few values are small on disk only


def swept(names: tuple, acts: DataFrame, negated: DataFrame | None = None, layers: tuple | None = None, key: str = "item_id", model: str = "vectors") -> DataFrame:
    """(model, probe, layer, item, cell, truth, score) of each kind at each layer, learnt on the diagonal; layer is null for
    kinds that read several. Kinds that lack what they need are an error, never left out."""
    acts, negated = staged(acts, "acts"), negated if negated is None else staged(negated, "negated")  # each probe reads them
    out = None
    for kind in map(loaded, names):
        for layer in (None,) if kind.taps else layers or (None,):
            rows = staged(prepared(kind, acts, layer, negated, key), "prepared")
            got = kind.run(rows.where(diagonal(F.col("cell"))), rows).select(F.lit(model).alias("model"), F.lit(kind.name).alias("probe"), F.lit(layer).cast("int").alias("layer"), key, "cell", "truth", "score")
            out = got if out is None else out.unionByName(got)
    return out


def text_vectors(rows: DataFrame, text: str = "text", dimensions: int = 16, layers: int = 4) -> DataFrame:
    """rows without text, with layer and vec: signed counts of a text's hashed runs of layer + 1 words, over the square root of
    their number. Stands in for activations where there is no model; a text without words is a vector of zeros.

    A run is hashed once, as a slice of its text's bytes, whatever the dimensions."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " "))

    @F.pandas_udf("array<array<double>>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_vectors(texts.tolist(), dimensions, layers)), dtype=object)

    rest = [c for c in rows.columns if c != text]
    each = rows.select(*rest, vectors(plain).alias("_v"))
    # numbers are exploded, not vectors, so that a filter on them is not one on the function, which then ran twice
    each = each.select(*rest, "_v", F.explode(F.array(*[F.lit(i) for i in range(layers)])).alias("layer"))
    return each.select(*rest, "layer", F.get("_v", "layer").alias("vec"))


#: bytes of texts whose runs are hashed at once
TEXTS = 1 << 18


def _vectors(texts: list[str], dimensions: int, layers: int) -> Iterator[list[np.ndarray]]:
    """For each text of single-spaced words its vector of every layer."""
    part, size = [], 0
    for t in texts:
        part.append(t.encode())
        size += len(part[-1])
        if size >= TEXTS:
            yield from _hashed(part, dimensions, layers)
            part, size = [], 0
    if part:
        yield from _hashed(part, dimensions, layers)


def _hashed(texts: list[bytes], dimensions: int, layers: int) -> Iterator[list[np.ndarray]]:
    line = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.flatnonzero(line == 32)  # each closes a word; an empty text is a word of no bytes
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.array([t.count(b" ") + 1 for t in texts])
    first = np.cumsum(counts) - counts
    counts = np.where([bool(t) for t in texts], counts, 0)
    out = np.zeros((layers, len(texts), dimensions))
    for layer in range(layers):
        runs = np.where(counts > 0, np.maximum(1, counts - layer), 0)
        of = np.repeat(np.arange(len(texts)), runs)
        begin = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
        last = np.minimum(begin + layer, (first + counts - 1)[of])
        a, b = starts[begin], ends[last]
        h = np.empty(len(of), np.int64)
        for n in np.unique(b - a):
            here = np.flatnonzero(b - a == n)
            for c in range(0, len(here), BLOCK):
                some = here[c : c + BLOCK]
                said = np.empty((len(some), 4 + n), np.uint8)
                said[:, :4] = np.frombuffer(b"vec:", np.uint8)
                said[:, 4:] = line[a[some, None] + np.arange(n)]
                h[some] = heads(said)
        signs = 1.0 - 2.0 * ((h >> 16) & 1)
        sums = np.bincount(of * dimensions + h % dimensions, signs, len(texts) * dimensions).reshape(-1, dimensions)
        out[layer] = sums / np.sqrt(np.maximum(runs, 1))[:, None]
    for i in range(len(texts)):
        yield list(out[:, i])
