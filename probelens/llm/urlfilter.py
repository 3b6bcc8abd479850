"""URL rules by a Bloom filter cascade.

A rule is (host, path, verdict): it fits its host and all subdomains where the url's path starts with the rule's path.
A url's keys are its host suffixes with its path prefixes of the lengths that rules have; the keys of all urls are the
complete universe on which filters are ever asked. A cascade (as in CRLite, Larisch et al., 2017) holds the listed keys
in level 1, the universe's keys that level 1 wrongly accepts in level 2, the listed keys that level 2 wrongly accepts in
level 3, and so on until none is left: on the universe, membership is exact, and a url is judged without a join.

There is a cascade for each verdict. The longest listed key of a url (then the longer host) is the rule that decides;
without one the verdict is ``allow``. A cascade's size is bounded by the listed keys, not by the urls: it is sent
to the executors while under ``max_filter_bytes``, else urls are judged by an equi-join of their keys with the rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.llm.common import written

BITS_A_KEY, HASHES = 10, 4


class Bloom:
    def __init__(self, n: int, salt: int):
        self.m = max(64, -(-n * BITS_A_KEY // 8) * 8)
        self.salt = salt
        self.bits = np.zeros(self.m // 8, np.uint8)

    def _at(self, keys) -> np.ndarray:
        h = np.array([xxhash.xxh3_128_intdigest(k.encode(), self.salt) & (2**64 - 1) for k in keys], np.uint64)
        a, b = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(self.m)

    def add(self, keys) -> None:
        if len(keys):
            at = self._at(keys).ravel()
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, keys) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        at = self._at(keys)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(1)


class Cascade:
    """Levels of filters; exact for the keys of the universe it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def has(self, keys) -> np.ndarray:
        keys = np.asarray(keys, object)
        inside = np.zeros(len(keys), bool)
        asked = np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            passed = level.has(keys[asked])
            inside[asked[~passed]] = depth % 2 == 1  # turned away by an even level (2, 4, ...): listed
            asked = asked[passed]
        inside[asked] = len(self.levels) % 2 == 1
        return inside

    def nbytes(self) -> int:
        return sum(x.bits.nbytes for x in self.levels)


def build(universe: DataFrame, listed: list[str], seed: int = 0, most: int = 1 << 22) -> Cascade:
    """universe(key), distinct or not; listed: the keys on the list, which is the side that must fit a driver.

    Level 1 is tested over the whole universe on the executors; only keys that it wrongly accepts, a small part bounded
    by its error rate, are kept for the next levels. Where these are too many, level 1 gets more room.
    """
    spark = universe.sparkSession
    room = 1
    while True:
        first = Bloom(max(1, len(listed)) * room, seed)
        first.add(listed)
        sent = spark.sparkContext.broadcast((first, set(listed)))

        def wrong(batches):
            level, known = sent.value
            for batch in batches:
                keys = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, hit in zip(keys, level.has(keys)) if hit and k not in known], pa.string())})

        false = written(universe.select("key").mapInArrow(wrong, "key string").distinct(), "false-keys")
        n = false.count()
        if n <= most:
            break
        room *= 4
    levels, inside, outside = [first], list(listed), [r[0] for r in false.collect()]  # at most ``most`` keys
    while outside:
        level = Bloom(len(outside), seed + len(levels))
        level.add(outside)
        levels.append(level)
        inside, outside = outside, [k for k, hit in zip(inside, level.has(inside)) if hit]
    return Cascade(levels)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def keys(lengths: list[int]) -> Column:
    """All host suffixes with all path prefixes of the given lengths, as 'host' + 'path' split by a NUL."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    kept = F.array_compact(prefixes)
    return F.flatten(F.transform(suffixes, lambda s: F.transform(kept, lambda p: F.concat(s, F.lit("\0"), p))))


def url_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """keys() for one url in Python."""
    labels = host.split(".")
    return [f"{'.'.join(labels[i:])}\0{path[:n]}" for i in range(len(labels)) for n in lengths if len(path) >= n]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """pages -> its columns with host, path, rule (host + path of the deciding rule, or null), verdict.

    rules: (host, path, 'allow' or 'block'); of rules with one key, the last holds. A null url, or one without ://, has
    an empty host and path, which only a rule with an empty host fits.
    """
    verdict = {f"{h.lower()}\0{p}": v for h, p, v in rules}
    if not set(verdict.values()) <= {"allow", "block"}:
        raise ValueError("verdicts are allow and block")
    lengths = sorted({len(k.split("\0")[1]) for k in verdict})
    host, path = parts(url)
    rows = pages.withColumns({"host": host, "path": path})
    if not lengths:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    universe = rows.select(F.explode(keys(lengths)).alias("key")).distinct()
    cascades = {v: build(universe, sorted(k for k, w in verdict.items() if w == v), seed=100 * i) for i, v in enumerate(("allow", "block"))}
    if sum(c.nbytes() for c in cascades.values()) > max_filter_bytes:
        return _joined(rows, verdict, lengths)
    sent = pages.sparkSession.sparkContext.broadcast(cascades)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            own = [url_keys(h, p, lengths) for h, p in zip(hosts, paths)]
            number: dict[str, int] = {}
            for ks in own:
                for k in ks:
                    number.setdefault(k, len(number))
            there = list(number)
            found = {v: c.has(there) for v, c in sent.value.items()}
            out = []
            for ks in own:
                hits = [(len(k) - 1, k.index("\0"), k, v) for v, hit in found.items() for k in ks if hit[number[k]]]
                _, _, k, v = max(hits) if hits else (0, 0, None, "allow")
                out.append((k and k.replace("\0", "", 1), v))
            yield pd.DataFrame(out, columns=["rule", "verdict"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    got = F.pandas_udf(run, "rule string, verdict string")("host", "path")
    return rows.withColumn("_v", got).withColumns({"rule": F.col("_v.rule"), "verdict": F.col("_v.verdict")}).drop("_v")


def _joined(rows: DataFrame, verdict: dict[str, str], lengths: list[int]) -> DataFrame:
    """The same by joins, for lists whose filters are too large to send."""
    listed = rows.sparkSession.createDataFrame(list(verdict.items()), "key string, v string")
    numbered = written(rows.withColumn("_id", F.monotonically_increasing_id()), "pages")
    hits = numbered.select("_id", F.explode(keys(lengths)).alias("key")).join(listed, "key")
    best = hits.groupBy("_id").agg(F.max(F.struct(F.length("key").alias("a"), F.instr("key", "\0").alias("b"), "key", "v")).alias("_m"))
    out = numbered.join(best, "_id", "left").drop("_id")
    return out.withColumns({"rule": F.replace(F.col("_m.key"), F.lit("\0"), F.lit("")), "verdict": F.coalesce("_m.v", F.lit("allow"))}).drop("_m")
