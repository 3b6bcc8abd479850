"""Periodic runs of words: the tandem repeats of a text (Gusfield and Stoye, 2004), located and merged into runs.

A run is a stretch of words with smallest period q, as long as ``least`` words and ``times`` q, that no neighbouring word
extends. Runs of one text are found in three steps, over texts laid end to end:

1. Names of all word sequences of 1, 2, 4, ... words (Karp, Miller and Rosenberg) order the suffixes and give the longest
   common extension of any two places; the order with its common prefixes is the suffix tree, a node an interval of it.
   From it come the Lempel-Ziv blocks. The leftmost occurrence of every square touches a block's border within the
   lengths of two blocks, so extensions around the borders give squares that cover all leftmost ones.
2. Suffix links, from the node of w[i:i+2q] to that of w[i+1:i+1+2q] while w[i] = w[i+2q], complete the vocabulary of
   squares; a node is kept once for each q.
3. The leaves below a square's node are its occurrences. Occurrences of one period at adjoining places merge into runs.

Squares of squares are left out by their smallest period before step 2, so the work stays near n log n.

Only texts in which a run can lie are laid out: inside a run of period q every word, and every 8 words, return after at
most q places, for 3 q places in a row; a text without such a stretch for any q has no run. That test loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 8
#: words of the texts that are looked at together
HELD = 400_000


def _names(w: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[j][i]: number of w[i:i+2^j] in the order of these sequences; what passes the end is cut there."""
    out = [np.unique(w, return_inverse=True)[1].astype(np.int32)]
    width = 1
    while width < longest and int(out[-1].max()) + 1 < len(w):
        at = out[-1].astype(np.int64)
        after = np.zeros(len(w), np.int64)
        after[: len(w) - width] = at[width:] + 1
        out.append(np.unique(at * (len(w) + 1) + after, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return out


def _extension(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree from places i and j on. w must hold a word of its own behind each text."""
    n = len(names[0])
    i, j = i.copy(), j.copy()
    total = np.zeros(len(i), np.int64)
    for level in range(len(names) - 1, -1, -1):
        ok = (np.maximum(i, j) + (1 << level) <= n) & (np.minimum(i, j) >= 0)
        same = np.zeros(len(i), bool)
        same[ok] = names[level][i[ok]] == names[level][j[ok]]
        step = same * (1 << level)
        total, i, j = total + step, i + step, j + step
    return total


def _extension_back(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree from places i and j backwards, both included."""
    n = len(names[0])
    i, j = i + 1, j + 1
    total = np.zeros(len(i), np.int64)
    for level in range(len(names) - 1, -1, -1):
        width = 1 << level
        ok = (np.minimum(i, j) >= width) & (np.maximum(i, j) <= n)
        same = np.zeros(len(i), bool)
        same[ok] = names[level][i[ok] - width] == names[level][j[ok] - width]
        step = same * width
        total, i, j = total + step, i - step, j - step
    return total


def _nearest_smaller(order: list[int]) -> tuple[list[int], list[int]]:
    """For each place of a permutation, the nearest places before and after it that hold a smaller number; -1: none."""
    n = len(order)
    before, after, stack = [-1] * n, [-1] * n, []
    for r, x in enumerate(order):
        while stack and order[stack[-1]] > x:
            after[stack.pop()] = r
        if stack:
            before[r] = stack[-1]
        stack.append(r)
    return before, after


def _blocks(names: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the Lempel-Ziv blocks: each is the longest sequence that also starts earlier, or one word."""
    longest = np.zeros(len(order), np.int64)
    for near in map(np.array, _nearest_smaller(order.tolist())):
        has = np.flatnonzero(near >= 0)
        got = _extension(names, order[has], order[near[has]])
        longest[order[has]] = np.maximum(longest[order[has]], got)
    starts, at, n, steps = [], 0, len(order), np.maximum(longest, 1).tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    return starts, np.diff(np.append(starts, n))


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of its range, number) for all numbers of the ranges [first, first + count)."""
    which = np.repeat(np.arange(len(first)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, first[which] + inside


def _covering(names: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of repetitions around block borders; their squares cover every square's leftmost occurrence."""
    after = np.append(lengths[1:], 0)
    found = []
    for border, most, sign in ((starts + lengths, lengths, -1), (starts, lengths + after, 1)):
        for cut in range(0, len(border), 1 << 16):
            which, period = _spread(np.ones(min(1 << 16, len(border) - cut), np.int64), most[cut : cut + (1 << 16)])
            h = border[cut : cut + (1 << 16)][which]
            low = np.where(sign < 0, h - period, h)
            # one of the extensions must reach half a period, which one look at a name tells
            level = np.minimum(np.log2((period + 1) // 2).astype(np.int64), len(names) - 1)
            n, hit = len(names[0]), np.zeros(len(h), bool)
            for one in np.unique(level):
                at = np.flatnonzero(level == one)
                x, y, width = low[at], low[at] + period[at], 1 << int(one)
                ok = (x >= 0) & (y + width <= n)
                hit[at[ok]] |= names[one][x[ok]] == names[one][y[ok]]
                ok = (x >= width) & (y <= n)
                hit[at[ok]] |= names[one][x[ok] - width] == names[one][y[ok] - width]
            low, period = low[hit], period[hit]
            right, left = _extension(names, low, low + period), _extension_back(names, low - 1, low + period - 1)
            good = right + left >= period
            found.append(np.stack([low - left, low + period + right, period])[:, good])
    a, b, k = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    return a, b, k


def _primitive(names: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the words of one period are no smaller sequence written several times."""
    ok, rest = np.ones(len(period), bool), period.copy()
    if not len(period):
        return ok
    least = np.zeros(int(period.max()) + 1, np.int64)  # smallest prime factors
    for p in range(2, len(least)):
        if not least[p]:
            own = least[p::p]
            own[own == 0] = p
    while (rest > 1).any():
        at = np.flatnonzero(rest > 1)
        prime = least[rest[at]]
        part = period[at] // prime
        ok[at] &= _extension(names, start[at], start[at] + part) < 2 * period[at] - part
        rest[at] //= prime
    return ok


def _node(tables: list[np.ndarray], rank: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) leaf of the node in which the path of depth words to a leaf ends. tables: least common prefixes of 2^j neighbours."""
    n, low, high = len(tables[0]) + 1, rank.copy(), rank.copy()
    for level in range(len(tables) - 1, -1, -1):
        width = 1 << level
        at = np.flatnonzero(low >= width)
        at = at[tables[level][low[at] - width] >= depth[at]]
        low[at] -= width
        at = np.flatnonzero(high + width < n)
        at = at[tables[level][high[at]] >= depth[at]]
        high[at] += width
    return low, high


def squares(w: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all squares whose root is no power, by period and place. w: words as numbers, a number of its
    own behind each text; longest: words of the longest text."""
    none = np.zeros(0, np.int64)
    if len(w) < 2:
        return none, none
    names = _names(w, longest + 1)
    rank = names[-1].astype(np.int64)
    order = np.empty(len(w), np.int64)
    order[rank] = np.arange(len(w))
    a, b, k = _covering(names, *_blocks(names, order))
    keep = _primitive(names, a, k)
    a, b, k = a[keep], b[keep], k[keep]
    if not len(a):
        return none, none
    which, place = _spread(a, np.minimum(b - 2 * k - a + 1, k))  # the walk along suffix links; after k of them it returns
    period = k[which]
    table = [_extension(names, order[:-1], order[1:])]
    while 2 << (len(table) - 1) <= len(w) - 1:
        width = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
    low, high = _node(table, rank[place], 2 * period)
    low, high, period = np.unique(np.stack([low, high, period]), axis=1)
    which, leaf = _spread(low, high - low + 1)
    place, period = order[leaf], period[which]
    by = np.lexsort((place, period))
    return place[by], period[by]


def runs_of(w: np.ndarray, longest: int, least: int = 6, times: int = 4) -> np.ndarray:
    """(start, length, period) rows of the runs of texts laid end to end, by start and period."""
    place, period = squares(w, longest)
    if not len(place):
        return np.zeros((0, 3), np.int64)
    new = np.flatnonzero(np.concatenate(([True], (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1))))
    last = np.append(new[1:], len(place)) - 1
    start, q = place[new], period[new]
    length = place[last] + 2 * q - start
    keep = length >= np.maximum(least, times * q)
    out = np.stack([start, length, q], axis=1)[keep]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _back(values: np.ndarray) -> np.ndarray:
    """Places back to the same value; the largest number where there is none."""
    by = np.argsort(values, kind="stable")
    out = np.full(len(values), np.iinfo(np.int64).max)
    same = np.flatnonzero(values[by[1:]] == values[by[:-1]]) + 1
    out[by[same]] = by[same] - by[same - 1]
    return out


def _stretch(near: np.ndarray, text: np.ndarray, n_texts: int, need: int) -> np.ndarray:
    """Whether a text has ``need`` near places in a row."""
    at = np.flatnonzero(near)
    out = np.zeros(n_texts, bool)
    if len(at) >= need:
        far = at[need - 1 :]
        hit = (far - at[: len(far)] == need - 1) & (text[far] == text[at[: len(far)]])
        out[text[far[hit]]] = True
    return out


def possible(w: np.ndarray, text: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """For each text whether a run can lie in it. w: hashes of the words end to end; text: the text of each."""
    own = w + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = _back(own)
    gram = np.zeros(max(0, len(w) - GRAM + 1), np.uint64)
    for j in range(GRAM):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + own[j : j + len(gram)]
    many = np.full(len(w), np.iinfo(np.int64).max)
    if len(gram):
        many[: len(gram)] = _back(gram)
        many[: len(gram)][text[GRAM - 1 :] != text[: len(gram)]] = np.iinfo(np.int64).max
    out, most = np.zeros(len(sizes), bool), 1
    while most == 1 or times * (most // 2 + 1) <= sizes.max(initial=0):
        q = most // 2 + 1 if most > 1 else 1  # the smallest period up to ``most`` that the step before left
        if most <= 2 * GRAM:
            out |= _stretch(one <= most, text, len(sizes), max(least, times * q) - q)
        else:
            out |= _stretch(many <= most, text, len(sizes), (times - 1) * q - GRAM + 1)
        most *= 2
    return out


def _described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    kept = [words[i] for i in np.flatnonzero(keep).tolist()] if runs else words
    return (len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept))


def _packed(raws: list, least: int, times: int) -> list[tuple]:
    """_described() of some texts."""
    words = [(raw or b"").split() for raw in raws]
    sizes = np.array([len(x) for x in words], np.int64)
    flat = [x for own in words for x in own]
    runs: list[list] = [[] for _ in words]
    if flat:
        code, names = pd.factorize(np.array(flat, dtype=object))
        digest = xxhash.xxh64_intdigest
        text = np.repeat(np.arange(len(sizes)), sizes)
        go = np.flatnonzero(possible(np.array([digest(x) for x in names], np.uint64)[code], text, sizes, least, times))
        if len(go):
            first = np.cumsum(sizes) - sizes
            parts, total = [], 0
            for i, t in enumerate(go.tolist()):  # each text's words are numbers of its own, and one more ends it
                own = pd.factorize(code[first[t] : first[t] + sizes[t]])[0] + total
                parts.append(np.append(own, own.max() + 1))
                total = int(own.max()) + 2
            begin = np.cumsum([0, *[len(p) for p in parts]])
            for s, n, q in runs_of(np.concatenate(parts), int(sizes[go].max()), least, times).tolist():
                i = int(np.searchsorted(begin, s, side="right")) - 1
                runs[go[i]].append((s - int(begin[i]), n, q))
    return [_described(*x) for x in zip(words, runs)]


FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """docs -> its columns but the text, and n_words, runs (start, length, period; by start, then period), and collapsed:
    the text without what a run repeats, the words after its first period, joined by one space.

    A row for each row; words are runs of other than ASCII white space. Null, empty and wordless texts have no words, no
    run and an empty ``collapsed``. Rows that repeat are each their own. Columns of the result's names give way to it.
    No exchange: a text is looked at where it is read, with some 100 bytes a word for each doubling of its length.
    """
    made = ["n_words", "runs", "collapsed"]
    rest = [c for c in docs.columns if c != text and c not in made]

    @F.pandas_udf(f"struct<{', '.join(':'.join(x.split(' ', 1)) for x in FOUND.split(', '))}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raws in batches:
            out, held, size = [], [], 0
            for raw in raws:
                held.append(raw)
                size += len(raw or b"") // 6
                if size > HELD:
                    out += _packed(held, least, times)
                    held, size = [], 0
            out += _packed(held, least, times) if held else []
            yield pd.DataFrame(out, columns=made)

    got = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), found(F.col(text).cast("string").cast("binary")).alias("found"))
    return got.select(*[F.col("row")[c].alias(c) for c in rest], "found.n_words", "found.runs", F.col("found.collapsed").cast("string").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared as whole numbers; of equal ones the first; null where there is none."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def described(found: DataFrame, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The rows of periodic_runs() with n_runs, the strongest run (start, length, period, exponent_milli; null where there
    is none) and digests of the runs and of the collapsed text in place of these."""
    best = strongest(F.col(runs))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    got = found.withColumns({"n_runs": F.size(runs).cast("long"), "_best": best, "runs_sha256": F.sha2(lines, 256), "collapsed_sha256": F.sha2(collapsed, 256)})
    rest = [c for c in found.columns if c not in (runs, collapsed)]
    return got.select(*rest, "n_runs", *[F.col("_best")[c].alias(c) for c in ("start", "length", "period")], F.floor(F.expr("1000 * _best.length div _best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
