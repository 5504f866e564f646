"""Benchmark decontamination by the q-gram lemma.

Texts are normalised to lower-case letters and digits with single blanks.  Benchmark
items are cut into segments of ``segment`` characters, one every ``stride`` characters (a
shorter item is one segment); so every passage of ``segment + stride - 1`` characters of an
item, 79 by default, holds a whole segment and is found.  A copy of a segment of n characters with at most e edits shares at
least ``n + 1 - q - q * e`` q-grams with it, all on diagonals no further than e apart.  So
shared q-grams are counted in overlapping diagonal bands, two neighbouring bands of e
diagonals at a time; regions that meet the bound are kept and verified by alignment
within the band.  The edit budget is ``error`` times n.

The segments' q-grams are an index that every task holds.  Its size is bounded: items
are taken in blocks of ``block_chars`` characters, and all documents are read once for
each block.  Documents are read whole; a text is taken in pieces that overlap by more
than a segment and its budget, so memory does not grow with its length.

Nulls: null texts, and items too short for one q-gram within budget, match only as
whole equal words, or nothing when empty.  Null ids are kept as they are.  Repeated rows
give one row each.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, hidden

Q = 10
SEGMENT = 64
STRIDE = 16
ERROR = 0.06
#: Characters of benchmark text that one index holds, about.
BLOCK_CHARS = 4_000_000
#: Characters of a text that are matched at a time.
PIECE = 1 << 18
_FILTER_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters() -> np.ndarray:
    """The small form of every letter and digit, 0 for any other character; planes above the ideographs have none."""
    out = np.zeros(0x33000, "<u4")
    for i in range(len(out)):
        c = chr(i)
        if c.isalnum():
            small = c.lower()
            out[i] = ord(small) if len(small) == 1 else i
    return out


def codes_of(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the normalised text: small letters and digits, single blanks for what is between.

    ``table`` is that of ``letters``.
    """
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = table[np.minimum(raw, len(table) - 1)]
    held = low > 0
    kept = held.copy()
    kept[1:] |= held[:-1]  # the first of several other characters stays, as a blank
    out = np.where(held, low, 32)[kept]
    if len(out) and out[-1] == 32:
        out = out[:-1]
    return out


def plain(text: str, table: np.ndarray) -> str:
    """The normalised text."""
    return codes_of(text, table).tobytes().decode("utf-32-le", "surrogatepass")


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    n = len(codes) - q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    # hashes of 1, 2, 4, ... characters, of which q is put together
    step, width, out, done = codes.astype(np.uint64), 1, np.zeros(n, np.uint64), 0
    while True:
        if q & width:
            out = out * _MIX + step[done : done + n]
            done += width
        if 2 * width > q:
            break
        step = step[:-width] * (_MIX + np.uint64(2 * width)) + step[width:]
        width *= 2
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def distance_within(pattern: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole pattern with a stretch of ``text``.

    ``text`` starts at the diagonal band's first position and holds the pattern's length
    and the band's width; only cells within the band are computed.
    """
    n, width = len(pattern), len(text) - len(pattern)
    big = n + len(text)
    # row i covers text positions i .. i + width: band cell j is position i + j
    row = np.zeros(width + 1, np.int64)
    steps = np.arange(width + 1)
    for i in range(n):
        here = text[i : i + width + 1]
        here = np.append(here, np.full(width + 1 - len(here), -1)) if len(here) < width + 1 else here
        keep = row + (here[: width + 1] != pattern[i])  # both move on
        drop = np.append(row[1:], big) + 1  # the pattern's character is missing
        new = np.minimum(keep, drop)
        # characters of the text that the pattern does not have
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > budget:
            return big, 0
    j = int(row.argmin())
    return int(row[j]), n + j


def _place(window: np.ndarray, segment: np.ndarray) -> int:
    """Where the segment stands unchanged in the window, or -1."""
    whole, part = window.astype("<u4").tobytes(), segment.astype("<u4").tobytes()
    i = whole.find(part)
    while i >= 0 and i % 4:
        i = whole.find(part, i + 1)
    return i // 4 if i >= 0 else -1


@dataclass
class Index:
    q: int
    hashes: np.ndarray  # sorted q-gram hashes
    owner: np.ndarray  # segment of each
    offset: np.ndarray  # where in its segment
    segments: list[np.ndarray]  # codes
    starts: np.ndarray  # of segments in their items
    items: list  # item id of each segment
    budget: np.ndarray
    need: np.ndarray
    exact: list[tuple[object, str]]  # items too short for the lemma
    table: np.ndarray  # of ``letters``

    def __post_init__(self):
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True
        self.longest = max([len(s) for s in self.segments] + [len(t) for _, t in self.exact], default=0)
        self.most = int(self.budget.max()) if len(self.budget) else 0
        self.least = int(self.need.min()) if len(self.need) else 0


def build(items: list[tuple[object, str]], q: int = Q, segment: int = SEGMENT, error: float = ERROR, stride: int = STRIDE) -> Index:
    """The index of (item id, text) pairs."""
    segs, starts, owners, exact = [], [], [], []
    table = letters()
    for name, text in items:
        codes = codes_of(text or "", table)
        n = len(codes)
        if not n:
            continue
        cuts = [0] if n <= segment else list(range(0, n - segment, stride)) + [n - segment]
        for s in cuts:
            part = codes[s : s + segment]
            if len(part) + 1 - q - q * int(error * len(part)) < 1:
                exact.append((name, plain(text, table)))
                break
            segs.append(part)
            starts.append(s)
            owners.append(name)
    lengths = np.array([len(s) for s in segs], np.int64)
    budget = (error * lengths).astype(np.int64)
    need = lengths + 1 - q - q * budget
    hashes = [grams(s, q) for s in segs]
    owner = np.repeat(np.arange(len(segs)), [len(h) for h in hashes])
    offset = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
    all_ = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.argsort(all_, kind="stable")
    return Index(q, all_[order], owner[order], offset[order], segs, np.array(starts, np.int64), owners, budget, need, exact, table)


def regions(codes: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """(segment, first diagonal) of the bands whose shared q-grams meet the segment's bound."""
    g = grams(codes, index.q)
    if not len(g) or not len(index.hashes):
        return []
    at = np.flatnonzero(index.filter[g >> np.uint64(64 - _FILTER_BITS)])
    if not len(at):
        return []
    # a region has enough q-grams in some stretch of its length, whatever segment they are of
    stretch = index.longest + index.most
    held = np.searchsorted(at, at + stretch) - np.arange(len(at)) >= index.least
    if not held.any():
        return []
    reach = np.maximum.accumulate(np.where(held, at + stretch, -1))
    at = at[at < reach]
    lo = np.searchsorted(index.hashes, g[at])
    hi = np.searchsorted(index.hashes, g[at], "right")
    times = hi - lo
    at, lo, times = at[times > 0], lo[times > 0], times[times > 0]
    if not len(at):
        return []
    place = np.repeat(lo - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
    where = np.repeat(at, times)
    seg, off = index.owner[place], index.offset[place]
    shift = int(len(codes) + index.longest + 4 * index.most + 8)
    diagonal = where - off + index.longest
    width = index.budget[seg] + 1
    band = diagonal // width
    # one q-gram of the segment counts once in a band, however often the band has it
    keys = np.unique((seg * shift + band) * (index.longest + 1) + off) // (index.longest + 1)
    keys, counts = np.unique(keys, return_counts=True)
    both = dict(zip(keys.tolist(), counts.tolist()))
    found = []
    for key, count in both.items():
        s, b = divmod(key, shift)
        need = int(index.need[s])
        w = int(index.budget[s]) + 1
        if count + both.get(key + 1, 0) >= need:
            found.append((s, b * w - index.longest))
    return found


def matches(text: str | None, index: Index, located: bool = True) -> list[tuple[object, int, int, int]]:
    """(item, start, end, edits) of segments found in the text, positions in the normalised text.

    Without ``located`` each item is reported once, at its first verified region.
    """
    flat = codes_of(text, index.table) if text else np.empty(0, "<u4")
    out, seen = [], set()
    if not len(flat):
        return out
    spaced = f" {plain(text, index.table)} " if index.exact else ""
    for name, whole in index.exact:
        i = spaced.find(f" {whole} ")
        if i >= 0 and name not in seen:
            out.append((name, i, i + len(whole), 0))
            seen.add(name)
    over = index.longest + 2 * index.most + index.q + 2
    for a in range(0, len(flat), PIECE):
        codes = flat[a : a + PIECE + over]
        for s, d in regions(codes, index):
            if not located and index.items[s] in seen:
                continue
            n, budget = len(index.segments[s]), int(index.budget[s])
            # the copy lies on diagonals of two bands, and may start and end a budget further out
            start, stop = a + d - budget, a + d + 2 * (budget + 1) + n + budget
            window = flat[max(0, start) : max(0, stop)].astype(np.int64)
            if len(window) < n - budget:
                continue
            # a copy at an end of the text may lack characters there: the band goes on beyond it
            window = np.concatenate([np.full(min(max(0, -start), stop - start), -1), window])
            window = np.append(window, np.full(stop - start - len(window), -1))
            at = _place(window, index.segments[s])
            if at >= 0:
                out.append((index.items[s], start + at, start + at + n, 0))
                seen.add(index.items[s])
                continue
            edits, end = distance_within(index.segments[s].astype(np.int64), window, budget)
            if edits <= budget:
                end = max(0, min(len(flat), start + end))
                out.append((index.items[s], max(0, end - n), end, edits))
                seen.add(index.items[s])
    return out


def _blocks(benchmark: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items in blocks of about ``block_chars`` characters, copies of a text once."""
    rows = benchmark.select(col(key).alias("k"), col(text).alias("t")).where("t is not null")
    rows = rows.groupBy("t").agg(F.min("k").alias("k"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b)
        yield sorted(((r["k"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _matcher(index: Index, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"item": i, "start": a, "end": b, "edits": e} for i, a, b, e in matches(t, index)] for t in texts])

    return run


def find(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", text: str = "text", item_text: str = "text", q: int = Q, segment: int = SEGMENT, error: float = ERROR, block_chars: int = BLOCK_CHARS, name: str = "found", stride: int = STRIDE) -> DataFrame:
    """``docs`` with an array of (item, start, end, edits): the segments of benchmark items that the text holds.

    Positions count code points of the normalised text.  An item of the benchmark given
    more than once is reported under its smallest id.
    """
    kind = f"array<struct<item:{benchmark.schema[key].dataType.simpleString()},start:long,end:long,edits:long>>"
    out, made = docs, []
    for items in _blocks(benchmark, key, item_text, block_chars):
        index = build(items, q, segment, error, stride)  # block_chars bounds what the tasks get
        made.append(hidden(out, f"_block{len(made)}"))
        out = out.withColumn(made[-1], _matcher(index, kind)(col(text).cast("string")))
    found = F.concat(*[F.col(m) for m in made])
    return out.select(*[col(c) for c in docs.columns if c.lower() != name.lower()], found.alias(name))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no segment of a benchmark item."""
    f = hidden(docs, "_found")
    return find(docs, benchmark, name=f, **options).where(F.size(f) == 0).select(*[col(c) for c in docs.columns])
