"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common neighbour no further than
half the radius from either.  So every distinct fingerprint emits all its variants
within half the radius, equal variants meet in a shuffle, and only fingerprints that
meet are compared bit by bit.  An odd radius has no half: the word is then cut into
three blocks, of which one holds at least a third of the differing bits, hence at
least one; leaving out each block in turn makes the rest differ in ``radius - 1`` bits
at most, which has a half.  For 3 of 64 bits that is 131 variants of a fingerprint.

Nulls: a null text has no words and the fingerprint zero; a null id never names a
group unless all its members lack one.  Repeated rows share a fingerprint and give one
row each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import col, cut, hidden

BITS = 64
SEED = 42
#: Fingerprints of one variant that are compared at a time.
BLOCK = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of all word shingles of the text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """The rows of ``docs`` with their fingerprint as a (signed) long in column ``name``."""

    @F.pandas_udf(T.LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return docs.withColumn(name, prints(col(text).cast("string")))


def variants(print_: Column, radius: int) -> Column:
    """Array of the variants of a fingerprint: two that are ``radius`` bits apart or less share one."""
    size = BITS // 3
    blocks = [range(0, size), range(size, 2 * size), range(2 * size, BITS)] if radius % 2 else [range(0)]
    out = []
    for b, block in enumerate(blocks):
        left = [i for i in range(BITS) if i not in block]
        flips = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(left, k)]
        # the bits left out hold the block's number, so that blocks do not meet each other
        keep, tag = sum(1 << i for i in left), (b << block[0] if block else 0)
        kept = print_.bitwiseAND(F.lit(_signed(keep))).bitwiseXOR(F.lit(_signed(tag)))
        out.append(F.transform(F.lit([_signed(x) for x in flips]), kept.bitwiseXOR))
    return F.concat(*out)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _stars(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links from the first fingerprint of each chain of close pairs to the chain's others.

    What a chain reaches leaves the set that later comparisons look at, so a dense group
    costs little more than its size.
    """
    links, words, left = [], prints.view(np.uint64), np.arange(len(prints))
    while len(left) > 1:
        first, left = left[0], left[1:]
        reached = [np.array([first])]
        while reached and len(left):
            ring, reached = np.concatenate(reached), []
            for i in range(0, len(ring), BLOCK):
                near = (np.bitwise_count(words[ring[i : i + BLOCK], None] ^ words[None, left]) <= radius).any(axis=0)
                if near.any():
                    reached.append(left[near])
                    left = left[~near]
                    links += [(int(prints[first]), int(prints[x])) for x in reached[-1]]
    return links


def _meet(radius: int):
    """Rows (variant, fingerprint) in the order of the variant to links, each backed by a chain of verified pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_v, held_p = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(v: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(v)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(v))
            sizes, found = ends - starts, []
            two = starts[sizes == 2]
            close = two[np.bitwise_count(p[two].view(np.uint64) ^ p[two + 1].view(np.uint64)) <= radius]
            for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
                found += _stars(p[s:e], radius)
            a = np.concatenate([p[close], np.array([x for x, _ in found], np.int64)])
            b = np.concatenate([p[close + 1], np.array([y for _, y in found], np.int64)])
            return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        for batch in batches:
            v = np.concatenate([held_v, batch.column(0).to_numpy(zero_copy_only=False)])
            p = np.concatenate([held_p, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(v):
                continue
            last = int(np.searchsorted(v, v[-1]))  # the last variant may go on in the next batch
            if last:
                yield links(v[:last], p[:last])
            held_v, held_p = v[last:], p[last:]
        if len(held_v):
            yield links(held_v, held_p)

    return run


def close_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints in the only column of ``prints``.

    Every link stands for a chain of verified pairs, and every pair within the radius is
    connected through links.
    """
    if radius < 1:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    rows = prints.select(F.explode(variants(F.col(prints.columns[0]), radius)).alias("v"), F.col(prints.columns[0]).alias("p"))
    rows = rows.repartition("v").sortWithinPartitions("v", "p")
    return rows.mapInArrow(_meet(radius), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the undirected links (a, b): the smallest node of its component.

    Alternates the large-star and the small-star step until nothing changes; each step
    takes minima with map-side combination, and joins that may be split where a node is hot.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.*").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) of every row of ``docs``.

    ``fingerprint`` is a signed long, ``component_id`` the smallest key among all rows
    that chains of fingerprints at most ``radius`` bits apart reach.
    """
    rows = cut(with_fingerprint(docs.select(col(key).alias("k"), col(text).alias("t")), "t", shingle, "p").select("k", "p"))
    return assign(rows, radius).select(F.col("k").alias(key), F.col("p").alias("fingerprint"), F.col("c").alias("component_id"))


def assign(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (k, p, more) with the smallest ``k`` of their component as ``c``, its smallest fingerprint as ``g``."""
    first = cut(rows.groupBy("p").agg(F.min("k").alias("first")))
    linked = components(close_links(first.select("p"), radius))
    linked = cut(linked.join(first, linked["node"] == first["p"]).select("p", "root", "first"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("p", "root", "least")
    # alone: not linked; a linked fingerprint takes what its component has, null included
    named = first.join(linked, "p", "left").select(
        "p", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("c"), F.coalesce("root", "p").alias("g")
    )
    # written before the join, so that a fingerprint of many rows can be split there
    return rows.join(cut(named), "p")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, in the columns of ``docs``: the one with the smallest key.

    Among rows of the same key the smallest hash of the whole row decides; rows that are
    equal throughout count as one.  Rows without a key stay only where their whole
    component has none.
    """
    h, p = hidden(docs, "_h"), hidden(docs, "_p")
    hashed = docs.withColumn(h, F.xxhash64(*[F.to_json(F.struct(col(f.name))) if "map<" in f.dataType.simpleString() else col(f.name) for f in docs.schema.fields]))
    rows = cut(with_fingerprint(hashed.select(col(key).alias("k"), F.col(h).alias("h"), col(text).alias("t")), "t", shingle, "p").select("k", "h", "p"))
    picked = assign(rows, radius).where(F.col("k").eqNullSafe(F.col("c"))).groupBy("g", "c").agg(F.min("h").alias(p))
    kept = hashed.join(picked.select(p, F.col("c").alias(p + "k")), (F.col(h) == F.col(p)) & col(key).eqNullSafe(F.col(p + "k")), "left_semi")
    return kept.dropDuplicates([h, key]).select(*[col(c) for c in docs.columns])
