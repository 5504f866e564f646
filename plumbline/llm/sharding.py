"""Sharding indivisible groups by Karmarkar-Karp differencing.

Rows with equal content form a group that stays together.  A partial partition is an
array of ``shards`` piles; differencing takes the two partial partitions with the
largest spread and lays the large piles of one on the small piles of the other, until
one is left.  Groups are dealt by hash to tasks of at most about ``fan_in`` groups;
each task differences its own, and what remains of it, one partial partition, is an
item of the next level, until one task holds all.  No task ever sees more than about
``fan_in`` items, and the number of levels grows with the logarithm of the groups.
The way back joins each item's pile to where the level above put it.

Nulls: a null text has no bytes, the CRC-32 zero and a group of its own.  Repeated rows
are members of one group.  A group above a shard's fair share is still kept whole, and
fills a shard of its own.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, cut, hidden

#: Items that one task differences.
FAN_IN = 20_000


def difference(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions.

    ``items`` (n, k) holds the piles of n partial partitions.  Returns the piles of the
    whole and, for each item, the pile of the whole that each of its piles went to.
    """
    n, k = items.shape
    if not n:
        return np.zeros(k, np.int64), np.zeros((0, k), np.int64)
    # a node holds its piles in ascending order; where[node] maps them to the parent's piles
    order = np.argsort(items, axis=1, kind="stable")
    piles = {i: np.take_along_axis(items[i], order[i], 0) for i in range(n)}
    heap = [(int(p[0] - p[-1]), i) for i, p in piles.items()]
    heapq.heapify(heap)
    parent, where, made = {}, {}, n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = piles.pop(a) + piles.pop(b)[::-1]
        rank = np.argsort(both, kind="stable")
        back = np.empty(k, np.int64)
        back[rank] = np.arange(k)
        parent[a] = parent[b] = made
        where[a], where[b] = back, back[::-1]
        piles[made] = both[rank]
        heapq.heappush(heap, (int(both[rank[0]] - both[rank[-1]]), made))
        made += 1
    top = heap[0][1]
    goes = {top: np.arange(k)}
    for node in range(made - 2, -1, -1):
        goes[node] = goes[parent[node]][where[node]]
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = goes[i]
    return piles[top], out


def _level(items: DataFrame, shards: int, tasks: int) -> DataFrame:
    """Items (id, piles) to (id, task, goes, total): where each pile goes, and the task's piles."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        whole, goes = difference(np.array(part["piles"].tolist(), np.int64).reshape(len(part), shards))
        return pd.DataFrame({"id": part["id"], "task": part["task"], "goes": list(goes), "total": [whole] * len(part)})

    dealt = items.withColumn("task", F.pmod(F.xxhash64("id", F.lit(tasks)), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(run, "id string, task long, goes array<long>, total array<long>")


def assign_groups(groups: DataFrame, shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """(id, shard) of groups (id string, size long) with distinct ids."""
    left = groups.count()
    items = groups.select("id", F.concat(F.array("size"), F.array_repeat(F.lit(0).cast("long"), shards - 1)).alias("piles"))
    levels = []
    while True:
        tasks = max(1, -(-left // fan_in))
        done = cut(_level(items, shards, tasks))
        levels.append(done.select("id", F.col("task").cast("string").alias("up"), "goes"))
        if tasks == 1:
            break
        items = done.groupBy(F.col("task").cast("string").alias("id")).agg(F.first("total").alias("piles"))
        left = tasks
    # from the last level down: pile p of an item is pile goes[p] of its task, whose own pile the level above placed
    placed = levels[-1].select("id", "goes")
    for level in reversed(levels[:-1]):
        above = placed.select(F.col("id").alias("up"), F.col("goes").alias("above"))
        placed = level.join(above, "up").select("id", F.transform("goes", lambda x: F.element_at("above", (x + 1).cast("int"))).alias("goes"))
    return placed.select("id", F.element_at("goes", 1).cast("int").alias("shard"))


def shard_rows(docs: DataFrame, shards: int, size: Column, group: Column, order: list[Column], fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 within the shard); columns of these names are replaced.

    ``size`` is the long size of a row, ``group`` a string that only rows of one group
    share, ``order`` the columns that order rows within a slot range.
    """
    g, s, c, pile, n, at, begin = (hidden(docs, x) for x in ("_group", "_size", "_chunk", "_pile", "_n", "_at", "_begin"))
    rows = docs.withColumns({g: group, s: size})
    groups = rows.groupBy(F.col(g).alias("id")).agg(F.sum(s).alias("size"))
    placed = assign_groups(groups, shards, fan_in).select(F.col("id").alias(g), F.col("shard").alias(pile))
    rows = rows.join(placed, g)
    # slots: rows of a shard are cut by hash into ranges, whose counts give the ranges' offsets;
    # about as many ranges as a range has rows
    chunks = max(1, math.isqrt(docs.count() // shards))
    rows = rows.withColumn(c, F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    counts = rows.groupBy(pile, c).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(pile).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(pile, c, before.alias(begin))
    within = F.row_number().over(Window.partitionBy(pile, c).orderBy(*order))
    joined = rows.withColumn(at, within).join(offsets, [pile, c])
    keep = [col(x) for x in docs.columns if x.lower() not in ("shard", "slot")]
    return joined.select(*keep, F.col(pile).alias("shard"), (F.col(begin) + F.col(at) - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row: equal texts share a shard, bytes are near equal.

    ``size`` is the text's UTF-8 bytes and one more.
    """
    t = col(text)
    slim = docs.select(
        col(key).alias("k"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("crc"),
        F.coalesce(F.sha2(t, 256), F.lit("null")).alias("digest"),
    )
    slim = cut(slim)
    out = shard_rows(slim, shards, F.col("size"), F.col("digest"), [F.col("k"), F.col("crc"), F.col("digest")], fan_in)
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", text: str = "text", files_per_shard: int = 32) -> None:
    """Writes the rows of ``docs`` as Parquet, a folder ``shard=N`` for each shard, in ``files_per_shard`` slot ranges."""
    d = hidden(docs, "_digest")
    rows = docs.withColumn(d, F.coalesce(F.sha2(col(text), 256), F.lit("null")))
    out = shard_rows(rows, shards, (F.coalesce(F.octet_length(col(text)), F.lit(0)) + 1).cast("long"), F.col(d), [col(key), F.col(d)])
    out = out.repartition(shards * files_per_shard, "shard", F.col("slot") % files_per_shard).drop(d)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
