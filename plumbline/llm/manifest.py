"""Merkle manifest of a dataset as a postorder append log.

Every row is a leaf, the leaves of a group (a language) are ordered by key, and runs of
``FAN`` nodes become their parent until one is left, the group's subroot; the subroots, in
the order of their groups, become the root in the same way.  The last run of a level may
be shorter, even a single node.

Aligned builders: a task takes ``FAN ** LEVELS`` leaves from a multiple of that number on,
appends each leaf to its log, and each parent as soon as its run is complete, so nodes
stand in the order of completion, which is postorder.  What is left of a builder, one
node, is a leaf of the next tier's builders, until one is left.

Places in a log need no index.  A node of level ``l`` whose leaves begin at ``first`` and
end before ``end`` follows all nodes that end before or with it, of its own level and the
levels below, and those of the levels above that end before it begins:

    place = sum over j <= l of ceil(end / FAN^j)  -  1  +  sum over j > l of floor(first / FAN^j)

and as a subtree stands in one piece, the same holds within a builder's log.  Proofs take
the siblings of a leaf from those places of its builder's log, then those of the builder's
node from the next tier's log, and so on.

A hash is SHA-256 of the concatenated inputs, digests as lowercase hex text.

Nulls: a null group is a group of its own, the first; a null key comes first; null fields
are written as ``-``.  Rows of equal key are ordered by their leaf; repeated rows are
leaves each.  Long texts are hashed in place and go no further.  An empty table has no
root and gives no rows.  Columns are picked by name, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, cut

FAN = 8
LEVELS = 4


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int, fan: int = FAN) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def place(level: int, index, n: int, top: int, fan: int = FAN):
    """Postorder place of the node ``index`` (or an array of them) of a level, in a tree of ``n`` leaves with ``top`` levels above them."""
    first, end = index * fan**level, np.minimum((index + 1) * fan**level, n)
    below = sum(-(-end // fan**j) for j in range(level + 1))
    return below - 1 + sum(first // fan**j for j in range(level + 1, top + 1))


def size(n: int, top: int, fan: int = FAN) -> int:
    """Nodes of a tree of ``n`` leaves with ``top`` levels above them."""
    return sum(-(-n // fan**j) for j in range(top + 1))


def append_log(leaves: list[str], top: int, fan: int = FAN) -> list[str]:
    """All nodes of the tree in the order in which they are complete."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(top + 1)]

    def add(level: int, node: str) -> None:
        log.append(node)
        open_[level].append(node)
        if level < top and len(open_[level]) == fan:
            close(level)

    def close(level: int) -> None:
        children, open_[level] = open_[level], []
        add(level + 1, digest("".join(children)))

    for leaf in leaves:
        add(0, leaf)
    for level in range(top):
        if open_[level]:
            close(level)
    return log


def siblings(log: list[str], n: int, top: int, fan: int = FAN) -> list[str]:
    """For each of the ``n`` leaves its siblings, level by level and left to right, out of the log."""
    out = [""] * n
    for level in range(top):
        width = -(-n // fan**level)
        nodes = [log[p] for p in place(level, np.arange(width), n, top, fan).tolist()]
        others = [
            "".join(nodes[start:i]) + "".join(nodes[i + 1 : start + fan]) for start in range(0, width, fan) for i in range(start, min(start + fan, width))
        ]
        out = [path + others[i // fan**level] for i, path in enumerate(out)]
    return out


def fold(node: str, path: str, index: int, n: int, fan: int = FAN) -> tuple[str, str]:
    """The root that a leaf and its siblings lead to, and what is left of the path."""
    while n > 1:
        start = index - index % fan
        others = (min(start + fan, n) - start - 1) * 64
        before = (index - start) * 64
        node, path = digest(path[:before] + node + path[before:others]), path[others:]
        index, n = index // fan, -(-n // fan)
    return node, path


def leaf(fields: list[Column]) -> Column:
    """The leaf of a row: ``-`` for a null, else UTF-8 bytes, a colon and the value of each field."""
    said = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (x.cast("string") for x in fields)]
    return F.sha2(F.concat(*said), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``g`` (number of the group), ``groups``, ``i`` (place in the group) and ``n`` (rows of the group).

    Rows are sorted by range; a partition's rows are numbered from where the partitions
    before it end, which takes a row for each partition and group.
    """
    tie, at = "_tie", "_at"
    rows = cut(rows.withColumn(tie, F.monotonically_increasing_id()))  # equal rows may go to different ranges
    by = [group, *order, tie]
    rows = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop(tie))
    # the id of a row of written partitions is its partition's number and its place in there
    rows = rows.withColumn(at, F.monotonically_increasing_id())
    part = F.shiftright(at, 33)
    counts = rows.groupBy(part.alias("p"), F.col(group).alias("k")).agg(F.count("*").alias("c"), F.min(at).alias("begin"))
    own = Window.partitionBy("k")
    before = F.coalesce(F.sum("c").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(counts.select("p", "k", (before - F.col("begin")).alias("shift"), F.sum("c").over(own).alias("n")))
    names = starts.select(F.col("k").alias("name")).distinct().withColumn("g", F.row_number().over(Window.orderBy("name")).cast("long") - 1)  # a row per group
    names = names.withColumn("groups", F.count("*").over(Window.partitionBy()))
    starts = starts.join(names, F.col("k").eqNullSafe(F.col("name"))).select("p", "k", "shift", "n", "g", "groups")
    joined = rows.join(starts, (part == F.col("p")) & F.col(group).eqNullSafe(F.col("k")))
    return joined.withColumn("i", F.col(at) + F.col("shift")).drop(at, "p", "k", "shift")


_SEGMENT = "g long, n long, tier int, block long, place long, log binary, node string"


def _builder(tier: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        g, n, block = (int(part[c].iloc[0]) for c in ("g", "n", "block"))
        here = -(-n // FAN ** (LEVELS * tier))  # leaves of the group in this tier
        top = min(LEVELS, height(here))
        log = append_log(part.sort_values("i")["node"].tolist(), top)
        at = int(place(top, np.int64(block), here, height(here))) - len(log) + 1
        return pd.DataFrame({"g": [g], "n": [n], "tier": [tier], "block": [block], "place": [at], "log": [bytes.fromhex("".join(log))], "node": [log[-1]]})

    return run


def _spelled(log: bytes) -> list[str]:
    text = log.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


@dataclass
class Forest:
    """Logs by tier of trees over the nodes (g, n, i, node), a tree for each g."""

    tiers: list[DataFrame]

    @property
    def log(self) -> DataFrame:
        """(g, n, tier, block, place, log, node): ``log`` holds 32 bytes a node from the place on in the tier's order of completion."""
        out = self.tiers[0]
        for t in self.tiers[1:]:
            out = out.union(t)
        return out

    def roots(self) -> DataFrame:
        """(g, node): the last node of each tree."""
        done = F.ceil(F.col("n") / F.pow(F.lit(float(FAN)), LEVELS * (F.col("tier") + 1))) <= 1
        return self.log.where(done).select("g", "node")

    def upper_paths(self) -> DataFrame:
        """(g, block, path): siblings above the lowest tier's builders."""
        above = None
        for t in reversed(range(1, len(self.tiers))):
            segments = self.tiers[t] if above is None else self.tiers[t].join(above, ["g", "block"], "left")
            if above is None:
                segments = segments.withColumn("path", F.lit(None).cast("string"))
            above = segments.mapInPandas(_paths(t), "g long, block long, path string")
        if above is None:
            return self.tiers[0].select("g", "block", F.lit("").alias("path"))
        return self.tiers[0].select("g", "block").join(above, ["g", "block"], "left").select("g", "block", F.coalesce("path", F.lit("")).alias("path"))


def _paths(tier: int):
    """Segments with the path of their node to (g, block, path) of their leaves, the nodes of the tier below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                here = -(-row.n // FAN ** (LEVELS * tier))
                leaves = min(FAN**LEVELS, here - row.block * FAN**LEVELS)
                own = siblings(_spelled(row.log), leaves, min(LEVELS, height(here)))
                first = row.block * FAN**LEVELS
                yield pd.DataFrame({"g": row.g, "block": np.arange(first, first + leaves), "path": [x + (row.path or "") for x in own]})

    return run


def grow(nodes: DataFrame, largest: int) -> Forest:
    """Logs of the trees over (g, n, i, node); ``largest`` is the largest n."""
    tiers = []
    while True:
        tier = len(tiers)
        dealt = nodes.select("g", "n", "i", "node", F.expr(f"i div {FAN**LEVELS}").alias("block"))
        tiers.append(cut(dealt.groupBy("g", "n", "block").applyInPandas(_builder(tier), _SEGMENT)))
        largest = -(-largest // FAN**LEVELS)
        if largest <= 1:
            return Forest(tiers)
        more = F.ceil(F.col("n") / F.lit(float(FAN ** (LEVELS * (tier + 1))))) > 1
        nodes = tiers[-1].where(more).select("g", "n", F.col("block").alias("i"), "node")


@dataclass
class Manifest:
    """Leaves with their places, the forest of the groups, the tree over their subroots."""

    leaves: DataFrame
    groups: Forest
    whole: Forest

    def root(self) -> str:
        return self.whole.roots().first()["node"]


def build(rows: DataFrame, group: str = "group", key: str = "key") -> Manifest | None:
    """The manifest of (group, key, leaf, claimed); None of an empty table.

    ``claimed`` is the leaf that is held against the manifest, equal to ``leaf`` where
    nothing changed.
    """
    leaves = cut(ranked(rows, group, [key, "leaf", "claimed"]))
    most = leaves.agg(F.max("n").alias("n"), F.max("groups").alias("groups")).first()
    if most["n"] is None:
        return None
    groups = grow(leaves.select("g", "n", "i", F.col("leaf").alias("node")), most["n"])
    tops = groups.roots().select(F.lit(0).cast("long").alias("g"), F.lit(most["groups"]).cast("long").alias("n"), F.col("g").alias("i"), "node")
    return Manifest(leaves, groups, grow(tops, most["groups"]))


def proofs(manifest: Manifest, key: str = "key", with_path: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), and ``path``, the siblings themselves, if asked."""
    groups, whole = manifest.groups, manifest.whole
    top = whole.tiers[0].join(whole.upper_paths().withColumnRenamed("path", "suffix"), ["g", "block"])
    # siblings of every subroot: the number of the group is its place
    over = top.withColumn("path", F.col("suffix")).mapInPandas(_paths(0), "g long, block long, path string").select(F.col("block").alias("g"), F.col("path").alias("over"))
    roots = groups.roots().withColumnRenamed("node", "subroot").join(over, "g").withColumn("root", F.lit(manifest.root()))
    segments = groups.tiers[0].join(groups.upper_paths(), ["g", "block"]).join(roots, "g").select("g", "n", "block", "log", "path", "over", "subroot", "root")
    leaves = manifest.leaves.withColumn("block", F.expr(f"i div {FAN**LEVELS}"))
    kind = leaves.select(key).schema[0].dataType.simpleString()

    def run(part: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        s = segment.iloc[0]
        n, groups_, g = int(s["n"]), int(part["groups"].iloc[0]), int(s["g"])
        rest = s["path"] + s["over"]
        paths = [x + rest for x in siblings(_spelled(s["log"]), len(part), min(LEVELS, height(n)))]
        folded = []
        for node, path, i in zip(part["claimed"], paths, part["i"].tolist()):
            node, path = fold(node, path, i, n)
            folded.append(fold(node, path, g, groups_)[0])
        out = pd.DataFrame({"key": part["key"], "leaf": part["leaf"], "subroot": s["subroot"], "root": s["root"], "proof_sha256": [digest(x) for x in paths], "folded_root": folded})
        out["verified"] = out["folded_root"] == out["root"]
        if with_path:
            out["path"] = paths
        return out

    # the key passes as text: pandas would make numbers with nulls doubles
    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", path string" * with_path
    leaves = leaves.select(col(key).cast("string").alias("key"), "leaf", "claimed", "g", "i", "groups", "block")
    out = leaves.groupBy("g", "block").cogroup(segments.groupBy("g", "block")).applyInPandas(run, schema)
    return out.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def audit_documents(docs: DataFrame, tampered: Column, changed: dict[str, Column], key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """Proofs of all rows of ``docs``, held against leaves of rows that are ``changed`` where ``tampered`` holds."""
    said = {f: col(f) for f in fields}
    claimed = F.when(F.coalesce(tampered, F.lit(False)), leaf(list((said | changed).values())))
    rows = docs.select(col(group).alias("group"), col(key).alias("key"), leaf(list(said.values())).alias("leaf"), claimed.alias("claimed"))
    manifest = build(rows.withColumn("claimed", F.coalesce("claimed", "leaf")))
    if manifest is None:
        kind = docs.select(col(key)).schema[0].dataType.simpleString()
        none = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], none).withColumnRenamed("key", key)
    return proofs(manifest).withColumnRenamed("key", key)
