"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by membership pattern, the set of sources they belong to.  A
pattern can send each of its words to any of its sources, up to ``max_epochs`` times;
the first pass is the cheapest and each further one dearer, so that documents are not
repeated while fresh ones are left.  As every pattern has the same convex cost, the
min-cost flow is found by opening one pass after the other and augmenting to a maximum
flow each time.  A pattern's flow is then spent on its documents: all of them as often
as it lasts, and for the rest documents in the order of a seeded hash, the last one in
part.

The graph has a node per pattern and per source and is solved in the driver; its size is
checked against ``max_nodes``, beyond which an error says so.  Documents never leave the
tasks: they are cut by hash into chunks whose sums tell where the seeded choice ends,
and only the chunk that holds the end is put in order.

Nulls: a null text has no words, a null source is a source of its own, the last.
Repeated rows count each.  Sources without words, and an empty table, get nothing.  Texts
are only counted, so long ones need no memory.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, col, cut, hidden

MAX_NODES = 200_000
EPOCHS = 3


def targets(sizes: dict, weights: dict, cap: float = EPOCHS, total: float | None = None) -> dict:
    """Shares of ``total`` (all sizes together, unless given) by weight, none above ``cap`` times its source's size.

    What is above is shared again among the others by weight, until none is above.
    """
    rest, full, out = float(sum(sizes.values()) if total is None else total), set(), {}
    while True:
        free = [x for x in sizes if x not in full]
        weight = sum(weights[x] for x in free)
        out |= {x: rest * weights[x] / weight if weight else 0.0 for x in free}
        above = [x for x in free if out[x] > cap * sizes[x]]
        if not above:
            return out
        out |= {x: float(cap * sizes[x]) for x in above}
        rest -= sum(out[x] for x in above)
        full |= set(above)


class _Flow:
    """Maximum flow by blocking flows (level graph, then depth first, without recursion)."""

    def __init__(self, n: int):
        self.to, self.room, self.arcs = [], [], [[] for _ in range(n)]

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def fill(self, start: int, end: int) -> None:
        while True:
            level, queue = {start: 0}, deque([start])
            while queue:
                a = queue.popleft()
                for e in self.arcs[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if end not in level:
                return
            at = defaultdict(int)
            path: list[int] = []
            node = start
            while True:
                if node == end:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    first = next(i for i, e in enumerate(path) if not self.room[e])
                    node = self.to[path[first] ^ 1]
                    path = path[:first]
                    continue
                while at[node] < len(self.arcs[node]):
                    e = self.arcs[node][at[node]]
                    if self.room[e] and level.get(self.to[e], -1) == level[node] + 1:
                        break
                    at[node] += 1
                else:
                    if node == start:
                        break
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
                    continue
                path.append(e)
                node = self.to[e]


def route(patterns: dict, quotas: dict, epochs: int = EPOCHS) -> dict:
    """Words from patterns to sources: {(pattern, source): words}.

    ``patterns`` maps tuples of sources to their words, ``quotas`` sources to the words
    wanted.  Among the largest flows it is one with the fewest repeated words, a later
    pass counting more than an earlier one.
    """
    names, sources = list(patterns), list(quotas)
    node = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    flow = _Flow(2 + len(names) + len(sources))
    taps = [flow.arc(0, 2 + i, 0) for i in range(len(names))]
    pipes = {(p, s): flow.arc(2 + i, node[s], epochs * patterns[p]) for i, p in enumerate(names) for s in p if s in node}
    for s in sources:
        flow.arc(node[s], 1, quotas[s])
    for _ in range(epochs):
        for tap, p in zip(taps, names):
            flow.room[tap] += patterns[p]
        flow.fill(0, 1)
    return {k: flow.room[e ^ 1] for k, e in pipes.items() if flow.room[e ^ 1]}


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights, size: Column, sources: Column, seed: int = 42, epochs: int = EPOCHS, max_nodes: int = MAX_NODES, chunks: int | None = None, key: list[Column] | None = None) -> DataFrame:
    """``docs`` with ``size``, ``sources``, ``source_sizes``, ``targets`` and ``taken``; columns of these names are replaced.

    ``sources`` is an array column, the row's memberships; ``source_sizes`` and ``targets``
    follow its order.  ``weights`` is a dict by source, or makes one of the list of
    sources in order.  ``taken`` counts the words that the mix takes of the row, repeats
    included: at most ``epochs`` times its size.  ``key`` seeds the choice and orders rows
    of equal hash; by default it is the whole row.
    """
    results = ("size", "sources", "source_sizes", "targets", "taken")
    z, s, h, c, pattern, plan_, more = (hidden(docs, x) for x in ("_size", "_sources", "_hash", "_chunk", "_pattern", "_plan", "_more"))
    rows = docs.withColumns({z: size, s: F.array_sort(F.array_distinct(sources))})
    order = key or [col(x) for x in docs.columns]
    rows = rows.withColumn(h, F.xxhash64(F.lit(seed), *order))
    sums = rows.groupBy(s).agg(F.sum(z).alias("words"), F.count("*").alias("n")).limit(max_nodes + 1).collect()
    if len(sums) > max_nodes:
        raise ValueError(f"more than {max_nodes} membership patterns: merge sources or raise max_nodes")
    patterns = {tuple(r[0]): int(r["words"]) for r in sums}
    sizes: dict = defaultdict(int)
    for p, words in patterns.items():
        for x in p:
            sizes[x] += words
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = weights if isinstance(weights, dict) else weights(names)
    # shares of all words, each counted once however many sources it is in
    wanted = targets(sizes, weight, epochs, sum(patterns.values()))
    sent: dict = defaultdict(int)
    for (p, _), words in route(patterns, {x: round(t) for x, t in wanted.items()}, epochs).items():
        sent[p] += words
    # as many chunks as a chunk has rows: neither grows faster than the root of the rows
    chunks = chunks or max(1, math.isqrt(sum(r["n"] for r in sums)))
    spark = docs.sparkSession
    kind = f"array<{docs.select(sources.alias('x')).schema['x'].dataType.elementType.simpleString()}>"
    known = spark.createDataFrame(
        [(list(p), sent[p] // w if w else 0, sent[p] % w if w else 0, [sizes[x] for x in p], [wanted[x] for x in p]) for p, w in patterns.items()],
        f"p {kind}, full long, rest long, source_sizes array<long>, targets array<double>",
    )
    # where the seeded order of each pattern passes its rest: at chunk ``cut``, ``before`` words in
    rows = rows.withColumn(c, F.pmod(F.shiftrightunsigned(F.col(h), 1), F.lit(chunks)))
    by_chunk = rows.groupBy(s, c).agg(F.sum(z).alias("words"))
    run = F.sum("words").over(Window.partitionBy(s).orderBy(c)) - F.col("words")
    ends = by_chunk.withColumn("before", run).join(F.broadcast(known), F.col(s).eqNullSafe(F.col("p")))
    ends = ends.where("before <= rest and rest < before + words").select("p", F.col(c).alias("cut"), "before")
    plan = cut(known.join(ends, "p", "left"))  # a row per pattern
    # one column of the plan's fields, so that none meets a column of the caller's
    plan = plan.select(F.col("p").alias(pattern), F.struct("full", "rest", "source_sizes", "targets", "cut", "before").alias(plan_))
    rows = rows.join(F.broadcast(plan), F.col(s).eqNullSafe(F.col(pattern))).drop(pattern)
    end, rest, begun = (F.col(f"{plan_}.{x}") for x in ("cut", "rest", "before"))
    passed = F.col(c) < F.coalesce(end, F.lit(0))
    plain = rows.where(end.isNull() | (F.col(c) != end)).withColumn(more, F.when(passed, F.col(z)).otherwise(0))
    last = rows.where(F.col(c) == end)
    before = F.sum(z).over(Window.partitionBy(s).orderBy(h, *order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(z) + begun
    last = last.withColumn(more, F.greatest(F.lit(0), F.least(F.col(z), rest - before)))
    both = plain.unionByName(last)
    return both.select(
        *[col(x) for x in docs.columns if x.lower() not in results],
        F.col(z).alias("size"),
        F.col(s).alias("sources"),
        F.col(f"{plan_}.source_sizes").alias("source_sizes"),
        F.col(f"{plan_}.targets").alias("targets"),
        (F.col(f"{plan_}.full") * F.col(z) + F.col(more)).cast("long").alias("taken"),
    )


def cycle(weights: list[float]):
    """Weights that repeat along the sources, in the order of their code points with null last."""
    return lambda names: {x: weights[i % len(weights)] for i, x in enumerate(names)}


def copies(taken: Column, size: Column) -> Column:
    """Whole copies nearest to the words taken; a row without words is kept once."""
    return F.when(size > 0, F.round(taken / size).cast("int")).otherwise(1)
