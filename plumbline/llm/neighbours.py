"""Approximate nearest neighbours by inverted lists and adaptive dimension scan.

Vectors get one more component so that the largest inner product is the smallest
distance, and are turned by a random rotation, so that any first components are a fair
sample of all.  They are kept in lists around centroids.  A query probes its nearest
lists; there, distances grow block by block of components, and after each block a
hypothesis test abandons candidates whose partial distance is too large to be among the
best, ``EPSILON`` setting how sure it has to be.  Who survives all blocks is scored
exactly on the original vectors.  The nearest list is scanned first, and the threshold
found there holds in all others.

Centroids and rotation come from a bounded sample of ``SAMPLE`` distinct vectors, as does
the number of lists to probe: the least that finds ``recall`` of the true neighbours
within the sample.  A query whose nearest lists together hold too few ids, as in small
outlying clusters, probes further ones until they hold enough; so every query gets ``k``
rows if the table has them.  Every vector is indexed.

Equal vectors are searched once: a vector stands for the ``k + 1`` smallest of its ids,
which are all that can be among the best.  Lists are cut by hash into blocks of about
``LIST_BLOCK`` candidates and ``QUERY_BLOCK`` queries, so a hot list is many tasks.

Nulls: vectors that are null, zero, or hold a null or non-finite component take no part,
nor do rows without an id or with another number of components than most vectors have
(of equally frequent numbers the smaller).  Repeated rows of one id count once; an id
with several vectors stands for each.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, cut

SAMPLE = 20_000
LISTS = 1024
LIST_BLOCK = 4096
QUERY_BLOCK = 1024
#: Components per block, and how many deviations a partial distance must lie above what it should be.
STEP = 16
EPSILON = 2.5
RECALL = 0.97


def usable(vector: Column) -> Column:
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < big), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Model:
    """How vectors are lifted, turned and dealt to lists."""

    norm: float
    turn: np.ndarray
    centres: np.ndarray  # of turned vectors
    probes: int

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Turned vectors with one component more: nearer means a larger inner product."""
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - np.einsum("ij,ij->i", v, v)))
        return np.column_stack([v, more]) @ self.turn

    def near(self, turned: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        d = (self.centres**2).sum(axis=1)[None] - 2 * turned @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def lists_of(self, turned: np.ndarray, held: np.ndarray, need: int) -> list[np.ndarray]:
        """The lists each vector probes, nearest first: ``probes``, or as many more as hold ``need`` ids together."""
        order = self.near(turned, len(self.centres))
        together = np.minimum(held, need).astype(np.int32)[order].cumsum(axis=1, dtype=np.int32)
        n = np.maximum(self.probes, (together < need).sum(axis=1) + 1)
        return [row[:m].astype(np.int32) for row, m in zip(order, n)]


def fit(sample: np.ndarray, norm: float, total: int, recall: float = RECALL, k: int = 20, seed: int = 42, lists: int = LISTS) -> Model:
    """A model from a sample of distinct vectors out of ``total``."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    n_lists = int(max(1, min(lists, round(total**0.5 / 2), len(sample) // 32 or 1)))
    model = Model(norm, turn, np.zeros((1, d)), 1)
    x = model.lift(sample, False)
    centres = x[rng.permutation(len(x))[:n_lists]].copy()
    for _ in range(8):
        own = ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
        count = np.bincount(own, minlength=n_lists)
        for j in np.flatnonzero(count):
            centres[j] = x[own == j].mean(axis=0)
    model.centres = centres
    # probe as many lists as find ``recall`` of the sample's own neighbours
    asked = rng.permutation(len(x))[:256]
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-near, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
    order = model.near(model.lift(sample[asked], True), n_lists)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n_lists), order.shape), axis=1)
    own = model.near(x, 1)[:, 0]
    at = np.sort(rank[np.arange(len(asked))[:, None], own[top]].ravel())
    model.probes = int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1
    return model


def scan_list(model: Model, ids: list, cands: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """(query position, score, id): for each query the best ``k`` candidates that reach its floor.

    A candidate stands for all its ids; equal scores go to smaller ids.
    """
    c, q = model.lift(cands, False), model.lift(queries, True)
    d = c.shape[1]
    limits = np.append(np.arange(STEP, d, STEP), d)
    first = limits[0]
    part0 = (c[:, :first] ** 2).sum(axis=1)[None] - 2 * q[:, :first] @ c[:, :first].T + (q[:, :first] ** 2).sum(axis=1)[:, None]
    lifted = np.einsum("ij,ij->i", queries, queries) + model.norm**2
    slack = 1e-9 * (1 + lifted)
    out = []
    for i in range(len(q)):
        best: list[tuple[float, int]] = []
        floor = floors[i]
        for start in range(0, len(c), 1024):
            alive = np.arange(start, min(start + 1024, len(c)))
            part = part0[i, alive]
            for b, used in enumerate(limits):
                if b:
                    lo = limits[b - 1]
                    part = part + ((c[alive, lo:used] - q[i, lo:used]) ** 2).sum(axis=1)
                if np.isfinite(floor):
                    bound = max(0.0, lifted[i] - 2 * floor) + slack[i]
                    sure = 1.0 if used == d else (1 + EPSILON / np.sqrt(used)) ** 2 * used / d
                    stay = part <= bound * sure
                    alive, part = alive[stay], part[stay]
                    if not len(alive):
                        break
            if not len(alive):
                continue
            scores = np.einsum("ij,j->i", cands[alive], queries[i])
            for s, a in zip(scores.tolist(), alive.tolist()):
                if s >= floor:
                    best += [(-s, x) for x in ids[a]]
            if len(best) > k:
                best = sorted(best)[:k]
            if len(best) == k:
                floor = max(floor, -best[-1][0])
        out += [(i, -s, x) for s, x in sorted(best)[:k]]
    return out


def _typed(rows: list[tuple[str, float, int]]) -> pd.DataFrame:
    """(h, score, id) rows; a block without any has the same types, which Arrow needs."""
    return pd.DataFrame(rows, columns=["h", "score", "id"]).astype({"h": object, "score": float, "id": "int64"})


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row for which ``is_query`` holds.

    Nearness is the inner product in double precision; a row is not its own neighbour.
    """
    rows = vectors.select(col(key).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), col(vector).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    # two 64-bit hashes name a vector
    rows = rows.withColumn("h", F.concat_ws(".", F.xxhash64(F.lit(1), "v"), F.xxhash64(F.lit(2), "v")))
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return empty
    rows = rows.where(F.size("v") == common["n"])
    # the k + 1 smallest ids of each vector, cut in every task before the shuffle
    order = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    ids = rows.groupBy("h", "id").agg(F.max("asked").alias("asked"))
    few = ids.select("h", "id").withColumn("n", order).where(F.col("n") <= k + 1).groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = ids.where("asked").select("h").distinct().withColumn("asked", F.lit(True))
    shape = rows.select("h", "v").dropDuplicates(["h"])
    known = cut(shape.join(few, "h").join(asked, "h", "left").select("h", "ids", F.col("v").cast("array<double>").alias("v"), F.coalesce("asked", F.lit(False)).alias("asked")))
    stats = known.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    picked = known.select("h", "v").orderBy(F.xxhash64(F.lit(seed), "h"), "h").limit(sample).collect()
    model = fit(np.array([r["v"] for r in picked]), float(stats["m"]) ** 0.5 * (1 + 1e-12), stats["n"], recall, k, seed)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(model.near(model.lift(np.array(v.tolist()), False), 1)[:, 0] if len(v) else np.empty(0), dtype="int32")

    @F.pandas_udf("array<int>")
    def probed(v: pd.Series) -> pd.Series:
        return pd.Series(model.lists_of(model.lift(np.array(v.tolist()), True), held, k + 1) if len(v) else [])

    kept = cut(known.withColumn("list", home("v")))
    counts = kept.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("held")).collect()  # a row per list
    sizes = {r["list"]: r["n"] for r in counts}
    held = np.zeros(len(model.centres), np.int64)
    held[list(sizes)] = [r["held"] for r in counts]
    queries = cut(known.where("asked").select("h", "v", probed("v").alias("lists")))

    def scan(tasks: DataFrame) -> DataFrame:
        """Best (h, score, id) of queries (h, v, list, floor) in their lists."""
        asked = {r["list"]: r["count"] for r in tasks.groupBy("list").count().collect()}
        plan = spark.createDataFrame(
            [(j, -(-sizes[j] // LIST_BLOCK), -(-n // QUERY_BLOCK)) for j, n in asked.items() if j in sizes], "list int, parts int, turns int"
        )
        plan = F.broadcast(plan)
        cell = F.xxhash64(F.lit(3), "h")
        cands = kept.join(plan, "list").select(
            "list", F.pmod(cell, F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "h", "v", "ids", F.lit(None).cast("double").alias("floor")
        )
        asks = tasks.join(plan, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(cell, F.col("turns")).cast("int").alias("turn"), "h", "v", F.lit(None).cast("array<long>").alias("ids"), "floor"
        )

        def run(part: pd.DataFrame) -> pd.DataFrame:
            isq = part["ids"].isna()
            c, q = part[~isq].sort_values("h"), part[isq].sort_values("h")
            if not len(c) or not len(q):
                return _typed([])
            found = scan_list(model, c["ids"].tolist(), np.array(c["v"].tolist()), np.array(q["v"].tolist()), q["floor"].to_numpy(float), k + 1)
            names = q["h"].tolist()
            return _typed([(names[i], s, x) for i, s, x in found])

        return cands.union(asks).groupBy("list", "part", "turn").applyInPandas(run, "h string, score double, id long")

    top = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("score"), "id"))
    start = queries.select("h", "v", F.element_at("lists", 1).alias("list"), F.lit(float("-inf")).alias("floor"))
    first = cut(scan(start).withColumn("n", top).where(F.col("n") <= k + 1).drop("n"))
    floors = first.groupBy("h").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    rest = queries.join(floors, "h", "left").select("h", "v", F.explode(F.slice("lists", F.lit(2), F.size("lists"))).alias("list"), F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    found = first.union(scan(rest)).withColumn("n", top).where(F.col("n") <= k + 1)
    best = found.groupBy("h").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id")))).alias("best"))
    # every row that asks gets its vector's list, without itself
    own = rows.where("asked").select(F.col("id").alias("query_id"), "h").distinct().join(best, "h")
    mine = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(mine).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").cast("long").alias("vec_id"), (-F.col("x.s")).alias("score"))
