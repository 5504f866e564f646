"""Pearson and Spearman correlation with pairwise deletion, matrices and strong pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import Cell, local_table, number_cells
from plumbline.operators.ranks import rank_sums

MIN_PAIRS = 3


def column_pairs(profile: DataFrame) -> DataFrame:
    """Unordered pairs of a column table, in column order: ``(column_x, column_y, ord_x, ord_y)``."""
    a = profile.select(F.col("column").alias("column_x"), F.col("ordinal").alias("ord_x"))
    b = profile.select(F.col("column").alias("column_y"), F.col("ordinal").alias("ord_y"))
    return a.join(F.broadcast(b), F.col("ord_x") < F.col("ord_y"))  # one row per column on both sides


PAIR_SCHEMA = "column_x string, column_y string, pairs bigint, correlation double"
# A share of its square sum below which a spread is rounding: the column is constant over the pair.
ROUNDING = 1e-12
# Partial sums of a pair over its complete rows: their number, sums, square sums, products.
SUMS = ("n", "sx", "sy", "qx", "qy", "p")
SUMS_SCHEMA = "pair long, " + ", ".join(f"{f} double" for f in SUMS)


def _all_pairs(df: DataFrame, values: dict[str, Column], pairs: Sequence[tuple[str, str]], zero_variance: str) -> DataFrame:
    """Coefficients of the given pairs over their complete rows, in two scans whatever their number.

    The first scan finds a mean per column.  The second takes matrix products of each batch,
    centred on the means and masked where a cell is missing, which gives the sums of all
    pairs at once; every task sends one row per pair.
    """
    if not pairs:
        return local_table(df.sparkSession, [], PAIR_SCHEMA)
    names = list(dict.fromkeys(n for p in pairs for n in p))
    source = df.select(*[values[n].cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    finite = [F.when(F.abs(f"x{i}") < float("inf"), F.col(f"x{i}")) for i in range(len(names))]
    facts = source.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(finite)]).first()
    means = np.array([facts[i] or 0.0 for i in range(len(names))])
    at = {n: i for i, n in enumerate(names)}
    index = np.array([(at[a], at[b]) for a, b in pairs])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(means)
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - means
            held = ~np.isnan(x)
            d, m = np.where(held, x, 0.0), held.astype(float)
            n += m.T @ m
            s += d.T @ m
            q += (d * d).T @ m
            p += d.T @ d
        i, j = index[:, 0], index[:, 1]
        out = {"pair": np.arange(len(index)), "n": n[i, j], "sx": s[i, j], "sy": s[j, i], "qx": q[i, j], "qy": q[j, i], "p": p[i, j]}
        yield pa.RecordBatch.from_pydict(out)

    return _coefficients(source.mapInArrow(sums, SUMS_SCHEMA), pairs, zero_variance)


def _coefficients(parts: DataFrame, pairs: Sequence[tuple[str, str]], zero_variance: str) -> DataFrame:
    """Coefficients from partial sums by pair; a pair without sums has no rows."""
    total = parts.groupBy("pair").agg(*[F.sum(f).alias(f) for f in SUMS]).where("n > 0")
    vx, vy = (F.col(f"q{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n") for c in "xy")
    flat = (vx <= F.col("qx") * ROUNDING) | (vy <= F.col("qy") * ROUNDING)
    r = (F.col("p") - F.col("sx") * F.col("sy") / F.col("n")) / (F.sqrt(vx) * F.sqrt(vy))
    constant = F.lit(0.0 if zero_variance == "zero" else None).cast("double")
    labels = local_table(parts.sparkSession, [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair long, column_x string, column_y string")
    return labels.join(F.broadcast(total), "pair", "left").select(  # a row per pair on both sides
        "column_x",
        "column_y",
        F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("pairs"),
        F.when(F.col("n") >= MIN_PAIRS, F.when(flat, constant).otherwise(r)).alias("correlation"),
    )


def pearson(df: DataFrame, x: str, y: str, zero_variance: str = "null") -> DataFrame:
    """One row ``(column_x, column_y, pairs, correlation)``; NULL under three complete pairs."""
    picked = number_cells(df, [x, y])
    return _all_pairs(df, {c.name: c.number() for c in picked}, [(x, y)], zero_variance)


def pearson_pairs(df: DataFrame, columns: Iterable[str] | None = None, zero_variance: str = "null") -> DataFrame:
    """Correlation of every unordered pair of numeric columns, in column order."""
    picked = number_cells(df, columns)
    pairs = list(combinations([c.name for c in picked], 2))
    return _all_pairs(df, {c.name: c.number() for c in picked}, pairs, zero_variance)


def spearman_pairs(
    df: DataFrame, columns: Iterable[str] | None = None, zero_variance: str = "null"
) -> DataFrame:
    """Rank correlation of every unordered pair, ranks taken over the complete rows of the pair.

    Ranks of all columns, and within all pairs, come out of one pass over ordered slots
    (``ranks.rank_sums``): the number of scans, shuffles and joins does not depend on the
    number of columns, pairs or missing cells.
    """
    picked = number_cells(df, columns)
    pairs = list(combinations([c.name for c in picked], 2))
    if not pairs:
        return local_table(df.sparkSession, [], PAIR_SCHEMA)
    return _coefficients(rank_sums(df, {c.name: c.number() for c in picked}, pairs), pairs, zero_variance)


def spearman(df: DataFrame, x: str, y: str, zero_variance: str = "null") -> DataFrame:
    return spearman_pairs(df, [x, y], zero_variance)


def correlation_matrix(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    method: str = "pearson",
    zero_variance: str = "null",
) -> DataFrame:
    """Long symmetric matrix ``(column_x, column_y, correlation)``, diagonal 1.

    Columns with fewer than three numeric values are left out.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method: {method}")
    picked = number_cells(df, columns)
    fn = pearson_pairs if method == "pearson" else spearman_pairs
    half = fn(df, [c.name for c in picked], zero_variance).select("column_x", "column_y", "correlation")
    return mirror(half, _filled_columns(df, picked))


def _filled_columns(df: DataFrame, picked: Sequence[Cell]) -> DataFrame:
    counts = df.agg(*[F.count(c.number()).alias(f"n{c.ordinal}") for c in picked])
    rows = [F.struct(F.lit(c.name).alias("column"), F.col(f"n{c.ordinal}").alias("n")) for c in picked]
    return counts.select(F.inline(F.array(*rows))).where(F.col("n") >= MIN_PAIRS).select("column")


def mirror(half: DataFrame, names: DataFrame) -> DataFrame:
    """Full matrix from its upper half and the columns on the diagonal."""
    x = names.select(F.col("column").alias("column_x"))
    kept = half.join(F.broadcast(x), "column_x", "left_semi").join(
        F.broadcast(names.select(F.col("column").alias("column_y"))), "column_y", "left_semi"
    )
    both = kept.select(
        F.inline(
            F.array(
                F.struct("column_x", "column_y", "correlation"),
                F.struct(
                    F.col("column_y").alias("column_x"), F.col("column_x").alias("column_y"), "correlation"
                ),
            )
        )
    )
    diagonal = names.select(F.col("column").alias("column_x"), F.col("column").alias("column_y"), F.lit(1.0))
    return both.unionAll(diagonal)


def dense_matrix(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column, one double per column."""
    return matrix.groupBy("column_x").pivot("column_y", list(columns)).agg(F.first("correlation"))


def chart_matrix(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``(x, y, correlation)`` for drawing: 0 wherever there is no coefficient."""
    names = [c.name for c in number_cells(df, columns)]
    half = pearson_pairs(df, names, "zero").select(
        "column_x", "column_y", F.coalesce("correlation", F.lit(0.0)).alias("correlation")
    )
    labels = local_table(df.sparkSession, [(n,) for n in names], "column string")
    return mirror(half, labels).toDF("x", "y", "correlation")


def correlated_pairs(half: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with ``|r| >= threshold``, their sign and magnitude, strongest first."""
    r = F.abs("correlation")
    return (
        half.where(r >= threshold)
        .select(
            F.col("column_x").alias("feature1"),
            F.col("column_y").alias("feature2"),
            "correlation",
            F.when(F.col("correlation") > 0, "positive").otherwise("negative").alias("strength"),
            F.when(r > 0.9, "very strong").when(r > 0.7, "strong").otherwise("moderate").alias("magnitude"),
        )
        .orderBy(F.desc(F.abs("correlation")), "feature1", "feature2")
    )
