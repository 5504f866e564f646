"""Exact order statistics, ranks, positions and gaps without ordering a table in one task.

Order statistics: a quantile sketch proposes probe values, an exact count says on which
side of each probe a wanted position lies (or that it is a probe), and only the values of
that narrow bracket are grouped and ordered.  The sketch decides how much is left for the
last step, never what the answer is; brackets that are still large are narrowed again.
What reaches the driver is a few numbers per column: probes, counts, answers.

Running counts, positions and gaps: values are cut into ordered buckets at sketched
quantiles, every bucket is ordered on its own, and bucket totals give the offsets.  A
table too large for one level of buckets is cut on two levels, the second by a sketch of
each stretch, so a bucket's size does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.columns import local_table, sql_literal
from plumbline.shared import cut

SKETCH_K = 4096
SKETCH_MARGIN = 0.002
# A bracket with more rows than this is sketched again before its values are ordered.
FINISH_ROWS = 5_000_000
# Buckets hold about this many rows: up to 2 ** BUCKET_BITS of them by one sketch, each cut again as often by its own.
BUCKET_ROWS = 200_000
BUCKET_BITS = 12
# Numbers of the buckets within one stretch between two edges.
FINE = 1 << 13
BUCKET_SKETCH_K = 16_384
VALUES_PER_SCAN = 24
# Steps of the shares at which the values of an open bracket are sketched again.
LADDER = 2000
# Up to this many cut points a value finds its bucket by compiled comparisons.
TREE_EDGES = 64


@dataclass(frozen=True)
class Target:
    """A wanted position: ``index`` maps the number of values to a 0-based position near ``p``."""

    name: str
    p: float
    index: Callable[[int], int]


def floor_index(p: float) -> Callable[[int], int]:
    """``floor(n * p)``, kept inside the list."""
    return lambda n: min(int(n * p), n - 1)


def partner_index(p: float) -> Callable[[int], int]:
    """Second position of the averaging rule: one lower when ``n * p`` is whole and ``n`` even."""

    def index(n: int) -> int:
        x = n * p
        whole = x == int(x) and n % 2 == 0 and x > 0
        return min(int(x) - (1 if whole else 0), n - 1)

    return index


@dataclass
class _Open:
    """Targets still looking inside one open interval of one value list."""

    name: str
    lo: float | None
    hi: float | None
    base: int
    size: int
    wanted: list[tuple[str, int]]

    def inside(self, v: Column) -> Column:
        cond = v.isNotNull()
        if self.lo is not None:
            cond = cond & (v > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (v < F.lit(self.hi))
        return cond


def doubles_sql(values: Sequence[float]) -> str:
    """A constant array of doubles as one string literal, which parses fast however long it is."""
    return f"cast(split('{','.join(repr(float(v)) for v in values)}', ',') as array<double>)"


def sketched_quantiles(
    df: DataFrame, values: Mapping[str, Column], probes: Mapping[str, Sequence[float]], k: int = SKETCH_K
) -> dict[str, tuple[int, float | None, float | None, list[float]]]:
    """Per value list: count, min, max and approximate values at the probed shares."""
    out = {}
    for part in _chunks(list(values), VALUES_PER_SCAN):
        aggs = []
        for i, name in enumerate(part):
            shares = doubles_sql(probes[name])
            aggs += [
                F.count(f"v{i}").alias(f"n{i}"),
                F.min(f"v{i}").alias(f"lo{i}"),
                F.max(f"v{i}").alias(f"hi{i}"),
                F.expr(
                    f"case when count(v{i}) > 0 then kll_sketch_get_quantile_double("
                    f"kll_sketch_agg_double(v{i}, {k}), {shares}) end"
                ).alias(f"q{i}"),
            ]
        row = df.select(*[values[n].alias(f"v{i}") for i, n in enumerate(part)]).agg(*aggs).first()
        for i, name in enumerate(part):
            out[name] = (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], list(row[f"q{i}"] or []))
    return out


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    targets: Sequence[Target],
    finish_rows: int = FINISH_ROWS,
) -> dict[str, dict]:
    """``{name: {"n", "min", "max", target: value}}`` for each named list of doubles (NULLs ignored).

    The lists must be few: columns of a table, or one per kept category.
    """
    shares = _near(t.p for t in targets)
    first = sketched_quantiles(df, values, {name: shares for name in values})
    return _settled(
        df.sparkSession, first, {n: targets for n in values}, lambda slots: _slot_rows(df, values, slots), lambda slots: _inner_edges(df, values, slots), finish_rows
    )


def grouped_order_statistics(
    df: DataFrame,
    label: Column,
    value: Column,
    names: Sequence[str],
    targets: Sequence[Target] | Mapping[str, Sequence[Target]],
    finish_rows: int = FINISH_ROWS,
) -> dict[str, dict]:
    """``order_statistics`` of the values of each label in ``names``, with the same targets or each with its own.

    Every row belongs to one list, so a pass reads one value a row, however many labels
    there are.  The driver holds a few numbers for each.
    """
    spark = df.sparkSession
    wanted = local_table(spark, [(i, n) for i, n in enumerate(names)], "list int, name string")
    rows = df.select(label.alias("name"), value.cast("double").alias("v")).where(F.col("v").isNotNull())
    rows = rows.join(F.broadcast(wanted), "name").select("list", "v")  # one row per label
    own = targets if isinstance(targets, Mapping) else {n: targets for n in names}
    shares = _near(t.p for n in names for t in own[n])

    def rows_of(slots: Sequence[_Open]) -> DataFrame:
        at = {n: i for i, n in enumerate(names)}
        table = [(at[s.name], i, s.lo if s.lo is not None else float("-inf"), s.hi if s.hi is not None else float("inf")) for i, s in enumerate(slots)]
        held = F.broadcast(local_table(spark, table, "list int, slot int, lo double, hi double"))  # one row per open interval
        return rows.join(held, "list").where((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))).select("slot", "v")

    def inner(slots: Sequence[_Open]) -> dict[int, list[float]]:
        sketched = _sketches(rows_of(slots).withColumnRenamed("slot", "list"), [i / LADDER for i in range(LADDER + 1)])
        out = {}
        for i, s in enumerate(slots):
            q = sketched[i][3]
            spots = {int((k - s.base) / s.size * LADDER) + d for _, k in s.wanted for d in (-1, 0, 1, 2)}
            out[id(s)] = sorted({q[min(LADDER, max(0, x))] for x in spots})
        return out

    found = _sketches(rows, shares)
    first = {n: found.get(i, (0, None, None, [])) for i, n in enumerate(names)}
    return _settled(spark, first, own, rows_of, inner, finish_rows)


def _sketches(rows: DataFrame, shares: Sequence[float]) -> dict[int, tuple[int, float | None, float | None, list[float]]]:
    """Count, min, max and approximate values at the shares, of the values of each list: one grouped aggregate."""
    quantiles = f"kll_sketch_get_quantile_double(kll_sketch_agg_double(v, {SKETCH_K}), {doubles_sql(shares)})"
    grouped = rows.groupBy("list").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.expr(quantiles).alias("q"))
    return {r["list"]: (r["n"], r["lo"], r["hi"], list(r["q"])) for r in grouped.collect()}


def _near(shares: Iterable[float]) -> list[float]:
    """The shares, and a little below and above each."""
    return sorted({min(1.0, max(0.0, x + d)) for x in shares for d in (-SKETCH_MARGIN, 0.0, SKETCH_MARGIN)})


def _settled(spark, first, targets, rows_of, inner_edges, finish_rows) -> dict[str, dict]:
    """The wanted positions of all lists, from their first sketches on."""
    found: dict[str, dict] = {}
    slots: list[_Open] = []
    for name, (n, low, high, _) in first.items():
        found[name] = {"n": n, "min": low, "max": high, **{t.name: None for t in targets[name]}}
        if n and targets[name]:
            slots.append(_Open(name, None, None, 0, n, [(t.name, t.index(n)) for t in targets[name]]))
    edges = {id(s): sorted(set(first[s.name][3])) for s in slots}
    slots = _narrow(spark, rows_of, slots, edges, found)
    while slots and max(s.size for s in slots) > finish_rows:
        slots = _narrow(spark, rows_of, slots, inner_edges(slots), found)
    _finish(spark, rows_of, slots, found)
    return found


def _inner_edges(df, values, slots):
    probes = {}
    for i, s in enumerate(slots):
        probes[str(i)] = _near((k - s.base) / s.size for _, k in s.wanted)
    sketched = sketched_quantiles(
        df, {str(i): F.when(s.inside(values[s.name]), values[s.name]) for i, s in enumerate(slots)}, probes
    )
    return {id(s): sorted(set(sketched[str(i)][3])) for i, s in enumerate(slots)}


def _narrow(spark, rows_of, slots, edges, found) -> list[_Open]:
    """Counts rows below, at and above every probe; settles targets that sit on a probe."""
    width = max(len(edges[id(s)]) for s in slots) if slots else 0
    counts: dict[int, dict[int, int]] = {i: {} for i in range(len(slots))}
    if slots:
        table = [(i, *_padded(edges[id(s)], width)) for i, s in enumerate(slots)]
        schema = ", ".join(["slot int", *[f"e{j} double" for j in range(width)]])
        probes = local_table(spark, table, schema)
        zones = (
            rows_of(slots)
            .join(F.broadcast(probes), "slot")  # one row per slot
            .groupBy("slot", F.expr(_zone_sql(width)).alias("zone"))
            .count()
        )
        for r in zones.collect():
            counts[r["slot"]][r["zone"]] = r["count"]
    left: list[_Open] = []
    for i, s in enumerate(slots):
        probe, reach = edges[id(s)], s.base
        spans = []
        for zone in sorted(counts[i]):
            spans.append((zone, reach, reach + counts[i][zone]))
            reach += counts[i][zone]
        opened: dict[int, _Open] = {}
        for target, k in s.wanted:
            zone, start, end = next(x for x in spans if x[1] <= k < x[2])
            if zone % 2:
                found[s.name][target] = probe[zone // 2]
                continue
            lo = probe[zone // 2 - 1] if zone else s.lo
            hi = probe[zone // 2] if zone // 2 < len(probe) else s.hi
            slot = opened.setdefault(zone, _Open(s.name, lo, hi, start, end - start, []))
            slot.wanted.append((target, k))
        left.extend(opened.values())
    return left


def _padded(edges: Sequence[float], width: int) -> list[float]:
    return list(edges) + [edges[-1]] * (width - len(edges))


def _zone_sql(width: int) -> str:
    """Even numbers between probes, odd numbers on them; repeated last probes never match."""
    branches = " ".join(f"when v < e{j} then {2 * j} when v = e{j} then {2 * j + 1}" for j in range(width))
    last = " ".join(f"when e{width - 1} = e{j} then {2 * (j + 1)}" for j in range(width))
    return f"case {branches} else case {last} end end"


def _slot_rows(df: DataFrame, values: Mapping[str, Column], slots: Sequence[_Open]) -> DataFrame:
    """``(slot, v)`` rows of the values inside each slot, built without a shuffle."""
    base = {n: f"b{i}" for i, n in enumerate(dict.fromkeys(s.name for s in slots))}
    pairs = []
    for i, s in enumerate(slots):
        b = base[s.name]
        limits = [f"{b} > {s.lo!r}D"] * (s.lo is not None) + [f"{b} < {s.hi!r}D"] * (s.hi is not None)
        pairs.append(f"{i}, " + (f"case when {' and '.join(limits)} then {b} end" if limits else b))
    return (
        df.select(*[values[n].alias(b) for n, b in base.items()])
        .selectExpr(f"stack({len(slots)}, {', '.join(pairs)}) as (slot, v)")
        .where(F.col("v").isNotNull())
    )


def _finish(spark, rows_of, slots, found) -> None:
    """Orders the distinct values of each remaining bracket and reads the positions off."""
    if not slots:
        return
    up = Window.partitionBy("slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    reach = (
        rows_of(slots)
        .groupBy("slot", "v")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("reach", F.sum("cnt").over(up))
    )
    asked = [(i, t, k - s.base) for i, s in enumerate(slots) for t, k in s.wanted]
    schema = "slot int, target string, k bigint"
    wanted = local_table(spark, asked, schema)
    picks = (
        reach.join(F.broadcast(wanted), "slot")  # one row per unanswered target
        .where((F.col("reach") > F.col("k")) & (F.col("reach") - F.col("cnt") <= F.col("k")))
        .select("slot", "target", "v")
    )
    for r in picks.collect():
        found[slots[r["slot"]].name][r["target"]] = r["v"]


def _chunks(items: list, size: int) -> Iterable[list]:
    return (items[i : i + size] for i in range(0, len(items), size))


@dataclass(frozen=True)
class Cuts:
    """Cut points of one value list: sorted ``edges``, and where these leave more than a task's
    rows between two of them, a table (high, cuts) with those within each stretch.

    Both are settled before they are used, so every branch and every retry cuts alike.
    """

    edges: list[float]
    fine: DataFrame | None = None


def bucket_edges(df: DataFrame, values: Mapping[str, Column], bucket_rows: int | None = None) -> dict[str, Cuts]:
    """Cut points per value list, at equal shares of the rows; as many as its size asks for."""
    bucket_rows = bucket_rows or BUCKET_ROWS
    n = 1 << BUCKET_BITS
    shares = [i / n for i in range(1, n)]
    sketched = sketched_quantiles(df, values, {name: shares for name in values}, BUCKET_SKETCH_K)
    out = {}
    for name, (count, _, _, q) in sketched.items():
        wanted = max(min(8, n), min(n, count // bucket_rows))
        edges = sorted(set(q[:: max(1, n // wanted)]))
        within = min(n, -(-count // (n * bucket_rows)))
        out[name] = Cuts(edges, _fine_cuts(df, values[name], edges, within) if within > 1 else None)
    return out


def _fine_cuts(df: DataFrame, value: Column, edges: Sequence[float], parts: int) -> DataFrame:
    """Cut points within each stretch between two edges, from a sketch of its own values.

    A row per stretch, at most ``2 ** BUCKET_BITS`` rows of as many numbers.
    """
    shares = doubles_sql([i / parts for i in range(1, parts)])
    rows = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull()).withColumn("high", edge_position(edges, "v"))
    sketch = F.call_function("kll_sketch_agg_double", F.col("v"), F.lit(BUCKET_SKETCH_K))
    found = rows.groupBy("high").agg(sketch.alias("sketch"))
    return cut(found.select("high", F.array_distinct(F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.expr(shares))).alias("cuts")))


def with_bucket(rows: DataFrame, value: str, cuts: Cuts, name: str = "bucket", floor: str | None = None) -> DataFrame:
    """``rows`` with the number of the bucket that ``value`` falls into, ordered like the values.

    ``floor`` names a column for the largest cut point at or below the value.
    """
    out = rows.withColumn("_high", edge_position(cuts.edges, value))
    by_edge = F.get(F.expr(doubles_sql(cuts.edges)), F.col("_high") - 1) if cuts.edges else F.lit(None).cast("double")
    if cuts.fine is None:
        out = out.withColumn(name, F.col("_high").cast("long") * FINE)
        return (out.withColumn(floor, by_edge) if floor else out).drop("_high")
    out = _with_low(out, cuts.fine.withColumnRenamed("high", "_high"), ["_high"], value, name)
    if floor:
        out = out.withColumn(floor, F.coalesce(F.get("_cuts", F.col("_low") - 1), by_edge))
    return out.drop("_high", "_low", "_cuts")


def with_bucket_by(rows: DataFrame, key: str, value: str, cuts: Mapping[str, Cuts]) -> DataFrame:
    """``with_bucket`` of values that are cut by the label in ``key``, each label with its own cut points."""
    high = F.when(F.lit(False), 0)
    for label, c in cuts.items():
        high = high.when(F.col(key) == label, edge_position(c.edges, value))
    out = rows.withColumn("_high", high)
    fine = [c.fine.select(F.lit(label).alias(key), F.col("high").alias("_high"), "cuts") for label, c in cuts.items() if c.fine is not None]
    if not fine:
        return out.withColumn("bucket", F.col("_high").cast("long") * FINE).drop("_high")
    return _with_low(out, reduce(DataFrame.unionAll, fine), [key, "_high"], value, "bucket").drop("_high", "_low", "_cuts")


def _with_low(rows: DataFrame, fine: DataFrame, on: list[str], value: str, name: str) -> DataFrame:
    # at most 2 ** BUCKET_BITS rows of as many numbers for each value list
    out = rows.join(F.broadcast(fine.withColumnRenamed("cuts", "_cuts")), on, "left")
    out = out.withColumn("_low", _position_in(F.coalesce("_cuts", F.array().cast("array<double>")), value))
    return out.withColumn(name, F.col("_high").cast("long") * FINE + F.col("_low"))


def _position_in(held: Column, value: str) -> Column:
    """How many of a sorted array's numbers are at or below the value."""
    steps = F.lit([1 << i for i in reversed(range(BUCKET_BITS + 1))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= F.col(value), at + step).otherwise(at))


def _offsets(totals: DataFrame) -> DataFrame:
    """(bucket, offset): the sum of ``total`` over earlier buckets, from a row per stretch and the buckets within one."""
    earlier = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    high = F.floor(F.col("bucket") / FINE)
    stretches = totals.groupBy(high.alias("high")).agg(F.sum("total").alias("sum"))
    begin = stretches.select("high", F.coalesce(F.sum("sum").over(earlier(Window.orderBy("high"))), F.lit(0)).alias("begin"))
    inside = F.coalesce(F.sum("total").over(earlier(Window.partitionBy("high").orderBy("bucket"))), F.lit(0))
    return (
        totals.withColumn("high", high)
        .withColumn("inside", inside)
        .join(F.broadcast(begin), "high")  # one row per stretch
        .select("bucket", (F.col("begin") + F.col("inside")).alias("offset"))
    )


def edge_position(edges: Sequence[float], value: str) -> Column:
    """How many of the sorted ``edges`` are at or below the ``value`` column."""
    if len(edges) < TREE_EDGES:
        return F.expr(_tree_sql([float(e) for e in edges], 0, len(edges), value))
    steps = [1 << i for i in reversed(range(len(edges).bit_length()))]
    held = doubles_sql(edges)
    return F.expr(
        f"aggregate({sql_literal(steps)}, 0, (at, step) -> case when get({held}, at + step - 1) <= {value} then at + step else at end)"
    )


def _tree_sql(edges: Sequence[float], lo: int, hi: int, value: str) -> str:
    """Nested comparisons, which compile; ``lo`` to ``hi`` are the answers still possible."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return (
        f"case when {value} < {sql_literal(edges[mid])} then {_tree_sql(edges, lo, mid, value)} "
        f"else {_tree_sql(edges, mid + 1, hi, value)} end"
    )


def running_counts(freq: DataFrame, value: str, cuts: Cuts, cnt: str = "cnt") -> DataFrame:
    """Adds ``before``: how many values are smaller.

    ``freq`` holds one row per distinct value, so a value shared by many rows is one row here.
    """
    b = with_bucket(freq, value, cuts)
    offsets = _offsets(b.groupBy("bucket").agg(F.sum(cnt).alias("total")))
    inside = Window.partitionBy("bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.withColumn("inside", F.coalesce(F.sum(cnt).over(inside), F.lit(0)))
        .join(offsets, "bucket")
        .withColumn("before", F.col("offset") + F.col("inside"))
        .drop("bucket", "offset", "inside")
    )


def average_ranks(rows: DataFrame, value: str, cuts: Cuts) -> DataFrame:
    """``(value, cnt, rank)``: 1-based rank of each distinct value, ties sharing their mean rank."""
    freq = rows.groupBy(value).agg(F.count(F.lit(1)).alias("cnt"))
    return running_counts(freq, value, cuts).select(
        value, "cnt", (F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)).alias("rank")
    )


def with_previous(distinct: DataFrame, value: str, cuts: Cuts | Mapping[str, Cuts], key: str | None = None) -> DataFrame:
    """Adds ``previous``: the next smaller value (values must be distinct), of the same label with ``key``."""
    by = [key] if key else []
    b = with_bucket_by(distinct, key, value, cuts) if key else with_bucket(distinct, value, cuts)
    last = b.groupBy(*by, "bucket").agg(F.max(value).alias("last")).withColumn("high", F.floor(F.col("bucket") / FINE))
    stretches = last.groupBy(*by, "high").agg(F.max("last").alias("end"))
    before = stretches.select(*by, "high", F.lag("end").over(Window.partitionBy(*by).orderBy("high")).alias("end"))  # a row per stretch
    near = F.lag("last").over(Window.partitionBy(*by, "high").orderBy("bucket"))
    carried = last.withColumn("near", near).join(F.broadcast(before), [*by, "high"]).select(*by, "bucket", F.coalesce("near", "end").alias("carried"))
    inside = Window.partitionBy(*by, "bucket").orderBy(value)
    return (
        b.withColumn("near", F.lag(value).over(inside))
        .join(carried, [*by, "bucket"])
        .withColumn("previous", F.coalesce("near", "carried"))
        .drop("bucket", "near", "carried")
    )


def with_position(
    rows: DataFrame, value: str, tie: str, bucket_rows: int | None = None, then: Sequence[str] = ()
) -> DataFrame:
    """Adds ``position`` (1-based by ``value``, ``tie``, both numeric, and ``then``) and ``total``.

    A value that sits on a cut point gets a bucket of its own, and such a bucket is cut
    again by ``tie``; a value shared by a third of all rows therefore spreads as well.
    """
    as_double = {c: F.col(c).cast("double") for c in (value, tie)}
    cuts = bucket_edges(rows, as_double, bucket_rows)
    placed = rows.withColumn("_v", as_double[value]).withColumn("_t", as_double[tie])
    placed = with_bucket(placed, "_v", cuts[value], "_at", "_floor")
    placed = with_bucket(placed, "_t", cuts[tie], "_cut")
    on_cut = F.coalesce(F.col("_floor") == F.col("_v"), F.lit(False))
    placed = (
        placed.withColumn("_bucket", F.col("_at") * 2 + F.when(on_cut, 0).otherwise(1))
        .withColumn("_part", F.when(on_cut, F.col("_cut")).otherwise(0))
        .drop("_at", "_floor", "_cut", "_v", "_t")
    )
    sizes = placed.groupBy("_bucket", "_part").agg(F.count(F.lit(1)).alias("_size"))
    # parts of the buckets on a cut point are summed per bucket first, so no window sees them all
    per_bucket = sizes.groupBy(F.col("_bucket").alias("bucket")).agg(F.sum("_size").alias("total"))
    count = per_bucket.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    starts = _offsets(per_bucket).withColumnRenamed("bucket", "_bucket")
    before = Window.partitionBy("_bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(starts, "_bucket").select(
        "_bucket",
        "_part",
        (F.col("offset") + F.coalesce(F.sum("_size").over(before), F.lit(0))).alias("_offset"),
    )
    inside = Window.partitionBy("_bucket", "_part").orderBy(value, tie, *then)
    return (
        placed.withColumn("_local", F.row_number().over(inside))
        .join(offsets, ["_bucket", "_part"])
        .withColumn("position", F.col("_offset") + F.col("_local"))
        .withColumn("total", count.scalar())
        .drop("_bucket", "_part", "_local", "_offset")
    )
