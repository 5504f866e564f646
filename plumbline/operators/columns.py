"""How each column of a table is read, and the two shapes all operators build on.

``wide`` runs many aggregates of many columns in one scan and turns the single
result row into one row per column.  ``long`` turns the table into
``(column, ordinal, value)`` rows for work that must be grouped by value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import scalars as s

# Aggregates per scan: beyond this the generated methods grow too large for the JIT.
MAX_AGGREGATES = 40

NUMBER_READERS: Mapping[str, Callable[[Column], Column]] = {
    "loose": s.loose_number,
    "strict": s.strict_number,
    "whole": s.whole_number,
}


@dataclass(frozen=True)
class Cell:
    """One column of a table together with its reading rules."""

    name: str
    ordinal: int
    dtype: T.DataType

    @property
    def raw(self) -> Column:
        return F.col("`" + self.name.replace("`", "``") + "`")

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.dtype, T.NumericType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))

    @property
    def is_supported(self) -> bool:
        return self.is_text or self.is_number or self.is_time

    @property
    def missing(self) -> Column:
        return s.is_missing(self.raw, "string" if self.is_text else "other")

    def number(self, reader: str = "loose") -> Column:
        """The cell as a double; NULL where it is not one (NaN and infinities count as none)."""
        if self.is_text:
            return NUMBER_READERS[reader](self.raw)
        if self.is_number:
            d = self.raw.cast("double")
            return F.when(F.abs(d) < float("inf"), d) if isinstance(self.dtype, (T.DoubleType, T.FloatType)) else d
        return F.lit(None).cast("double")

    def time(self) -> Column:
        if self.is_text:
            return s.parse_date(self.raw)
        return self.raw if self.is_time else F.lit(None).cast("timestamp")

    def millis(self) -> Column:
        if isinstance(self.dtype, T.TimestampNTZType):
            return s.epoch_ms(self.raw, "timestamp_ntz")
        return s.epoch_ms(self.time())

    def year(self) -> Column:
        return F.year(self.time())

    def looks_dated(self, month_words: bool = False) -> Column:
        if self.is_text:
            return s.is_date(self.raw, month_words)
        return F.lit(self.is_time) & self.raw.isNotNull()

    def text(self) -> Column:
        return self.raw.cast("string")


def cells(df: DataFrame, columns: Iterable[str] | None = None) -> list[Cell]:
    """Reading rules of the named columns (all by default), in table order of the request."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = list(columns) if columns is not None else list(fields)
    unknown = [n for n in names if n not in fields]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    return [Cell(n, i, fields[n]) for i, n in enumerate(names)]


def row_hash(df: DataFrame, seed: int = 42) -> Column:
    """64-bit hash that is equal for rows that group together: 0.0 and -0.0 do, and maps whatever their order."""
    parts = []
    for c in cells(df):
        kind = c.dtype.simpleString()
        if kind in ("double", "float"):
            parts.append(c.raw + F.lit(0.0))
        elif kind.startswith("map<"):
            parts.append(F.array_sort(F.transform(F.map_entries(c.raw), lambda e: F.to_json(e))))
        elif "map<" in kind or kind == "variant":
            parts.append(F.to_json(c.raw))
        else:
            parts.append(c.raw)
    return F.xxhash64(F.lit(seed), *parts)


def number_cells(df: DataFrame, columns: Iterable[str] | None = None) -> list[Cell]:
    """Named columns, or every natively numeric column."""
    picked = cells(df, columns)
    return picked if columns is not None else [c for c in picked if c.is_number]


class _AnyCell:
    """Stands for all cells at once: what is read from it becomes a column of the unpivoted table."""

    def __init__(self):
        self.read: dict[str, Callable[[Cell], Column]] = {}

    def _column(self, name: str, of: Callable[[Cell], Column]) -> Column:
        self.read[name] = of
        return F.col(name)

    @property
    def missing(self) -> Column:
        return self._column("_missing", lambda c: c.missing)

    def number(self, reader: str = "loose") -> Column:
        return self._column(f"_number_{reader}", lambda c: c.number(reader))

    def millis(self) -> Column:
        return self._column("_millis", lambda c: c.millis().cast("long"))

    def year(self) -> Column:
        return self._column("_year", lambda c: c.year().cast("int"))

    def looks_dated(self, month_words: bool = False) -> Column:
        return self._column(f"_dated_{month_words}", lambda c: c.looks_dated(month_words))

    def text(self) -> Column:
        return self._column("_text", lambda c: c.text())


def wide(
    df: DataFrame, picked: Sequence[Cell], aggregates: Callable[[Cell], Mapping[str, Column]]
) -> DataFrame:
    """One row per column holding the named aggregates.

    ``aggregates`` must return the same names and types for every column.  A few columns are
    aggregated side by side.  More are unpivoted to one row per cell, holding what the
    aggregates read, and aggregated by column with map-side combination: one scan, whatever
    their number.  Aggregates that look at a column's own type are computed side by side, in
    as many scans as code generation needs.
    """
    if not picked:
        raise ValueError("no columns to aggregate")
    per_cell = [(c, dict(aggregates(c))) for c in picked]
    step = max(1, MAX_AGGREGATES // max(1, len(per_cell[0][1])))
    if len(per_cell) > step:
        stand_in = _AnyCell()
        try:
            keyed = dict(aggregates(stand_in))
        except AttributeError:  # needs to know the column
            pass
        else:
            return _keyed(df, picked, stand_in, keyed)
    parts = [_wide_part(df, per_cell[i : i + step]) for i in range(0, len(per_cell), step)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _keyed(df: DataFrame, picked: Sequence[Cell], stand_in: _AnyCell, aggregates: Mapping[str, Column]) -> DataFrame:
    """The aggregates by column over one unpivoted scan; columns of an empty table have a row as well."""
    structs = [
        F.struct(F.lit(c.ordinal).alias("ordinal"), *[of(c).alias(n) for n, of in stand_in.read.items()]) for c in picked
    ]
    cells_ = df.select(F.inline(F.array(*structs)))
    done = cells_.groupBy("ordinal").agg(*[e.alias(n) for n, e in aggregates.items()])
    names = local_table(df.sparkSession, [(c.name, c.ordinal) for c in picked], "column string, ordinal int")
    # without rows an aggregate that is never null, such as a count, is 0
    zero = {f.name for f in done.schema.fields if not f.nullable}
    filled = [F.coalesce(F.col(n), F.lit(0)).cast(done.schema[n].dataType).alias(n) if n in zero else F.col(n) for n in aggregates]
    return names.join(F.broadcast(done), "ordinal", "left").select("column", "ordinal", *filled)  # a row per column


def _wide_part(df: DataFrame, per_cell: Sequence[tuple[Cell, Mapping[str, Column]]]) -> DataFrame:
    names = list(per_cell[0][1])
    flat = [e.alias(f"a{i}_{j}") for i, (_, aggs) in enumerate(per_cell) for j, e in enumerate(aggs.values())]
    rows = [
        F.struct(
            F.lit(c.name).alias("column"),
            F.lit(c.ordinal).alias("ordinal"),
            *[F.col(f"a{i}_{j}").alias(n) for j, n in enumerate(names)],
        )
        for i, (c, _) in enumerate(per_cell)
    ]
    return df.agg(*flat).select(F.inline(F.array(*rows)))


def long(
    df: DataFrame,
    picked: Sequence[Cell],
    value: Callable[[Cell], Column],
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(keep…, column, value)``: one row per cell, built without a shuffle."""
    if not picked:
        raise ValueError("no columns to unpivot")
    kept = [F.col(k) for k in keep]
    aliased = [value(c).alias(f"v{c.ordinal}") for c in picked]
    pairs = ", ".join(f"'{_quote(c.name)}', v{c.ordinal}" for c in picked)
    return df.select(*kept, *aliased).selectExpr(
        *[f"`{k}`" for k in keep], f"stack({len(picked)}, {pairs}) as (column, value)"
    )


def _quote(name: str) -> str:
    return name.replace("\\", "\\\\").replace("'", "\\'")


def sql_literal(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float):
        return f"{x!r}D" if math.isfinite(x) else f"double('{x!r}')"
    if isinstance(x, (list, tuple)):
        return "array(" + ", ".join(sql_literal(i) for i in x) + ")"
    return "'" + _quote(str(x)) + "'"


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small table as literals in the plan (rule tables, per-column numbers)."""
    if not rows:
        return spark.createDataFrame([], schema)
    fields = T.StructType.fromDDL(schema).fields
    values = ", ".join("(" + ", ".join(sql_literal(x) for x in r) + ")" for r in rows)
    casts = ", ".join(
        f"cast(col{i + 1} as {f.dataType.simpleString()}) as `{f.name}`" for i, f in enumerate(fields)
    )
    return spark.sql(f"select {casts} from values {values}")


def settle(small: DataFrame) -> DataFrame:
    """A result with a row or two per column, computed once and kept as literals.

    For profiles and findings that many rules read: their size follows the schema, not the data.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields)
    return local_table(small.sparkSession, [tuple(r) for r in small.collect()], schema)
