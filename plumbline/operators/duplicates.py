"""Full-row duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import cells, row_hash
from plumbline.shared import cut

HASH = "_row_hash"
# Up to this many repeated hashes are broadcast (8 bytes each) to keep all other rows from travelling.
BROADCAST_HASHES = 4_000_000
# Bits of the filter that does so for more hashes; with more hashes than bits it would let most rows pass.
FILTER_BITS = 1 << 27
# A hash held by one row in so many is hot; there are at most so many hot hashes.
HOT_SHARE = 10_000
# Repeats of a row that are listed in one array.
PIECE = 100_000


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Distinct rows occurring more than once, with their number of occurrences as ``copies``.

    A first pass counts 64-bit row hashes map-side, so 16 bytes per distinct row and task are
    shuffled.  Only rows whose hash repeats go on to be compared on their values, and they
    are counted in every task before any shuffle, so a row repeated in a third of the table
    stays one record per task.  Which rows go on is decided without moving any: by a
    broadcast of the repeated hashes, or of a bit filter over them where they are many.
    What passes the filter meets the hashes in a join, but for the hot ones, at most
    ``HOT_SHARE``, which are broadcast.
    """
    hashed = df.withColumn(HASH, row_hash(df))
    repeated = cut(hashed.groupBy(HASH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    many = repeated.count()
    if many <= BROADCAST_HASHES:
        return _compared(df, hashed.join(F.broadcast(repeated.select(HASH)), HASH, "left_semi"))
    often = F.col("n") * HOT_SHARE >= df.count()
    hot = hashed.join(F.broadcast(repeated.where(often).select(HASH)), HASH, "left_semi")
    rest = repeated.where(~often).select(HASH)
    if many <= FILTER_BITS:
        hashed = _maybe_held(hashed, rest, _bits_for(many))
    seldom = hashed.join(rest, HASH, "left_semi")
    return _compared(df, hot).unionAll(_compared(df, seldom))


def _compared(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that are equal in all values, counted."""
    return rows.groupBy(*[c.raw for c in cells(df)]).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def _bits_for(many: int) -> int:
    return min(FILTER_BITS, 1 << (8 * many).bit_length())


def _maybe_held(rows: DataFrame, hashes: DataFrame, bits: int) -> DataFrame:
    """Rows whose hash may be among the ``hashes``: those whose bit is set in an array of ``bits`` bits (a power of two)."""
    words = bits // 64
    place = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)).cast("int")
    bit = lambda h: F.expr(f"shiftleft(1L, cast({h} & 63 as int))")
    own = hashes.groupBy(place(F.col(HASH)).alias("word")).agg(F.bit_or(bit(HASH)).alias("bits"))
    every = hashes.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(own, "word", "left")
    # an array of fixed size, put together once
    packed = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    held = every.agg(F.transform(packed, lambda x: x["bits"]).alias("_held"))
    found = F.get("_held", place(F.col(HASH))).bitwiseAND(bit(HASH)) != 0
    return rows.crossJoin(F.broadcast(held)).where(found).drop("_held")  # one row


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every repeat of a row after its first occurrence, listed in pieces of bounded size."""
    names = [c.raw for c in cells(df)]
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 2) / PIECE))).alias("_piece")
    first = F.col("_piece") * PIECE + 2
    inside = F.sequence(first, F.least(first + PIECE - 1, F.col("copies")))
    return duplicate_groups(df).select(*names, "copies", pieces).select(*names, F.explode(inside).alias("occurrence"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, duplicates after the first occurrence, their share."""
    dup = duplicate_groups(df).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        dup.scalar().alias("duplicates"),
        F.try_divide(dup.scalar() * 100.0, F.col("rows").cast("double")).alias("pct"),
    )
