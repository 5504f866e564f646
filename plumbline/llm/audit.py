"""How filters interact: Shapley values by the Hart-Mas-Colell potential of the removal game.

In the removal game of a set of filters, a coalition is worth the documents that at least
one of its filters fails.  The potential of a coalition is

    P(S) = (worth(S) + sum of P(S without i) over its filters i) / |S|,    P(no filter) = 0,

and the Shapley value of a filter is P(all) - P(all without it): what the filter removes,
averaged over all orders.  Potentials are kept times the least common multiple of 1 to the
number of filters, which makes them whole numbers, so nothing is rounded.

What a step of an order removes is a difference of worths as well: that of the coalition up
to the step, less that of the coalition before it.  So the documents are read once: every
document becomes a mask of the filters that it fails, masks are counted by part, and all
orders follow from 32 worths of a part.

Nulls: a null text is empty, a null part is the empty string.  A document without an id
fails no duplicate filter, and no other document fails because of it.  Repeated rows of a
document each count; rows that share the smallest id of a text do not fail as duplicates.
Labels of a document are put together: it is good, or toxic, if one of its labels says so.
Labels without an id say nothing.  An empty table has no parts and gives no rows.  Columns
are picked by name from the tables, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, col, cut

FILTERS = "ABCDE"
MIN_WORDS = 200
MARKS = r"[#$%&*|]"
HOT = 1000


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    inner = F.btrim(text, F.lit(" \t\n\v\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def fails(text: Column, words: Column) -> dict[str, Column]:
    """Conditions on a text (not null) and its words under which filters A to D fail it."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(MARKS),
    }


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, mask) of every row: bit i of the mask is set where filter i of ``FILTERS`` fails it."""
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(key).alias("key"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"), words(body).alias("words"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails(F.col("body"), F.col("words")).values())]
    rows = cut(rows.select("key", "part", reduce(Column.bitwiseOR, bits).alias("mask"), F.sha2("body", 256).alias("digest")))
    # texts of several ids; other texts have no copies
    copied = rows.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).where("least < most")
    copied = cut(copied.select("digest", "least", "n"))
    # fewer than HOT texts can hold more than a HOT-th of the rows: they are broadcast, and their rows stay where they are
    often = F.col("n") * HOT > rows.count()
    hot = F.broadcast(copied.where(often).select("digest", F.col("least").alias("hot")))
    rows = rows.join(hot, "digest", "left")
    rest = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("key").cast("string")))
    rows = rows.withColumn("digest", rest).join(copied.where(~often).drop("n"), "digest", "left")
    copy = F.when(F.col("key") > F.coalesce("hot", "least"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.select("key", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def worths(masks: DataFrame, counts: Sequence[str], filters: int = len(FILTERS)) -> DataFrame:
    """(part, all_<count>, worth_<count>) of (part, mask, counts): worths are arrays by coalition."""
    sets = range(1 << filters)
    sums = [F.sum(F.col(c)).alias(f"all_{c}") for c in counts]
    for c in counts:
        lost = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0)) for s in sets]
        sums.append(F.array(*lost).alias(f"worth_{c}"))
    return masks.groupBy("part").agg(*sums)


def scale(filters: int = len(FILTERS)) -> int:
    return math.lcm(*range(1, filters + 1))


def with_potentials(table: DataFrame, worth: str, filters: int = len(FILTERS)) -> DataFrame:
    """``table`` with ``potential``: by coalition, times ``scale(filters)``, from coalitions of ever more filters."""
    out = table.withColumn("potential", F.array_repeat(F.lit(0).cast("long"), 1 << filters))
    for size in range(1, filters + 1):
        cells = []
        for s in range(1 << filters):
            members = [i for i in range(filters) if s >> i & 1]
            below = "".join(f" + potential[{s & ~(1 << i)}]" for i in members)
            # the scale makes the division whole
            cells.append(f"({scale(filters)} * {worth}[{s}]{below}) div {size}" if len(members) == size else f"potential[{s}]")
        out = out.withColumn("potential", F.expr(f"array({', '.join(cells)})"))
    return out


def steps(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, coalition before the step, bit of its filter) for all orders."""
    out = []
    for order in permutations(filters):
        before = 0
        for i, f in enumerate(order, 1):
            out.append(("".join(order), i, before, 1 << filters.index(f)))
            before |= 1 << filters.index(f)
    return out


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps, removes and loses.

    ``shapley`` is the step's filter's Shapley value times the number of orders: the
    documents it removes, summed over all orders.
    """
    is_one = lambda c: F.max(F.when(col(c) == 1, 1).otherwise(0))
    marks = labels.where(F.col(key).isNotNull()).groupBy(col(key).alias("key")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = failures(docs, key, text, part).join(marks, "key", "left")
    one = F.lit(1).alias("docs")
    masks = rows.select("part", "mask", one, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counts = ("docs", "good", "toxic")
    masks = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])
    n, whole = len(FILTERS), (1 << len(FILTERS)) - 1
    known = with_potentials(worths(masks, counts), "worth_docs")
    every = ", ".join(f"named_struct('filter_order', '{o}', 'step', {i}, 'before', {b}, 'bit', {f})" for o, i, b, f in steps())
    out = known.withColumn("at", F.explode(F.expr(f"array({every})"))).select("*", "at.*")
    worth = lambda s, c="docs": F.get(f"worth_{c}", s)
    after = F.col("before").bitwiseOR(F.col("bit"))
    gain = lambda c: worth(after, c) - worth(F.col("before"), c)
    without = F.lit(whole) - F.col("bit")
    share = (F.get("potential", F.lit(whole)) - F.get("potential", without)) * F.lit(math.factorial(n) // scale(n))
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.col("all_docs") - worth(after)).cast("long").alias("kept"),
        gain("docs").cast("long").alias("removed"),
        (worth(F.col("bit")) - gain("docs")).cast("long").alias("redundant"),
        (worth(F.lit(whole)) - worth(without)).cast("long").alias("unique_fails"),
        gain("good").cast("long").alias("good_lost"),
        gain("toxic").cast("long").alias("toxic_lost"),
        share.cast("long").alias("shapley"),
    )
