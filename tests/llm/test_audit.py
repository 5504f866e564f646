import math
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from plumbline.llm import audit

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def slow(docs, labels):
    """Every order applied to every document."""
    first = {}
    for key, text, *_ in docs:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    parts = {}
    for key, text, source in docs:
        t = text or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t):
            bad.add("C")
        if any(c in "#$%&*|" for c in t):
            bad.add("D")
        if key is not None and key > first[t]:
            bad.add("E")
        good = any(k == key and key is not None and q == 1 for k, q, _ in labels)
        toxic = any(k == key and key is not None and x == 1 for k, _, x in labels)
        parts.setdefault(source or "", []).append((bad, good, toxic))
    out, shapley = [], {}
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                early = sum(f in r[0] for r in rows) - len(gone)
                out.append([part, "".join(order), step, len(stay), len(gone), early, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f])
                left = stay
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns({"part": F.lit("x"), "good": F.lit("x"), "mask": F.lit(1)})


def texts(rnd):
    out = []
    for i in range(60):
        n = rnd.choice([0, 1, 3, 150, 199, 200, 201, 260])
        vocabulary = [f"w{j}" for j in range(rnd.choice([1, 50, 120, 500]))]
        t = rnd.choice([" ", "\n", "\t "]).join(rnd.choice(vocabulary) for _ in range(n))
        t = rnd.choice(["", "  "]) + t + rnd.choice(["", "#", "ABC" * 20, " \r\n", "É é"])
        out.append((rnd.randint(0, 40) if rnd.random() < 0.9 else None, rnd.choice([t, t, None, "same"]), rnd.choice(["a", "b", "", None])))
    return out


@pytest.mark.parametrize("hot", [1000, 3])
def test_against_all_orders(spark, make, rnd, monkeypatch, hot):
    monkeypatch.setattr(audit, "HOT", hot)
    rows = texts(rnd)
    marks = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = make([(k, t, None, s) for k, t, s in rows])
    for c in ("mask", "digest", "part", "words", "body", "key", "least", "hot"):
        docs = docs.withColumn(c, F.lit("x"))
    assert got(audit.audit(docs, labels(spark, marks))) == slow(rows, marks)


def test_shapley_values_share_out_what_all_filters_remove(spark, make, rnd):
    rows = texts(rnd)
    out = audit.audit(make([(k, t, None, s) for k, t, s in rows]), labels(spark, []))
    first = out.where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect()
    assert first and all(x["s"] == math.factorial(5) * x["r"] for x in first)


def test_empty_tables(spark, make):
    none = make([(1, "a")]).where("false")
    assert got(audit.audit(none, labels(spark, []))) == []
    assert len(got(audit.audit(make([(1, None)]), labels(spark, [])))) == 600


def test_potential_of_other_numbers_of_filters(spark):
    """Unanimity games: the potential of a coalition that holds the carrier is 1 / its size."""
    n, carrier = 3, 0b101
    worth = [int(s & carrier == carrier) for s in range(1 << n)]
    row = audit.with_potentials(spark.createDataFrame([(worth,)], "w array<long>"), "w", n).first()
    assert list(row["potential"]) == [audit.scale(n) // 2 * x for x in worth]
