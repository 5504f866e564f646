"""Edge inputs, properties and brute-force comparisons."""

import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline import operators as ops
from plumbline import plans
from plumbline.functions import fixed_text, loose_number, parse_date, strict_number, whole_number
from plumbline.operators import ordering
from plumbline.plans import charts, recommend
from plumbline.sources import csv_files, preview, read_csv, table_catalog, write_insights, write_issues, write_preview, write_tables
from plumbline.streaming import map_batches, run_profile


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


# -- functions ---------------------------------------------------------------------


def test_number_shapes(spark):
    cells = ["12abc", "+5", ".5", "007", "1e3", "599.70", " 7 ", "", "599.7", "-3", "0", "-0", "NaN", "Infinity", "1."]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {
        r["c"]: (r["s"], r["l"], r["w"])
        for r in df.select("c", strict_number(F.col("c")).alias("s"), loose_number(F.col("c")).alias("l"), whole_number(F.col("c")).alias("w")).collect()
    }
    assert got["12abc"] == (None, 12, None)
    assert got["+5"] == (None, 5, 5)
    assert got[".5"] == (None, 0.5, 0.5)
    assert got["007"] == (None, 7, 7)
    assert got["1e3"] == (None, 1000, 1000)
    assert got["599.70"] == (None, 599.7, 599.7)
    assert got[" 7 "] == (7, 7, 7)
    assert got[""] == (None, None, None)
    assert got["599.7"] == (599.7, 599.7, 599.7)
    assert got["-3"][0] == -3 and got["0"][0] == 0 and got["-0"][0] is None
    assert got["NaN"] == (None, None, None) and got["Infinity"] == (None, None, None)
    assert got["1."] == (None, 1, 1)


def test_date_shapes(spark):
    cells = ["2023-01-05", "2023-01-05T10:30:00Z", "2023-01-05 10:30:00.25", "1/2/2023", "Jan 5 2020", "5 Feb 2021", "2021/7/9", "2023-13-40", "soon", "20230105", "2023-04"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r["c"]: r["d"] for r in df.select("c", parse_date(F.col("c")).cast("string").alias("d")).collect()}
    assert got["2023-01-05"] == "2023-01-05 00:00:00"
    assert got["2023-01-05T10:30:00Z"] == "2023-01-05 10:30:00"
    assert got["2023-01-05 10:30:00.25"] == "2023-01-05 10:30:00.25"
    assert got["1/2/2023"] == "2023-01-02 00:00:00"
    assert got["Jan 5 2020"] == "2020-01-05 00:00:00"
    assert got["5 Feb 2021"] == "2021-02-05 00:00:00"
    assert got["2021/7/9"] == "2021-07-09 00:00:00"
    assert got["2023-04"] == "2023-04-01 00:00:00"
    assert got["2023-13-40"] is None and got["soon"] is None and got["20230105"] is None


def test_fixed_text_rounds_by_exact_value(spark):
    values = [36.05, 1.005, 2.675, 0.125, 8.345, -36.05, 100.0, 0.0, 99.995, 1e15]
    df = numbers(spark, values)
    got = [tuple(r) for r in df.select(fixed_text(F.col("x"), 1), fixed_text(F.col("x"), 2)).collect()]
    from decimal import ROUND_HALF_UP, Decimal

    want = [tuple(str(Decimal(v).quantize(Decimal(q), ROUND_HALF_UP)) for q in ("0.1", "0.01")) for v in values]
    assert got == want


# -- order statistics --------------------------------------------------------------


@pytest.mark.parametrize("finish_rows", [ordering.FINISH_ROWS, 5])
def test_order_statistics_against_sorting(spark, finish_rows):
    rnd = random.Random(7)
    lists = {
        "spread": [rnd.lognormvariate(0, 9) for _ in range(3001)],
        "hot": [1.5] * 1000 + [rnd.random() for _ in range(2001)],
        "same": [4.0] * 3001,
        "negative": [-rnd.random() for _ in range(3001)],
        "few": [2.0, 1.0, None] + [None] * 2998,
        "none": [None] * 3001,
    }
    df = spark.createDataFrame(list(zip(*lists.values())), ", ".join(f"{n} double" for n in lists)).repartition(5)
    targets = [ordering.Target(f"p{p}", p, ordering.floor_index(p)) for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.999)]
    found = ordering.order_statistics(df, {n: F.col(n) for n in lists}, targets, finish_rows)
    for name, values in lists.items():
        kept = sorted(v for v in values if v is not None)
        assert found[name]["n"] == len(kept)
        for t in targets:
            assert found[name][t.name] == (kept[t.index(len(kept))] if kept else None), (name, t.name)


@pytest.mark.parametrize("bits", [12, 4])
def test_ranks_gaps_positions_many_buckets(spark, monkeypatch, bits):
    monkeypatch.setattr(ordering, "BUCKET_BITS", bits)
    rnd = random.Random(3)
    values = [float(rnd.randrange(400)) for _ in range(2000)] + [7.0] * 1000
    df = numbers(spark, values).repartition(6)
    for bucket_rows in (10, 400, 10**6):
        edges = ordering.bucket_edges(df, {"x": F.col("x")}, bucket_rows)["x"]
        # few buckets at the first level: the second is used, and buckets stay small
        assert (edges.fine is not None) == (3000 > bucket_rows * 2**bits)
        if bucket_rows == 10:
            distinct = df.distinct()
            most = ordering.with_bucket(distinct, "x", edges).groupBy("bucket").count().agg(F.max("count")).first()[0]
            assert most <= 25
        got = {r["x"]: r["rank"] for r in ordering.average_ranks(df, "x", edges).collect()}
        ordered_values = sorted(values)
        first = {}
        for i, v in enumerate(ordered_values, 1):
            first.setdefault(v, i)
        want = {v: first[v] + (values.count(v) - 1) / 2 for v in first}
        assert got == want
        distinct = sorted(first)
        prev = {r["x"]: r["previous"] for r in ordering.with_previous(df.distinct(), "x", edges).collect()}
        assert prev == dict(zip(distinct, [None, *distinct[:-1]]))
    tied = spark.createDataFrame(
        list(zip(values, range(len(values)))), "x double, id bigint"
    ).repartition(6)
    for bucket_rows in (10, 10**6):
        got = {r["id"]: r["position"] for r in ordering.with_position(tied, "x", "id", bucket_rows).collect()}
        want = {i: n for n, (_, i) in enumerate(sorted(zip(values, range(len(values)))), 1)}
        assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 100])
def test_median_rule(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    got = ops.quantiles(numbers(spark, values), ["x"], [0.5]).first()["quantile"]
    assert got == statistics.median(values)


# -- edge inputs -------------------------------------------------------------------


def test_empty_and_single(spark):
    empty = numbers(spark, [])
    s = ops.column_summary(empty).first()
    assert (s["count"], s["null_count"], s["min"], s["mean"], s["data_type"]) == (0, 0, None, None, "categorical")
    assert ops.histogram(empty, ["x"]).count() == 0
    q = ops.iqr_outliers(empty, ["x"]).first()
    assert (q["n"], q["q1"], q["outliers"]) == (0, None, 0)
    assert ops.quality_report(empty, 2026)["summary"].first()["rating"] == "error"
    assert ops.quality_report(empty, 2026)["summary"].first()["score"] == 0
    one = numbers(spark, [5.0])
    m = ops.moments(one, ["x"]).first()
    assert (m["variance"], m["standard_deviation"], m["skewness"], m["kurtosis"]) == (0, 0, None, None)
    assert ops.date_pattern(spark.createDataFrame([("2020-01-01",)], "d string"), ["d"]).first()["frequency"] == "unknown"


def test_constant_column(spark):
    df = spark.createDataFrame([(0.1, float(i)) for i in range(9)], "c double, v double")
    h = ops.histogram(df, ["c"], 4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [0, 0, 0, 9]
    assert ops.pearson(df, "c", "v").first()["correlation"] is None
    assert ops.pearson(df, "c", "v", "zero").first()["correlation"] == 0
    assert ops.spearman(df, "c", "v").first()["correlation"] is None


def test_pairwise_deletion_and_minimum(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 1.0)], "a double, b double")
    r = ops.pearson(df, "a", "b").first()
    assert (r["pairs"], r["correlation"]) == (2, None)
    more = df.union(spark.createDataFrame([(4.0, 4.0)], "a double, b double"))
    want = statistics.correlation([1, 3, 4], [2, 5, 4])
    assert ops.pearson(more, "a", "b").first()["correlation"] == pytest.approx(want)
    assert ops.spearman(more, "a", "b").first()["correlation"] == pytest.approx(0.5)


def slow_spearman(rows, i, j):
    """Mean ranks over the complete pairs, counted one by one."""
    both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]

    def ranks(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    x, y = (ranks([b[k] for b in both]) for k in (0, 1))
    return len(both), statistics.correlation(x, y) if len(both) >= 3 and len(set(x)) > 1 and len(set(y)) > 1 else None


@pytest.mark.parametrize("edges", [(4095, 63), (3, 2)])
def test_ranks_of_gappy_hot_and_tied_columns(spark, monkeypatch, edges):
    from plumbline.operators import ranks

    monkeypatch.setattr(ranks, "MOST_EDGES", edges[0])
    monkeypatch.setattr(ranks, "FEWEST_EDGES", edges[1])
    monkeypatch.setattr(ranks, "BLOCK", 500)
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        u = rnd.gauss(0, 1)
        row = [u, round(u + rnd.gauss(0, 1), 1), 7.0 if rnd.random() < 0.6 else rnd.random(), float(rnd.randint(0, 3)), rnd.random() - u, 1.0, None]
        rows.append(tuple(v if v is None or i in (0, 5) or rnd.random() < 0.8 else None for i, v in enumerate(row)))
    names = list("abcdefg")
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r["column_x"], r["column_y"]): (r["pairs"], r["correlation"]) for r in ops.spearman_pairs(df).collect()}
    assert len(got) == 21
    for i, a in enumerate(names):
        for j in range(i + 1, 7):
            n, want = slow_spearman(rows, i, j)
            pairs, r = got[a, names[j]]
            assert pairs == n and (r == pytest.approx(want) if want is not None else r is None), (a, names[j])


def test_ranks_from_many_small_blocks_and_buckets(spark, monkeypatch):
    from plumbline.operators import ranks

    for name, value in {"MOST_EDGES": 9, "FEWEST_EDGES": 9, "BLOCK": 300, "PACKED": 50, "BUCKET_CELLS": 20, "SENT": 40}.items():
        monkeypatch.setattr(ranks, name, value)
    rnd = random.Random(8)
    rows = []
    for i in range(500):
        u = rnd.gauss(0, 1)
        row = [u, round(u, 1) + 0.0, -u + rnd.random(), float(i // 3), rnd.random()]
        rows.append(tuple(None if i % (c + 4) == 0 or (c == 2 and u > 1) else v for c, v in enumerate(row)))
    names = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    for r in ops.spearman_pairs(df).collect():
        n, want = slow_spearman(rows, names.index(r["column_x"]), names.index(r["column_y"]))
        assert (r["pairs"], r["correlation"]) == (n, pytest.approx(want)), r


def shuffled_records(df):
    """Rows that the shuffles of a query wrote."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        if kind == "ShuffleExchangeExec":
            found += node.metrics().apply("shuffleRecordsWritten").value()
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("gaps", [True, False])
def test_ranks_shuffle_blocks_not_cells(spark, gaps):
    n = 30000
    cells = [F.rand(i) if not gaps else F.when(F.rand(i + 9) < 0.8, F.rand(i)) for i in range(4)]
    df = spark.range(0, n, 1, 4).select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    assert 0 < shuffled_records(ops.spearman_pairs(df)) < n / 50


def test_ranks_need_as_many_shuffles_for_many_columns(spark):
    def exchanges(k):
        df = spark.range(5000).select(*[(F.rand(i) if i % 2 else F.when(F.rand(i) < 0.9, F.rand(i))).alias(f"c{i}") for i in range(k)])
        plan = ops.spearman_pairs(df)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), plan.count("Join")

    assert exchanges(3) == exchanges(12)


def test_ranks_of_no_rows_and_no_pairs(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert tuple(ops.spearman(df, "a", "b").first()) == ("a", "b", 0, None)
    assert ops.spearman_pairs(df.select("a")).count() == 0


@pytest.mark.parametrize("bits", [12, 3])
def test_date_patterns_of_many_columns(spark, monkeypatch, bits):
    monkeypatch.setattr(ordering, "BUCKET_BITS", bits)
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 7)
    rnd = random.Random(2)
    day = 86_400_000
    lists = {
        "daily": [i * day for i in range(200)], "ties": [(i // 9) * 7 * day for i in range(200)], "mixed": [rnd.randrange(10**12) if i % 3 else None for i in range(200)],
        "one": [5] + [None] * 199, "none": [None] * 200, "same": [day] * 200, "two": [0, 31 * day] + [None] * 198,
    }
    df = spark.createDataFrame(list(zip(*lists.values())), ", ".join(f"{n} long" for n in lists)).repartition(6)
    df = df.select(*[F.timestamp_millis(n).alias(n) for n in lists])
    got = {r["column"]: (r["frequency"], r["median_days"]) for r in ops.date_pattern(df).collect()}
    for name, values in lists.items():
        kept = sorted(v for v in values if v is not None)
        gaps = sorted(b - a for a, b in zip(kept, kept[1:]))
        n = len(gaps)
        want = None if not gaps else (gaps[n // 2] + gaps[n // 2 - (1 if n % 2 == 0 and n else 0)]) / 2 / day if n % 2 == 0 else gaps[n // 2] / day
        assert got[name][1] == (None if want is None else pytest.approx(want)), name
    assert [got[n][0] for n in ("daily", "ties", "one", "none", "two")] == ["daily", "sub-hourly", "unknown", "unknown", "monthly"]


def test_histogram_counts_everything(spark):
    values = [math.sin(i) * 10 for i in range(1000)]
    h = ops.histogram(numbers(spark, values), ["x"], 20)
    assert h.agg(F.sum("count")).first()[0] == 1000
    assert h.agg(F.sum("density")).first()[0] == pytest.approx(1)


def test_frequency_keeps_everything(spark):
    df = spark.createDataFrame([(f"v{i % 50}",) for i in range(1000)] + [(None,), ("",)], "c string")
    f = ops.frequency(df, ["c"])
    assert f.agg(F.sum("count")).first()[0] == 1001
    assert f.where("value = 'Other'").count() == 1
    assert ops.frequency(df, ["c"], empty_is_value=False).agg(F.sum("count")).first()[0] == 1000


def test_partitioning_does_not_matter(spark, sales):
    def everything(df):
        out = [
            ops.column_summary(df), ops.iqr_outliers(df, ["quantity"]), ops.frequency(df, ["product"]),
            ops.random_sample(df, 7, seed=1), ops.stratified_sample(df, "category", 9, seed=1),
            ops.downsample(df, "date", 10), ops.spearman(df, "quantity", "unit_price"),
        ]
        return [profile_rows(d) for d in out]

    assert everything(sales.repartition(1)) == everything(sales.repartition(7))


# -- samples -----------------------------------------------------------------------


def test_sample_sizes(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 990, "big").otherwise(F.concat(F.lit("s"), "id")))
    assert ops.random_sample(df, 100, ["id"]).count() == 100
    assert ops.reservoir_sample(df, 5000, ["id"]).count() == 1000
    s = ops.stratified_sample(df, "g", 100, ["id"], 5)
    assert s.count() == 100
    assert ops.random_sample(df, 100, ["id"], 1).collect() != ops.random_sample(df, 100, ["id"], 2).collect()
    small = ops.stratified_sample(df, "g", 200, ["id"])
    assert small.count() == 200 and small.select("g").distinct().count() >= 9
    a = ops.adaptive_sample(df, {"g": "categorical"}, 200, ["id"])
    assert a.count() == 200 and a.select("g").distinct().count() >= 9
    assert ops.adaptive_sample(df, {"id": "numeric"}, 50, ["id"]).count() == 50


# -- quality -----------------------------------------------------------------------


@pytest.mark.parametrize("share,severity,deduction", [(4, None, 0), (10, "minor", 2), (30, "major", 5), (60, "critical", 10)])
def test_missing_ladder(spark, share, severity, deduction):
    df = spark.createDataFrame([(str(i), None if i < share else "x") for i in range(100)], "id string, a string")
    found = ops.missing_by_column(df).collect()
    assert [(r["severity"], r["deduction"]) for r in found] == ([(severity, deduction)] if severity else [])


@pytest.mark.parametrize("copies,severity", [(0, None), (1, "minor"), (5, "major"), (15, "critical")])
def test_duplicate_ladder(spark, copies, severity):
    df = spark.createDataFrame([(i, 0.0) for i in range(100 - copies)] + [(0, -0.0)] * copies, "a int, b double")
    from plumbline.operators.quality import duplicate_issue

    found = duplicate_issue(df).collect()
    assert [r["severity"] for r in found] == ([severity] if severity else [])
    assert ops.duplicate_rows(df).count() == copies
    assert ops.duplicate_count(df).first()["duplicates"] == copies


def test_health_rules(spark):
    n = 100
    data = [
        (
            150 if i == 0 else 40, 70.0 if i == 1 else 22.0, 200.0 if i < 60 else 5.0, 300 if i < 20 else 70,
            "12" if i == 3 else "3000", ["NSW", "New South Wales", "Mars"][i % 3], "flu" if i < 70 else "A00.1",
            2010 if i % 2 else 2014, 120.0 if i == 0 else 50.0,
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(
        data, "Age int, BMI double, cholesterol_mgdl double, heart_rate int, Postcode string, State string, diagnosis string, Year int, `success percent` double"
    ).withColumnRenamed("cholesterol_mgdl", "cholesterol mg/dL")
    found = {(r["column"], r["type"]): r for r in ops.issues(df, 2016, numeric=[]).collect()}
    assert found["Age", "unrealistic_values"]["affected"] == 1
    assert found["BMI", "unrealistic_values"]["affected"] == 1
    assert found["cholesterol mg/dL", "invalid_health_measurement"]["severity"] == "major"
    assert found["cholesterol mg/dL", "suspicious_unit"]["deduction"] == 5
    assert found["cholesterol mg/dL", "non_australian_unit"]["deduction"] == 1
    assert found["heart_rate", "invalid_health_measurement"]["affected"] == 20
    assert found["Postcode", "invalid_format"]["severity"] == "minor"
    assert found["State", "non_australian_states"]["affected"] == 1
    assert found["State", "incomplete_state_coverage"]["affected"] == 2
    assert found["diagnosis", "non_standard_classification"]["kind"] == "warning"
    assert found["Year", "chronological_gaps"]["description"].endswith("2010-2014")
    assert found["success percent", "logical_inconsistency"]["affected"] == 1
    assert ("Year", "outdated_data") not in found
    late = {(r["column"], r["type"]): r for r in ops.issues(df, 2025, numeric=[]).collect()}
    assert late["Year", "outdated_data"]["severity"] == "critical"
    advice = {r["type"] for r in ops.recommendations(ops.issues(df, 2025, numeric=[])).collect()}
    assert {"acquire_recent_data", "standardise_australian_units", "improve_geographical_representation", "duplicate_removal"} <= advice


def test_name_matching():
    from plumbline.operators.rules import columns_with

    assert columns_with(["three", "hr", "max_hr"], ("hr",)) == ["three", "hr", "max_hr"]
    assert columns_with(["three", "hr", "max_hr"], ("hr",), "token") == ["hr", "max_hr"]


# -- charts and recommendations ----------------------------------------------------


def test_pie_limits(spark):
    df = spark.createDataFrame([(f"g{i}", float(i)) for i in range(11)], "g string, v double")
    assert plans.chart_data(df, "pie", category="g", value="v").count() == 7
    assert plans.chart_data(df.where("v < 10"), "pie", category="g", value="v").count() == 10


def test_treemap_clamps(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 3.0)], "g string, v double")
    got = {r["category"]: r["value"] for r in plans.chart_data(df, "treemap", category="g", value="v").collect()}
    assert got == {"a": 0, "b": 3}


def test_unknown_chart_and_column(spark, sales):
    with pytest.raises(ValueError):
        plans.chart_data(sales, "radar")
    with pytest.raises(ValueError):
        plans.chart_data(sales, "bar", category="nope", value="quantity")
    with pytest.raises(ValueError):
        ops.infer_types(sales, "guess")


def test_chart_rules(spark, sales):
    def one(df):
        r = plans.select_chart(plans.chart_profile(df)).first()
        return r["type"], r["x"], r["y"]

    share = spark.createDataFrame([(f"g{i}", "25.0") for i in range(4)], "g string, v string")
    assert one(share) == ("pie", "g", "v")
    tree = spark.createDataFrame([(f"g{i}", "12.5") for i in range(8)], "g string, v string")
    assert one(tree) == ("treemap", "g", "v")
    bars = spark.createDataFrame([(f"g{i}", "7.0") for i in range(12)], "g string, v string")
    assert one(bars) == ("horizontalBar", "g", "v")
    assert one(spark.createDataFrame([(float(i), 1.0 * i) for i in range(12)], "a double, b double")) == ("scatter", "a", "b")
    assert one(numbers(spark, [float(i) for i in range(20)])) == ("histogram", "x", None)
    assert one(spark.createDataFrame([("a", "b"), ("c", "d")], "p string, q string")) == ("heatmap", "p", "q")
    assert one(spark.createDataFrame([("a",)], "p string"))[0] == "table"
    p = plans.chart_profile(sales)
    assert plans.select_chart_for(p, "quantity", "category").first()["type"] == "boxplot"
    assert plans.select_chart_for(p, "date", "quantity").first()["type"] == "line"
    assert plans.select_chart_for(p, "category", "product").first()["type"] == "heatmap"
    assert plans.select_chart_for(p, "category", "date").first()["type"] == "table"
    assert recommend.category_table(spark).count() == 11


def test_progressive_has_no_repeats(sales):
    got = plans.progressive_charts(plans.chart_profile(sales), 30).collect()
    keys = [(r["type"], r["title"], r["x"], r["y"]) for r in got]
    assert len(keys) == len(set(keys))
    assert [r["seq"] for r in got] == list(range(1, len(got) + 1))


def test_grouped_order_statistics(spark):
    rnd = random.Random(8)
    rows = [(g, rnd.choice([None, float(rnd.randrange(50)), rnd.gauss(0, 9)])) for g in ["a", "b", "", "hot"] + ["hot"] * 5 for _ in range(300)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    targets = [ordering.Target(f"p{p}", p, ordering.floor_index(p)) for p in (0.0, 0.3, 0.5, 0.999)]
    names = ["a", "b", "", "hot", "one", "none", "absent"]
    for finish_rows in (10**6, 3):
        found = ordering.grouped_order_statistics(df, F.col("g"), F.col("v"), names, targets, finish_rows)
        for name in names:
            kept = sorted(v for g, v in rows if g == name and v is not None)
            assert found[name]["n"] == len(kept)
            for t in targets:
                assert found[name][t.name] == (kept[t.index(len(kept))] if kept else None), (name, t.name)


def test_sketched_chart_facts_agree_with_exact_ones(spark):
    """Columns on both sides of every limit, and close to it."""
    from plumbline.plans import profile as pr

    n = 4000
    columns = {
        "id": [float(i) for i in range(n)], "fifth": [float(i % 800) for i in range(n)], "over": [float(i % 801) for i in range(n)], "under": [float(i % 700) for i in range(n)],
        "skewed": [math.exp(i / 700) for i in range(n)], "flat": [5.0] * n, "rare": [1000.0 if i % 19 == 0 else float(i % 10) for i in range(n)],
        "close": [1000.0 if i % 20 == 0 else float(i % 10) for i in range(n)], "none": [None] * n, "zero": [(-1.0) ** i for i in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(7)
    got = {r["column"]: r for r in pr.chart_profile(df, {c: "numeric" for c in columns}).collect()}
    exact = {r["column"]: r for r in pr.numeric_profile(df).collect()}
    distinct = {c: len(set(v) - {None}) for c, v in columns.items()}
    for c, v in columns.items():
        e, kept = exact[c], [x for x in v if x is not None]
        assert got[c]["n"] == len(kept) and got[c]["missing"] == n - len(kept)
        assert got[c]["is_continuous"] == (len(kept) >= 10 and distinct[c] > 0.2 * len(kept)), c
        assert got[c]["has_outliers"] == bool(kept and e["outliers"] > 0.05 * len(kept)), c
        assert got[c]["skewed"] == bool(kept and abs(e["mean"] - e["mid"]) > 0.2 * abs(e["mean"])), c


def test_boxplot_forms(sales):
    b = {r["category"]: r for r in ops.boxplot(sales, "quantity", "category").collect()}
    assert (b["Garden"]["q1"], b["Garden"]["median"], b["Garden"]["q3"]) == (5, 9, 13)
    whole = ops.boxplot(sales, "quantity").first()
    assert (whole["q1"], whole["q3"], whole["max"], whole["outliers"]) == (6, 17, 33.5, 1)
    out = ops.boxplot_outliers(sales, "quantity").collect()
    assert [(r["value"], r["count"]) for r in out] == [(52, 1)]


def test_line_and_table(sales):
    got = charts.line(sales, "date", ["quantity"], 10).collect()
    assert len(got) == 11 and got[0]["date"] == "2024-03-01" and got[-1]["date"] == "2024-03-31"
    assert charts.table(sales, ["product"]).columns == ["product"]


# -- sources, sinks, streams -------------------------------------------------------


def test_sinks(spark, sales, tmp_path):
    report = ops.quality_report(sales, 2025)
    write_issues(report["issues"], str(tmp_path / "issues"))
    assert spark.read.json(str(tmp_path / "issues")).count() == 3
    write_tables({"summary": ops.column_summary(sales)}, str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "all" / "summary")).count() == 6
    write_preview(sales, str(tmp_path / "preview"))
    back = read_csv(spark, str(tmp_path / "preview"))
    assert back.count() == 20 and back.columns == sales.columns
    found = plans.dataset_metadata(sales)["insights"]
    write_insights(found, str(tmp_path / "insights"))
    assert spark.read.text(str(tmp_path / "insights")).count() == found.count()


def test_sources(spark, sales, employees):
    import pathlib

    files = csv_files(spark, str(pathlib.Path(__file__).parent / "data"))
    assert {r["name"] for r in files.collect()} == {"sales.csv", "employees.csv"}
    assert preview(sales, 5).count() == 5
    c = {r["name"]: tuple(r)[1:] for r in table_catalog({"s": sales, "e": employees, "later": None, "bad": ValueError()}).collect()}
    assert c == {"s": ("ready", 31, 6), "e": ("ready", 13, 5), "later": ("processing", None, None), "bad": ("error", None, None)}


def test_stream_continues_from_checkpoint(spark, sales, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    sales.where("quantity <= 10").write.parquet(str(source))
    stream = lambda: spark.readStream.schema(sales.schema).parquet(str(source))
    first = run_profile(stream(), "first_part", checkpoint).collect()
    assert {r["count"] for r in first} == {sales.where("quantity <= 10").count()}
    sales.where("quantity > 10").write.mode("append").parquet(str(source))
    total = profile_rows(run_profile(stream(), "first_part", checkpoint))
    assert total == profile_rows(ops.column_summary(sales))


def test_batch_run_again_counts_once(spark, sales, tmp_path):
    """The state after a batch does not depend on how often the batch was tried."""
    from plumbline.streaming import profile as st

    source, path = tmp_path / "in", str(tmp_path / "kept")
    for part in range(3):
        sales.where(f"cast(quantity as int) % 3 = {part}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(sales.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    st.keep_profile(stream, path).awaitTermination()
    versions = sorted(p.name for p in (tmp_path / "kept" / "state").iterdir())
    assert versions == ["version=0", "version=1", "version=2"]
    before = profile_rows(st.latest_state(spark, path).drop("distinct", "quantiles"))
    # the commit of the last batch is lost: the query runs it again
    (tmp_path / "kept" / "checkpoint" / "commits" / "2").unlink()
    crc = tmp_path / "kept" / "checkpoint" / "commits" / ".2.crc"
    if crc.exists():
        crc.unlink()
    st.keep_profile(stream, path).awaitTermination()
    assert profile_rows(st.latest_state(spark, path).drop("distinct", "quantiles")) == before
    kept = {r["column"]: r for r in st.summary_of(st.latest_state(spark, path)).collect()}
    assert kept["product"]["distinct_values"] == sales.select("product").distinct().count()
    low, mid, high = kept["quantity"]["approximate_quantiles"]
    assert kept["quantity"]["min"] <= low <= mid <= high <= kept["quantity"]["max"]


def test_reservoir_of_a_stream_is_that_of_the_table(spark, sales, tmp_path):
    from plumbline.streaming import keep_reservoir, latest_state

    source, path = tmp_path / "in", str(tmp_path / "kept")
    for part in range(3):
        sales.where(f"cast(quantity as int) % 3 = {part}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(sales.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    keep_reservoir(stream, path, 7, seed=4).awaitTermination()
    kept = profile_rows(latest_state(spark, path).drop("_h"))
    assert len(kept) == 7
    assert kept == profile_rows(ops.reservoir_sample(sales, 7, seed=4)) == profile_rows(ops.random_sample(sales, 7, seed=4))


def test_reservoir_takes_one_scan(spark):
    df = spark.range(0, 5000, 1, 11)
    sample = ops.reservoir_sample(df, 40, ["id"], 3)
    assert sample._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert sorted(r[0] for r in sample.collect()) == sorted(r[0] for r in ops.random_sample(df, 40, ["id"], 3).collect())


def profile_rows(df):
    names = sorted(df.columns)
    return sorted(str([round(r[n], 6) if isinstance(r[n], float) else r[n] for n in names]) for r in df.collect())


def test_batches_have_the_asked_size(spark):
    df = spark.range(0, 2500, 1, 1)
    sizes = map_batches(df, lambda p: p.head(1).assign(n=len(p))[["n"]], "n bigint", 1000)
    assert sorted(r["n"] for r in sizes.collect()) == [500, 1000, 1000]


def test_reconcile(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (3,), (4,)], "k int")
    got = {r["k"]: r["finding"] for r in ops.reconcile(a, b, ["k"]).collect()}
    assert got == {1: "mismatch", 2: "missing", 4: "orphaned"}


def test_approximate_forms(sales):
    assert ops.cardinality(sales, ["product"], approximate=True).first()["cardinality"] == 15
    q = ops.quantiles(sales, ["quantity"], [0.5], approximate=True).first()["quantile"]
    assert q == 10
    assert ops.outlier_values(sales, "quantity").first()["value"] == 52


def test_downsample_keeps_different_rows(spark):
    df = spark.createDataFrame([(f"2024-01-{1 + i // 4:02d}", 1, i) for i in range(40)], "day string, tie int, payload int")
    for parts in (1, 7):
        got = ops.downsample(df.repartition(parts), "day", 100, "tie").collect()
        assert sorted(r["payload"] for r in got) == list(range(40))
        few = ops.downsample(df.repartition(parts), "day", 10, "tie")
        assert few.count() == few.distinct().count() == 11


@pytest.mark.parametrize("limits", [(4_000_000, 1 << 27), (0, 1 << 27), (0, 64), (0, 1)])
def test_duplicates_by_broadcast_filter_and_join(spark, monkeypatch, limits):
    from plumbline.operators import duplicates

    monkeypatch.setattr(duplicates, "BROADCAST_HASHES", limits[0])
    monkeypatch.setattr(duplicates, "FILTER_BITS", limits[1])
    monkeypatch.setattr(duplicates, "HOT_SHARE", 8)
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 7, rnd.randint(0, 200)]), rnd.choice(["a", None, "b"])) for _ in range(600)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    want = sorted(((*r, n) for r, n in collections.Counter(rows).items() if n > 1), key=str)
    assert sorted((tuple(r) for r in ops.duplicate_groups(df).collect()), key=str) == want


def test_rows_that_do_not_repeat_are_not_shuffled(spark):
    df = spark.range(2000).select((F.col("id") % 1990).alias("a"), F.lit("wide").alias("b"))
    plan = ops.duplicate_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_duplicates_of_maps_and_odd_names(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, 1), ({"b": 2, "a": 1}, 1), ({"a": 3}, 2)], "m map<string,int>, `we``ird` int")
    assert ops.duplicate_count(df).first()["duplicates"] == 1
    assert ops.duplicate_rows(df).count() == 1
    assert ops.random_sample(df.select("`we``ird`"), 2, seed=1).count() == 2


def scans(df):
    """Scans of files in the plan; lists of column names are local relations and none."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("] parquet")


def test_one_scan_whatever_the_number_of_columns(spark, tmp_path):
    for n in (8, 200):
        path = str(tmp_path / f"w{n}")
        spark.range(20).select(*[(F.col("id") * i % 7).cast("double").alias(f"c{i}") for i in range(1, n + 1)]).write.parquet(path)
        df = spark.read.parquet(path)
        assert scans(ops.column_summary(df)) == 1 and scans(ops.moments(df)) == 1
    some = [f"c{i}" for i in range(1, 13)]
    gaps = df.select(*[F.when(F.col(c) != i % 7, F.col(c)).alias(c) for i, c in enumerate(some)])
    assert scans(ops.pearson_pairs(gaps)) == 1


def test_summaries_of_an_empty_table(spark):
    df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(30)))
    got = ops.column_summary(df).collect()
    assert len(got) == 30 and all(r["count"] == 0 and r["sum"] == 0.0 and r["min"] is None for r in got)


def test_infinities_are_no_numbers(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)] + [(float("inf"), float("-inf"))], "a double, b double")
    m = {r["column"]: r for r in ops.moments(df).collect()}
    assert m["a"]["max"] == 8 and m["b"]["min"] == 0 and m["a"]["count"] == 9
    assert ops.pearson(df, "a", "b").first()["correlation"] == pytest.approx(1.0)
    assert sum(r["count"] for r in ops.histogram(df, ["a"], 4).collect()) == 9
