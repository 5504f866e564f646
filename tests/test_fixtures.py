"""Values of two small CSV tables and a five-row literal, computed by hand or with the statistics module."""

import pytest
from pyspark.sql import functions as F

from plumbline import operators as ops
from plumbline import plans


def rows(df, key="column"):
    return {r[key]: r for r in df.collect()}


def test_employee_statistics(employees):
    m = rows(ops.moments(employees, ["age", "income"]))
    assert (m["age"]["min"], m["age"]["max"], m["age"]["sum"]) == (27, 51, 498)
    assert m["age"]["mean"] == pytest.approx(38.307692, abs=1e-6)
    assert m["age"]["variance"] == pytest.approx(51.443787, abs=1e-6)
    assert m["age"]["standard_deviation"] == pytest.approx(7.172432, abs=1e-6)
    assert m["age"]["skewness"] == pytest.approx(0.127232, abs=1e-6)
    assert m["age"]["kurtosis"] == pytest.approx(-1.084559, abs=1e-6)
    assert m["income"]["mean"] == pytest.approx(73115.384615, abs=1e-6)
    q = rows(ops.iqr_outliers(employees, ["age", "income"]))
    assert (q["age"]["q1"], q["age"]["q3"], q["age"]["lower_bound"], q["age"]["upper_bound"]) == (33, 44, 16.5, 60.5)
    assert (q["income"]["q1"], q["income"]["q3"], q["income"]["outliers"]) == (61000, 86500, 0)
    r = ops.pearson(employees, "age", "income").first()["correlation"]
    assert r == pytest.approx(0.994664, abs=1e-6)


def test_employee_charts_and_score(employees):
    means = rows(plans.chart_data(employees, "bar", category="department", value="income"), "category")
    assert {k: v["value"] for k, v in means.items()} == {
        "Design": 74625, "Legal": 75250, "Research": 92000, "Support": 56375,
    }
    report = ops.quality_report(employees, 2026)
    s = report["summary"].first()
    assert (s["score"], s["rating"], s["warnings"], s["total_records"], s["total_columns"]) == (100, "excellent", 1, 13, 5)
    assert [r["type"] for r in report["issues"].collect()] == ["no_temporal_columns"]


def test_sales_summary(sales):
    s = rows(ops.column_summary(sales))
    t = s["total_sales"]
    assert (t["numeric_count"], t["text_count"], t["data_type"]) == (11, 20, "mixed")
    assert t["sum"] == pytest.approx(19156.34)
    assert t["mean_nonempty"] == pytest.approx(617.946452, abs=1e-6)
    assert (s["quantity"]["sum"], s["quantity"]["min"], s["quantity"]["max"]) == (369, 3, 52)
    o = ops.overview(sales).first()
    assert tuple(o) == (31, 6, 2, 3)


def test_sales_outliers_and_correlation(sales):
    q = rows(ops.iqr_outliers(sales, ["quantity", "unit_price", "total_sales"]))
    assert [q[c]["outliers"] for c in ("quantity", "unit_price", "total_sales")] == [1, 4, 4]
    assert (q["quantity"]["lower_bound"], q["quantity"]["upper_bound"]) == (-10.5, 33.5)
    assert q["unit_price"]["upper_bound"] == pytest.approx(360.025)
    medians = rows(ops.quantiles(sales, ["quantity", "unit_price", "total_sales"], [0.5]))
    assert [medians[c]["quantile"] for c in ("quantity", "unit_price", "total_sales")] == [10, 31.95, 291.2]
    strong = ops.correlated_pairs(ops.pearson_pairs(sales, ["quantity", "unit_price", "total_sales"])).collect()
    assert [(r["feature1"], r["feature2"], r["strength"], r["magnitude"]) for r in strong] == [
        ("unit_price", "total_sales", "positive", "strong")
    ]
    assert strong[0]["correlation"] == pytest.approx(0.836875, abs=1e-6)


@pytest.mark.parametrize("year,score", [(2026, 88), (2027, 86)])
def test_sales_score(sales, year, score):
    s = ops.quality_report(sales, year)["summary"].first()
    assert (s["score"], s["rating"], s["minor_issues"], s["major_issues"]) == (score, "good", 1, 2)


def test_sales_dates(sales):
    p = ops.date_pattern(sales, ["date"]).first()
    assert (p["frequency"], p["median_days"]) == ("daily", 1.0)
    types = ops.type_map(sales)
    assert types["date"] == "temporal"
    assert ops.type_map(sales, "metadata")["date"] == "numeric"


def test_sales_analysis_is_complete(sales):
    out = plans.analyze(sales, 2025)
    assert {"summary", "overview", "types", "correlation_matrix", "charts", "quality_summary", "metadata_insights"} <= set(out)
    kinds = {r["type"] for r in out["charts"].collect()}
    assert {"table", "histogram", "line", "correlationMatrix"} <= kinds
    means = rows(plans.chart_data(sales, "bar", category="category", value="total_sales"), "category")
    assert means["Kitchen"]["value"] == pytest.approx(1604.173, abs=1e-6)


def test_five_rows(spark):
    df = spark.createDataFrame(
        [tuple(map(float, r)) for r in ((3, 120, 9, 2), (5, 131, 14, 2), (6, 150, 18, 4), (9, 162, 29, 5), (11, 190, 33, 5))],
        "depth double, length double, load double, grade double",
    )
    r = {(p["column_x"], p["column_y"]): p["correlation"] for p in ops.pearson_pairs(df).collect()}
    want = {
        ("depth", "length"): 0.978735, ("depth", "load"): 0.995275, ("depth", "grade"): 0.908424,
        ("length", "load"): 0.965395, ("length", "grade"): 0.909632, ("load", "grade"): 0.932254,
    }
    assert r == pytest.approx(want, abs=1e-6)
    assert ops.quality_report(df, 2026)["summary"].first()["score"] == 100
    matrix = ops.correlation_matrix(df)
    assert matrix.where("column_x = column_y and correlation = 1").count() == 4
    assert matrix.count() == 16
    dense = ops.dense_matrix(matrix, df.columns)
    assert dense.where(F.col("column_x") == "depth").first()["length"] == pytest.approx(0.978735, abs=1e-6)
