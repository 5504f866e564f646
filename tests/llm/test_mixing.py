import itertools
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing, queries


def test_targets_stop_and_share_again():
    got = mixing.targets({"a": 10, "b": 1000, "c": 1000}, {"a": 5, "b": 2, "c": 1})
    assert got["a"] == 30 and got["b"] == pytest.approx(1980 * 2 / 3) and got["c"] == pytest.approx(660)
    assert mixing.targets({"a": 0, "b": 4}, {"a": 5, "b": 1}) == {"a": 0, "b": 4}
    assert mixing.targets({}, {}) == {}


def test_route_is_a_cheapest_largest_flow(rnd):
    for _ in range(30):
        names = [("a",), ("a", "b"), ("b", "c")]
        sizes = {p: rnd.randrange(0, 4) for p in names}
        quotas = {s: rnd.randrange(0, 5) for s in "abc"}
        flow = mixing.route(sizes, quotas, 3)
        pairs = [(p, s) for p in names for s in p]
        cost = lambda f, sizes=sizes: sum(max(0, min(f.get(p, 0) - e * sizes[p], sizes[p])) * e for p in names for e in range(3))
        best = (-1, 0)
        for amounts in itertools.product(range(5), repeat=len(pairs)):
            used, got = {}, {}
            for (p, s), x in zip(pairs, amounts):
                used[p] = used.get(p, 0) + x
                got[s] = got.get(s, 0) + x
            if all(used[p] <= 3 * sizes[p] for p in used) and all(got[s] <= quotas[s] for s in got):
                best = max(best, (sum(amounts), -cost(used)))
        used, got = {}, {}
        for (p, s), x in flow.items():
            used[p] = used.get(p, 0) + x
            got[s] = got.get(s, 0) + x
        assert all(got[s] <= quotas[s] for s in got) and all(used[p] <= 3 * sizes[p] for p in used)
        assert (sum(flow.values()), -cost(used)) == best


def test_query_comes_to_the_targets(spark, sf, docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op1_mix_sources(spark, sf).collect()
    assert len(got) == len(text)
    by = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
        assert sum(r["taken"] for r in rows) == round(rows[0]["target"])
    assert {tuple(r) for r in got} == {tuple(r) for r in queries.op1_mix_sources(spark, sf).collect()}


def test_chunks_do_not_change_sums_and_hot_source(make):
    rows = [(i, "w " * (i % 13), None, "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    df = make(rows)
    for chunks in (1, 40, None):
        out = mixing.mix(df, mixing.cycle([5, 2, 1]), mixing.words_in(F.col("text")), F.array("source"), chunks=chunks, key=[F.col("doc_id")])
        got = out.select("source", "taken", F.element_at("targets", 1).alias("target")).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()
        assert all(r["n"] == round(r["target"]) for r in got)


def test_overlapping_sources_fill_from_both(make):
    df = make([(i, "w " * 10, None, "a" if i < 10 else "b" if i < 12 else "ab") for i in range(30)], clash=False)
    out = mixing.mix(df, {"a": 1, "b": 1}, mixing.words_in(F.col("text")), F.split("source", ""), key=[F.col("doc_id")])
    got = {tuple(r["sources"]): r["n"] for r in out.groupBy("sources").agg(F.sum("taken").alias("n")).collect()}
    assert sum(got.values()) == 300 and got[("a",)] == 100 and got[("b",)] == 20 and got[("a", "b")] == 180


def test_nulls_empty_texts_and_repeats(make):
    df = make([(1, None, None, "a"), (2, "", None, None), (3, "x y z", None, None), (3, "x y z", None, None), (None, "q", None, "")])
    out = mixing.mix(df, mixing.cycle([5, 2, 1]), mixing.words_in(F.col("text")), F.array("source")).collect()
    assert len(out) == 5 and sum(r["taken"] for r in out) == 7
    assert [r["sources"] for r in out if r["doc_id"] == 2] == [[None]]


def test_empty_table_and_too_many_patterns(make):
    size, source = mixing.words_in(F.col("text")), F.array("source")
    assert mixing.mix(make([]), mixing.cycle([1]), size, source).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(make([(1, "a", None, "x"), (2, "a", None, "y")]), mixing.cycle([1]), size, source, max_nodes=1)


def test_copies(spark):
    rows = spark.createDataFrame([(0, 0), (0, 4), (6, 4), (12, 4)], "taken long, size long")
    assert [r[0] for r in rows.select(mixing.copies(F.col("taken"), F.col("size"))).collect()] == [1, 0, 2, 3]
