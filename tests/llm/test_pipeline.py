import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, toxicity
from test_simhash import slow_components, slow_print


def test_stages_against_plain_loops(spark, sf, docs):
    """Every stage on its predecessor's rows, against a loop over all of them."""
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_near_duplicates", "drop_benchmark", "mix_sources", "shard"]
    left, columns = docs.cache(), docs.columns
    rows = [r.asDict() for r in left.collect()]

    out = corpus_pipeline.drop_toxic(spark, left, sf).cache()
    score = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    rows = [r for r in rows if score(r["text"])[0] < 0.7]
    assert out.columns == columns and sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in rows)

    out = corpus_pipeline.drop_near_duplicates(spark, out, sf).cache()
    root = slow_components([(r["doc_id"], slow_print(r["text"])) for r in rows], 3)
    rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    assert out.columns == columns and sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in rows)

    out = corpus_pipeline.drop_benchmark(spark, out, sf).cache()
    index = decontaminate.build([(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = [r for r in rows if not decontaminate.matches(r["text"], index)]
    assert out.columns == columns and sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in rows)

    out = corpus_pipeline.mix_sources(spark, out, sf).cache()
    mixed = collections.Counter(r["doc_id"] for r in out.collect())
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    of = collections.defaultdict(list)
    for r in rows:
        of[r["source"]].append(r["doc_id"])
    assert out.columns == columns and set(mixed) <= set(size) and max(mixed.values()) <= 3
    weights = dict(zip(sorted(of), [5, 2, 1] * 99))
    full, rest, want = set(), sum(size.values()), {}
    while True:
        free = [s for s in of if s not in full]
        want |= {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        above = [s for s in free if want[s] > 3 * sum(size[d] for d in of[s])]
        for s in above:
            want[s] = 3 * sum(size[d] for d in of[s])
            rest -= want[s]
        full |= set(above)
        if not above:
            break
    for s, ids in of.items():
        assert abs(sum(mixed[d] * size[d] for d in ids) - want[s]) <= max(size[d] for d in ids) / 2 + 1

    got = corpus_pipeline.shard(spark, out, sf).collect()
    assert collections.Counter(r["doc_id"] for r in got) == mixed
    text = {r["doc_id"]: r["text"] for r in rows}
    where = {}
    assert all(where.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"] for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_documents_with_nulls(spark, sf, make):
    for rows in ([], [(None, None), (1, None), (2, ""), (2, ""), (3, "a b")]):
        df = make(rows, clash=False)
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf)
            assert df.count() >= 0


def test_columns_with_names_that_operators_use(spark, sf, docs):
    names = "p rest before full cut size sources targets source_sizes taken more shard slot _s _n _before c k h found score".split()
    df = docs.withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == docs.columns + names
    assert df.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == df.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == df.count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).where(F.col("slot") < 0).count() == 0
