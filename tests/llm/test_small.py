"""Licences, languages, URLs and toxicity."""

import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, licenses, queries, toxicity, urls


# -- licences ------------------------------------------------------------------------


def test_licenses(make, spark):
    mit = licenses.MIT
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit.upper().replace(" ", "  ")),
        (2, "Some text.\nReleased under the MIT Licence\nmore"),
        (3, None), (4, ""), (5, "Copyright 2020 only"), (6, mit + " and more"), (2, "Some text.\nReleased under the MIT Licence\nmore"),
        (None, "* Copyright X *\r\nLicensed under CC BY-NC 4.0.\r\nThis work is licensed under the GNU General Public License, version 3."),
        (8, "word " * 20_000),
    ]
    df = make(rows)
    out = licenses.scan(df, licenses.registry(spark))
    assert [c for c in df.columns if c != "Digest"] == out.columns[:-3]
    got = sorted(((str(r["doc_id"]), r["license_id"], ",".join(r["line_licenses"])) for r in out.collect()), key=str)
    assert got == sorted(
        [("1", "MIT", ""), ("2", None, "MIT"), ("2", None, "MIT"), ("3", None, ""), ("4", None, ""), ("5", None, ""), ("6", None, ""), ("8", None, ""), ("None", None, "CC-BY-NC-4.0,GPL-3.0-only")],
        key=str,
    )
    assert licenses.scan(make([]), licenses.registry(spark)).count() == 0
    assert licenses.scan(df, licenses.registry(spark), lines=False).where("size(line_licenses) > 0").count() == 0


def test_licenses_wrapped_at_any_width(make, spark):
    full = {"MIT": licenses.MIT, "ISC": licenses.ISC, "BSD-2-Clause": licenses.BSD_2, "BSD-3-Clause": licenses.BSD_3, "0BSD": licenses.ZERO_BSD, "Unlicense": licenses.UNLICENSE, "Apache-2.0": licenses.APACHE_NOTICE}
    heads = ["", "Copyright (c) 2020 Some One\n", "© Some One, all rights reserved\n", "Copyright 1999-2004 Some One <a@b.org>\nPortions copyright Another\n"]
    rows, want = [], {}
    for width in range(30, 100):
        for name, text in full.items():
            wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
            want[len(rows)] = name
            rows.append((len(rows), heads[len(rows) % len(heads)] + wrapped))
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(make(rows), licenses.registry(spark), lines=False).collect()}
    assert got == want


# -- languages -----------------------------------------------------------------------


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_edges(make):
    en, de = "the house and the garden with a green door ", "das haus und der garten mit einer tür "
    train = make([(i, (en if i % 2 else de) * 3 + f" {chr(97 + i)}", "en" if i % 2 else "de") for i in range(10)] + [(99, None, "fr"), (98, "123", "fr"), (97, "abc", None)])
    model = language.learn(train)
    assert set(model.dictionaries) == {"en", "de"}
    df = make([(1, None), (2, ""), (3, "123 ... \n"), (4, en), (4, en), (None, de.upper()), (5, "x"), (6, en * 3000)])
    out = language.identify(df, model, margin=None)
    assert [c for c in df.columns if c != "score"] == out.columns[:-4]
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in out.collect())
    assert [g for g in got if g[0] != "5"] == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("6", "en"), ("None", "de")]
    numerals = {r["lang_pred"] for r in language.identify(make([(1, "²"), (2, "½ Ⅷ"), (3, "٣ _")]), model, margin=None).collect()}
    assert numerals == {"und"}
    strict = {str(r["doc_id"]): (r["lang_pred"], r["narrow"]) for r in language.identify(df, model).collect()}
    assert strict["5"] == ("und", True) and strict["4"] == ("en", False)
    assert language.identify(make([]), model).count() == 0
    nothing = language.learn(make([]))
    assert {r["lang_pred"] for r in language.identify(df, nothing, margin=None).collect()} == {"und"}


# -- URLs ----------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("deep.org", "/a/b/c/d", "block"), ("deep.org", "", "allow")]
URLS = [
    "http://example.com/en/1", "https://a.www.EXAMPLE.com/en/", "http://www.example.com/EN/x", "http://com/", "http://com", "http://x.net/es/?q=/fr/", "http://x.net/es", "ftp://notnet/fr/",
    "x.com/en/", "", None, "://", "http://a.example.com:80/en/", "http://u@b.com/#/en/", "http://deep.org/a/b/c/dx/e", "http://deep.org/a/b/c", "http://q.deep.org?x", "HTTP://X.NET/fr/://y.com/en/",
    "http://" + "a." * 3000 + "example.com/en/" + "/" * 3000, "http://x.net/fr/\nz", "http:///en/", "http://..com/",
]


def slow_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, marks: s[: min([s.find(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_against_every_rule(spark):
    rules = spark.createDataFrame(RULES + [RULES[0], (None, None, "block")], "host string, path string, verdict string").where("host is not null")
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "x")], "page_id long, url string, host string, e string")
    out = urls.judge_urls(pages, rules)
    assert out.columns == ["page_id", "url", "e", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_judge(r["url"]), r["url"]
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_url_query_has_no_python(spark, sf):
    plan = queries.op9_url_filter(spark, sf)._jdf.queryExecution().toString() + queries.op7_licenses(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# -- toxicity ------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    df = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(df, labels, where=fold != 1)
    rows = toxicity.score(df.where(fold == 1), model).join(labels, "doc_id").collect()
    bad, good = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["score"] >= toxicity.THRESHOLD for r in bad) >= 0.85 * len(bad)
    assert sum(r["score"] >= toxicity.THRESHOLD for r in good) <= 0.02 * len(good)
    assert all(r["offending"] for r in bad if r["score"] >= 0.9)


@pytest.fixture(scope="module")
def toy(make):
    clean = "the sun was over the hill. we went home early! nothing more"
    rows = [(i, f"{clean}. word{i} here. " + ("what a dreadful vexing thing. " if i % 2 else "") + "so it went") for i in range(200)]
    df = make(rows)
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    return toxicity.train(df, labels)


def test_toxicity_edges_and_places(make, toy):
    text = "é so. we saw a DREADFUL vexing cat. the sun"
    df = make([(1, None), (2, ""), (3, "..."), (4, text), (4, text), (None, "the sun was over"), (6, "the sun. " * 20_000), (7, "the sun " * 20_000)])
    out = toxicity.score(df, toy)
    assert [c for c in df.columns if c != "score"] == out.columns[:-2]
    rows = out.collect()
    got = {str(r["doc_id"]): r for r in rows}
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert got["1"]["score"] == got["2"]["score"] == got["3"]["score"] == 0
    assert got["4"]["score"] > 0.7 and [text[p["start"] : p["end"]] for p in got["4"]["offending"]] == ["we saw a DREADFUL vexing cat"]
    assert max(got[k]["score"] for k in ("None", "6", "7")) < 0.7
    assert toxicity.score(make([]), toy).count() == 0


def test_noisy_or_of_sentences(toy):
    import math

    text = "what a dreadful thing. a vexing one. the sun"
    z = [sum(toy.word_weight(w) for w in set(ws)) for _, _, ws in toxicity.sentences(text)]
    p = [x for x in (1 / (1 + math.exp(-(toy.bias + x))) for x in z) if x >= toxicity.FLOOR]
    assert p
    assert toy.scorer()(text)[0] == pytest.approx(1 - math.prod(1 - x for x in p))


def test_training_without_labels(make, spark):
    df = make([(1, "a b"), (2, "c d"), (None, "e")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    for labels in (none, one):
        model = toxicity.train(df, labels)
        assert {r["score"] for r in toxicity.score(df, model).collect()} == {0.0}
