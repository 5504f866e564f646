import itertools

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash


def slow_print(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, at = [], ""
    for c in low + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [at] if at else []
            at = ""
        else:
            at += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints, radius):
    """{key: smallest key reached} of (key, print) by looking at every pair."""
    root = {k: k for k, _ in prints}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in itertools.combinations(prints, 2):
            if bin(x ^ y).count("1") <= radius and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


TEXTS = ["", None, " \t\n", "one", "One two", "A b c", "a B c", "É b c d", "x y z w", "a b c d e f " * 50, "a b c d e g " * 50, "\x0ba\x0cb c", "word " * 30_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_of_whole_text(text):
    assert simhash.fingerprint(text) == slow_print(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_connect_exactly_what_all_pairs_connect(spark, rnd, radius):
    prints = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for _ in range(rnd.randrange(1, radius + 2)):
                x ^= 1 << rnd.randrange(64)
    prints |= {0, (1 << 64) - 1, 1 << 63}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "p long").repartition(5)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.close_links(df, radius)).collect()}
    want = slow_components([(x, x % (1 << 64)) for x in signed], radius)
    assert {x: got.get(x, x) for x in signed} == want


def test_near_duplicates_against_all_pairs(docs):
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = [(r["doc_id"], slow_print(r["text"])) for r in rows]
    root = slow_components(prints, 3)
    assert got == {k: (p, root[k]) for k, p in prints}


def test_nulls_repeats_and_clashing_names(make):
    df = make([(5, None), (3, ""), (None, "a b c d"), (9, "a b c d"), (9, "a b c d"), (None, "other words are here"), (None, "quite different ones there now")])
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("5", "3"), ("9", "9"), ("9", "9"), ("None", "9"), ("None", "None"), ("None", "None")]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None", "None"]


def test_hot_group_is_one_component(spark, make, rnd):
    base = [str(rnd.randrange(1000)) for _ in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rnd.randrange(400)] = f"w{i}"
        rows.append((i, " ".join(words)))
    got = simhash.near_duplicates(make(rows, clash=False)).collect()
    root = slow_components([(k, slow_print(t)) for k, t in rows], 3)
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_empty_table(make):
    df = make([])
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_stars_of_a_chain():
    p = np.array([0, 1, 3, 7, 15, 0xFF << 40], np.int64)
    assert {b for _, b in simhash._stars(p, 1)} == {1, 3, 7, 15}
