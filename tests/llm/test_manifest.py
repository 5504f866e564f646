import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import manifest, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels of the tree, from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def walk(levels, i, node):
    """Siblings of a leaf, and the root that ``node`` in its place leads to."""
    path = ""
    for level in levels[:-1]:
        start = i // 8 * 8
        run = level[start : start + 8]
        own = i - start
        path += "".join(run[:own] + run[own + 1 :])
        node = sha("".join([*run[:own], node, *run[own + 1 :]]))
        i //= 8
    return path, node


def slow(rows):
    """Proofs of (doc_id, source, lang, n_chars, text), as the contract says."""
    out = []
    first = lambda x: (x is not None, x if x is not None else "")
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = [sorted((r for r in rows if r[2] == x), key=lambda r: (first(r[0] if r[0] is not None else None)[0], r[0] or 0, leaf(r))) for x in langs]
    trees = [tree([leaf(r) for r in p]) for p in parts]
    top = tree([t[-1][0] for t in trees])
    for g, (p, t) in enumerate(zip(parts, trees)):
        for i, r in enumerate(p):
            own = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                own = leaf((*r[:4], low))
            path, node = walk(t, i, own)
            more, node = walk(top, g, node)
            out.append((r[0], leaf(r), t[-1][0], top[-1][0], sha(path + more), node, node == top[-1][0]))
    return out


def got(spark, docs):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest.audit_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, {"text": low})
    assert out.columns == "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return [tuple(r) for r in out.collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({c: F.lit("x") for c in ("g", "i", "n", "k", "p", "leaf", "claimed", "group", "key", "_tie", "_at", "block", "groups")})


def documents(rnd, n, langs):
    text = lambda: rnd.choice([None, "", "É Abc", "abc", "X" * rnd.randint(0, 30)])
    ids = [rnd.randint(0, n) if rnd.random() < 0.9 else None for _ in range(n)]
    rows = [(i, rnd.choice(["s", None, ""]), rnd.choice(langs), rnd.choice([None, 5]), text()) for i in ids]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("levels", [4, 1])
def test_against_a_plain_tree(spark, rnd, monkeypatch, levels):
    """With one level a builder, five tiers and more groups than a run holds."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = documents(rnd, 700, [None, "", "de", "é", "z", "Z"] + [f"l{i}" for i in range(9)]) + [(i, None, "de", 1, "T") for i in range(600)]
    assert order(got(spark, table(spark, rows))) == order(slow(rows))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_small_trees(spark, n):
    rows = [(i, "s", "de", 3, f"Text {i}") for i in range(n)]
    assert order(got(spark, table(spark, rows))) == order(slow(rows))


def test_no_rows(spark):
    assert got(spark, table(spark, []).where("false")) == []


def test_repeated_rows_are_leaves_each(spark):
    rows = [(7, "s", "de", 3, "a")] * 20
    assert order(got(spark, table(spark, rows))) == order(slow(rows))


def test_large_ids_stay_whole(spark):
    rows = [((1 << 60) + 1, "s", "de", 3, "a"), (None, "s", "de", 3, "a")]
    assert order(got(spark, table(spark, rows))) == order(slow(rows))


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 100, 513])
@pytest.mark.parametrize("fan", [2, 3, 8])
def test_places_are_the_order_of_completion(n, fan):
    top = manifest.height(n, fan)
    log = manifest.append_log([f"{i}" for i in range(n)], top, fan)
    assert len(log) == manifest.size(n, top, fan)
    nodes, level, seen = [f"{i}" for i in range(n)], 0, set()
    while True:
        places = manifest.place(level, np.arange(len(nodes)), n, top, fan)
        assert [log[p] for p in places] == nodes
        seen |= set(places.tolist())
        if level == top:
            break
        nodes, level = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)], level + 1
    assert seen == set(range(len(log)))


def test_log_segments_join_to_the_whole_log(spark, monkeypatch):
    """Builders of the lowest tier write the pieces of one postorder log, at the places they state."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    leaves = [sha(str(i)) for i in range(75)]
    whole = manifest.append_log(leaves, manifest.height(75))
    rows = spark.createDataFrame([(0, 75, i, x) for i, x in enumerate(leaves)], "g long, n long, i long, node string")
    forest = manifest.grow(rows, 75)
    for s in forest.tiers[0].collect():
        mine = manifest._spelled(bytes(s["log"]))
        assert whole[s["place"] : s["place"] + len(mine)] == mine
    assert forest.roots().first()["node"] == whole[-1] and len(forest.tiers) == 3


def test_altered_rows_are_found_and_no_others(spark, docs):
    out = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in out:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[r["doc_id"]])
        assert r["verified"] is (not changed) and (r["folded_root"] == r["root"]) is r["verified"]
