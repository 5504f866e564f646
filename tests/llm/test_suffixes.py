import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import suffixes


def slow(rows, length=100):
    """What goes of each (key, text), in the order of keys: window by window."""
    out, seen = [], set()
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((_, len(data), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def got(df, key="doc_id"):
    rows = suffixes.first_copies(df, key).collect()
    return sorted([(r[key], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows], key=lambda r: (r[0] is not None, r[0] or 0))


def corpus(rnd, n=60):
    """Texts that share passages, whole copies, periodic texts and edits."""
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(40)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared = [prose(rnd.randint(15, 60)) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = rnd.randint(0, 6)
        if kind == 0 and rows:
            text = rnd.choice(rows)[1]
        elif kind == 1:
            text = "ab" * rnd.randint(40, 200)
        elif kind == 2:
            text = prose(rnd.randint(0, 20))
        elif kind == 3 and rows and rows[0][1]:
            old = rnd.choice(rows)[1] or ""
            at = rnd.randint(0, len(old))
            text = old[:at] + "#" + old[at:]
        else:
            text = prose(rnd.randint(5, 40)) + " " + rnd.choice(shared) + " " + prose(rnd.randint(5, 40))
        rows.append((i * 3 - 20, text))
    return rows


def test_against_every_window(make, rnd):
    rows = corpus(rnd)
    assert got(make(rows).repartition(5)) == slow(rows)


def test_split_blocks_and_frequent_seeds(make, rnd, monkeypatch):
    for name, value in (("CHUNK", 700), ("BLOCK", 3000), ("SORTED", 2000), ("HEAVY", 3), ("GROUP", 4)):
        monkeypatch.setattr(suffixes, name, value)
    rows = corpus(rnd, 80)
    assert got(make(rows).repartition(3)) == slow(rows)
    monkeypatch.setattr(suffixes, "HEAVY", 1000)
    assert got(make(rows).repartition(7)) == slow(rows)


def test_passage_in_every_document_leaves_the_first(make, rnd):
    passage = " ".join(f"w{rnd.randint(0, 999)}" for _ in range(40))
    rows = [(i, f"{i * 7919} {passage} {i * 104729}") for i in range(300)]
    assert got(make(rows).repartition(8)) == slow(rows)


def test_nulls_empty_repeated_rows_and_no_rows(make):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    rows = [(None, long), (1, None), (2, ""), (3, long[:99]), (4, "x" + long), (5, "é" * 120)]
    assert got(make(rows)) == slow(rows)
    twice = got(make([(4, long), (4, long), (9, long), (9, long)]))
    assert [r[2] for r in twice] == [[], [], [(0, len(long))], [(0, len(long))]]
    assert got(make([(1, "a")]).where("false")) == []


def test_equal_ids_with_other_texts_keep_one_copy(make):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    rows = got(make([(4, long + "a"), (4, long + "b")]))
    assert sorted(len(r[2]) for r in rows) == [0, 1]


def test_earlier_starts_are_previous_smaller_positions(rnd):
    """Against the textbook: previous and next smaller position in the full suffix order."""
    data = "".join(rnd.choice("ab") for _ in range(30)).encode() * 9
    n, length = len(data), 40
    order = sorted(range(n), key=lambda p: data[p:])
    factor = [0] * n
    for i, p in enumerate(order):
        for step in (-1, 1):
            j = i + step
            while 0 <= j < n and order[j] > p:
                j += step
            if 0 <= j < n:
                q, k = order[j], 0
                while p + k < n and data[p + k] == data[q + k]:
                    k += 1
                factor[p] = max(factor[p], k)
    starts = np.arange(n - length + 1)
    earlier = suffixes.earlier_starts(np.frombuffer(data, np.uint8), starts, length)
    assert [e >= 0 for e in earlier] == [f >= length for f in factor[: len(starts)]]
    assert all(e < p and data[e : e + length] == data[p : p + length] for p, e in enumerate(earlier) if e >= 0)


def test_short_length_is_refused(make):
    with pytest.raises(ValueError):
        suffixes.first_copies(make([(1, "a")]), length=10)


def test_query_against_every_window(spark, sf):
    from plumbline.llm import queries

    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    import hashlib

    want = [(k, n, sum(b - a for a, b in s), len(s), hashlib.sha256(t).hexdigest()) for k, n, s, t in slow(rows)]
    out = queries.op13_first_copies(spark, sf)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == want
    assert any(n for _, _, n, _, _ in want)
