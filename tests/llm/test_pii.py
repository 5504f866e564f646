import timeit
import hashlib
import re

import numpy as np
import pytest

from plumbline.llm import pii, queries


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_base(text):
    """The contract's patterns as they are written, without any short cut."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        out += [("card", m.start(), m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [("phone", m.start(), m.end())] if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15 else []
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_base_spans_are_those_of_the_patterns(rnd):
    for _ in range(4000):
        text = "".join(rnd.choice("aZ0912345.@+-() é%_\n") for _ in range(rnd.randrange(60)))
        assert pii.base_spans(text) == slow_base(text), text
    for _ in range(300):
        text = " ".join(rnd.choice(["4111111111111111", "4111-1111 1111-1111", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "a@b.c", "a@@b.c.d", "+1 (555) 123-4567", "x@y", "007"]) for _ in range(8))
        assert pii.base_spans(text) == slow_base(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def crf(spark):
    return pii.train(pii.labelled_table(spark))


def test_windows_of_long_texts_take_linear_time():
    """Triggers far apart in a text without line ends, and one without any blank."""
    for unit in ("plain words and 17 more words here " * 40, "x" * 700 + "7"):
        took = []
        for times in (200, 800):
            text = unit * times
            took.append(min(timeit.repeat(lambda: pii.windows(text), number=1, repeat=2)))
        assert took[1] < 4 * 3 * took[0] + 0.05


def test_windows_reach_over_blanks_and_line_ends():
    text = "a b c d e f 7 g\nh i\nj k l m"
    assert [[text[a:b] for a, b in w] for w in pii.windows(text)] == [["c", "d", "e", "f", "7", "g", "h", "i", "j", "k"]]


def test_viterbi_is_the_best_of_all_paths(crf):
    rng = np.random.default_rng(3)
    small = rng.standard_normal((2, len(pii.LABELS))) * 3
    best = max(
        (small[0, a] + pii._START[a] + crf.move[a, b] + pii._ALLOWED[a, b] + small[1, b], a, b) for a in range(len(pii.LABELS)) for b in range(len(pii.LABELS))
    )
    assert list(crf.decode([small])[0]) == [best[1], best[2]]
    many = [rng.standard_normal((n, len(pii.LABELS))) for n in (1, 5, 3, 9, 0, 5)]
    together = crf.decode(many)
    assert all(list(a) == list(crf.decode([s])[0]) for a, s in zip(together, many))


def test_field_finds_what_patterns_miss_and_leaves_clean_text(crf):
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.find_spans([t], crf)[0][1]]
    assert found('und token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" der') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert ("secret", "a9ce735683f9772d") in found("que password=a9ce735683f9772d avec")
    assert found("ring ana.12@example.com the") == [("email", "ana.12@example.com")]
    for clean in ("", "the thing is with that.", "Version 2.0.", "in 1999 , nothing", "page 12 of 300", "card 1234567812345678 the"):
        assert found(clean) == []


def test_field_on_held_out_rows(crf):
    rows = pii.labelled_rows(seed=99, count=145)
    want = {(i, s) for i, (_, spans) in enumerate(rows) for s in spans.split(",") if s and not s.startswith(("card", "email", "ip"))}
    got = {(i, pii.joined([s])) for i, (b, a) in enumerate(pii.find_spans([t for t, _ in rows], crf)) for s in a if s[0] not in ("card", "email", "ip")}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got)


def test_query_against_plain_patterns(spark, sf, docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op2_personal_data(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = slow_base(text[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r["spans"].split(",")) | {""}


def test_nulls_repeats_names_and_empty(make, crf):
    df = make([(1, None), (2, ""), (3, "+1 (555) 123-4567"), (3, "+1 (555) 123-4567"), (None, "é 1.2.3.4")])
    out = pii.find(df, crf)
    assert set(df.columns) <= set(out.columns)
    assert sorted((str(r["doc_id"]), pii.joined([tuple(s) for s in r["spans"]])) for r in out.collect()) == [("1", ""), ("2", ""), ("3", "phone:0:17"), ("3", "phone:0:17"), ("None", "ip:2:9")]
    assert pii.find(make([]), crf).count() == 0


def test_empty_labelled_table(spark):
    crf = pii.train(spark.createDataFrame([], "text string, spans string"))
    assert pii.find_spans(["password: abc123def456", "1.2.3.4"], crf) == [([], []), ([("ip", 0, 7)], [("ip", 0, 7)])]


def test_redact():
    assert pii.redact("ab 1.2.3.4 c", [("ip", 3, 10)]) == "ab <ip> c"
