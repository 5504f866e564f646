"""Personal data: exact patterns, and a conditional random field for what they miss.

Four patterns find e-mail addresses, IPv4 addresses, payment cards and international
phone numbers in whole texts.  A linear-chain CRF over word-shape features then labels
the words around places that hold a digit, an ``@`` or a word such as ``token``, and adds
spans that no pattern covers: secrets after a key word, numbers of other make, spelt-out
addresses.  It is trained in the driver from a small labelled table, which is a
parameter.  Words elsewhere are outside by definition of the model: only those windows
can hold a label.  Windows of a batch of texts are decoded together by Viterbi in numpy.

What looks like a card or an IPv4 address but fails its check is not added back, nor an
address without any form of ``@``, nor a secret without a digit.  The
patterns are applied so that no text, however long a run of digits or letters it holds,
takes more than linear time.

Nulls: a null text is empty and has no span.  Repeated rows give one row each.  An empty
table gives an empty result; an empty labelled table leaves the patterns alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import col, hidden

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans of one start are listed.
KINDS = BASE + ("secret", "id")

# The four patterns, with a look behind that only saves time: a number
# that does not match from its first digit does not match from a later one.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in s.split("."))


def card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four patterns, by start and then kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if ip_ok(m.group())]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and card_ok(m.group())]
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- the conditional random field ---------------------------------------------------

_BLANK = re.compile(r"[ \n]")
_TOKEN = re.compile(r"[^\s=:|,;\"'<>{}]+|[=:|,;\"'<>{}]")
_TRIGGER = re.compile(r"[0-9@]|\b(?:token|password|passwd|secret|api[_-]?key)\b|[\[(]at[\])]", re.I)
_AT = re.compile(r"@|[\[(]at[\])]", re.I)
_EDGE = "\"'()[]{}<>,.;:!?%*#&$|"
#: Words on either side of a trigger that are decoded with it.
REACH = 4
_CUES = frozenset("token password passwd pwd secret key api_key apikey access auth bearer ssn iban passport tel phone call mobile fax mail email card ip host version page no".split())
LABELS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits become ``X``, ``x`` and ``d``."""
    s = re.sub(r"[0-9]+", "d", re.sub(r"[^\W\d_]+", lambda m: "X" if m.group().isupper() else "x" if m.group().islower() else "Xx", token))
    # mixtures such as hexadecimal digits are one shape, whatever their order
    return "mix" if len(s) > 4 and not re.search(r"[^Xxd]", s) else s[:12]


def token_features(tokens: list[str]) -> list[list[str]]:
    """Features of each token of a window: its own shape, length and cues, and its neighbours'."""
    own = []
    for t in tokens:
        core = t.strip(_EDGE)
        digits = sum(c.isdigit() for c in core)
        low = core.lower()
        own.append(
            (
                shape(core) if core else t,
                low if low in _CUES else "",
                f"n{min(len(core), 6) if len(core) < 6 else 6 + min(len(core) // 8, 4)}",
                f"d{min(digits, 3) if digits < 3 else 3 + min(digits // 3, 4)}",
            )
        )
    out = []
    for i, (s, cue, n, d) in enumerate(own):
        f = ["1", f"s={s}", f"{n}", f"{d}", f"{n}{d}", f"s={s},{n}"] + ([f"cue={cue}"] if cue else [])
        for step in (-3, -2, -1, 1, 2):
            j = i + step
            if 0 <= j < len(own):
                if own[j][1]:
                    f += [f"{step}cue={own[j][1]}", f"{step}cue={own[j][1]},{n}"]
                if abs(step) == 1:
                    f += [f"{step}s={own[j][0]}", f"{step}s={own[j][0]},s={s}"]
            elif abs(step) == 1:
                f.append(f"{step}edge")
        out.append(f)
    return out


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token spans within ``REACH`` tokens of a trigger, neighbouring windows joined."""
    out: list[list[tuple[int, int]]] = []
    end, blanks = 0, None
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        # REACH tokens before and behind, counted by the blanks and line ends between them
        if blanks is None:
            blanks = [x.start() for x in _BLANK.finditer(text)]
        i, j = bisect_left(blanks, m.start()) - REACH - 1, bisect_right(blanks, m.end()) + REACH
        a = blanks[i] if i >= 0 else 0
        b = blanks[j] if j < len(blanks) else len(text)
        spans = [t.span() for t in _TOKEN.finditer(text, max(a, end), b)]
        if out and a <= end:
            out[-1] += spans
        elif spans:
            out.append(spans)
        end = b
    return out


@dataclass
class Crf:
    names: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LABELS))))
    move: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))

    def scores(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        for i, fs in enumerate(token_features(tokens)):
            ids = [self.names[f] for f in fs if f in self.names]
            if ids:
                out[i] = self.emit[ids].sum(axis=0)
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence of scores; sequences of like length go through Viterbi together."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        for start in range(0, len(order), 256):
            part = [i for i in order[start : start + 256] if len(sequences[i])]
            if not part:
                continue
            longest = max(len(sequences[i]) for i in part)
            e = np.zeros((len(part), longest, len(LABELS)))
            for r, i in enumerate(part):
                e[r, : len(sequences[i])] = sequences[i]
            best, back = e[:, 0] + _START, np.zeros((len(part), longest, len(LABELS)), np.int8)
            ends = {len(sequences[i]) for i in part}
            last = {1: best}
            for t in range(1, longest):
                all_ = best[:, :, None] + self.move[None] + _ALLOWED[None]
                back[:, t] = all_.argmax(axis=1)
                best = all_.max(axis=1) + e[:, t]
                if t + 1 in ends:
                    last[t + 1] = best
            for r, i in enumerate(part):
                n = len(sequences[i])
                path = np.empty(n, np.int64)
                path[-1] = last[n][r].argmax()
                for t in range(n - 1, 0, -1):
                    path[t - 1] = back[r, t, path[t]]
                out[i] = path
        return out


_NEVER = -1e4
_ALLOWED = np.array([[_NEVER if b.startswith("I-") and a[1:] != b[1:] else 0.0 for b in LABELS] for a in LABELS])
_START = np.array([_NEVER if b.startswith("I-") else 0.0 for b in LABELS])


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(labelled: DataFrame, steps: int = 70, rate: float = 0.2, l2: float = 1e-3) -> Crf:
    """The CRF of a small labelled table: text, and spans as ``kind:start:end`` joined by commas.

    The table is read into the driver; it is meant to hold hundreds of rows.
    """
    rows = sorted((r["text"], r["spans"] or "") for r in labelled.select("text", "spans").where("text is not null").collect())
    names: dict[str, int] = {}
    data = []
    for text, spans in rows:
        marks = [(k, int(a), int(b)) for k, a, b in (s.rsplit(":", 2) for s in spans.split(",") if s)]
        places = [m.span() for m in _TOKEN.finditer(text)]
        if not places:
            continue
        y = []
        for a, b in places:
            hit = next(((k, s) for k, s, e in marks if a < e and s < b), None)
            before = next(((k, s) for k, s, e in marks if y and places[len(y) - 1][0] < e and s < places[len(y) - 1][1]), None)
            y.append(0 if hit is None else LABELS.index(("I-" if hit == before else "B-") + hit[0]))
        x = [[names.setdefault(f, len(names)) for f in fs] for fs in token_features([text[a:b] for a, b in places])]
        data.append((x, np.array(y)))
    if not data:
        return Crf()
    # all rows at once, padded to the longest; (row, place) of each feature
    n, size, k = np.array([len(y) for _, y in data]), len(data), len(LABELS)
    longest = int(n.max())
    cell = np.array([r * longest + i for r, (x, _) in enumerate(data) for i, fs in enumerate(x) for _ in fs])
    feat = np.array([f for x, _ in data for fs in x for f in fs])
    gold = np.zeros((size, longest), np.int64)
    for r, (_, y) in enumerate(data):
        gold[r, : len(y)] = y
    real = np.arange(longest)[None] < n[:, None]
    want = np.eye(k)[gold] * real[..., None]
    both = real[:, 1:]  # transitions
    want_move = np.zeros((k, k))
    np.add.at(want_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    moments = [(np.zeros_like(emit), np.zeros_like(emit)), (np.zeros_like(move), np.zeros_like(move))]
    for t in range(1, steps + 1):
        e = np.zeros((size * longest, k))
        np.add.at(e, cell, emit[feat])
        e = e.reshape(size, longest, k)
        step = move + _ALLOWED
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + _START
        for i in range(1, longest):
            fwd[:, i] = _logsum(fwd[:, i - 1, :, None] + step, 1) + e[:, i]
        for i in range(longest - 2, -1, -1):
            nxt = _logsum(step + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            bwd[:, i] = np.where(real[:, i + 1, None], nxt, 0.0)
        z = _logsum(fwd[np.arange(size), n - 1], 1)[:, None, None]
        off = np.exp(np.minimum(fwd + bwd - z, 0)) * real[..., None] - want
        ge = np.zeros_like(emit)
        np.add.at(ge, feat, off.reshape(-1, k)[cell])
        pair = np.minimum(fwd[:, :-1, :, None] + step + (e + bwd)[:, 1:, None, :] - z[..., None], 0)
        gm = (np.exp(pair) * both[..., None, None]).sum(axis=(0, 1)) - want_move
        for w, g, (m, v) in zip((emit, move), (ge / size + l2 * emit, gm / size + l2 * move), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf(names, emit, move)


def labelled_rows(seed: int = 42, count: int = 240) -> list[tuple[str, str]]:
    """(text, spans) of a small labelled table, made from patterns by rule.

    Each row has filler words of several languages around one piece of personal data, a
    secret, or something that only looks like one.
    """
    rnd = random.Random(seed)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    name = lambda: rnd.choice(("ana", "jo.li", "max", "eva_k", "tom.b", "lea"))
    host = lambda: rnd.choice(("example", "mail3.example", "post", "web-host"))
    filler = "the of and is with Haus der und nicht ist pour dans les une avec que los para como más Este When thing, time. place; over: from".split()
    makers = (
        ("email", "{}", lambda: f"{name()}{digits(2)}@{host()}.com"),
        ("email", "mail {}", lambda: f"{name()} [at] {host()} [dot] org"),
        ("email", "{}", lambda: f"{name()} (at) {host()}.net"),
        ("ip", "ip {}", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4))),
        ("card", "{}", lambda: digits(16)),
        ("card", "card {}", lambda: " ".join(digits(4) for _ in range(4))),
        ("phone", "{}", lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", "tel {}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", "call {}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        ("secret", 'token = "{}"', lambda: hexes(40)),
        ("secret", "token: {}", lambda: hexes(32)),
        ("secret", "password={}", lambda: hexes(rnd.choice((8, 12, 20)))),
        ("secret", "password: {}", lambda: mixed(12)),
        ("secret", "secret = {}", lambda: mixed(24)),
        ("secret", 'api_key = "{}"', lambda: mixed(32)),
        ("secret", "{}", lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))),
        ("id", "ssn {}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        (None, "version {}.", lambda: digits(1)),
        (None, "Version {}.", lambda: f"{rnd.randrange(9)}.{rnd.randrange(9)}"),
        (None, "in {} ,", lambda: str(rnd.randrange(1900, 2030))),
        (None, "on {}", lambda: f"{rnd.randrange(2000, 2030)}-{rnd.randrange(10, 13)}-{rnd.randrange(10, 29)}"),
        (None, "page {} of", lambda: digits(3)),
        (None, "{} times", lambda: digits(rnd.choice((1, 2, 4, 5)))),
        (None, "about {}%", lambda: digits(2)),
        (None, "costs {} euro", lambda: f"{digits(2)}.{digits(2)}"),
        (None, "at {} h", lambda: f"{rnd.randrange(10, 24)}:{rnd.randrange(10, 60)}"),
        (None, "the {} was", lambda: rnd.choice(("token", "password", "secret", "key"))),
        (None, "no {}", lambda: digits(8)),
        (None, "build {} of", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}"),
    )
    out = []
    for i in range(count):
        kind, frame, make = makers[i % len(makers)]
        words = lambda: " ".join(rnd.choice(filler) for _ in range(rnd.randrange(5)))
        value = make()
        before = f"{words()} {frame.split('{}')[0]}".lstrip()
        text = f"{before}{value}{frame.split('{}')[1]}{rnd.choice(('', '', '.', ',', '###', '%%%', '!!'))} {words()}".rstrip()
        out.append((text, f"{kind}:{len(before)}:{len(before) + len(value)}" if kind else ""))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "text string, spans string")


def added_spans(text: str, base: list[tuple[str, int, int]], spans: list[tuple[int, int]], path: np.ndarray) -> list[tuple[str, int, int]]:
    """The spans of a decoded window that no pattern's span touches."""
    out, i = [], 0
    while i < len(path):
        label = LABELS[path[i]]
        if not label.startswith("B-"):
            i += 1
            continue
        j = i + 1
        while j < len(path) and LABELS[path[j]] == "I-" + label[2:]:
            j += 1
        a, b = spans[i][0], spans[j - 1][1]
        while a < b and text[a] in _EDGE and text[a] != "(":
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        kind, s = label[2:], text[a:b]
        sound = {"ip": lambda: bool(_IP.fullmatch(s)) and ip_ok(s), "card": lambda: card_ok(s), "email": lambda: bool(_AT.search(s)), "secret": lambda: bool(_DIGIT.search(s))}.get(kind, lambda: True)()
        if b - a > 3 and sound and not any(x < b and a < y for _, x, y in base):
            out.append((kind, a, b))
        i = j
    return out


def find_spans(texts: list[str | None], crf: Crf) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text; the windows of all texts are decoded together."""
    bases = [base_spans(t) if t else [] for t in texts]
    jobs, scores = [], []
    for i, t in enumerate(texts):
        if t and crf.names:
            for w in windows(t):
                jobs.append((i, w))
                scores.append(crf.scores([t[a:b] for a, b in w]))
    more: list[list] = [[] for _ in texts]
    for (i, w), path in zip(jobs, crf.decode(scores)):
        if path.any():
            more[i] += added_spans(texts[i], bases[i], w, path)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return [(b, sorted(set(b) | set(m), key=order)) for b, m in zip(bases, more)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, crf: Crf, text: str = "text", base: str = "base_spans", name: str = "spans") -> DataFrame:
    """``docs`` with two arrays of (kind, start, end): the patterns' spans, and all spans.

    Positions are code points, ends exclusive, ordered by start and then by kind.
    """
    span = "array<struct<kind:string,start:int,end:int>>"
    made = hidden(docs, "_made")

    @F.pandas_udf(f"base {span}, spans {span}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for texts in batches:
            texts, base_out, all_out = list(texts), [], []
            for i in range(0, len(texts), 512):
                for b, s in find_spans(texts[i : i + 512], crf):
                    base_out.append(as_rows(b))
                    all_out.append(as_rows(s))
            yield pd.DataFrame({"base": base_out, "spans": all_out})

    out = docs.withColumn(made, run(col(text).cast("string")))
    keep = [col(c) for c in docs.columns if c.lower() not in (base.lower(), name.lower())]
    return out.select(*keep, F.col(f"{made}.base").alias(base), F.col(f"{made}.spans").alias(name))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join(out) + text[at:]


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
