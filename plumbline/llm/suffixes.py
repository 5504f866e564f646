"""Removing later copies of long strings by longest-previous-factor arrays.

A suffix array orders all suffixes; the nearest earlier starts above and below a suffix in
that order (its previous and next smaller positions) share the longest prefix with it that
any earlier start has, the longest previous factor.  Where that factor reaches ``length``
bytes, the bytes it covers are a later copy and go; the first copy stays.  Order and
comparison are cut at ``length`` bytes: suffixes equal that far form a run in the order of
their positions, so each but the first of a run has its previous smaller position right
above it, and no other suffix has a factor that long (``earlier_starts``).

The suffixes are dealt to tasks so that equal strings of ``length`` bytes meet.  Every
window of ``length`` bytes has a minimizer, its ``SEED``-byte string with the smallest
hash; consecutive windows with the same one form a run, which is one row: the seed's hash,
a hash of all bytes the run's windows cover, the place.  Then

1. runs that are equal throughout are later copies as a whole, all but the first;
2. of the others, only those whose seed stands in two different runs can share a window:
   their bytes are fetched, and suffixes of equal seed are sorted together in one task;
3. a seed with many different runs (``HEAVY`` in one block of text, ``GROUP`` in all) is
   cut further: its windows are compared one by one, by a 64-bit hash of all their bytes.

Every task first removes what repeats within its own block of text, so that a string that
a third of all documents hold reaches the shuffle once a block, not once a document.

The text is its UTF-8 bytes; matches never cross rows.  "Earlier" is a smaller key, or the
same key and a smaller start.  Nulls: a null text is empty, a null key comes first.  Rows
of the same key and text count as one document, and all get its result; rows of the same
key and other texts are ordered by a hash of the text.  Texts shorter than ``length`` keep
all their bytes, though they may not hold an earlier place.  An empty table gives an empty
result; other columns of the table are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, scratch_path

LENGTH = 100
SEED = 24
#: Bytes hashed at once, bytes within which a task compares runs, bytes whose suffixes are sorted at once.
CHUNK = 1 << 20
BLOCK = 1 << 24
SORTED = 1 << 20
HEAVY = 64
GROUP = 20_000

RUN, WINDOW, MARK, SPAN, SPLIT = range(5)
_ROW = "kind int, h long, hc long, key long, tie long, at long, n int"
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that orders like them; ``data`` has eight bytes more."""
    return np.ndarray((len(data) - 8,), ">u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    total = parts[0] * _FACTORS[0]
    for i, p in enumerate(parts[1:], 1):
        total = total + p * _FACTORS[i % len(_FACTORS)] + np.uint64(i)
    return _mix(total)


def _window_hash(mixed: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each place on, out of the mixed words of the text."""
    steps = [*range(0, length - 8, 8), length - 8]
    return _join([mixed[at + s] for s in steps])


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        v, step = np.minimum(v[:-step], v[step:]), step * 2
    return np.minimum(v[: len(v) - (width - step)], v[width - step :]) if step < width else v


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, first window, windows after it, seed hash, run hash) of all windows in the texts that end at ``ends``."""
    found = []
    starts = np.append(0, ends[:-1])
    for c in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[c : c + CHUNK + length - 1]
        mixed = _mix(_words(np.append(part, np.zeros(8, np.uint8))))
        seeds = len(part) - SEED + 1
        seed = _join([mixed[s : s + seeds] for s in range(0, SEED, 8)])
        place = np.uint64(len(part).bit_length())
        ranked = (seed >> place) << place | np.arange(seeds, dtype=np.uint64)
        own = (_smallest(ranked, length - SEED + 1) & np.uint64((1 << int(place)) - 1)).astype(np.int64)
        # windows that lie within one text
        docs = np.arange(np.searchsorted(ends, c, "right"), np.searchsorted(starts, c + len(own), "left"))
        lo, hi = np.maximum(starts[docs], c) - c, np.minimum(ends[docs] - length + 1, c + len(own)) - c
        held = np.maximum(0, hi - lo)
        doc = np.repeat(docs, held)
        window = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(lo, held)
        if not len(window):
            continue
        anchor = own[window]
        new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(doc) != 0)) + 1
        first, last = np.append(0, new), np.append(new, len(window)) - 1
        a, b = window[first], window[last]
        whole = _join([_window_hash(mixed, a, length), _window_hash(mixed, b, length), (b - a).astype(np.uint64)])
        found.append((doc[first], a + c - starts[doc[first]], b - a, seed[anchor[first]], whole))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def earlier_starts(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each of the ``starts`` the number of an earlier one (its previous smaller position) whose longest previous factor reaches ``length``, or -1.

    Positions are the order in which the starts are given.  The suffix order comes from
    ranks of ever longer prefixes: two or three ranks together rank a prefix as many times as long.
    """
    padded = np.append(data, np.zeros(length + 8, np.uint8))
    values, size, everywhere = _words(padded), 8, np.arange(len(data))
    while True:
        _, rank = np.unique(values, return_inverse=True)
        if size == length:
            break
        n = int(rank.max()) + 1
        parts = 3 if n < 1 << 21 else 2
        reach = min(length, size * parts)
        offsets = sorted({min(i * size, reach - size) for i in range(parts)})
        at = starts if reach == length else everywhere
        rank = np.append(rank, np.zeros(length, rank.dtype))
        values = np.zeros(len(at), np.uint64)
        for o in offsets:
            values = values * np.uint64(n) + rank[at + o].astype(np.uint64)
        size = reach
    order = np.argsort(rank, kind="stable")
    same = rank[order[1:]] == rank[order[:-1]]
    out = np.full(len(starts), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def merged(at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of those given, in order."""
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate(end[order]) if len(at) else end
    if not len(at):
        return at, end
    new = np.append(True, at[1:] > end[:-1])
    return at[new], np.append(end[:-1][new[1:]], end[-1])


def _rows(kind, h, hc, key, tie, at, n) -> pa.RecordBatch:
    h, hc = (np.asarray(x).astype(np.uint64).view(np.int64) for x in (h, hc))
    size = len(h)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(x, size).astype(t)) for x, t in zip((kind, h, hc, key, tie, at, n), (np.int32, np.int64, np.int64, np.int64, np.int64, np.int64, np.int32))],
        ["kind", "h", "hc", "key", "tie", "at", "n"],
    )


def _later(*keys: np.ndarray, name: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by all keys; which are the first of their first ``name`` keys, and which stand behind it."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, np.empty(0, bool), np.empty(0, bool)
    differs = [np.append(True, k[order][1:] != k[order][:-1]) for k in keys]
    first = np.logical_or.reduce(differs[:name])
    top = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    behind = np.logical_or.reduce([k[order] != k[order][top] for k in keys[name:]])
    return order, first, behind


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[edges[0] : edges[-1]], edges[1:] - edges[0]


def _survey(length: int):
    """Texts to rows of ``_ROW``: the runs that are the first of their kind within a block, and spans that repeat within it."""

    def block(data, ends, key, tie, skip):
        doc, at, more, h, hc = runs(data, ends, length)
        k, t = key[doc], tie[doc]
        # the first text of the block may be the rest of one that the last block began
        place = at + np.where(doc == 0, skip, 0)
        order, first, behind = _later(h, hc, k, t, place, name=2)
        cut = order[behind]
        spans = [(k[cut], t[cut], place[cut], place[cut] + more[cut] + length)]
        one = order[first]
        seeds, which, counts = np.unique(h[one], return_inverse=True, return_counts=True)
        heavy = counts[which] >= HEAVY
        if heavy.any():
            hot = one[heavy]
            width = more[hot] + 1
            owner = np.repeat(hot, width)
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            start = np.append(0, ends)[doc[owner]] + at[owner] + step
            mixed = lambda p: _mix(_words_at(data, p))
            w = _join([mixed(start + s) for s in [*range(0, length - 8, 8), length - 8]])
            o, f, b = _later(w, k[owner], t[owner], place[owner] + step, name=1)
            p = (place[owner] + step)[o]
            yield _rows(WINDOW, w[o][f], np.zeros(f.sum()), k[owner][o][f], t[owner][o][f], p[f], 0)
            yield _rows(MARK, seeds[counts >= HEAVY], np.zeros((counts >= HEAVY).sum()), 0, 0, 0, 0)
            spans.append((k[owner][o][b], t[owner][o][b], p[b], p[b] + length))
            one = one[~heavy]
        yield _rows(RUN, h[one], hc[one], k[one], t[one], place[one], more[one])
        sk, st, sa, se = (np.concatenate(x) for x in zip(*spans))
        order = np.lexsort((sa, st, sk))
        sk, st, sa, se = sk[order], st[order], sa[order], se[order]
        if len(sk):
            other = np.append(True, (np.diff(sk) != 0) | (np.diff(st) != 0))
            # spans that touch are one; each document by itself
            shift = np.cumsum(other) * (np.int64(1) << 32)
            a, e = merged(sa + shift, se + shift)
            i = np.searchsorted(sa + shift, a)
            yield _rows(SPAN, _mix(sk[i].view(np.uint64) + a.astype(np.uint64)), np.zeros(len(i)), sk[i], st[i], sa[i], e - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, ends = _binary(batch.column(2))
            for c in range(0, len(data), BLOCK):
                d0, d1 = np.searchsorted(ends, c, "right"), np.searchsorted(ends, min(len(data), c + BLOCK), "left") + 1
                stop = min(len(data), c + BLOCK + length - 1, ends[d1 - 1])
                own = np.minimum(ends[d0:d1], stop) - c
                yield from block(data[c:stop], own, key[d0:d1], tie[d0:d1], c - (ends[d0 - 1] if d0 else 0))

    return run


def _words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[at + i].astype(np.uint64)
    return out


def _fetch(length: int):
    """Rows (key, tie, text, wanted) to (kind, h, key, tie, at, bytes): bytes of runs, or hashes of the windows of runs to split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, tie, text, wanted in zip(*(batch.column(i) for i in range(4))):
                data = text.as_py()
                flat = np.frombuffer(data, np.uint8)
                rows: dict = {"kind": [], "h": [], "key": [], "tie": [], "at": [], "bytes": []}
                for w in wanted.as_py():
                    at, n = w["at"], w["n"]
                    if w["kind"] == RUN:
                        found = [(RUN, w["h"], at, data[at : at + n + length])]
                    else:
                        start = np.arange(at, at + n + 1)
                        h = _join([_mix(_words_at(flat, start + s)) for s in [*range(0, length - 8, 8), length - 8]])
                        found = [(WINDOW, x, a, None) for x, a in zip(h.view(np.int64).tolist(), start.tolist())]
                    for kind, h, a, b in found:
                        for name, x in zip(rows, (kind, h, key.as_py(), tie.as_py(), a, b)):
                            rows[name].append(x)
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("key", pa.int64()), ("tie", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())]))

    return run


def _resolve(length: int):
    """Runs (h, key, tie, at, bytes) in the order of ``h`` to spans (key, tie, at, n) that have an earlier copy."""

    def spans(h, key, tie, at, data, ends) -> pa.RecordBatch:
        order = np.lexsort((at, tie, key))
        starts = np.append(0, ends[:-1])
        windows = (ends - starts - length + 1)[order]
        run = np.repeat(order, windows)
        step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        gone = np.flatnonzero(earlier_starts(data, starts[run] + step, length) >= 0)
        new = np.append(True, (np.diff(gone) != 1) | (np.diff(run[gone]) != 0)) if len(gone) else np.empty(0, bool)
        first, last = gone[new], gone[np.append(new[1:], True)] if len(gone) else gone
        r = run[first]
        return pa.RecordBatch.from_pydict({"key": key[r], "tie": tie[r], "at": at[r] + step[first], "n": (step[last] - step[first] + length).astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            cols = [table.column(i).to_numpy() for i in range(4)]
            return spans(*cols, *_binary(table.column(4).chunk(0)))

        for batch in batches:
            at = 0
            h = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = np.cumsum(_binary(batch.column(4))[1]) if not len(h) else _binary(batch.column(4))[1]
            while at < len(h):
                have = sum(int(_binary(b.column(4))[1][-1]) for b in held)
                base = int(sizes[at - 1]) if at else 0
                # as many rows as fill a sort, then on to the end of the seed's rows
                stop = int(np.searchsorted(sizes, base + max(0, SORTED - have), "left")) + 1
                stop = min(max(stop, at + 1), len(h))
                stop = int(np.searchsorted(h[stop - 1 :], h[stop - 1], "right")) + stop - 1
                held.append(batch.slice(at, stop - at))
                at = stop
                if at < len(h):
                    yield flush(held)
                    held = []
            # the last seed may go on in the next batch
            if held and sum(b.num_rows for b in held) and sum(int(_binary(b.column(4))[1][-1]) for b in held) >= SORTED:
                tail = held[-1].column(0).to_numpy(zero_copy_only=False)
                whole = int(np.searchsorted(tail, tail[-1], "left"))
                rest = held[-1].slice(whole)
                if whole:
                    yield flush([*held[:-1], held[-1].slice(0, whole)])
                    held = [rest]
        if held:
            yield flush(held)

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) to (id, n_bytes, spans merged, kept)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        ids, texts, spans = (batch.column(i) for i in range(3))
        sizes, out, kept = [], [], []
        for text, given in zip(texts, spans.to_pylist()):
            data = text.as_py()
            sizes.append(len(data))
            if not given:
                out.append([])
                kept.append(data)
                continue
            at, end = merged(*np.array([(s["at"], s["at"] + s["n"]) for s in given], np.int64).T)
            edges = list(zip(at.tolist(), end.tolist()))
            out.append([{"start": a, "end": e} for a, e in edges])
            kept.append(b"".join(data[e:a] for e, a in zip([0, *end.tolist()], [*at.tolist(), len(data)])))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def first_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, spans, kept) of every row: the byte spans (start, end) that go, and the bytes that stay.

    ``key`` is any whole number.  ``kept`` is binary, as a span may begin within a character.
    """
    if length < SEED + 8:
        raise ValueError(f"length must be at least {SEED + 8}")
    spark = docs.sparkSession
    body = F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(col(key).alias("id"), F.coalesce(col(key).cast("long"), least).alias("key"), F.xxhash64(body).alias("tie"), body.alias("text"))
    seen = rows.select("key", "tie", "text").mapInArrow(_survey(length), _ROW)
    # which runs are copies, and which share a seed with another run
    side = F.when(F.col("kind").isin(RUN, MARK), RUN).otherwise(F.col("kind"))
    seen = seen.withColumns({"side": side, "hc": F.when(F.col("kind") == RUN, F.col("hc")), "place": F.struct("key", "tie", "at")})
    seed = Window.partitionBy("side", "h")
    same = Window.partitionBy("side", "h", "hc")
    judged = seen.select(
        "*",
        (F.min("hc").over(seed) < F.max("hc").over(seed)).alias("several"),
        (F.max("kind").over(seed) == MARK).alias("marked"),
        (F.count(F.lit(1)).over(seed) > GROUP).alias("large"),
        F.min("place").over(same).alias("first"),
    )
    run, again = F.col("kind") == RUN, F.col("place") > F.col("first")
    open_ = F.coalesce(F.col("several"), F.lit(False)) | F.col("marked")
    judged = judged.where(F.col("kind").isin(WINDOW, SPAN) | (run & (again | open_)))
    path = scratch_path(spark, "runs")
    judged.select(
        F.when(run & again, SPAN).when(run & (F.col("marked") | F.col("large")), SPLIT).otherwise(F.col("kind")).alias("kind"),
        F.when(run & again, 0).otherwise(F.col("h")).alias("h"),
        "key",
        "tie",
        "at",
        F.when(run & again, F.col("n") + length).otherwise(F.col("n")).alias("n"),
    ).write.parquet(path)
    known = spark.read.parquet(path)
    # bytes of the runs that have to be compared
    wanted = known.where(F.col("kind").isin(RUN, SPLIT)).groupBy("key", "tie").agg(F.collect_list(F.struct("kind", "h", "at", "n")).alias("wanted"))
    texts = rows.select("key", "tie", "text").dropDuplicates(["key", "tie"])
    path = scratch_path(spark, "open")
    texts.join(wanted, ["key", "tie"]).select("key", "tie", "text", "wanted").mapInArrow(
        _fetch(length), "kind int, h long, key long, tie long, at long, bytes binary"
    ).write.parquet(path)
    fetched = spark.read.parquet(path)
    by_seed = fetched.where(F.col("kind") == RUN).select("h", "key", "tie", "at", "bytes").repartition("h").sortWithinPartitions("h")
    sorted_ = by_seed.mapInArrow(_resolve(length), "key long, tie long, at long, n int")
    windows = known.where(F.col("kind") == WINDOW).select("h", "key", "tie", "at").union(fetched.where(F.col("kind") == WINDOW).select("h", "key", "tie", "at"))
    place = F.struct("key", "tie", "at")
    windows = windows.withColumn("first", F.min(place).over(Window.partitionBy("h"))).where(place > F.col("first"))
    spans = known.where(F.col("kind") == SPAN).select("key", "tie", "at", "n").union(sorted_).union(windows.select("key", "tie", "at", F.lit(length)))
    spans = spans.groupBy("key", "tie").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    kind = dict(rows.dtypes)["id"]
    joined = rows.join(spans, ["key", "tie"], "left").select("id", "text", "spans")
    out = joined.mapInArrow(_apply, f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", key)
