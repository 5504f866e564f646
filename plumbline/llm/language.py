"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of sample text.  A text is
compressed with every dictionary, and the language whose dictionary gives the fewest
bytes is chosen; what it saves against the runner-up is the margin.  Only letters count:
case, digits and punctuation are taken out on both sides.  Long texts are compressed in
pieces, so that the dictionary matters to the last word, and the pieces' sizes added up.

The dictionaries are a bounded sample of labelled rows: of each language ``sample_docs``
documents in the order of a seeded hash, of each ``piece_chars`` characters from its
middle, ``dict_bytes`` at most together.  Whole texts are classified.

Nulls: a null text, or one without a letter, is ``und`` with score 0.  Rows without a
language teach nothing.  Of equally small languages the one with more labelled rows, then the first in code point
order, is chosen.  Without any sample every text is ``und``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, hidden

SAMPLE_DOCS = 200
PIECE_CHARS = 1000
DICT_BYTES = 112_640
#: Bytes compressed at a time.
PIECE_BYTES = 8192
LEVEL = 3
#: Where the first pass saves less than this share, a stronger level decides.
DOUBT, STRONG = 0.05, 12
#: Share of bytes that the best dictionary must save against the next.
MARGIN = 0.02
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str) -> bytes:
    """Lower-cased words, a blank between them."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


@dataclass
class Languages:
    dictionaries: dict[str, bytes]
    rows: dict[str, int]  # labelled rows of each language: of equally small ones the more frequent is chosen

    def classifier(self):
        """A function from a text to (language, score, margin)."""
        names = sorted(self.dictionaries, key=lambda x: (-self.rows.get(x, 0), x))

        def tools(level: int) -> list:
            out = []
            for name in names:
                d = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress)
            return out

        quick, strong = tools(LEVEL), tools(STRONG)

        def sizes_of(raw: bytes, compressors: list) -> list[int]:
            sizes = [0] * len(names)
            for i in range(0, len(raw), PIECE_BYTES):
                piece = raw[i : i + PIECE_BYTES]
                for k, compress in enumerate(compressors):
                    sizes[k] += len(compress(piece))
            return sizes

        def classify(text: str | None) -> tuple[str, float, float]:
            raw = letters(text) if text else b""
            if not raw or not names:
                return UNKNOWN, 0.0, 0.0
            sizes = sizes_of(raw, quick)
            if len(names) > 1 and (least := sorted(sizes))[1] - least[0] < DOUBT * least[1]:
                sizes = sizes_of(raw, strong)
            best = min(range(len(names)), key=lambda k: (sizes[k], k))
            if len(names) == 1:
                return names[best], 1.0, 1.0
            others = sorted(sizes)
            margin = (others[1] - others[0]) / others[1]
            # the share of the odds if every tenth byte saved made a language e times as likely
            odds = sum(2.718281828459045 ** (-(s - others[0]) / (0.1 * others[0] + 1) * 10) for s in others)
            return names[best], 1.0 / odds, margin

        return classify


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, where: Column | None = None, sample_docs: int = SAMPLE_DOCS, piece_chars: int = PIECE_CHARS, dict_bytes: int = DICT_BYTES) -> Languages:
    """Dictionaries from rows with a language for which ``where`` holds."""
    rows = docs if where is None else docs.where(where)
    rows = rows.where(col(lang).isNotNull() & F.rlike(col(text), F.lit(r"\p{L}")))
    slim = rows.select(col(lang).alias("lang"), F.xxhash64(F.lit(42), col(text)).alias("h"))
    # copies of one text count once; the rank limit holds in every task before the shuffle
    picked = slim.distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample_docs)
    picked = picked.select(F.col("lang").alias("l"), "h")
    texts = rows.select(col(lang).alias("lang"), F.xxhash64(F.lit(42), col(text)).alias("hash"), col(text).alias("t"))
    # at most sample_docs rows for each language
    texts = texts.join(F.broadcast(picked), (F.col("hash") == F.col("h")) & (F.col("lang") == F.col("l")))
    start = F.greatest(F.lit(1), ((F.length("t") - piece_chars) / 2).cast("int"))
    pieces = texts.select("lang", "hash", F.substring("t", start, F.lit(piece_chars)).alias("piece")).distinct()
    got: dict[str, list[tuple[int, bytes]]] = {}
    for r in pieces.collect():  # at most sample_docs short pieces for each language
        got.setdefault(r["lang"], []).append((r["hash"], letters(r["piece"])))
    frequent = {r["lang"]: r["count"] for r in rows.groupBy(col(lang).alias("lang")).count().collect()}  # a row for each language
    return Languages({name: b" ".join(p for _, p in sorted(parts))[-dict_bytes:] for name, parts in got.items()}, frequent)


def identify(docs: DataFrame, languages: Languages, text: str = "text", margin: float | None = MARGIN, name: str = "lang_pred") -> DataFrame:
    """``docs`` with the chosen language, a score from 0 to 1, the margin and whether it is narrow.

    With ``margin`` a text whose margin is narrower is rejected, as ``und``; with None the
    smallest is always named and ``narrow`` follows ``MARGIN``.
    """
    made, least = hidden(docs, "_made"), MARGIN if margin is None else margin

    @F.pandas_udf("lang string, score double, margin double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = languages.classifier()
        for texts in batches:
            yield pd.DataFrame([of(t) for t in texts], columns=["lang", "score", "margin"])

    out = docs.withColumn(made, run(col(text).cast("string")))
    drop = {name.lower(), "score", "margin", "narrow"}
    narrow = F.col(f"{made}.margin") < least
    pick = F.col(f"{made}.lang") if margin is None else F.when(narrow, F.lit(UNKNOWN)).otherwise(F.col(f"{made}.lang"))
    return out.select(
        *[col(c) for c in docs.columns if c.lower() not in drop],
        pick.alias(name), F.col(f"{made}.score").alias("score"), F.col(f"{made}.margin").alias("margin"), narrow.alias("narrow"),
    )
