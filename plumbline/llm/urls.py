"""URL rules by host-suffix and path-prefix expressions.

A rule is kept under its anchor: the host and the path up to its last slash.  A URL is
expanded into the expressions (host suffix, path prefix ending in a slash) that a rule
could be kept under; both sides are joined on the first four bytes of the expression's
SHA-256, then the whole digest is compared and the rest of the rule's path checked.
The longest rule that fits decides.  Hosts and paths are counted together before the
join, so that a hot URL is looked up once.  All steps are built-in functions.

Nulls: a null URL, and one without ``://``, has an empty host and an empty path, and no
rule with a host fits it.  Repeated rows give one row each.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, hidden


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    raw = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, prefix: Column) -> Column:
    # a length before the host keeps (host, prefix) pairs apart
    return F.sha2(F.concat(F.octet_length(host).cast("string"), F.lit(":"), host, prefix), 256)


def _anchor(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?s:(.*/)?)", 1)


def prepared(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their anchor, digest and length; null parts are empty, equal rules count once."""
    r = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    # of equal rules with other verdicts "block" stands
    r = r.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    anchor = _anchor(F.col("rule_path"))
    return r.withColumns(
        {
            "anchor_digest": _digest(F.col("rule_host"), anchor),
            "labels": F.size(F.split("rule_host", r"\.")),
            "slashes": F.length("rule_path") - F.length(F.replace(F.col("rule_path"), F.lit("/"), F.lit(""))),
        }
    )


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Array of (host suffix, path prefix): suffixes of up to ``labels`` labels, prefixes of up to ``slashes`` slashes and none."""
    parts = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, labels)))), lambda n: F.array_join(F.slice(parts, -n, n), ".")
    )
    steps = F.split(path, "/")
    ends = F.transform(
        F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(slashes))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, F.greatest(n, F.lit(1))), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(hosts, lambda h: F.transform(ends, lambda p: F.struct(h.alias("h"), p.alias("p")))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule that decides, or null) and ``verdict``.

    ``rules`` has host, path and verdict (``allow`` or ``block``).  A rule fits its host
    and all subdomains if the path starts with the rule's.  The longest fitting rule
    wins, of equally long ones the one with the longer host.  Without one the verdict is
    ``default``.  Columns of ``pages`` with the names of results are replaced.
    """
    known = prepared(rules)
    # exact: no rule is kept under a longer expression
    most = known.agg(F.max("labels"), F.max("slashes")).first()
    rows = pages.withColumns({"host": host_of(col(url).cast("string")), "path": path_of(col(url).cast("string"))})
    tried = rows.select("host", "path").distinct()
    tried = tried.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), most[0] or 1, most[1] or 0)).alias("e"))
    tried = tried.withColumn("digest", _digest(F.col("e.h"), F.col("e.p")))
    short = lambda c: F.substring(c, 1, 8)  # noqa: E731  four bytes in hex
    met = tried.join(known, short(F.col("digest")) == short(F.col("anchor_digest")))
    met = met.where((F.col("digest") == F.col("anchor_digest")) & F.startswith("path", "rule_path"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"
    )
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    b = hidden(pages, "_best")
    out = rows.join(best.select("host", "path", F.col("best").alias(b)), ["host", "path"], "left")
    keep = [col(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return out.select(*keep, "host", "path", F.col(f"{b}.rule").alias("rule"), F.coalesce(F.col(f"{b}.rule_verdict"), F.lit(default)).alias("verdict"))
