"""One query for each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import audit, decontaminate, language, licenses, manifest, mixing, neighbours, pii, sharding, simhash, suffixes, toxicity, urls
from plumbline.llm.common import cut, fold_of, table

Query = Callable[[SparkSession, str], DataFrame]

WEIGHTS = (5, 2, 1)
SHARDS = 8
RULES = "select * from values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block') as t(host, path, verdict)"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = cut(docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("words"), F.xxhash64("text").alias("mark")))
    out = mixing.mix(slim, mixing.cycle(WEIGHTS), F.col("words"), F.array("source"), key=[F.col("doc_id"), F.col("mark"), F.col("source")])
    return out.select("doc_id", "size", F.element_at("source_sizes", 1).alias("source_size"), F.element_at("targets", 1).alias("target"), "taken", "source")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(pii.labelled_table(spark))).drop("text")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("long") for k in pii.BASE]
    counts = [(F.size("base_spans") - n).alias(f"n_{k}") for n, k in zip(counts, pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).drop("text")
    items = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item"])))
    return found.select(
        "doc_id", (F.size("found") > 0).alias("contaminated"), items.alias("items"), F.array_min(F.transform("found", lambda x: x["edits"])).alias("least_edits")
    )


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.registry(spark))
    return out.select("doc_id", "digest", "license_id", F.array_join("line_licenses", ",").alias("line_licenses"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = fold_of(F.col("doc_id"), 5)
    model = language.learn(docs, where=fold != 0)
    out = language.identify(docs.drop("lang"), model, margin=None)
    return out.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "margin", "narrow")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), spark.sql(RULES)).drop("url")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of(F.col("doc_id"), 3)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=fold != 1)
    out = toxicity.score(docs, model)
    places = F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"), places.alias("offending"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return manifest.audit_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, {"text": low})


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.first_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_mix_sources, op2_personal_data, op3_decontaminate, op4_neighbours, op5_shards, op6_simhash, op7_licenses, op8_language, op9_url_filter, op10_toxicity,
    op11_merkle_manifest, op12_filter_audit, op13_first_copies,
)}

# a line goes if it opens with a sign or a reservation, or if the word after its "copyright" names someone or a year
_NEXT_WORD = r"regexp_extract(x, '^[^\p{L}\p{N}]*(?:portions )?copyrights?[^\p{L}\p{N}]+([\p{L}\p{N}]+)', 1)"
_STATES = (
    r"regexp_matches(x, '^[^\p{L}\p{N}]*(\(c\)|©|all rights reserved)') or (" + _NEXT_WORD + " <> '' and " + _NEXT_WORD
    + " not in ('notice', 'notices', 'holder', 'holders', 'owner', 'owners', 'law', 'laws', 'statement', 'statements', 'license', 'licenses', 'licence', 'licences', "
    "'interest', 'interests', 'protection', 'and', 'or', 'in', 'is', 'to', 'as', 'are'))"
)
_LINES = "string_split(replace(replace(lower(coalesce({0}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
_SPELLED = "' ' || regexp_replace(array_to_string(list_transform(" + _LINES + ", lambda x: case when " + _STATES.replace("{", "{{").replace("}", "}}") + " then ' ' else x end), chr(10)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"


def _canonical(x: str) -> str:
    out = f"regexp_replace({_SPELLED.format(x)}, ' +', ' ', 'g')"
    for written, meant in licenses.SPELLINGS:
        out = f"replace({out}, ' {written} ', ' {meant} ')"
    return f"trim({out})"


def _license_sql() -> str:
    known = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licenses.KNOWN)
    return (
        f"with known as (select c, min(n) as n from (select n, {_canonical('t')} as c from (values {known}) k(n, t)) group by c), "
        f"own as (select distinct text from documents where text is not null), "
        f"lines as (select text, {_canonical('line')} as c from (select text, unnest(string_split_regex(text, '\\r\\n|[\\r\\n]')) as line from own)), "
        "stated as (select text, string_agg(distinct n, ',' order by n) as line_licenses from lines join known using (c) group by text), "
        f"whole as (select doc_id, text, {_canonical('text')} as c from documents) "
        "select doc_id, sha256(c) as digest, n as license_id, coalesce(line_licenses, '') as line_licenses from whole left join known using (c) left join stated using (text)"
    )


# a rule fits its host and all subdomains if the path starts with the rule's; the longest fits best
_URL_SQL = r"""
with p as (select page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages)
select page_id, host, path,
    case when is_www then 'www.example.com/en/' when is_example then 'example.com/en/' when is_es then 'net/es/' when is_fr then 'net/fr/' when is_com then 'com/' end as rule,
    case when is_www then 'allow' when is_example or is_es or is_fr then 'block' else 'allow' end as verdict
from (select *,
    ('.' || host) like '%.www.example.com' and path like '/en/%' as is_www,
    ('.' || host) like '%.example.com' and path like '/en/%' as is_example,
    ('.' || host) like '%.net' and path like '/es/%' as is_es,
    ('.' || host) like '%.net' and path like '/fr/%' as is_fr,
    ('.' || host) like '%.com' and path like '/%' as is_com from p)
"""

# every order applied document by document: the first filter of the order that fails it removes it
_AUDIT_SQL = r"""
with recursive o as (select '' as filter_order union all select filter_order || f from o, unnest(['A', 'B', 'C', 'D', 'E']) t(f) where not contains(filter_order, f)),
orders as (select filter_order, unnest(range(1, 6))::int as step from o where length(filter_order) = 5),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as least from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, length(regexp_replace(t, '[^A-Z]', '', 'g')) as capitals from d),
f as (select w.*, (len(words) < 200) as a, (100 * len(list_distinct(words)) < 50 * len(words)) as b, (100 * capitals > 2 * length(t)) as c, regexp_matches(t, '[#$%&*|]') as dd, (doc_id > least) as e from w),
m as (select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when dd then 'D' else '' end || case when e then 'E' else '' end as failed,
    count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by all),
x as (select *, filter_order[step] as filter, contains(failed, filter_order[step]) as fails,
    exists (select 1 from range(1, step) r(i) where contains(failed, filter_order[i::int])) as earlier from m, orders),
s as (select part, filter_order, step, any_value(filter) as filter,
    sum(case when not fails and not earlier then n else 0 end) as kept, sum(case when fails and not earlier then n else 0 end) as removed,
    sum(case when fails and earlier then n else 0 end) as redundant, sum(case when failed = filter then n else 0 end) as unique_fails,
    sum(case when fails and not earlier then good else 0 end) as good_lost, sum(case when fails and not earlier then toxic else 0 end) as toxic_lost from x group by part, filter_order, step)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
    toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from s
"""

def _merkle_sql(levels: int = 12) -> str:
    """Level by level: ``a`` trees of languages, ``b`` the tree of subroots; ``levels`` are enough for 8 ** levels leaves."""

    def field(x: str) -> str:
        return f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"

    def leaf_of(text: str) -> str:
        return "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"

    def tree(name: str, nodes: str) -> list[str]:
        """Lists of the runs of each level, as name_r<level>; a lone node stays as it is."""
        parts = [f"{name}0 as materialized ({nodes})"]
        for k in range(levels):
            parts.append(f"{name}_r{k} as materialized (select g, i // 8 as i, list(h order by i) as hs, any_value(n) as n from {name}{k} group by g, i // 8)")
            parts.append(f"{name}{k + 1} as materialized (select g, i, case when n = 1 then hs[1] else sha256(list_aggregate(hs, 'string_agg', '')) end as h, (n + 7) // 8 as n from {name}_r{k})")
        return parts

    def walk(name: str, start: str) -> list[str]:
        """Folding (rid, g, i, h, path) upwards, as name_f<level>."""
        parts = [f"{name}_f0 as materialized ({start})"]
        for k in range(levels):
            at = "(f.i % 8)::int"
            parts.append(
                f"{name}_f{k + 1} as materialized (select rid, f.g, f.i // 8 as i, case when n = 1 then f.h else sha256(list_aggregate(hs[:{at}] || [f.h] || hs[{at} + 2:], 'string_agg', '')) end as h, "
                f"path || coalesce(list_aggregate(hs[:{at}] || hs[{at} + 2:], 'string_agg', ''), '') as path from {name}_f{k} f join {name}_r{k} r on r.g = f.g and r.i = f.i // 8)"
            )
        return parts

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    d = f"d as materialized (select doc_id, lang, {leaf_of('text')} as leaf, case when crc % 3 = 0 then {leaf_of(lower)} else {leaf_of('text')} end as claimed from documents join crcs using (doc_id))"
    # no checksum function: CRC-32 byte by byte over the decimal digits
    bits = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    crc_table = f"poly(b, k, x) as (select b, 0, b::bigint from range(256) t(b) union all select b, k + 1, {bits} from poly where k < 8), tab as materialized (select list(x order by b) as xs from poly where k = 8)"
    crc_rows = (
        "crcs as materialized (select doc_id, xor(c, 4294967295) as crc from (select doc_id, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ord(ch)::bigint)), "
        "lambda c, ch: xor(c >> 8, xs[(xor(c, ch) & 255) + 1])) as c from (select distinct doc_id from documents), tab))"
    )
    parts = [
        crc_table,
        crc_rows,
        d,
        "p as materialized (select row_number() over () as rid, doc_id, leaf, claimed, dense_rank() over (order by lang nulls first) - 1 as g, row_number() over (partition by lang order by doc_id, leaf) - 1 as i, count(*) over (partition by lang) as n from d)",
        *tree("a", "select g, i, leaf as h, n from p"),
        f"s as materialized (select g, h as subroot from a{levels})",
        *tree("b", "select 0 as g, g as i, subroot as h, (select count(*) from s) as n from s"),
        *walk("a", "select rid, g, i, claimed as h, '' as path from p"),
        *walk("b", f"select rid, 0 as g, g as i, h, path from a_f{levels} join (select rid as r, g as gg from p) on r = rid"),
    ]
    root = f"(select h from b{levels})"
    return (
        "with recursive " + ", ".join(parts) + f" select doc_id, leaf, subroot, {root} as root, sha256(path) as proof_sha256, w.h as folded_root, w.h = {root} as verified "
        f"from p join s using (g) join b_f{levels} w using (rid)"
    )


ORACLES: dict[str, str] = {"op11_merkle_manifest": _merkle_sql(), "op12_filter_audit": _AUDIT_SQL, "op7_licenses": _license_sql(), "op9_url_filter": _URL_SQL}
