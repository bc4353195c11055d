"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, licenses, media, mixing, neardup, tokens, toxicity, urlfilter, warc
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it holds (``decontaminate.contaminated``
    says what nulls, ties, repeated rows and empty tables give, as the operators named
    below do)."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the mix of its sources (``mixing.mix``)."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as JPEG and read back (``media.features``)."""
    return media.features(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page (``html.main_text``)."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near copies (``neardup.near_duplicates``)."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on each page's url (``urlfilter.judge``)."""
    return urlfilter.judge(table(spark, sf_dir, "pages")).drop("pattern")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of each document (``tokens.counts``)."""
    return tokens.counts(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases of each document (``licenses.scan``)."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each document (``toxicity.fit``, ``toxicity.scored``)."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back (``warc.write``, ``warc.records``)."""
    return warc.records(warc.write(table(spark, sf_dir, "pages"))).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_mixing, op3_media, op4_html, op5_near_dedup, op6_url_filter, op7_token_counts, op8_licenses, op9_toxicity, op10_warc)
    return {f.__name__: f for f in found}


_NEAR = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
n as (select doc_id, len(sh)::bigint as n_shingles, case when len(sh) > 0 then md5(array_to_string(list_sort(sh), chr(10))) end as h, sh from s),
r as (select h, min(doc_id) as rid, any_value(sh) as sh, any_value(n_shingles) as n from n where h is not null group by h),
e as (select rid, n, unnest(sh) as g from r),
p as (select a.rid as a, b.rid as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.g = b.g and a.rid < b.rid group by a.rid, b.rid),
l as (select a, b from p where 100 * c >= 85 * (na + nb - c)),
u as (select a as x, b as y from l union all select b, a from l),
t(x, y) as (select rid, rid from r union select t.x, u.y from t join u on u.x = t.y),
m as (select x, min(y) as cid from t group by x)
select n.doc_id, n.n_shingles, coalesce(m.cid, n.doc_id) as component_id, n.doc_id = coalesce(m.cid, n.doc_id) as kept
from n left join r on n.h = r.h left join m on m.x = r.rid"""

_UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


#: The rules as (host, path, action), longest first.
_URL_RULES = (("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow"))


def _url_sql() -> str:
    """Hosts and words by plain string functions; no rule of the engine is used."""
    at = lambda h: f"(host = '{h}' or ends_with(host, '.{h}'))"
    case = lambda what, end: "case " + " ".join(f"when {at(h)} and starts_with(path, '{p}') then '{what(h, p, a)}'" for h, p, a in _URL_RULES) + f" else {end} end"
    has = " or ".join(f"contains(words, ' {' '.join(w)} ')" for w in urlfilter.WORDS)
    listed = f"{at('doubleclick.net')} or {at('googlesyndication.com')} or ends_with(lower(path), '/wp-login.php') or ends_with(lower(path), '/xmlrpc.php')"
    verdict = case(lambda h, p, a: a, f"case when {has} or {listed} then 'block' else 'allow' end")
    return f"""
with u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), {_UP}), '') as host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') as path from u),
w as (select *, ' ' || regexp_replace(host, '[^a-z0-9\\x{{80}}-\\x{{10ffff}}]', ' ', 'g') || ' ' as words from h)
select page_id, host, path, {case(lambda h, p, a: h + p, "null")} as rule, {verdict} as verdict from w"""


_WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as n, sha256(h) as g from p),
f as (select g, min(page_id) as first from d where n >= 100 group by g)
select page_id, n as payload_bytes, d.g as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from d left join f on d.g = f.g"""


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": _NEAR, "op6_url_filter": _url_sql(), "op8_licenses": licenses.scan_sql(), "op10_warc": _WARC}
