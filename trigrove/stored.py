"""Searches in a stored index that is built of CSV files, and the same in SQL.

The files are made of the test tables, with the faults that real ones have; the SQL
says what must come of them without any part of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config, Field, Source
from .plans.engine import BadRequest, SearchEngine, build, search_request
from .plans.search import Query, Range
from .session import fresh_path
from .sources.tabular import BITS, LAST, from_table

Run = Callable[[SparkSession, str], DataFrame]

FIELDS = (Field("name", "text", True), Field("segment", "enum"), Field("balance", "number"), Field("code", "keyword"), Field("note", "text"), Field("good", "boolean"), Field("kind", "enum", values=(" b ", "a", "A")))
#: Customers: c_custkey mod 6 chooses the fault of a line.
CUSTOMER_LINES = """
case c_custkey % 6
  when 0 then concat_ws(',', concat('"', c_name, ', ""Inc""', '"'), c_mktsegment, c_acctbal, concat(' k', c_custkey % 7), 'Yes', 'other')
  when 1 then concat_ws(',', c_name, c_mktsegment)
  when 2 then concat_ws(',', c_name, c_mktsegment, c_acctbal, concat('k', c_custkey % 7), '0', 'x', 'one', 'too many')
  when 3 then concat_ws(',', c_name, '', '', concat('k', c_custkey % 7), '', 'x')
  when 4 then concat_ws(',', concat('"', c_name, '\\nbranch', '"'), concat(' ', lower(c_mktsegment), ' '), concat(' ', c_acctbal), concat('k', c_custkey % 7), 't', 'x')
  else concat_ws(',', c_name, c_mktsegment, '1e2', '', 'N', 'x') end"""
#: The same as documents; ``src`` and ``k`` give their order.
DOCUMENTS = """
d as (
select 0 as src, c_custkey::bigint as k, 'customers' as source,
  c_name || case c_custkey % 6 when 0 then ', "Inc"' when 4 then chr(10) || 'branch' else '' end as name,
  case when c_custkey % 6 = 3 then null else upper(c_mktsegment) end as segment,
  case c_custkey % 6 when 0 then c_acctbal when 1 then 7.5 when 2 then c_acctbal when 5 then 100.0 else 0.0 end::double as balance,
  case c_custkey % 6 when 0 then ' k' || (c_custkey % 7) when 1 then 'none' when 5 then null else 'k' || (c_custkey % 7) end as code,
  null as note, case c_custkey % 6 when 0 then true when 2 then false when 4 then true when 5 then false end as good, null as kind from customer
union all
select 1, s_suppkey::bigint, 'suppliers', s_name, 'SUPPLIER', round(s_acctbal)::double, null, 'Ships ' || lower(s_name), true, case when s_suppkey % 2 = 0 then 'A' else 'C' end from supplier),
n as (select count(*)::double as n from d)"""
_made: dict[tuple[str, str, str], str] = {}


def _lines(df: DataFrame, key: str, line: str, head: str, path: str) -> None:
    """CSV files in order of ``key``, each beneath a header."""
    rows = df.selectExpr(f"cast({key} as long) as k", f"{line} as value").unionByName(df.sparkSession.createDataFrame([(-1, head)], "k long, value string"))
    first = (F.monotonically_increasing_id().bitwiseAND(LAST) == 0) & (F.col("k") >= 0)
    dealt = rows.repartitionByRange("k").sortWithinPartitions("k")
    dealt.select(F.when(first, F.concat(F.lit(head + "\n"), "value")).otherwise(F.col("value")).alias("value")).write.text(path)


def _config(spark: SparkSession, sf_dir: str) -> Config:
    """The index of customers and suppliers, built once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "csv")
    top = _made.get(key) or fresh_path(spark, "csv")
    config = Config(
        FIELDS,
        (
            Source(f"{top}/customers", {"name": "title", "segment": "seg", "balance": "money", "code": "code", "good": "ok", "note": "no such column"}, {"balance": "7.5", "code": "none"}),
            Source(f"{top}/suppliers", {"name": "unused"}, {"segment": " supplier ", "good": "T"}, "second"),
        ),
        {"second": {"name": "company", "balance": "sum", "note": "text", "kind": "letter"}},
        f"{top}/index",
    )
    if key not in _made:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        # The second column of the name "title" is never read.
        _lines(read("customer"), "c_custkey", CUSTOMER_LINES, "title,seg,money,code,ok,title", f"{top}/customers")
        _lines(read("supplier"), "s_suppkey", "concat_ws(',', concat('Ships ', lower(s_name)), cast(round(s_acctbal) as int), s_name, if(s_suppkey % 2 = 0, ' a', 'c'))", "text,sum,company,letter", f"{top}/suppliers")
        build(spark, config, parts=8)
        _made[key] = top
    return config


def _engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    return SearchEngine(spark, _config(spark, sf_dir))


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the stored index, as results show them."""
    e = _engine(spark, sf_dir)
    d = e.collection.docs
    # Ids follow the order of sources and records; here they are numbers without gaps.
    d = d.withColumn("piece", F.shiftright("_doc_id", BITS))
    pieces = d.groupBy("piece").count().withColumn("src", F.shiftright("piece", 56 - BITS))
    before = Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("piece", "src", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    d = d.join(F.broadcast(pieces), "piece")  # a row for each piece that the files were split into
    return d.select("src", (F.col("before") + F.col("_doc_id").bitwiseAND(LAST)).alias("place"), F.col("_source").alias("source"), "name", "segment", "balance", "code", "note", "good", "kind")


def _page(q: Query) -> Run:
    """A search as the engine answers it, with its pagination."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = _engine(spark, sf_dir).search(q, pagination=True)
        info = got["pagination"]
        rows = [(i, r["name"], r["segment"], r["balance"], r["good"], round(r["_score"], 6), info["total"], info["total_relation"], info["has_more"]) for i, r in enumerate(got["results"], 1)]
        return spark.createDataFrame(rows, "_rank int, name string, segment string, balance double, good boolean, _score double, total long, total_relation string, has_more boolean")

    return run


def _page_sql(limit: int, offset: int, order: str, matches: str, key: str = "_score") -> str:
    return f"""
with {DOCUMENTS}, {matches},
o as (select m.*, row_number() over (order by {order}, src, k) - {offset} as r, count(*) over () as total from m)
select r::int as _rank, name, coalesce(segment, '') as segment, case when balance <> 0 then balance end as balance, good, round({key}, 6)::double as _score,
  least(total, 100000)::bigint as total, case when total > 100000 then 'gte' else 'eq' end as total_relation, total > {offset} + least({limit}, greatest(total - {offset}, 0)) as has_more
from o where r between 1 and {limit}"""


def _idf(df: str) -> str:
    return f"ln(1 + (n - {df} + 0.5) / ({df} + 0.5))"


def _fuzzy(q: str) -> str:
    return f"""
q as (select x as term, count(*)::double as qtf from (select unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) as x from (select lower('{q}') as t)) group by x),
g as (select src, k, greatest(length(name) - 2, 0)::double as dl, unnest(list_transform(range(1, length(name) - 1), lambda i: lower(name)[i:i + 2])) as term from d),
t as (select src, k, term, any_value(dl) as dl, count(*)::double as tf from g group by src, k, term),
a as (select sum(greatest(length(name) - 2, 0))::double / count(*) as avgdl from d),
b as (select term, count(*)::double as df from t group by term),
s as (select src, k, sum(qtf * {_idf("df")} * 2.2::double * tf / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as s from t join b using (term) join q using (term), a, n group by src, k)"""


def _value(column: str, value: str) -> str:
    """The score of a whole value, as an expression over one row of d and n."""
    df, share = f"(select count(*) from d where {column} = {value})::double", f"((select count({column}) from d)::double / n)"
    return f"case when {column} = {value} then {_idf(df)} * 2.2::double / (1 + 1.2::double * (0.25::double + 0.75::double / {share})) else 0 end"


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document with a code, by value; a number takes no part."""
    got = _engine(spark, sf_dir).lookup({"code": " k3 ", "balance": "5", "good": "no"})["results"]
    return spark.createDataFrame([(r["name"], r["code"], r["good"]) for r in got], "name string, code string, good boolean")


def index_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client may offer for each field, and how many documents there are."""
    e = _engine(spark, sf_dir)
    docs = e.stats()["documents"]
    return spark.createDataFrame([(f, ",".join(v["values"]), v["truncated"], docs) for f, v in e.field_values().items()], "field string, shown string, truncated boolean, documents long")


def index_total_is_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pagination over twice the line items: more than a total reports (at sf0.01)."""
    fields = (Field("l_returnflag", "keyword"), Field("l_quantity", "number"))
    key = (spark.sparkContext.applicationId, sf_dir, "lineitem")
    config = Config(fields, index_path=_made.get(key) or fresh_path(spark, "lineitem"))
    if key not in _made:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("k", F.monotonically_increasing_id())
        twice = lines.unionByName(lines.withColumn("k", F.col("k") + F.lit(1 << 60)))
        build(spark, config, from_table(twice, "k", fields, source="lineitem"), parts=4)
        _made[key] = config.index_path
    got = SearchEngine(spark, config).search(Query(ranges=(Range("l_quantity", 1.0, 50.0),), limit=10, offset=40), pagination=True)["pagination"]
    return spark.createDataFrame([(got["offset"], got["limit"], got["returned"], got["total"], got["total_relation"], got["has_more"])], "offset int, limit int, returned int, total long, total_relation string, has_more boolean")


REQUESTS: dict[str, dict[str, str]] = {
    "default": {},
    "least": {"limit": "0", "q": "ab"},
    "most": {"limit": "5000"},
    "not a number": {"limit": "x"},
    "window": {"offset": "99990", "limit": "20"},
    "range": {"balance_min": "100", "balance_max": "nonsense", "limit": "1000"},
    "alias": {"good": " Y ", "limit": "1000", "nothing": "x"},
    "list": {"code": "k3, k4,,k3", "limit": "1000"},
    "no such value": {"good": "perhaps"},
    "not sortable": {"code_min": "1"},
}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How requests are answered: rows returned, or the kind of error."""
    e, rows = _engine(spark, sf_dir), []
    for name, params in REQUESTS.items():
        try:
            got = search_request(e, params)
        except BadRequest:
            got = {"error": "bad request"}
        said = got.get("error")
        rows.append((name, got.get("total"), "field" if said and "is not a number" in said else said))
    return spark.createDataFrame(rows, "request string, total long, error string")


_REQUESTS = f"""
with {DOCUMENTS}, c as (select count(*)::bigint as all_, count(*) filter (balance >= 100)::bigint as rich, count(*) filter (good)::bigint as good, count(*) filter (code in ('k3', 'k4'))::bigint as listed from d)
select unnest(['default', 'least', 'most', 'not a number', 'window', 'range', 'alias', 'list', 'no such value', 'not sortable']) as request,
  unnest([least(all_, 20), 1, least(all_, 1000), null, null, least(rich, 1000), least(good, 1000), least(listed, 1000), 0, null])::bigint as total,
  unnest([null, null, null, 'bad request', 'pagination_window_too_large', null, null, null, null, 'field']) as error from c"""

_SEGMENT = _value("segment", "'BUILDING'")
ALL: dict[str, tuple[Run, str]] = {
    "index_documents": (index_documents, f"with {DOCUMENTS} select src::bigint as src, (row_number() over (partition by src order by k) - 1)::bigint as place, source, name, segment, balance, code, note, good, kind from d"),
    "index_fuzzy": (_page(Query("custmer#0000 inc", limit=25, offset=5)), _page_sql(25, 5, "_score desc", _fuzzy("custmer#0000 inc") + ", m as (select d.*, round(s, 9) as _score from d join s using (src, k))")),
    "index_fuzzy_filtered": (
        _page(Query("branhc 12", (("segment", " building "),), (Range("balance", None, 10.0),), limit=30)),
        _page_sql(30, 0, "_score desc", _fuzzy("branhc 12") + f", m as (select d.*, round(s + {_SEGMENT} + 1.0, 9) as _score from d join s using (src, k), n where segment = 'BUILDING' and balance <= 10)"),
    ),
    "index_sorted": (_page(Query(filters=(("good", "1"),), sort_by="balance", limit=40, offset=10)), _page_sql(40, 10, "balance desc", "m as (select *, balance as _score from d where good)")),
    "index_values_score": (
        _page(Query(filters=(("segment", "building, SUPPLIER,building"),), limit=50)),
        _page_sql(50, 0, "_score desc", f"m as (select d.*, round(2 * ({_SEGMENT}) + {_value('segment', chr(39) + 'SUPPLIER' + chr(39))}, 9) as _score from d, n where segment in ('BUILDING', 'SUPPLIER'))"),
    ),
    "index_word": (
        _page(Query(filters=(("note", "000000007"),), limit=5)),
        _page_sql(5, 0, "_score desc", f"w as (select src, k, list_filter(regexp_split_to_array(lower(note), '[^a-z0-9]+'), lambda x: x <> '') as ws from d where note is not null), m as (select d.*, round({_idf('(select count(*) from w where list_contains(ws, ' + chr(39) + '000000007' + chr(39) + '))::double')} * 2.2::double / (1 + 1.2::double * (0.25::double + 0.75::double * len(ws) / ((select sum(len(ws)) from w)::double / n))), 9) as _score from d join w using (src, k), n where list_contains(ws, '000000007'))"),
    ),
    "index_lookup": (index_lookup, f"with {DOCUMENTS} select name, code, good from d where code = 'k3' and not good order by src, k limit 1"),
    "index_field_values": (index_field_values, f"with {DOCUMENTS}, c as (select count(*)::bigint as documents from d) select 'segment' as field, (select string_agg(distinct segment, ',' order by segment) from d) as shown, false as truncated, documents from c union all select 'good', 'TRUE,FALSE', false, documents from c union all select 'kind', 'A,B', false, documents from c"),
    "index_total_is_capped": (index_total_is_capped, "with c as (select 2 * count(*) as n from lineitem where l_quantity between 1 and 50) select 40 as \"offset\", 10 as \"limit\", 10 as returned, least(n, 100000)::bigint as total, case when n > 100000 then 'gte' else 'eq' end as total_relation, n > 50 as has_more from c"),
    "requests": (requests, _REQUESTS),
}
