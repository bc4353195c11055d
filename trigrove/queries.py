"""Searches over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored
from .config import Field
from .functions.canonical import number_value
from .operators.terms import enum_values, field_stats, postings, term_stats
from .plans.engine import MOST, source_counts
from .plans.search import Collection, Query, Range
from .sources.tabular import from_table

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    fields: tuple[Field, ...]

    def open(self, spark: SparkSession, sf_dir: str) -> Collection:
        return Collection(from_table(spark.read.parquet(f"{sf_dir}/{self.name}.parquet"), self.key, self.fields), self.fields)

    def sql(self) -> str:
        """The documents, canonical."""
        cols = []
        for f in self.fields:
            v = f"cast({f.name} as varchar)"
            if f.type == "number":
                v = f"coalesce({f.name}::double, 0.0)"
            elif f.type == "enum":
                v = f"nullif(upper(trim({v})), '')"
            elif f.type == "boolean":
                v = f"(upper(trim({v})) in ('TRUE', 'T', 'YES', 'Y', '1'))"
            else:
                v = f"nullif({v}, '')"
            cols.append(f"{v} as {f.name}")
        return f"select {self.key}::bigint as _doc_id, {', '.join(cols)} from {self.name}"


def text(name: str, fuzzy: bool = True) -> Field:
    return Field(name, "text", fuzzy)


PART = Table("part", "p_partkey", (text("p_name"), Field("p_brand", "keyword"), Field("p_type", "enum"), Field("p_retailprice", "number")))
PART2 = Table("part", "p_partkey", (text("p_name"), text("p_type"), Field("p_brand", "keyword")))
DOCS = Table("documents", "doc_id", (text("text"), Field("lang", "enum"), Field("source", "keyword"), Field("n_chars", "number")))
WORDS = Table("documents", "doc_id", (text("text", False), Field("lang", "enum"), Field("n_chars", "number")))
CUSTOMER = Table("customer", "c_custkey", (text("c_name"), Field("c_mktsegment", "enum"), Field("c_acctbal", "number")))
ORDERS = Table("orders", "o_orderkey", (Field("o_orderstatus", "enum"), Field("o_totalprice", "number"), Field("o_orderpriority", "keyword")))
LABELS = Table("labels", "doc_id", (Field("toxic", "boolean"), Field("quality", "number")))
PAGES = Table("pages", "page_id", (text("url"),))

SEARCHES: dict[str, tuple[Table, Query]] = {
    "fuzzy_basic": (PART, Query("smal wigdet")),
    "fuzzy_typo_long_text": (DOCS, Query("worthles thinking", limit=20)),
    "fuzzy_duplicate_trigrams": (PART, Query("ear ear ear")),
    "fuzzy_multi_field": (PART2, Query("standard plaet")),
    "fuzzy_short_query_is_browse": (PART, Query("ab")),
    "fuzzy_with_keyword_filter": (PART, Query("red plat", (("p_brand", "Brand#11"),))),
    "fuzzy_with_in_list": (PART, Query("red plat", (("p_brand", "Brand#11,Brand#12,Brand#11"),))),
    "fuzzy_with_range": (PART, Query("blue rnig", ranges=(Range("p_retailprice", 910.0, 980.0),))),
    "fuzzy_with_filter_and_sort": (PART, Query("old rod", (("p_type", " standard "),), sort_by="p_retailprice", limit=50)),
    "fuzzy_url": (PAGES, Query("cheap-pils.example", limit=50)),
    "filter_enum": (CUSTOMER, Query(filters=(("c_mktsegment", " building "),), limit=1000)),
    "filter_keyword": (PART, Query(filters=(("p_brand", "Brand#21"),), limit=1000)),
    "filter_in_list": (CUSTOMER, Query(filters=(("c_mktsegment", "BUILDING, machinery,,"),), limit=100)),
    "filter_boolean_alias": (LABELS, Query(filters=(("toxic", "yes"),), limit=1000)),
    "filter_unknown_and_blank": (CUSTOMER, Query(filters=(("nothing", "x"), ("c_mktsegment", " , "), ("c_acctbal", "1")), limit=30)),
    "filter_text_token": (WORDS, Query(filters=(("text", "worthless"),), limit=100)),
    "filter_fuzzy_trigram": (DOCS, Query(filters=(("text", "dio"),), limit=100)),
    "filter_conjunction": (DOCS, Query(filters=(("lang", "en"), ("source", "src1,src2")), ranges=(Range("n_chars", 500.0, None),), limit=200)),
    "range_two_sided": (ORDERS, Query(ranges=(Range("o_totalprice", 1000.0, 20000.0),), limit=1000)),
    "range_min": (ORDERS, Query(ranges=(Range("o_totalprice", 100000.0),), limit=100)),
    "range_max": (CUSTOMER, Query(ranges=(Range("c_acctbal", None, 0.0),), limit=1000)),
    "sort_number_asc": (ORDERS, Query(sort_by="o_totalprice", ascending=True, limit=50)),
    "sort_number_desc": (ORDERS, Query(sort_by="o_totalprice", limit=50)),
    "sort_number_offset": (ORDERS, Query(filters=(("o_orderstatus", "F"),), sort_by="o_totalprice", limit=25, offset=100)),
    "sort_string_page_local_asc": (PART, Query("hot gizmo", sort_by="p_brand", ascending=True)),
    "sort_string_page_local_desc": (PART, Query("hot gizmo", sort_by="p_type", limit=40, offset=20)),
    "sort_boolean_is_relevance": (LABELS, Query(sort_by="toxic", limit=40)),
    "browse_all": (CUSTOMER, Query(limit=1000)),
    "offset_page": (CUSTOMER, Query("customer", limit=30, offset=60)),
}

LOOKUPS: dict[str, tuple[Table, tuple[tuple[str, str], ...]]] = {
    "lookup_exact": (CUSTOMER, (("c_mktsegment", "machinery"),)),
    "lookup_number_is_ignored": (CUSTOMER, (("c_acctbal", "1"),)),
    "lookup_text_token": (WORDS, (("text", "worthless"), ("lang", "en"))),
    "lookup_nothing": (CUSTOMER, (("c_mktsegment", "no such segment"),)),
}


def _search(t: Table, q: Query) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return t.open(spark, sf_dir).search(q).withColumn("_score", F.round("_score", 6))

    return run


def _lookup(t: Table, filters: tuple[tuple[str, str], ...]) -> Run:
    return lambda spark, sf_dir: t.open(spark, sf_dir).lookup(filters)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _shown(t: Table) -> str:
    return ", ".join(f"case when {f.name} <> 0 then {f.name} end as {f.name}" if f.type == "number" else f.name if f.type == "boolean" else f"coalesce({f.name}, '') as {f.name}" for f in t.fields)


ALIASES = {**dict.fromkeys(("TRUE", "T", "YES", "Y", "1"), "TRUE"), **dict.fromkeys(("FALSE", "F", "NO", "N", "0"), "FALSE")}


def _pieces(f: Field, value: str) -> list[str]:
    """What a filter asks for, told anew for the SQL."""
    found = [] if f.type == "number" else [p.strip() for p in value.split(",") if p.strip()]
    if f.type == "enum":
        return [p.upper() for p in found]
    return [ALIASES.get(p.upper(), p.upper()) for p in found] if f.type == "boolean" else found


def search_sql(t: Table, q: Query) -> str:
    """Matches and scores by scanning everything."""
    ctes, joins, score, where = [f"d as ({t.sql()})", "n as (select count(*)::double as n from d)"], [], [], []
    named = {f.name: f for f in t.fields}

    def terms(f: Field, values: str, name: str) -> None:
        if f.analyzed == "trigram":
            cut, dl = f"string_split(lower({f.name}), '')", "greatest(len(c) - 2, 0)"
            term = "unnest(list_transform(list_zip(c, c[2:], c[3:]), lambda x: x[1] || x[2] || x[3]))"
        else:
            cut, dl = f"list_filter(regexp_extract_all(lower({f.name}), '[\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) < 40)", "len(c)"
            term = "unnest(c)"
        ctes.extend(
            [
                f"{name}q as ({values})",
                f"{name}c as (select _doc_id, {cut} as c from d where {f.name} is not null)",
                f"{name}g as (select _doc_id, {dl} as dl, {term} as term from {name}c)",
                f"{name}t as (select _doc_id, term, count(*)::double as tf, any_value(dl)::double as dl from {name}g where term in (select term from {name}q) group by _doc_id, term)",
                f"{name}d as (select term, count(*)::double as df from {name}t group by term)",
                f"{name}a as (select (select sum({dl}) from {name}c)::double / n as avgdl from n)",
                f"{name}s as (select _doc_id, sum(k * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2::double * tf / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as s from {name}t join {name}d using (term) join {name}q using (term), {name}a, n group by _doc_id)",
            ]
        )

    for i, (key, value) in enumerate(q.filters):
        f = named.get(key)
        vs = _pieces(f, value) if f else []
        if not vs:
            continue
        if f.analyzed:
            terms(f, f"select term, count(*)::double as k from (select unnest([{', '.join(map(_q, vs))}]) as term) group by term", f"x{i}")
            joins.append(f"join x{i}s using (_doc_id)")
            score.append(f"x{i}s.s")
            continue
        lit = lambda v, f=f: ("true" if v == "TRUE" else "false") if f.type == "boolean" else _q(v)
        where.append(f"{f.name} in ({', '.join(map(lit, vs))})")
        for v in vs:
            df = f"(select count(*) from d where {f.name} = {lit(v)})::double"
            share = f"((select count({f.name}) from d)::double / n)"
            score.append(f"case when {f.name} = {lit(v)} then ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * 2.2::double / (1 + 1.2::double * (0.25::double + 0.75::double / {share})) else 0 end")
    for r in q.ranges:
        where.append(f"{r.field} between {-1.7976931348623157e308 if r.low is None else r.low} and {1.7976931348623157e308 if r.high is None else r.high}")
        score.append("1.0::double")
    grams = f"select term, count(*)::double as k from (select unnest(list_transform(range(1, length(q) - 1), lambda i: q[i:i + 2])) as term from (select lower({_q(q.text)}) as q)) group by term" if len(q.text) > 2 else ""
    parts = []
    for i, f in enumerate([f for f in t.fields if f.fuzzy] if grams else []):
        terms(f, grams, f"z{i}")
        joins.append(f"left join z{i}s using (_doc_id)")
        parts.append(f"z{i}s.s")
    if parts:
        where.append("(" + " or ".join(f"{p} is not null" for p in parts) + ")")
        score += [f"coalesce({p}, 0)" for p in parts]
    total = " + ".join(score) if score else "1.0::double"
    ctes.append(f"m as (select d.*, round(({total})::double, 9) as _score from d {' '.join(joins)}, n" + (f" where {' and '.join(where)}" if where else "") + ")")
    f = named.get(q.sort_by or "")
    way = "asc" if q.ascending else "desc"
    if f and f.type == "number":
        ctes.append(f"o as (select * exclude (_score), {f.name} as _score from m)")
        key = f"_score {way}, _doc_id"
    else:
        ctes.append("o as (select * from m)")
        key = "_score desc, _doc_id"
    ctes.append(f"p as (select *, row_number() over (order by {key})::int as _rank from o order by {key} limit {q.limit} offset {q.offset})")
    rank = f"_rank - {q.offset}" if not f or f.type in ("number", "boolean") else f"row_number() over (order by coalesce({f.name}, '') {way}, _rank)"
    return f"with {', '.join(ctes)} select _doc_id, {_shown(t)}, round(_score, 6) as _score, ({rank})::int as _rank from p"


def lookup_sql(t: Table, filters: tuple[tuple[str, str], ...]) -> str:
    usable = tuple((k, v) for k, v in filters if t_field(t, k).type != "number")
    if not usable:
        return f"with d as ({t.sql()}) select _doc_id, {_shown(t)} from d limit 0"
    return f"select * exclude (_score, _rank) from ({search_sql(t, Query(filters=usable, limit=1))})"


def t_field(t: Table, name: str) -> Field:
    return next(f for f in t.fields if f.name == name)


# What an index is made of, and the rest.


def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(PART.open(spark, sf_dir).docs, PART.fields)


def word_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(WORDS.open(spark, sf_dir).docs, WORDS.fields)


def trigram_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_stats(trigram_postings(spark, sf_dir))


def text_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_stats(DOCS.open(spark, sf_dir).docs, DOCS.fields)


def count_capped_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, relation and has_more of a request for 10 line items from 40."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity between 1 and 50").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(MOST)).cast("long").alias("total"), F.when(F.col("n") > MOST, "gte").otherwise("eq").alias("total_relation"), (F.col("n") > 50).alias("has_more"))


def zero_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table("lineitem", "l_orderkey", (Field("l_discount", "number"), Field("l_returnflag", "keyword")))
    docs = t.open(spark, sf_dir).docs
    return docs.groupBy("l_returnflag").agg(F.count(F.nullif(F.col("l_discount"), F.lit(0.0))).alias("n_shown"), F.count(F.lit(1)).alias("n_rows"))


def union_sources_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in one collection; suppliers have no segment."""
    return _both(spark, sf_dir).select("_doc_id", "name", "segment", F.round("balance", 2).alias("balance"), F.col("_source").alias("source"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (text("name"), Field("segment", "enum"), Field("balance", "number"))
    c = from_table(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", fields, {"name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal"}, "customer")
    s = from_table(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", fields, {"name": "s_name", "balance": "s_acctbal"}, "supplier", {"segment": " supplier "})
    return c.unionByName(s)


def source_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_counts(_both(spark, sf_dir))


def _enum(table: str, column: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Table(table, column, (Field(column, "enum"),))
        docs = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        found, more = enum_values(from_table(docs.withColumn("__k", F.lit(0)), "__k", t.fields), t.fields[0])
        return spark.createDataFrame([(",".join(found), more)], "enum_values string, truncated boolean")

    return run


def _enum_sql(table: str, column: str) -> str:
    return f"with v as (select distinct nullif(upper(trim(cast({column} as varchar))), '') as v from {table}), n as (select count(v) as n from v) select case when n > 128 then '' else (select coalesce(string_agg(v, ',' order by v), '') from v) end as enum_values, n > 128 as truncated from n"


def number_parse_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a number in them, of which some are numbers as they stand."""
    c = F.col("s")
    t = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_custkey").cast("string"), F.lit("d"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.col("c_custkey").cast("string"), F.lit("e1"))).otherwise(F.concat(F.lit("-."), F.col("c_custkey").cast("string"))).alias("s"))
    return t.select("c_custkey", number_value(c).alias("number"))


def fuzzy_keyword_beside_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over names, and over codes of three letters that are whole values."""
    fields = (text("p_name"), Field("code", "keyword", True))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("code", F.lower(F.substring("p_type", 1, 3)))
    return Collection(from_table(parts, "p_partkey", fields), fields).search(Query("eco plat", limit=60)).withColumn("_score", F.round("_score", 6))


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item's text as a search over all parts' names (an extension)."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    return PART.open(spark, sf_dir).search_many(items, 5).select("qid", "_doc_id", F.round("_score", 6).alias("_score"), "_rank")


_POSTED = "select 'p_name' as field, term, _doc_id, count(*)::int as tf, any_value(dl)::int as dl from (select p_partkey::bigint as _doc_id, length(p_name) - 2 as dl, unnest(list_transform(range(1, length(p_name) - 1), lambda i: lower(p_name)[i:i + 2])) as term from part) group by term, _doc_id"
_WORDED = r"select 'text' as field, term, _doc_id, count(*)::int as tf, any_value(dl)::int as dl from (select doc_id as _doc_id, len(w) as dl, unnest(w) as term from (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: octet_length(encode(w)) < 40) as w from documents)) group by term, _doc_id"
_BATCH = """
with q as (select item_id as qid, unnest(list_transform(range(1, length(text) - 1), lambda i: lower(text)[i:i + 2])) as term from benchmark),
k as (select qid, term, count(*)::double as k from q group by qid, term),
t as (select term, _doc_id, tf::double as tf, dl::double as dl from ({posted})),
f as (select term, count(*)::double as df from t group by term),
a as (select count(*)::double as n, avg(length(p_name) - 2)::double as avgdl from part),
s as (select qid, _doc_id, round(sum(k * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2::double * tf / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 9) as _score from k join t using (term) join f using (term), a group by qid, _doc_id),
r as (select *, row_number() over (partition by qid order by _score desc, _doc_id)::int as _rank from s)
select qid, _doc_id, round(_score, 6) as _score, _rank from r where _rank <= 5"""

_BESIDE = """
with d as (select p_partkey::bigint as _doc_id, p_name, lower(p_type[1:3]) as code from part), n as (select count(*)::double as n from d),
q as (select x as term, count(*)::double as k from (select unnest(list_transform(range(1, 7), lambda i: 'eco plat'[i:i + 2])) as x) group by x),
t as (select term, _doc_id, tf::double as tf, dl::double as dl from ({posted})), f as (select term, count(*)::double as df from t group by term),
a as (select avg(length(p_name) - 2)::double as avgdl from d),
s as (select _doc_id, sum(k * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2::double * tf / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as s from t join f using (term) join q using (term), a, n group by _doc_id),
c as (select code, count(*)::double as df from d group by code),
v as (select _doc_id, k * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2::double / (1 + 1.2::double) as v from d join c using (code) join q on q.term = d.code, n),
m as (select d.*, round(coalesce(s, 0) + coalesce(v, 0), 9) as score from d left join s using (_doc_id) left join v using (_doc_id) where s is not null or v is not null)
select _doc_id, p_name, code, round(score, 6) as _score, row_number() over (order by score desc, _doc_id)::int as _rank from m qualify _rank <= 60"""

OTHERS: dict[str, tuple[Run, str]] = {
    "trigram_postings": (trigram_postings, _POSTED),
    "word_postings": (word_postings, _WORDED),
    "term_stats": (trigram_term_stats, f"select field, term, count(*) as df from ({_POSTED}) group by field, term"),
    "field_stats": (text_field_stats, "select 'text' as field, count(*) as n_docs, sum(greatest(length(lower(text)) - 2, 0))::bigint as tokens, sum(greatest(length(lower(text)) - 2, 0))::double / count(*) as avgdl from documents"),
    "count_capped_pagination": (count_capped_pagination, "select least(count(*), 100000)::bigint as total, case when count(*) > 100000 then 'gte' else 'eq' end as total_relation, count(*) > 50 as has_more from lineitem where l_quantity between 1 and 50"),
    "zero_is_null": (zero_is_null, "select l_returnflag, count(nullif(l_discount, 0)) as n_shown, count(*) as n_rows from lineitem group by l_returnflag"),
    "union_sources_with_defaults": (union_sources_with_defaults, "select c_custkey::bigint as _doc_id, c_name as name, upper(trim(c_mktsegment)) as segment, round(c_acctbal, 2) as balance, 'customer' as source from customer union all select s_suppkey::bigint, s_name, 'SUPPLIER', round(s_acctbal, 2), 'supplier' from supplier"),
    "source_row_counts": (source_row_counts, "select 'customer' as source, count(*) as n_rows from customer union all select 'supplier', count(*) from supplier"),
    "enum_values": (_enum("part", "p_brand"), _enum_sql("part", "p_brand")),
    "enum_truncated": (_enum("events", "user_id"), _enum_sql("events", "user_id")),
    "number_parse_or_zero": (number_parse_or_zero, "select c_custkey, case c_custkey % 4 when 2 then c_custkey * 10.0::double when 3 then -(('0.' || c_custkey)::double) else 0.0::double end as number from customer"),
    "fuzzy_keyword_beside_text": (fuzzy_keyword_beside_text, _BESIDE.format(posted=_POSTED)),
    "batch_search": (batch_search, _BATCH.format(posted=_POSTED)),
}


def queries() -> dict[str, Run]:
    return {k: _search(*v) for k, v in SEARCHES.items()} | {k: _lookup(*v) for k, v in LOOKUPS.items()} | {k: v[0] for k, v in (OTHERS | stored.ALL).items()}


def oracle_sql() -> dict[str, str]:
    return {k: search_sql(*v) for k, v in SEARCHES.items()} | {k: lookup_sql(*v) for k, v in LOOKUPS.items()} | {k: v[1] for k, v in (OTHERS | stored.ALL).items()}
