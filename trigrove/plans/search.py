"""Search over a collection: match, rank, cut to a page, fetch.

Scores are BM25 (k1 = 1.2, b = 0.75) in double precision with exact lengths.
Plans stay narrow, (_doc_id, _score), until the page is cut; only then are the
documents' columns joined."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import RAW, Field
from ..functions.canonical import filter_value, filter_values, query_trigrams, shown_value
from ..operators.terms import by_document, field_stats, postings, term_stats
from ..session import ship

K1, B = 1.2, 0.75
LITERALS = 100  # terms of a query whose weights are part of the plan
RANGES = 32  # of ids, that a page is fetched by
ASKED = 200_000  # terms of all queries of a batch that are sent to the documents
CELLS = 1 << 20  # scores of documents and queries that a task holds at once
PAIRS = 1 << 18  # of terms of documents and queries that it scores at once


@dataclass(frozen=True)
class Range:
    field: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Query:
    text: str = ""
    filters: tuple[tuple[str, str], ...] = ()
    ranges: tuple[Range, ...] = ()
    sort_by: str | None = None
    ascending: bool = False
    limit: int = 20
    offset: int = 0


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avgdl: float) -> Column:
    """BM25 of a term without its idf."""
    norm = K1 * (1 - B + B * dl / F.lit(avgdl or 1.0))
    return (K1 + 1) * tf / (tf + norm)


class Collection:
    """Documents (_doc_id, fields, _source), with postings and statistics if
    there is an index of them; without, both are taken from the documents."""

    def __init__(self, docs: DataFrame, fields: tuple[Field, ...], posted: DataFrame | None = None, terms: DataFrame | None = None, lengths: DataFrame | None = None):
        self.docs, self.fields, self.posted, self.terms, self._lengths = docs, fields, posted, terms, lengths

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def named(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @cached_property
    def lengths(self) -> dict[str, tuple[int, float]]:
        """By analyzed field: documents in all, mean length."""
        t = field_stats(self.docs, self.fields) if self._lengths is None else self._lengths
        return {r.field: (r.n_docs, r.avgdl) for r in t.collect()}

    @cached_property
    def size(self) -> int:
        return next(iter(self.lengths.values()))[0] if self.lengths else self.docs.count()

    def rows(self, wanted: dict[str, list[str]]) -> DataFrame:
        """Postings of some terms of each field."""
        return postings(self.docs, self.fields, wanted) if self.posted is None else self.posted.where(_among(wanted))

    def frequencies(self, rows: DataFrame | None, wanted: dict[str, list[str]], whole: dict[str, list[str]]) -> dict[tuple[str, str], int]:
        """Documents that have each term (``whole``: that value); as many rows as the
        query has terms.  Of an index they are looked up."""
        if self.terms is not None:
            both = {f: ts for f, ts in (wanted | whole).items() if ts}
            return {(r.field, r.term): r.df for r in self.terms.where(_among(both)).collect()} if both else {}
        out = {(r.field, r.term): r.df for r in term_stats(rows).collect()} if wanted else {}
        if whole:
            sums = [F.count(F.lit(1)).alias("n")]
            for i, (name, values) in enumerate(whole.items()):
                sums.append(F.count(name).alias(f"p{i}"))
                sums += [F.sum(_equals(self.named(name), v).cast("int")).alias(f"v{i}_{j}") for j, v in enumerate(values)]
            got = self.docs.agg(*sums).first()
            self._shares = {name: (got["n"], got[f"p{i}"] / got["n"] if got["n"] else 0.0) for i, name in enumerate(whole)}
            out |= {(name, v): got[f"v{i}_{j}"] or 0 for i, (name, values) in enumerate(whole.items()) for j, v in enumerate(values)}
        return out

    # Clauses: each gives rows (_doc_id, s) of the documents that it holds for,
    # or a predicate on documents with a constant-time score.

    def _summed(self, rows: DataFrame, terms: dict[tuple[str, str], int], df: dict[tuple[str, str], int]) -> DataFrame:
        table = [(f, t, k * idf(self.size, df[f, t]), self.lengths[f][1]) for (f, t), k in terms.items() if (f, t) in df]
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
        s = F.col("w") * F.lit(K1 + 1) * F.col("tf") / (F.col("tf") + norm)
        return self._with_weights(rows, table).groupBy("_doc_id").agg(F.sum(s).alias("s"))

    def _with_weights(self, rows: DataFrame, table: list[tuple[str, str, float, float]]) -> DataFrame:
        """Postings with w and avgdl; those of other terms go.  Few terms are
        literals of the plan, which spares a job; many are broadcast, a row for
        each term of the query."""
        if not table or len(table) > LITERALS:
            w = self.spark.createDataFrame(table, "field string, term string, w double, avgdl double")
            return rows.join(F.broadcast(w), ["field", "term"])
        weight, mean = F.lit(None).cast("double"), F.lit(None).cast("double")
        for f in dict.fromkeys(x[0] for x in table):
            own = [x for x in table if x[0] == f]
            by_term = F.create_map(*[F.lit(x) for _, t, w, _ in own for x in (t, w)])
            weight = F.when(F.col("field") == f, F.try_element_at(by_term, F.col("term"))).otherwise(weight)
            mean = F.when(F.col("field") == f, F.lit(own[0][3])).otherwise(mean)
        return rows.withColumns({"w": weight, "avgdl": mean}).where("w is not null")

    def _value_score(self, f: Field, values: list[str], df: dict[tuple[str, str], int]) -> Column:
        """Score of whole values: length 1, mean length the share of documents with
        a value."""
        n, share = self._shares[f.name] if self.terms is None else self.lengths[f.name]
        tf = (K1 + 1) / (1 + K1 * (1 - B + B / share)) if share else 0.0
        return reduce(lambda a, b: a + b, (F.when(_equals(f, v), idf(n, df.get((f.name, v), 0)) * tf).otherwise(0.0) for v in values))

    def matched(self, q: Query, columns: tuple[str, ...] = ()) -> DataFrame:
        """(_doc_id, _score, columns) of all documents that a query fits."""
        preds: list[Column] = []
        score: list[Column] = []
        posted: list[dict[tuple[str, str], int]] = []
        raw: list[tuple[Field, list[str]]] = []
        for name, value in q.filters:
            f = self.named(name)
            values = filter_values(f, value) if f else []
            if not values:
                continue
            if f.analyzed:
                posted.append({(f.name, v): values.count(v) for v in values})
            else:
                preds.append(_any_of(f, values))
                raw.append((f, values))
        for r in q.ranges:
            f = self.named(r.field)
            if f is None:
                continue
            if f.type != "number":
                raise ValueError(f"field {f.name} is not a number")
            top = 1.7976931348623157e308
            preds.append(F.col(f.name).between(-top if r.low is None else r.low, top if r.high is None else r.high))
            score.append(F.lit(1.0))
        grams = query_trigrams(q.text)
        fuzzy = [f for f in self.fields if f.fuzzy] if grams else []
        mine = {(f.name, g): k for f in fuzzy if f.type == "text" for g, k in grams.items()}
        # A fuzzy field of whole values has a trigram if it is one.
        whole = [(f, list(grams.elements())) for f in fuzzy if f.type in RAW]
        wanted: dict[str, list[str]] = {}
        for f, t in (x for clause in (*posted, mine) for x in clause):
            if t not in wanted.setdefault(f, []):
                wanted[f].append(t)
        asked: dict[str, list[str]] = {}
        for f, values in (*raw, *whole):
            asked[f.name] = list(dict.fromkeys([*asked.get(f.name, []), *values]))
        rows = self.rows(wanted) if wanted else None
        df = self.frequencies(rows, wanted, asked)
        score += [self._value_score(f, values, df) for f, values in raw]
        if whole and not mine:
            preds.append(reduce(lambda a, b: a | b, (_any_of(f, v) for f, v in whole)))
            score += [self._value_score(f, v, df) for f, v in whole]
        clauses = [self._summed(rows, c, df) for c in posted]
        if mine:
            found = self._summed(rows, mine, df)
            if whole:
                same = reduce(lambda a, b: a | b, (_any_of(f, v) for f, v in whole))
                also = self.docs.where(F.coalesce(same, F.lit(False))).select("_doc_id", reduce(lambda a, b: a + b, (self._value_score(f, v, df) for f, v in whole)).alias("s"))
                found = found.unionByName(also).groupBy("_doc_id").agg(F.sum("s").alias("s"))
            clauses.append(found)
        d = self.docs
        for p in preds:
            d = d.where(F.coalesce(p, F.lit(False)))
        if clauses and not (preds or score or columns):  # postings alone tell: no document is read
            d = clauses.pop(0).withColumnRenamed("s", "_score")
        else:
            d = d.select("_doc_id", *columns, reduce(lambda a, b: a + b, score, F.lit(0.0 if score or clauses else 1.0)).alias("_score"))
        for found in clauses:
            d = d.join(found, "_doc_id").withColumn("_score", F.col("_score") + F.col("s")).drop("s")
        # Sums are taken in any order; nine decimals make equals equal.
        return d.withColumn("_score", F.round("_score", 9))

    def page(self, q: Query, seen: Observation | None = None) -> DataFrame:
        """(_doc_id, _score, _rank) of a page, in no order of its own; _rank from
        1.  A number sorts the whole result and is the score; any other field sorts
        only the page that relevance has picked.  ``seen`` counts all that matches
        (as n) on the way."""
        f = self.named(q.sort_by) if q.sort_by else None
        if f is not None and f.type == "number":
            d = self.matched(q, (f.name,)).select("_doc_id", F.col(f.name).alias("_score"))
            key = F.col("_score").asc() if q.ascending else F.col("_score").desc()
        else:
            d, key = self.matched(q), F.col("_score").desc()
        if seen is not None:
            d = d.observe(seen, F.count(F.lit(1)).alias("n"))
        top = d.orderBy(key, "_doc_id").offset(q.offset).limit(q.limit)
        # A page has a thousand rows at most: one task ranks them.
        top = top.withColumn("_rank", F.row_number().over(Window.orderBy(key, "_doc_id")))
        if f is None or f.type in ("number", "boolean"):
            return top
        top, docs = self._beside(top)
        value = docs.select("_doc_id", F.coalesce(f.name, F.lit("")).alias("v"))
        top = value.join(top, "_doc_id")
        by = F.col("v").asc() if q.ascending else F.col("v").desc()
        return top.select("_doc_id", "_score", F.row_number().over(Window.orderBy(by, "_rank")).alias("_rank"))

    def _beside(self, page: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A page, a thousand rows at most, to be broadcast, and the documents to
        join it with: of a stored index, which is in order of _doc_id, only those in
        some ranges around the page's."""
        if self.posted is None:
            return F.broadcast(page), self.docs
        rows = page.collect()
        ids = sorted({r._doc_id for r in rows})
        cuts = sorted(sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: RANGES - 1])
        spans = [(ids[a], ids[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)] if ids else []
        near = reduce(lambda a, b: a | b, (F.col("_doc_id").between(*x) for x in spans), F.lit(False))
        return F.broadcast(self.spark.createDataFrame(rows, page.schema)), self.docs.where(near)

    def search(self, q: Query, seen: Observation | None = None) -> DataFrame:
        """The documents of a page: _doc_id, the fields as shown, _score, _rank."""
        shown = [shown_value(f, F.col(f.name)).alias(f.name) for f in self.fields]
        page, docs = self._beside(self.page(q, seen))
        return docs.join(page, "_doc_id").select("_doc_id", *shown, "_score", "_rank")

    def count(self, q: Query) -> int:
        return self.matched(q).count()

    def lookup(self, filters: tuple[tuple[str, str], ...]) -> DataFrame:
        """The first document for which every usable filter holds; none without
        one.  The best by score, then in order of _doc_id."""
        usable = [(f, v) for name, value in filters if (f := self.named(name)) and (v := filter_value(f, value)) is not None]
        shown = [shown_value(f, F.col(f.name)).alias(f.name) for f in self.fields]
        if not usable:
            return self.docs.limit(0).select("_doc_id", *shown)
        d = self.docs
        for f, v in usable:
            if not f.analyzed:
                d = d.where(_equals(f, v))
        text = [{(f.name, v): 1} for f, v in usable if f.analyzed]
        if not text:  # whole values weigh the same in each match
            return d.orderBy("_doc_id").limit(1).select("_doc_id", *shown)
        wanted: dict[str, list[str]] = {}
        for f, v in (x for c in text for x in c):
            wanted.setdefault(f, []).append(v)
        rows = self.rows(wanted)
        df = self.frequencies(rows, wanted, {})
        best = d.select("_doc_id", F.lit(0.0).alias("_score"))
        for c in text:
            best = best.join(self._summed(rows, c, df), "_doc_id").withColumn("_score", F.col("_score") + F.col("s")).drop("s")
        best, docs = self._beside(best.orderBy(F.desc(F.round("_score", 9)), "_doc_id").limit(1))
        return docs.join(best, "_doc_id").select("_doc_id", *shown)

    def search_many(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """Fuzzy searches in one plan (an extension): ``queries(qid, q)`` ->
        (qid, _doc_id, _score, _rank), the best ``limit`` of each.  Up to ``ASKED``
        terms of queries are sent to the documents; more join postings by trigram."""
        fuzzy = [f for f in self.fields if f.fuzzy and f.type == "text"]
        low = queries.select("qid", F.split(F.lower("q"), "").alias("c"))
        grams = F.filter(F.transform("c", lambda x, i: F.concat(x, F.get(F.col("c"), i + 1), F.get(F.col("c"), i + 2))), lambda g: g.isNotNull())
        asked = low.select("qid", F.explode(grams).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("k"))
        few = asked.limit(ASKED + 1).toArrow()
        scored = self._joined(asked, fuzzy) if few.num_rows > ASKED or not fuzzy else self._beaten(few, queries.schema["qid"], fuzzy, limit)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_score"), "_doc_id"))
        return scored.withColumn("_rank", rank).where(F.col("_rank") <= limit)

    def _beaten(self, asked: pa.Table, qid: StructField, fuzzy: list[Field], limit: int) -> DataFrame:
        """(qid, _doc_id, _score) of what no ``limit`` others of its task beat, for a
        bounded number of terms of queries, which are sent to where the documents lie.
        No pair of a query and a document leaves a task but these."""
        ship(self.spark)
        qids, terms = asked["qid"].combine_chunks().dictionary_encode("encode"), asked["term"].combine_chunks().dictionary_encode()
        names = qids.dictionary.to_pylist()
        words = self.spark.createDataFrame(pd.DataFrame({"t": np.arange(len(terms.dictionary)), "term": terms.dictionary.to_pylist()}), "t long, term string")
        fields = [f.name for f in fuzzy]
        dealt = self.docs.select("_doc_id", *fields).repartition("_doc_id")  # a file may be few tasks
        rows = by_document(dealt, tuple(fuzzy)).join(F.broadcast(words), "term")
        stats = term_stats(postings(self.docs, tuple(fuzzy)).join(F.broadcast(words), "term")) if self.terms is None else self.terms.where(F.col("field").isin(fields)).join(F.broadcast(words), "term").select("field", "term", "df")
        at = {w: i for i, w in enumerate(terms.dictionary.to_pylist())}
        weights = np.zeros((len(fields), len(at)))
        for r in stats.collect():  # a row for each field and term of the queries
            weights[fields.index(r["field"]), at[r["term"]]] = idf(self.size, r["df"])
        t = terms.indices.to_numpy()
        order = np.argsort(t, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(at)))]).astype(np.int64)
        table = (ends, qids.indices.to_numpy()[order].astype(np.int64), asked["k"].to_numpy()[order].astype(np.float64), weights, np.array([self.lengths[f][1] or 1.0 for f in fields]), len(names))
        place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field")) - 1
        found = rows.select("_doc_id", place.cast("int").alias("f"), "t", "tf", "dl").mapInPandas(_best(self.spark.sparkContext.broadcast(table), limit), "q long, _doc_id long, _score double")
        named = self.spark.createDataFrame(list(enumerate(names)), StructType([StructField("q", LongType()), qid]))
        return found.join(F.broadcast(named), "q").select("qid", "_doc_id", "_score")

    def _joined(self, asked: DataFrame, fuzzy: list[Field]) -> DataFrame:
        """(qid, _doc_id, _score) of all pairs, by a shuffle: for any number of queries."""
        p = postings(self.docs, tuple(fuzzy)) if self.posted is None else self.posted.where(F.col("field").isin([f.name for f in fuzzy]))
        stats = term_stats(p) if self.terms is None else self.terms.where(F.col("field").isin([f.name for f in fuzzy]))
        n = self.size
        stats = stats.select("field", "term", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        mean = F.create_map(*[x for f in fuzzy for x in (F.lit(f.name), F.lit(self.lengths[f.name][1]))])
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / mean[F.col("field")])
        s = F.col("k") * F.col("idf") * F.lit(K1 + 1) * F.col("tf") / (F.col("tf") + norm)
        return asked.join(stats, "term").join(p, ["field", "term"]).groupBy("qid", "_doc_id").agg(F.round(F.sum(s), 9).alias("_score"))


class _Top:
    """The best of each query so far: by score, then _doc_id."""

    def __init__(self, n: int, limit: int):
        self.limit, self.q, self.d, self.s = limit, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least, self.last = np.zeros(n), np.full(n, np.iinfo(np.int64).min)

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        """``score`` has a row for each id and a column for each query; 0 is no match."""
        i, q = np.nonzero((score > self.least) | ((score == self.least) & (ids[:, None] < self.last)))
        if not len(i):
            return
        q, d, s = np.concatenate([self.q, q]), np.concatenate([self.d, ids[i]]), np.concatenate([self.s, score[i, q]])
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        full = place == self.limit - 1
        self.least[q[full]], self.last[q[full]] = s[full], d[full]
        self.q, self.d, self.s = (x[place < self.limit] for x in (q, d, s))


def _best(sent: Broadcast, limit: int):
    def scores(top: _Top, rows: dict[str, np.ndarray]) -> None:
        ends, queries, times, weights, means, n = sent.value
        ids = rows["_doc_id"]
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        doc, f, t, tf = np.cumsum(new) - 1, rows["f"], rows["t"], rows["tf"].astype(np.float64)
        s = weights[f, t] * (K1 + 1) * tf / (tf + K1 * (1 - B + B * rows["dl"] / means[f]))
        step = max(1, CELLS // n)
        first = np.concatenate([np.flatnonzero(new), [len(ids)]])
        for k in range(0, len(first) - 1, step):
            a, b = first[k], first[min(k + step, len(first) - 1)]
            m = min(step, len(first) - 1 - k)
            total = np.zeros(m * n)
            pairs = np.cumsum(ends[t[a:b] + 1] - ends[t[a:b]]) // PAIRS
            cuts = [a, *(a + 1 + np.flatnonzero(pairs[1:] != pairs[:-1])).tolist(), b]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):  # each term of a document for all queries that have it
                lo, many = ends[t[x:y]], ends[t[x:y] + 1] - ends[t[x:y]]
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                total += np.bincount(np.repeat((doc[x:y] - k) * n, many) + queries[at], np.repeat(s[x:y], many) * times[at], m * n)
            top.add(ids[first[k : k + m]], np.round(total, 9).reshape(m, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, rest = _Top(sent.value[-1], limit), None
        for pdf in batches:
            rows = {c: pdf[c].to_numpy() for c in pdf.columns}
            if rest is not None:
                rows = {c: np.concatenate([rest[c], v]) for c, v in rows.items()}
            ids = rows["_doc_id"]
            if not len(ids):
                continue
            cut = len(ids) - int((ids[::-1] != ids[-1]).argmax()) if ids[0] != ids[-1] else 0
            if cut:
                scores(top, {c: v[:cut] for c, v in rows.items()})
            rest = {c: v[cut:] for c, v in rows.items()}  # the last document may go on
        if rest is not None:
            scores(top, rest)
        yield pd.DataFrame({"q": top.q, "_doc_id": top.d, "_score": top.s})

    return run


def _among(wanted: dict[str, list[str]]) -> Column:
    return reduce(lambda a, b: a | b, ((F.col("field") == f) & F.col("term").isin(ts) for f, ts in wanted.items()))


def _any_of(f: Field, values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (_equals(f, v) for v in dict.fromkeys(values)))


def _equals(f: Field, v: str) -> Column:
    if f.type == "number":
        return F.lit(False)
    if f.type == "boolean":
        return F.col(f.name) == F.lit(v == "TRUE") if v in ("TRUE", "FALSE") else F.lit(False)
    return F.col(f.name) == v
