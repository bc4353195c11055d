"""Terms of text fields: postings and their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RAW, Field
from ..functions.canonical import bound, text_words, trigrams

DIRECT = 400  # terms that are counted one by one; with more, texts are cut into all their terms


def postings(docs: DataFrame, fields: tuple[Field, ...], terms: dict[str, list[str]] | None = None) -> DataFrame:
    """(field, term, _doc_id, tf, dl) of the analyzed fields.

    A document's terms are counted within its row: nothing is shuffled.  ``terms``
    restricts each field to what a query asks for; those are counted in each text
    where it lies, without cutting it up.  dl, the number of terms, is found before
    the explode: computed beside it, each output row would carry the whole text.  The
    explodes are outer ones: of an inner one Spark infers a filter on the array's
    size, pushes it down and makes the array twice."""
    spark = docs.sparkSession
    parts = []
    for f in fields:
        wanted = None if terms is None else terms.get(f.name)
        if f.analyzed is None or (terms is not None and not wanted):
            continue
        there = docs.where(F.col(f.name).isNotNull())
        if wanted is not None and len(wanted) <= DIRECT:
            parts.append(_counted(there, f, wanted))
            continue
        cut = trigrams if f.analyzed == "trigram" else text_words
        t = there.select("_doc_id", cut(F.col(f.name)).alias("g"))
        t = t.select("_doc_id", F.size("g").alias("dl"), _tallied(F.col("g") if wanted is None else _only(wanted)).alias("h"))
        t = t.select("_doc_id", "dl", F.explode_outer("h").alias("h")).where("h is not null")
        parts.append(t.select(F.lit(f.name).alias("field"), "h.term", "_doc_id", "h.tf", "dl"))
    if not parts:
        return spark.createDataFrame([], "field string, term string, _doc_id long, tf int, dl int")
    return reduce(DataFrame.unionByName, parts)


def by_document(docs: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """The same as ``postings`` of all terms, but those of a document, of all its fields,
    follow each other."""
    cut = [(trigrams if f.analyzed == "trigram" else text_words)(F.col(f.name)).alias(f"g{i}") for i, f in enumerate(fields)]
    t = docs.select("_doc_id", *cut)
    t = t.select("_doc_id", *[c for i in range(len(fields)) for c in (F.size(f"g{i}").alias(f"n{i}"), _tallied(F.col(f"g{i}")).alias(f"h{i}"))])
    each = lambda i, f: F.transform(f"h{i}", lambda h: F.struct(F.lit(f.name).alias("field"), h["term"].alias("term"), h["tf"].alias("tf"), F.col(f"n{i}").alias("dl")))
    all_ = F.flatten(F.array_compact(F.array(*[each(i, f) for i, f in enumerate(fields)])))
    return t.select("_doc_id", F.explode_outer(all_).alias("h")).where("h is not null").select("h.field", "h.term", "_doc_id", "h.tf", "h.dl")


def _tallied(terms: Column) -> Column:
    """Distinct elements of an array with how often they occur, by sorting it."""

    def tally(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"))))

    return F.when(F.size(terms) > 0, bound(F.sort_array(terms), tally))


def _only(wanted: list[str]) -> Column:
    return F.filter("g", lambda x: x.isin(wanted))


def _counted(docs: DataFrame, f: Field, wanted: list[str]) -> DataFrame:
    if f.analyzed == "trigram":
        t = docs.select("_doc_id", F.lower(F.col(f.name)).alias("t"))
        dl, count = F.greatest(F.char_length("t") - 2, F.lit(0)), _occurrences
    else:
        # A word is cheap to look for; only texts that hold one are cut.
        has = reduce(lambda x, y: x | y, (F.contains(F.lower(F.col(f.name)), F.lit(w)) for w in wanted))
        t = docs.where(has).select("_doc_id", text_words(F.col(f.name)).alias("t"))
        dl, count = F.size("t"), lambda t, w: F.size(F.filter(t, lambda x: x == w))
    hits = F.array(*[F.struct(F.lit(w).alias("term"), count(F.col("t"), w).cast("int").alias("tf")) for w in wanted])
    t = t.select("_doc_id", dl.cast("int").alias("dl"), F.filter(hits, lambda h: h["tf"] > 0).alias("h"))
    t = t.select("_doc_id", "dl", F.explode_outer("h").alias("h")).where("h is not null")
    return t.select(F.lit(f.name).alias("field"), "h.term", "_doc_id", "h.tf", "dl")


def _occurrences(text: Column, gram: str) -> Column:
    """How often three characters stand in a text, overlaps counted.  Only those
    that end as they begin can overlap."""
    if len(gram) != 3:
        return F.lit(0)
    if gram[0] != gram[2]:
        return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(gram), F.lit("")))) / len(gram.encode())
    return F.when(F.instr(text, gram) > 0, F.regexp_count(text, F.lit("(?=\\Q" + gram + "\\E)"))).otherwise(0)


def term_stats(posted: DataFrame) -> DataFrame:
    """(field, term, df)."""
    return posted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def value_stats(docs: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """(field, term, df) of the fields whose whole value is a term; booleans as TRUE
    and FALSE."""
    raw = [f for f in fields if f.type in RAW]
    if not raw:
        return docs.sparkSession.createDataFrame([], "field string, term string, df long")
    each = F.array(*[F.struct(F.lit(f.name).alias("field"), F.upper(F.col(f.name).cast("string")).alias("term") if f.type == "boolean" else F.col(f.name).alias("term")) for f in raw])
    return docs.select(F.explode(each).alias("e")).select("e.field", "e.term").where("term is not null").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def value_lengths(docs: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """The same columns as of ``field_stats``, of those fields: a term for each value."""
    raw = [f.name for f in fields if f.type in RAW]
    if not raw:
        return docs.sparkSession.createDataFrame([], "field string, n_docs long, tokens long, avgdl double")
    counts = F.array(*[F.struct(F.lit(f).alias("field"), F.count(f).alias("tokens")) for f in raw])
    one = docs.agg(F.count(F.lit(1)).alias("n_docs"), counts.alias("s")).select("n_docs", F.explode("s").alias("s"))
    return one.select("s.field", "n_docs", "s.tokens", F.when(F.col("n_docs") > 0, F.col("s.tokens") / F.col("n_docs")).otherwise(0.0).alias("avgdl"))


def field_stats(docs: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """(field, n_docs, tokens, avgdl) of the analyzed fields, over all documents:
    those without the field count with no terms."""
    sums = []
    for f in fields:
        if f.analyzed == "trigram":
            n = F.greatest(F.char_length(F.lower(F.col(f.name))) - 2, F.lit(0))
        elif f.analyzed == "word":
            n = F.size(text_words(F.col(f.name)))
        else:
            continue
        sums.append(F.struct(F.lit(f.name).alias("field"), F.coalesce(F.sum(F.coalesce(F.when(F.col(f.name).isNotNull(), n), F.lit(0))), F.lit(0)).alias("tokens")))
    if not sums:
        return docs.sparkSession.createDataFrame([], "field string, n_docs long, tokens long, avgdl double")
    one = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.array(*sums).alias("s")).select("n_docs", F.explode("s").alias("s"))
    return one.select("s.field", "n_docs", "s.tokens", F.when(F.col("n_docs") > 0, F.col("s.tokens") / F.col("n_docs")).otherwise(0.0).alias("avgdl"))


def enum_values(docs: DataFrame, f: Field) -> tuple[list[str], bool]:
    """An enum's distinct values, sorted; with more than its limit none, and
    true.  No more than the limit and one ever reach the driver."""
    if f.values is not None:
        return sorted({v.strip().upper() for v in f.values if v.strip()}), False
    found = [r[0] for r in docs.select(f.name).where(F.col(f.name).isNotNull()).distinct().limit(f.max_values + 1).collect()]
    return ([], True) if len(found) > f.max_values else (sorted(found), False)
