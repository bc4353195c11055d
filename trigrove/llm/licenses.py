"""Licence scans: a positional index of the rarest licence words.

A template is a passage of a licence, some of its words (the key phrase) mandatory.
Of each key phrase the two words that are rarest in the table at hand (highest IDF,
counted over all documents) have postings: template and place.  A file's occurrences
of such words fetch the postings; what both words of a template say about where it
would start is intersected, and there the key phrase is verified word by word and the
share of all its words that stand in place is taken.  The index is one literal of the
plan, whose shape doesn't depend on the templates.  DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` of a template; those from ``start`` up to ``end`` are mandatory."""

    label: str
    words: tuple[str, ...]
    start: int
    end: int
    least: float = 0.5
    base: bool = False


def template(label: str, before: str, key: str, after: str = "", base: bool = False) -> Template:
    a, k, z = before.split(), key.split(), after.split()
    return Template(label, (*a, *k, *z), len(a), len(a) + len(k), base=base)


BASE = (template("cc-by", "", "cc by", base=True), template("gpl", "", "general public license", base=True), template("reserved", "", "all rights reserved", base=True))
TEMPLATES = (
    template("mit", "released under the", "mit license"),
    template("mit", "", "permission is hereby granted free of charge", "to any person obtaining a copy of this software"),
    template("apache-2.0", "licensed under the", "apache license version 2"),
    template("gpl-3.0", "licensed under the", "gnu general public license version 3"),
    template("gpl-2.0", "licensed under the", "gnu general public license version 2"),
    template("lgpl", "licensed under the gnu", "lesser general public license"),
    template("agpl", "licensed under the gnu", "affero general public license"),
    template("mpl-2.0", "subject to the terms of the", "mozilla public license"),
    template("bsd", "", "redistribution and use in source and binary forms", "with or without modification are permitted"),
    template("isc", "permission to use copy modify", "and or distribute this software for any purpose"),
    template("cc-by-nc", "licensed under", "cc by nc"),
    template("cc-by-sa", "licensed under", "cc by sa"),
    template("cc-by-nd", "licensed under", "cc by nd"),
    template("cc-by", "licensed under a", "creative commons attribution", "4 0 international license"),
    template("unlicense", "this is free and", "unencumbered software released into the public domain"),
    template("mit", "", "the software is provided as is without warranty of any kind", "express or implied including but not limited to the warranties of merchantability"),
    template("bsd", "", "redistributions of source code must retain the above copyright notice", "this list of conditions and the following disclaimer"),
    template("bsd", "", "redistributions in binary form must reproduce the above copyright notice", "this list of conditions and the following disclaimer in the documentation"),
    template("apache-2.0", "", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at"),
    template("gpl", "", "you can redistribute it and or modify it under the terms of the gnu general public license", "as published by the free software foundation"),
    template("zlib", "this software is provided", "as is without any express or implied warranty", "in no event will the authors be held liable for any damages"),
    template("boost", "", "boost software license version 1 0"),
    template("epl", "made available under the terms of the", "eclipse public license"),
    template("cc0", "", "cc0 1 0 universal"),
    template("wtfpl", "", "do what the fuck you want to public license"),
)


def load(text: str) -> tuple[Template, ...]:
    """Templates of a table in text: label, words before, key phrase, words after, with
    bars between; blank lines and those that start with # don't count.  An error if a
    line has no label or key phrase."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip() and not line.lstrip().startswith("#"):
            cells = [c.strip().lower() for c in line.split("|")]
            if not 3 <= len(cells) <= 4 or not cells[0] or not cells[2].split():
                raise ValueError(f"line {n}: not label | before | key phrase | after")
            out.append(template(*cells))
    return tuple(out)


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then the runs of digits, a-z and what is beyond ASCII.

    ``lower`` touches other letters too, but only the Kelvin sign becomes a plain
    ASCII letter by it; that is set aside first."""
    return F.array_remove(_split(text), "")


def _split(text: Column) -> Column:
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("ĸ")))
    return F.split(low, SEPARATORS)


def _index(every: tuple[Template, ...], df: dict[str, int]) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Postings (template, place) of the rarest word of each key phrase and of the next
    rarest (the same, where there is no other)."""
    first: dict[str, list[tuple[int, int]]] = {}
    second: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(every):
        places = sorted(range(t.start, t.end), key=lambda k: (df.get(t.words[k], 0), t.words[k], k))
        for index, k in ((first, places[0]), (second, places[min(1, len(places) - 1)])):
            index.setdefault(t.words[k], []).append((n, k))
    return first, second


def _starts(hits: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """(template, where its first word would be) of the occurrences of indexed words."""
    posted = lambda ps: F.array(*[F.struct(F.lit(n).alias("t"), F.lit(k).alias("k")) for n, k in ps])
    index = F.create_map(*[x for w, ps in sorted(postings.items()) for x in (F.lit(w), posted(ps))])
    mine = F.filter(hits, lambda h: h["w"].isin(sorted(postings)))
    return F.flatten(F.transform(mine, lambda h: F.transform(F.element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["k"]).alias("o")))))


def _verified(starts: Column, words: Column, every: tuple[Template, ...], n_base: int) -> Column:
    """Places of templates: (label, start of the key phrase, share, is it a base one)."""
    lits = lambda ws: F.array(*map(F.lit, ws))
    table = F.array(*[F.struct(F.lit(t.label).alias("label"), lits(t.words).alias("ws"), F.lit(t.start).alias("a"), F.lit(t.end).alias("z"), F.lit(t.least).alias("least"), F.lit(n < n_base).alias("base")) for n, t in enumerate(every)])

    def place(s: Column) -> Column:
        t = F.get(table, s["t"])
        same = F.transform(t["ws"], lambda w, k: F.coalesce(F.get(words, s["o"] + k) == w, F.lit(False)))
        return F.struct(t["label"].alias("label"), (s["o"] + t["a"]).alias("at"), t["base"].alias("base"), t["least"].alias("least"), F.forall(F.slice(same, t["a"] + 1, t["z"] - t["a"]), lambda x: x).alias("key"), (F.size(F.filter(same, lambda x: x)) / F.size(t["ws"]).cast("double")).alias("share"))

    return F.filter(F.transform(starts, place), lambda p: p["key"] & (p["share"] >= p["least"]))


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Licence phrases of ``docs(doc_id, text, ...)``, a row for each row: doc_id,
    n_words, n_base (places of the base phrases), first_word and last_word (their
    least and greatest start, null without), base_labels, labels (with those of
    the templates; distinct, sorted, joined by commas, empty without) and score
    (the largest share of a found template's words that stand in place, 1 for a
    base phrase, 0 without).

    A null text is an empty one, with no words.  Texts are read whole; rows that
    repeat others and null ids are scanned like any; other columns are ignored.
    Without any templates nothing is found."""
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    every = (*base, *templates)
    found_type = "array<struct<label:string,at:int,base:boolean,least:double,key:boolean,share:double>>"
    d = src.select("doc_id", words_of(F.col("text")).alias("ws"))
    if every:
        keys = sorted({w for t in every for w in t.words[t.start : t.end]})
        there = src.select(F.explode(F.array_intersect(_split(F.col("text")), F.array(*map(F.lit, keys)))).alias("w"))
        df = {r.w: r.n for r in there.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the templates
        first, second = _index(every, df)
        # Only files with one of the rarest words are looked into.
        d = d.withColumn("here", F.arrays_overlap("ws", F.array(*map(F.lit, sorted(first)))))
        hits = F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(sorted({*first, *second})))
        d = d.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.when(F.col("here"), F.col("ws")).alias("ws"), F.when(F.col("here"), hits).alias("hits"))
        starts = F.array_intersect(_starts(F.col("hits"), first), _starts(F.col("hits"), second))
        d = d.withColumn("starts", F.when(F.col("hits").isNotNull(), starts))
        found = F.when(F.size("starts") > 0, _verified(F.col("starts"), F.col("ws"), every, len(base)))
    else:
        d = d.select("doc_id", F.size("ws").cast("long").alias("n_words"))
        found = F.lit(None)
    d = d.select("doc_id", "n_words", F.coalesce(found.cast(found_type), F.array().cast(found_type)).alias("f"))
    d = d.withColumn("b", F.filter("f", lambda p: p["base"]))
    label = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    return d.select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("b", lambda p: p["at"])).cast("long").alias("last_word"),
        label(F.col("b")).alias("base_labels"),
        label(F.col("f")).alias("labels"),
        F.coalesce(F.array_max(F.transform("f", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def scan_sql(base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same by trying every template at every place, in DuckDB's SQL."""
    quoted = lambda w: "'" + w.replace("'", "''") + "'"

    def places(t: Template) -> str:
        key = " and ".join(f"w[i + {k - t.start + 1}] = {quoted(t.words[k])}" for k in range(t.start, t.end))
        share = " + ".join(f"coalesce((i + {k - t.start} >= 0 and w[greatest(i + {k - t.start + 1}, 1)] = {quoted(x)})::int, 0)" for k, x in enumerate(t.words))
        n = len(t.words)
        return f"[{{'label': {quoted(t.label)}, 'at': i, 'share': ({share}) / {n}.0::double}} for i in range(len(w)) if coalesce({key}, false) and ({share}) / {n}.0::double >= {t.least}]"

    nested = lambda ts: reduce(lambda a, b: f"list_concat({a}, {b})", map(places, ts))
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    label = lambda e: f"array_to_string(list_sort(list_distinct(list_transform({e}, lambda p: p.label))), ',')"
    return f"""
with a as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{up}', '{up.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
f as (select doc_id, len(w) as n_words, {nested(base)} as b, {nested(templates)} as m from a)
select doc_id, n_words::bigint as n_words, len(b)::bigint as n_base,
  list_min(list_transform(b, lambda p: p.at))::bigint as first_word, list_max(list_transform(b, lambda p: p.at))::bigint as last_word,
  coalesce({label('b')}, '') as base_labels, coalesce({label('list_concat(b, m)')}, '') as labels,
  coalesce(list_max(list_transform(list_concat(b, m), lambda p: p.share)), 0.0)::double as score
from f"""
