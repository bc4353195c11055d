"""Benchmark decontamination: rare seeds, n-grams, then Smith-Waterman.

Words are maximal runs of ``\\w`` in the lower-cased text.  A document and a test item
are aligned word by word (+2 equal, -1 different, -1 a gap); the pair counts if the
score is a given share of a full copy's.

Two passes over the documents.  The first counts, for each word of the items, the
documents that hold it.  An alignment good enough has at least ``need`` of an item's
words, so of any ``size - need + 1`` of them it has one: the rarest so many are the
item's rare seeds.  The second pass fetches, for the n-grams that a document shares
with items, those items of which it also holds a rare seed; around the n-grams it cuts
out the stretches that an alignment could cover, and only those with ``need`` words of
the item, counted with repeats, are written and aligned.  So a line that all items and
documents have fetches nothing by itself.

Rarity only saves work: all that the seeds leave out can't reach the threshold, and a
pair's verdict depends on its two texts, not on the rest of the table."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import staged

_WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 8_000_000  # of test items that one pass holds in memory
FEW = 200_000  # ids that are broadcast (some 10 MB); with more, documents are shuffled to them


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def smith_waterman(a: list[int] | np.ndarray, b: list[int] | np.ndarray) -> tuple[int, int]:
    """Best local score of two sequences of word ids, and where it ends in
    ``b`` (the end is exclusive; the first such end).  Row by row; the gaps
    along a row are a running maximum."""
    b = np.asarray(b)
    h = np.zeros(len(b) + 1, np.int32)
    slope = np.arange(len(b) + 1, dtype=np.int32) * -GAP
    best, end = 0, 0
    for x in a:
        d = h[:-1] + np.where(b == x, MATCH, MISMATCH)
        row = np.maximum(h + GAP, 0)
        np.maximum(row[1:], d, out=row[1:])
        row[0] = 0
        h = (np.maximum.accumulate(row + slope) - slope).astype(np.int32)
        top = int(h.max())
        if top > best:
            best, end = top, int(h.argmax())
    return best, end


def least_words(size: int, threshold: float) -> int:
    """Words of an item of ``size`` that any alignment of that score has: each gives
    ``MATCH``, and nothing else gives anything."""
    return max(1, ceil(threshold * size - 1e-9))


class _Index:
    """n-grams of a block of test items, over ids of the items' words.  ``df``: in how
    many documents each word is."""

    def __init__(self, items: list[tuple[int, str]], n: int, threshold: float, df: dict[str, int] | None = None):
        self.n, self.items, self.vocab = n, [], {}
        self.at: dict[tuple[int, ...], list[tuple[int, int, int]]] = defaultdict(list)
        self.gram: dict[tuple[int, ...], int] = {}
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        self.need: list[int] = []
        for k, (_, text) in enumerate(items):
            ws = words(text)
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
            self.items.append(np.array(ids, np.int64))
            self.need.append(least_words(len(ids), threshold))
            if 0 < len(ids) < n:
                self.short[tuple(ws)].append(k)
            for i in range(len(ids) - n + 1):
                g = tuple(ids[i : i + n])
                self.at[g].append((k, i, self.gram.setdefault(g, len(self.gram))))
        count = np.array([(df or {}).get(w, 0) for w in self.vocab], np.int64)
        self.rare: list[frozenset[int]] = []
        self.filed: dict[int, list[int]] = defaultdict(list)  # items by rare seed
        for k, ids in enumerate(self.items):
            order = ids[np.lexsort((ids, count[ids]))]
            self.rare.append(frozenset(order[: len(ids) - self.need[k] + 1].tolist()))
            for w in self.rare[k] if len(ids) >= n else ():
                self.filed[w].append(k)

    def hits(self, ids: list[int]) -> dict[int, list[tuple[int, int, int]]]:
        """By item with a rare seed in the document: (place in the document, place in
        the item, n-gram)."""
        n, found = self.n, defaultdict(list)
        v = np.array(ids, np.int64)
        if len(v) < n:
            return found
        run = v[: len(v) - n + 1] >= 0
        for i in range(1, n):
            run &= v[i : len(v) - n + 1 + i] >= 0
        there: list[tuple[int, list[tuple[int, int, int]]]] = []
        for p in np.flatnonzero(run).tolist():
            places = self.at.get(tuple(ids[p : p + n]))
            if places is not None:
                there.append((p, places))
        if not there:
            return found
        held = set(np.unique(v[v >= 0]).tolist())
        # Of items and of what the document's rare seeds fetch, the shorter list is gone through.
        fetched: set[int] | None = None
        by_item: dict[int, dict[int, list[int]]] = {}
        wanted: dict[int, bool] = {}
        for p, places in there:
            if len(places) > MANY:
                if fetched is None:
                    fetched = {k for w in held for k in self.filed.get(w, ())}
                if len(fetched) < len(places):
                    g = places[0][2]
                    if g not in by_item:
                        by_item[g] = defaultdict(list)
                        for k, q, _ in places:
                            if k in fetched:
                                by_item[g][k].append(q)
                    for k, qs in by_item[g].items():
                        found[k] += [(p, q, g) for q in qs]
                    continue
            for k, q, g in places:
                ok = wanted.get(k)
                if ok is None:
                    ok = wanted[k] = not self.rare[k].isdisjoint(held)
                if ok:
                    found[k].append((p, q, g))
        return found


MANY = 16  # items of an n-gram from which the document's rare seeds may be the shorter list


def _stretches(hits: list[tuple[int, int, int]], size: int, length: int) -> list[tuple[int, int, set[int]]]:
    """Parts of the document that an alignment through a hit can reach, merged
    where they overlap: a path of positive score spans at most twice the item
    and its gaps."""
    out: list[list] = []
    for p, q, g in sorted(hits):
        lo, hi = max(0, p - 3 * q), min(length, p + 3 * (size - q))
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
            out[-1][2].add(g)
        else:
            out.append([lo, hi, {g}])
    return [(a, b, s) for a, b, s in out]


def _in_common(item: np.ndarray, piece: np.ndarray) -> int:
    """Words that both have, counted with repeats."""
    w, n = np.unique(item, return_counts=True)
    at = np.searchsorted(w, piece)
    at[at == len(w)] = 0
    return int(np.minimum(n, np.bincount(at[w[at] == piece], minlength=len(w))).sum())


def _count(sent: Broadcast):
    """Documents (rows) that hold each word of the items, added up a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = {w for _, text in sent.value for w in words(text)}
        df: Counter[str] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                df.update(vocab.intersection(words(text)))
        yield pd.DataFrame({"word": pd.Series(list(df), dtype=object), "n": pd.Series(list(df.values()), dtype="int64")})

    return run


def _scan(sent: Broadcast, n: int, threshold: float):
    made: list[_Index] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(_Index(sent.value[0], n, threshold, sent.value[1]))
        index = made[0]
        get = index.vocab.get
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ws = words(text)
                ids = [get(w, -1) for w in ws]
                if len(ws) < n:
                    rows += [(doc, k, 0, [0], np.array(ids, np.int32).tobytes()) for k in index.short.get(tuple(ws), ())]
                for k, h in index.hits(ids).items():
                    for lo, hi, grams in _stretches(h, len(index.items[k]), len(ids)):
                        piece = np.array(ids[lo:hi], np.int32)
                        if _in_common(index.items[k], piece) >= index.need[k]:
                            rows.append((doc, k, lo, sorted(grams), piece.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "lo", "grams", "part"])

    return run


def _align(sent: Broadcast, n: int, threshold: float):
    made: list[_Index] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = sent.value[0]
        if not made:
            made.append(_Index(items, n, threshold))
        for pdf in batches:
            rows = []
            for doc, k, lo, grams, part in zip(pdf["doc_id"], pdf["k"], pdf["lo"], pdf["grams"], pdf["part"], strict=True):
                item = made[0].items[k]
                score, end = smith_waterman(item, np.frombuffer(part, np.int32))
                share = score / (MATCH * len(item))
                if share >= threshold:
                    rows.append((doc, items[k][0], share, int(lo) + end, len(grams)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "end_word", "n_seeds"])

    return run


def _dealt(tests: DataFrame) -> tuple[DataFrame, int]:
    """The items in blocks of at most ``BLOCK_CHARS`` characters, or of one item."""
    blocks = max(1, -(-(tests.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    while True:
        dealt = tests.withColumn("blk", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        full = dealt.groupBy("blk").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).where((F.col("chars") > BLOCK_CHARS) & (F.col("n") > 1))
        if blocks == 1 or full.isEmpty():
            return dealt, blocks
        blocks *= 2


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.5) -> DataFrame:
    """Pairs of a document and a test item that it holds, whole or edited.

    Returns doc_id, item_id, score (alignment score over that of a full copy,
    ``threshold`` at least), end_word (where the best alignment ends, in words)
    and n_seeds (how many of the item's n-grams the stretch holds), one row a pair:
    the best of the document's stretches, the first among equals.  Test items are a
    stated query set: they are read in blocks of ``BLOCK_CHARS`` characters, each run
    against all rows of ``docs``.

    Null and empty texts hold nothing; empty test items are held by nothing.  An item
    of fewer than ``n`` words says too little to be looked for in a text: it is held by
    documents that have its words and no others.  Longer ones need one run of ``n``
    words in common.  Rows that repeat a doc_id count as one document, repeated items
    as one.  Rows with a null doc_id are reported under null, a null item_id likewise.
    Other columns are ignored."""
    spark = ship(docs.sparkSession)
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    tests = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null").distinct()
    dealt, blocks = _dealt(tests)
    out = None
    for blk in range(blocks):
        items = [(r.item_id, r.text) for r in dealt.where(F.col("blk") == blk).orderBy("item_id", "text").collect()]
        if not items:
            continue
        told = spark.sparkContext.broadcast(items)
        count = src.select("text").mapInPandas(_count(told), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        df = {r.word: r.n for r in count.collect()}  # the items' words at most
        sent = spark.sparkContext.broadcast((items, df))
        pairs = staged(src.mapInPandas(_scan(sent, n, threshold), "doc_id long, k int, lo int, grams array<int>, part binary"), "to-align")
        found = pairs.mapInPandas(_align(sent, n, threshold), "doc_id long, item_id long, score double, end_word int, n_seeds int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, end_word int, n_seeds int")
    best = F.max(F.struct("score", (-F.col("end_word")).alias("e"), "n_seeds")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", (-F.col("best.e")).alias("end_word"), "best.n_seeds")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that hold a test item (see ``contaminated``);
    same columns.  Null and empty texts stay, rows that repeat a doc_id go together, as
    do all with a null one; an empty table stays empty."""
    bad = contaminated(docs, benchmark, n, threshold).select("doc_id").distinct()
    bad = staged(bad, "contaminated")
    if bad.count() <= FEW:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")
