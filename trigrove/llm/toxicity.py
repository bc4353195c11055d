"""Toxicity: boosted trees over dense features, calibrated isotonically.

The features are densities of lexicons (a given one, and words and word stems
that the labelled sample shows to be toxic), how near the second person stands
to them, capitals, punctuation and obfuscation.  All is fitted on a bounded sample
of labelled documents: the lexicon on four tenths, the trees on the rest.  The
calibration is cross-fitted on that rest: each document's score is one of trees that
were fitted without it; the trees that score are fitted on all of the rest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import staged

SAMPLE = 10_000  # labelled rows that the classifier is fitted on, at most
TERMS = 3_000  # learned words and stems, at most
CACHE = 200_000  # words whose kind a worker remembers
THRESHOLD = 0.7

INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool foolish loser losers scum scumbag trash garbage filth filthy pathetic worthless disgusting clown clowns imbecile retard retarded jerk bastard bitch"
    " asshole ass crap shit shitty fuck fucking fucker damn dickhead prick slut whore cunt twat wanker bollocks hate hateful kill die vermin parasite pig swine subhuman ugly creep freak psycho lunatic liar coward cretin"
    " dummkopf arschloch scheisse trottel depp idiota imbecil estupido estupida mierda puta cabron gilipollas basura connard salope merde abruti cretine debile ordure".split()
)
SECOND = frozenset("you your yours yourself yourselves u ur youre thou thee du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos usted ustedes tus ti vosotros".split())
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_MARKS = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~" + "«»„“”‘’…–—¡¿"
_TWICE = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[^\W\d_][\d@$!|*#_.+-]+[^\W\d_]")
GIVEN, WORD, STEM, HIDDEN, YOU, CAPS, MIXED = (1 << k for k in range(7))
_TOXIC = GIVEN | WORD | STEM | HIDDEN
NAMES = ("log_words", "given", "word", "stem", "hidden", "toxic", "log_toxic", "you", "near", "close", "caps", "capitals", "exclaim", "question", "marks", "digits", "mixed", "burst", "long")


def bare(token: str) -> str:
    return token.strip(_MARKS).lower()


def terms(word: str) -> tuple[str, ...]:
    """A word, and its stems of 5 and 7 letters (marked by a dash)."""
    return (word, *(word[:n] + "-" for n in (5, 7) if len(word) > n))


class _Kinds(dict):
    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, token: str) -> int:
        w = bare(token)
        k = 0
        if w in INSULTS:
            k |= GIVEN
        if w in self.words:
            k |= WORD
        if len(w) > 5 and (w[:5] + "-" in self.stems or w[:7] + "-" in self.stems):
            k |= STEM
        if w in SECOND:
            k |= YOU
        if len(token) > 1 and token.isupper():
            k |= CAPS
        if not w.isalpha() and w:
            if _INNER.search(w):
                k |= MIXED
            plain = _TWICE.sub(r"\1", "".join(c for c in w.translate(_LEET) if c.isalpha()))
            if not k & GIVEN and plain in INSULTS:
                k |= HIDDEN
        elif len(w) > 3 and _TWICE.search(w) and _TWICE.sub(r"\1", w) in INSULTS:
            k |= HIDDEN
        if len(token) < 40:
            if len(self) >= CACHE:
                self.clear()
            self[token] = k
        return k


def features(text: str | None, kinds: _Kinds) -> list[float]:
    text = text or ""
    tokens = text.split()
    n = len(tokens)
    k = np.fromiter(map(kinds.__getitem__, tokens), np.int16, n)
    c = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    w, chars = max(n, 1), max(int(c.sum()), 1)
    each = [int(((k & b) > 0).sum()) for b in (GIVEN, WORD, STEM, HIDDEN, YOU, CAPS, MIXED)]
    bad = np.flatnonzero(k & _TOXIC)
    you = np.flatnonzero(k & YOU)
    near = close = 0.0
    if len(bad) and len(you):
        at = np.searchsorted(you, bad)
        gap = np.minimum(np.abs(bad - you[np.minimum(at, len(you) - 1)]), np.abs(bad - you[np.maximum(at - 1, 0)]))
        near, close = 1.0 / (1.0 + float(gap.min())), float((gap <= 5).sum()) / w
    most = 0
    if len(bad):
        most = int((np.searchsorted(bad, bad + 50) - np.arange(len(bad))).max())
    letters = int(c[65:91].sum() + c[97:123].sum())
    marks = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    return [
        math.log1p(n),
        *(x / w for x in each[:4]),
        len(bad) / w,
        math.log1p(len(bad)),
        each[4] / w,
        near,
        close,
        each[5] / w,
        int(c[65:91].sum()) / max(letters, 1),
        int(c[33]) / chars,
        int(c[63]) / chars,
        marks / chars,
        int(c[48:58].sum()) / chars,
        each[6] / w,
        float(most),
        chars / w,
    ]


@dataclass
class Trees:
    """Depth-wise trees of a logistic loss over binned features."""

    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    bias: float
    rate: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = _binned(x, self.cuts)
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += self.rate * leaf[at - len(feature)]
        return out


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.int64) if len(x) else np.zeros((0, len(cuts)), np.int64)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Gradient boosting with second-order leaves.  Deterministic: of equal
    gains the first feature and cut win."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    b, width = _binned(x, cuts), bins
    p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Trees(cuts, [], math.log(p0 / (1 - p0)), rate)
    score = np.full(len(y), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        inner = 2**depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = at - first
            best = np.full(many, 1e-9)
            for j in range(x.shape[1]):
                key = local * width + b[:, j]
                gs = np.bincount(key, g, many * width).reshape(many, width).cumsum(1)
                hs = np.bincount(key, h, many * width).reshape(many, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(many), k] > best
                best = np.where(better, gain[np.arange(many), k], best)
                feature[first : first + many][better] = j
                cut[first : first + many][better] = k[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.trees.append((feature, cut, value))
        score += rate * value[leaf]
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (raw scores, probabilities) to interpolate."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == r:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    xs = [r for b in blocks for r in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    words: frozenset[str]
    stems: frozenset[str]
    trees: Trees | None
    xs: np.ndarray
    ys: np.ndarray
    prior: float

    def kinds(self) -> _Kinds:
        return _Kinds(self.words, self.stems)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1.  A thousandth is the uncalibrated score: it orders what the
        steps of the calibration make equal."""
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        p = np.interp(raw, self.xs, self.ys) if len(self.xs) else 1 / (1 + np.exp(-raw))
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hits: tuple[Counter, Counter] = (Counter(), Counter())
    for pdf in batches:
        for t, y in zip(pdf["text"], pdf["y"], strict=True):
            hits[int(y)].update({s for w in set(map(bare, (t or "").split())) if w for s in terms(w)})
            if len(hits[0]) + len(hits[1]) > 300_000:
                yield _counted(hits)
                hits = (Counter(), Counter())
    yield _counted(hits)


def _counted(hits: tuple[Counter, Counter]) -> pd.DataFrame:
    keys = list(hits[1].keys() | hits[0].keys())
    return pd.DataFrame({"term": pd.Series(keys, dtype=object), "bad": pd.Series([hits[1][k] for k in keys], dtype="int64"), "good": pd.Series([hits[0][k] for k in keys], dtype="int64")})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` documents of ``labels(doc_id, toxic, ...)``, those
    first by a hash of doc_id; never on rows with crc32(doc_id as text) mod 3 = 1.
    Of rows that repeat a doc_id the label is the larger one and the text the first
    in order, so they are one document.  Rows without a text, id or label don't
    count; without any left, or with one class only, the model gives everything the
    share of toxic rows."""
    spark = ship(docs.sparkSession)
    told = labels.select(labels["doc_id"].cast("long").alias("lid"), (labels["toxic"].cast("int") > 0).cast("int").alias("y")).where("lid is not null and y is not null and crc32(cast(cast(lid as string) as binary)) % 3 <> 1")
    told = told.groupBy("lid").agg(F.max("y").alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(sample)
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id is not null and text is not null")
    # At most ``sample`` pairs of numbers are broadcast, and as many texts stay.
    rows = text.join(F.broadcast(told), text["doc_id"] == told["lid"]).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = staged(rows.withColumn("part", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(10))), "toxic-sample")
    lexicon = rows.where("part < 4")
    n = {r.y: r.n for r in lexicon.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    found: list[str] = []
    if n.get(0) and n.get(1):
        c = lexicon.select("text", "y").mapInPandas(_count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        odds = (F.col("bad") + 0.1) / F.lit(n[1] + 1.0) / ((F.col("good") + 0.5) / F.lit(n[0] + 1.0))
        best = c.withColumn("odds", odds).where("bad >= 3 and odds >= 12 and bad >= 3 * good").orderBy(F.desc("odds"), "term").limit(TERMS)
        found = [r.term for r in best.select("term").collect()]
    words = frozenset(t for t in found if not t.endswith("-"))
    stems = frozenset(t for t in found if t.endswith("-"))
    model = Model(words, stems, None, np.zeros(0), np.zeros(0), 0.0)
    rest = _features(rows.where("part >= 4").select("doc_id", "y", "part", "text"), model, ["y", "part"]).orderBy("doc_id").collect()
    y = np.array([r.y for r in rest], float)
    part = np.array([r.part for r in rest], int)
    model.prior = float(y.mean()) if len(y) else 0.0
    if len(y) < 20 or y.min() == y.max():
        return model
    x = np.array([r.x for r in rest], float)
    # Scores to calibrate with are those of trees that didn't see the row.
    raw = np.zeros(len(y))
    for k in range(3):
        own = part % 3 == k
        if own.any() and not own.all():
            raw[own] = boost(x[~own], y[~own]).raw(x[own])
    model.trees = boost(x, y)
    model.xs, model.ys = isotonic(raw, y)
    return model


def _features(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = model.kinds()
        for pdf in batches:
            out = pdf.drop(columns=["text"])
            out["x"] = [features(t, kinds) for t in pdf["text"]]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    cols = ["doc_id", *keep]
    return rows.select(*cols, "text").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", x array<double>")


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text, ...)`` scored: doc_id, held_out (crc32(doc_id as text)
    mod 3 is 1), score, predicted (1 if score >= ``threshold``), a row for each.

    Null and empty texts get the score of their (zero) features.  A null doc_id
    isn't held out.  Other columns are ignored."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = sent.value.kinds()
        for pdf in batches:
            x = np.array([features(t, kinds) for t in pdf["text"]], float).reshape(len(pdf), len(NAMES))
            s = sent.value.score(x)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("held_out", held)
    return src.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; same columns.  Null
    and empty texts have the score of their (zero) features; repeated rows share
    their fate; an empty table stays empty."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        kinds = sent.value.kinds()
        for batch in batches:
            x = np.array([features(t, kinds) for t in batch.column(at).to_pylist()], float).reshape(batch.num_rows, len(NAMES))
            yield batch.filter(pa.array(sent.value.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
