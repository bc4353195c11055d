import zlib

import numpy as np
from fixtures import edge_docs

from trigrove.llm import toxicity

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy_and_range(spark):
    docs, labels = tables(spark)
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.93
    assert sum(r.predicted and not y for r, y in held) / len(held) < 0.02


def test_held_out_labels_and_other_columns_play_no_part(spark):
    docs, labels = tables(spark)
    x = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    other = labels.selectExpr("doc_id", f"case when {x} then 1 - toxic else toxic end as toxic")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.selectExpr("doc_id", "text", "'x' as lang", "1 as source"), other)
    assert (a.words, a.stems, a.xs.tolist(), a.ys.tolist()) == (b.words, b.stems, b.xs.tolist(), b.ys.tolist())


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id % 40 as doc_id", "concat('text ', id % 40) as text")
    labels = spark.range(40).selectExpr("id as doc_id", "id % 2 as toxic")
    sizes, real = [], toxicity.staged
    monkeypatch.setattr(toxicity, "staged", lambda df, name: sizes.append((out := real(df, name)).count()) or out)
    toxicity.fit(docs, labels, sample=20)
    assert sizes == [20]
    one, many = toxicity.fit(docs.dropDuplicates(), labels), toxicity.fit(docs, labels)
    assert (one.words, one.prior) == (many.words, many.prior)


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-x))).astype(float)
    xs, ys = toxicity.isotonic(x, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    assert abs(np.interp(x, xs, ys).mean() - y.mean()) < 1e-9


def test_trees_learn_what_no_single_cut_can():
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    raw = toxicity.boost(x, y).raw(x)
    assert ((raw > 0) == (y > 0)).mean() > 0.98


def test_features_see_lexicon_distance_capitals_and_disguise():
    kinds = toxicity.Model(frozenset(), frozenset(), None, np.zeros(0), np.zeros(0), 0.0).kinds()
    f = lambda t: dict(zip(toxicity.NAMES, toxicity.features(t, kinds), strict=True))
    assert f("you idiot")["given"] == 0.5 and f("you idiot")["near"] == 0.5
    assert f("id1ot iiidiot")["hidden"] == 1.0 and f("YOU FOOL!")["caps"] == 1.0
    assert f("you " + "x " * 50 + "idiot")["near"] < 0.05
    assert f(None) == f("")


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(None, 1, 1), (4, None, None), (4, 1, 0), (4, 1, 1), (99, 1, 1)], "doc_id long, toxic int, quality int")
    for lab in (labels, labels.limit(0)):
        for d in (docs, edge_docs(spark, empty=True)):
            model = toxicity.fit(d, lab)
            assert toxicity.scored(d, model).count() == d.count()
            left = toxicity.accepted(d, model)
            assert left.columns == d.columns and left.count() <= d.count()
    toxic = toxicity.Model(frozenset(), frozenset(), None, np.zeros(0), np.zeros(0), 0.9)
    assert toxicity.accepted(docs, toxic).count() == 0
