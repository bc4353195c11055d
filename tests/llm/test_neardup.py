import tracemalloc

import numpy as np
import pandas as pd
import pytest
from fixtures import components as brute
from fixtures import edge_docs, near_copies

from trigrove.llm import common, neardup
from trigrove.llm.common import components


@pytest.mark.parametrize(("num", "small"), [(85, False), (80, True)])
def test_same_classes_as_comparing_all_pairs(spark, monkeypatch, num, small):
    if small:  # the ways of large keys and of groups of many blocks
        monkeypatch.setattr(neardup, "BUCKET", 3)
        monkeypatch.setattr(neardup, "BLOCK", 4)
        monkeypatch.setattr(neardup, "PIVOTS", 1)
        monkeypatch.setattr(neardup, "HOT", 1)
    rows = near_copies()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num, 100).collect()
    want, sizes = brute(rows, num, 100)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(set(want.values())) < len(want)


def test_many_documents_of_one_template_that_are_not_linked(spark, monkeypatch):
    """One group of signatures, no link: nothing is compared across blocks, however many there are."""
    monkeypatch.setattr(neardup, "BLOCK", 256)
    template = " ".join(f"t{i}" for i in range(60))
    rows = [(i, template + " " + " ".join(f"u{i}x{k}" for k in range(8))) for i in range(5000)]
    rows += [(5000 + i, template + " " + " ".join(f"u{i}x{k}" for k in range(7))) for i in range(0, 40)]  # and some that are
    across, real = [], neardup._across
    monkeypatch.setattr(neardup, "_across", lambda w, num, den: across.append(w.count()) or real(w, num, den))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i if i < 5000 else i - 5000 for i, _ in rows}
    assert across and across[0] <= 80


def test_a_full_table_of_counts_is_small_on_the_driver(spark, monkeypatch):
    """All slots counted, as many or long documents of large groups do; counts that are too high lose nothing."""
    for name, n in (("BUCKET", 3), ("BLOCK", 4), ("PIVOTS", 1)):
        monkeypatch.setattr(neardup, name, n)
    slots, real, narrow, peaks = neardup.SLOTS, neardup._tally, neardup._narrowed, []

    def full(batches):
        yield from real(batches)
        yield pd.DataFrame({"slot": np.arange(slots), "n": np.full(slots, 1000)})

    def narrowed(*args):
        tracemalloc.start()
        try:
            return narrow(*args)
        finally:
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

    monkeypatch.setattr(neardup, "_tally", full)
    monkeypatch.setattr(neardup, "_narrowed", narrowed)
    rows = near_copies()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 85, 100)[0]
    assert len(peaks) == 1 and peaks[0] < 100e6


@pytest.mark.parametrize("small", [False, True])
def test_nothing_that_grows_with_the_input_is_broadcast(spark, monkeypatch, small):
    """Not even where Spark takes a table for small: the driver would build it."""
    if small:
        for name, n in (("BUCKET", 3), ("BLOCK", 4), ("PIVOTS", 1)):
            monkeypatch.setattr(neardup, name, n)
    plans, real = [], common.staged
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (common, neardup):
        monkeypatch.setattr(module, "staged", lambda df, name: plans.append((name, plan(df))) or real(df, name))
    monkeypatch.setattr(neardup, "components", lambda edges, name: components(edges, name, limit=2))
    rows = near_copies()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(rows, 85, 100)[0]
    assert any("SortMergeJoin" in p for _, p in plans)
    assert [name for name, p in plans if "Broadcast" in p] == []
    assert plan(got).count("BroadcastHashJoin") == 2  # the sets of HOT rows, whose number is bounded


def test_linked_sets_share_a_prefix():
    rng, some = np.random.default_rng(8), 0
    for num in (80, 85):
        for _ in range(300):
            n = int(rng.integers(1, 60))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < num * (len(a) + len(b) - both):
                continue
            count = {x: int(rng.integers(2, 5)) for x in {*a.tolist(), *b.tolist()}}
            of = lambda s, count=count: neardup.prefix(s, np.array([count[x] for x in s.tolist()]), num, 100)
            small, large = sorted((a, b), key=len)
            keys, early = of(small)
            assert set(keys[early].tolist()) & set(of(large)[0].tolist())
            some += 1
    assert some > 50


def test_keep_one_keeps_the_smallest_of_each_class_and_all_columns(spark):
    rows = near_copies()
    want, _ = brute(rows, 80, 100)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, component_id string")
    got = neardup.keep_one(docs, 80, 100)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_edges_of_a_table(spark):
    got = neardup.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[7].component_id == 6 and not by[7].kept and by[6].n_exact == 2
    assert neardup.near_duplicates(edge_docs(spark, empty=True)).count() == 0
    assert neardup.keep_one(edge_docs(spark)).count() == 10
    assert neardup.keep_one(edge_docs(spark, empty=True)).count() == 0


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 65536, neardup.K).astype(np.uint16)
        b = a.copy()
        at = rng.choice(neardup.K, neardup.T, replace=False)
        b[at] ^= rng.integers(1, 65536, neardup.T).astype(np.uint16)
        assert set(neardup.chunk_keys(a)) & set(neardup.chunk_keys(b))


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    same = [np.mean(neardup.signature(np.unique(x[i : i + 200])) == neardup.signature(np.unique(x[i + 20 : i + 220]))) for i in range(0, 180, 5)]
    assert abs(np.mean(same) - 180 / 220) < 0.05


def test_components_with_and_without_contraction(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 103), (101, 103), (100, 100), (100, 103), (None, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    for limit in (2, 1000):
        got = {r.node: r.root for r in components(df, limit=limit).collect()}
        assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 103: 100}
