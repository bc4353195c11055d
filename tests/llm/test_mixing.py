import random
import time
from collections import Counter
from fractions import Fraction
from math import ceil, isclose, isqrt

import pytest
from fixtures import edge_docs
from pyspark.sql import functions as F

from trigrove.llm import mixing


@pytest.mark.parametrize("shares", [[1], [3, 1], [5, 3, 2, 1, 1], [17, 1, 1, 1], [7, 7, 7], [64, 25, 9, 2, 1]])
def test_no_source_is_a_block_off_its_target(shares):
    slots, q, got = mixing.period(shares), sum(shares), Counter()
    for t, i in enumerate(slots, 1):
        got[i] += 1
        assert all(abs(got[k] - t * a / q) < 1 for k, a in enumerate(shares))
    assert got == Counter(dict(enumerate(shares)))


def test_phases_use_every_block_once_at_the_shares_of_those_left():
    blocks, shares = [10, 3, 50], [4, 2, 1]
    used, slots = [0, 0, 0], 0
    for start, size, q, _, places, before in mixing.plan(blocks, shares):
        assert (start, before) == (slots, used)
        order = {t: i for i, p in enumerate(places) for t in p}
        for t in range(size):
            used[order[t % q]] += 1
        slots += size
    assert used == blocks


def test_mix_gives_each_row_one_place_and_rows_of_a_slot_together(spark, monkeypatch):
    rows = [(i, "abc"[min(i % 7, 2)]) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = None
    for cells in (0, 1000):
        monkeypatch.setattr(mixing, "CELLS", cells)
        got = sorted(mixing.mix(docs, {"a": 2, "b": 1, "c": 1}, block=8).collect(), key=lambda r: r.mix_position)
        assert out in (None, got)
        out = got
    assert [r.mix_position for r in out] == list(range(1000))
    assert [r.mix_slot for r in out] == sorted(r.mix_slot for r in out)
    for slot in {r.mix_slot for r in out}:
        own = [r for r in out if r.mix_slot == slot]
        assert len({(r.source, r.mix_block) for r in own}) == 1 and len(own) <= 8
    first = {s: min(r.mix_phase for r in out if r.source == s) for s in "abc"}
    assert set(first.values()) == {0}
    a = [r for r in out if r.mix_phase == 0]
    for n in range(8, len(a), 8):
        assert abs(sum(r.source == "a" for r in a[:n]) / 8 - n / 8 / 2) < 1 + 1e-9


def by_definition(rows, weights, block):
    """rows (doc_id, source, hash): doc_id -> (block, slot, position, phase), slot by slot."""
    names = sorted({s for _, s, _ in rows})
    queues = {}
    for s in names:
        mine = [(h, i) for i, x, h in rows if x == s]
        cells = ceil(len(mine) / max(1024, isqrt(len(mine))))
        mine.sort(key=lambda x: (int((x[0] % 2**64 >> 1) / 2**63 * cells), x))
        ids = [i for _, i in mine]
        queues[s] = [ids[k : k + block] for k in range(0, len(ids), block)]
    used, out, slot, position, phase = Counter(), {}, 0, 0, 0
    while any(used[s] < len(queues[s]) for s in names):
        live = [s for s in names if used[s] < len(queues[s])]
        q, taken, t, ended = sum(weights[s] for s in live), Counter(), 0, False
        while not ended:
            ready = []
            for n, s in enumerate(live):
                k, a = taken[s], weights[s]
                if Fraction(k * q, a) // 1 <= t:
                    ready.append((ceil(Fraction((k + 1) * q, a)), -(Fraction(k * q, a) // 1), n, s))
            s = min(ready)[3]
            for i in queues[s][used[s]]:
                out[i] = (used[s], slot, position, phase)
                position += 1
            taken[s] += 1
            used[s] += 1
            t, slot, ended = t + 1, slot + 1, used[s] == len(queues[s])
        phase += 1
    return out


def test_a_whole_mix_is_as_by_the_definition(spark):
    rng = random.Random(4)
    for weights, block in (({"a": 2, "b": 1, "c": 1}, 8), ({"a": 30, "b": 20, "c": 50}, 7), ({"a": 1, "b": 9, "c": 4}, 64)):
        docs = spark.createDataFrame([(i, rng.choice("aabbbc")) for i in range(700)], "doc_id long, source string")
        hashed = docs.withColumn("h", F.xxhash64(F.lit(7), F.col("doc_id").cast("string"))).collect()
        want = by_definition([(r.doc_id, r.source, r.h) for r in hashed], weights, block)
        got = {r.doc_id: (r.mix_block, r.mix_slot, r.mix_position, r.mix_phase) for r in mixing.mix(docs, weights, block).collect()}
        assert got == want


def test_large_weights_are_reduced_or_refused(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(1000)], "doc_id long, source string")
    same = mixing.mix(docs, {"a": 3_000_000, "b": 1_000_000}).collect()
    assert sorted(same) == sorted(mixing.mix(docs, {"a": 3, "b": 1}).collect())
    with pytest.raises(ValueError, match="round"):
        mixing.mix(docs, {"a": 1_000_003, "b": 1})
    start = time.perf_counter()
    assert len(mixing.plan([16, 10**9], [999_999, 1])) == 2 and time.perf_counter() - start < 1
    assert max(mixing.shares_by_size([1, 10**14], 0.5)) <= mixing.LONGEST // 2


def test_default_shares_follow_sizes():
    share = mixing.shares_by_size([100, 10_000], 0.5)
    assert isclose(share[1] / share[0], 10, rel_tol=0.02)


def test_default_shares_follow_sizes_with_many_sources():
    share = mixing.shares_by_size([100] * 5000 + [250_000], 0.5)
    assert isclose(share[-1] / sum(share), 500 / 50_500, rel_tol=0.01)
    share = mixing.shares_by_size([1, 10**8, 10**8], 0.5)
    assert isclose(share[1] / share[0], 10**4, rel_tol=1 / 16)


def test_an_early_end_gives_the_same_phases():
    rng = random.Random(3)
    for _ in range(200):
        shares = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 6))]
        left = [rng.randrange(1, 40) for _ in shares]
        whole, cut, seen = mixing.period(shares), mixing.period(shares, left), Counter()
        for t, i in enumerate(whole):
            seen[i] += 1
            if seen[i] == left[i]:
                whole = whole[: t + 1]
                break
        assert cut == whole


def test_edges(spark):
    docs = edge_docs(spark)
    got = mixing.mix(docs)
    assert sorted(r.mix_position for r in got.collect()) == list(range(11))
    assert set(got.columns) == {*docs.columns, "mix_block", "mix_slot", "mix_position", "mix_phase"}
    assert mixing.mix(edge_docs(spark, empty=True)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})
