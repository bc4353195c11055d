import random
import re

import pytest
from fixtures import edge_docs

from trigrove.llm import decontaminate as dc


def align(a, b):
    """The best local alignment, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def table():
    rng = random.Random(2)
    voc = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(n))) for k, n in enumerate((3, 15, 30, 40))] + [(9, ""), (10, None)]
    docs = []
    for i in range(60):
        w = [rng.choice(voc) for _ in range(rng.choice([5, 60, 200]))]
        if i % 2:
            part = items[i % 4][1].split()
            for _ in range(i // 12):  # edits: replaced, dropped, inserted
                at = rng.randrange(len(part))
                part[at : at + rng.choice([0, 1, 1])] = [rng.choice(voc)] * rng.choice([0, 1, 1])
                part = part or ["x"]
            at = rng.randrange(len(w))
            w[at:at] = part
        docs.append((i, " ".join(w).upper()))
    return docs, items


def align_with_run(a, b, n):
    """The best of the alignments that have ``n`` equal words in a row."""
    low = -(10**9)
    h = [[[0] + [low] * n for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            v = h[i][j]
            before = h[i - 1][j - 1]
            gap = [max(p, q) - 1 for p, q in zip(h[i - 1][j], h[i][j - 1])]
            v[0] = max(0, max(gap[:n]), max(before[:n]) - 1)
            v[n] = max(gap[n], before[n] - 1)
            if x == y:
                v[0] = max(0, max(gap[:n]))
                for r in range(1, n + 1):
                    v[r] = max(v[r], before[r - 1] + 2)
                v[n] = max(v[n], before[n] + 2)
            best = max(best, v[n])
    return best


def pairs(docs, items, n=4, threshold=0.5):
    """(doc, item): score of all that align well enough, and of those, which don't with a run of ``n`` words."""
    want, apart = {}, set()
    for d, text in docs:
        for k, item in items:
            a, b = re.findall(r"\w+", (item or "").lower()), re.findall(r"\w+", (text or "").lower())
            if len(a) < n:
                if a and a == b:
                    want[d, k] = 1.0
            elif align(a, b) / (2 * len(a)) >= threshold:
                want[d, k] = align(a, b) / (2 * len(a))
                if align_with_run(a, b, n) / (2 * len(a)) < threshold:
                    apart.add((d, k))
    return want, apart


def test_pairs_and_scores_are_those_of_aligning_everything(spark):
    docs, items = table()
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want, apart = pairs(docs, items)
    # All pairs, also those without a run of four words, if there were any.
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and not apart
    assert len(want) > 20 and any(s < 0.9 for s in want.values())


@pytest.mark.parametrize("many", [0, 16])
def test_recall_against_aligning_everything_with_heavy_edits(spark, monkeypatch, many):
    """No pair with a common run is lost; how many have none is the method's limit."""
    monkeypatch.setattr(dc, "MANY", many)
    rng = random.Random(8)
    voc = [f"v{i}" for i in range(60)]  # few words: every document has most of every item's
    line = " ".join(rng.choice(voc) for _ in range(6))
    items = [(k, line + " " + " ".join(rng.choice(voc) for _ in range(rng.randrange(12, 30)))) for k in range(12)]
    docs = []
    for i in range(150):
        w = items[i % 12][1].split()
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(voc)] * rng.randrange(2)
        docs.append((i, " ".join([rng.choice(voc) for _ in range(20)] + w + line.split() * (i % 2))))
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want, apart = pairs(docs, items)
    assert got == {k: s for k, s in want.items() if k not in apart}
    # Recall as measured: 146 of 149; the three others align without any run of four words.
    assert (len(got), len(want)) == (146, 149)


def test_a_line_that_all_have_fetches_nothing(spark, monkeypatch):
    rng = random.Random(9)
    line = "all rights are kept by us"
    items = [(k, line + " " + " ".join(f"i{rng.randrange(10_000)}" for _ in range(30))) for k in range(50)]
    docs = [(i, f"{line} " + " ".join(f"d{rng.randrange(10_000)}" for _ in range(20))) for i in range(2000)] + [(9999, items[7][1])]
    sizes, real = [], dc.staged
    monkeypatch.setattr(dc, "staged", lambda df, name: sizes.append((out := real(df, name)).count()) or out)
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in got] == [(9999, 7, 1.0)] and sizes == [1]


def test_short_items_are_whole_texts(spark):
    docs = [(1, "this is it"), (2, "Is!"), (3, "it is"), (4, "is is"), (5, "one two three"), (6, "zero one two three")]
    items = [(1, "is"), (2, "one two three")]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(2, 1, 1.0), (5, 2, 1.0)]


def test_smith_waterman_is_the_full_table():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 20))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        assert dc.smith_waterman(a, b)[0] == align(a, b)


def edited_item():
    """An item, a text that holds it with every sixth word replaced, and how well they align."""
    item = [f"i{k}" for k in range(60)]
    copy = ["before", *[w if k % 6 != 5 else f"x{k}" for k, w in enumerate(item)], "after"]
    return " ".join(item), " ".join(copy), align(item, copy) / 120


def test_an_edited_item_in_many_documents_is_found_in_each(spark):
    # All n-grams that are left are in 2% of the documents, the item's other ones in none.
    item, copy, score = edited_item()
    docs = spark.range(5000).selectExpr("id as doc_id", f"if(id % 50 = 0, '{copy}', concat('text ', id)) as text")
    got = dc.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.score) for r in got) == [(d, score) for d in range(0, 5000, 50)] and score >= 0.75


def test_a_verdict_does_not_depend_on_the_other_documents(spark):
    item, copy, score = edited_item()
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    for others in (0, 4, 1500):
        docs = spark.range(others + 1).selectExpr("id as doc_id", f"if(id = 0, '{copy}', concat('text ', id)) as text")
        got = dc.contaminated(docs, tests).collect()
        assert [(r.doc_id, r.score, r.n_seeds) for r in got] == [(0, score, 20)]


def test_several_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = table()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.item_id, r.score) for r in rows)
    one = key(dc.contaminated(d, b).collect())
    monkeypatch.setattr(dc, "BLOCK_CHARS", 100)
    assert key(dc.contaminated(d, b).collect()) == one


def test_edges_and_clean(spark, monkeypatch):
    docs, tests = edge_docs(spark), spark.createDataFrame([(1, "a null id with a text of its own"), (2, None), (None, "rights reserved you idiot")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, tests).collect()}
    assert got == {(None, 1), (5, None)}
    for few in (0, 10):  # by a shuffle, and by sending the ids
        monkeypatch.setattr(dc, "FEW", few)
        left = dc.clean(docs, tests)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 7, 8]
    assert dc.clean(edge_docs(spark, empty=True), tests).count() == 0
    assert dc.clean(docs, tests.limit(0)).count() == 11
