"""Many searches at once."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd

from trigrove.config import Field
from trigrove.plans import search
from trigrove.plans.search import Collection


def test_a_batch_is_ranked_where_the_documents_lie(spark, monkeypatch):
    """The same as by pairs, which no plan lists; ties, many chunks, two fields."""
    rng = random.Random(4)
    words = ["abc", "abcd", "ring", "bolt", "largering", "hot", "aaaa", "é€x"]
    rows = [(i * 7 % 501, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice([None, "ring", "hot abc"]), "") for i in range(501)]
    d = spark.createDataFrame(rows, "_doc_id long, name string, note string, _source string").repartition(3)
    c = Collection(d, (Field("name", "text", True), Field("note", "text", True)))
    asked = [(f"q{i}", " ".join(rng.choices([*words, "zz", "none"], k=rng.randint(0, 5)))) for i in range(60)] + [(None, "ring"), ("q1", "bolt"), ("empty", None)]
    queries = spark.createDataFrame(asked, "qid string, q string")
    key = lambda df: sorted((str(r.qid), r._rank, r._doc_id, r._score) for r in df.collect())
    monkeypatch.setattr(search, "ASKED", 0)
    want = key(c.search_many(queries, 5))
    monkeypatch.setattr(search, "ASKED", 10_000)
    plan = c.search_many(queries, 5)
    assert key(plan) == want and len(want) > 200
    assert "MapInPandas" in plan._jdf.queryExecution().executedPlan().toString()
    assert c.search_many(queries.limit(0), 5).count() == 0
    sent = (np.array([0, 2, 3]), np.array([0, 1, 1]), np.ones(3), np.ones((1, 2)), np.ones(1), 2)
    rows = pd.DataFrame({"_doc_id": [5, 5, 9, 3], "f": 0, "t": [0, 1, 0, 0], "tf": 1, "dl": 1})
    monkeypatch.setattr(search, "CELLS", 1)
    monkeypatch.setattr(search, "PAIRS", 1)
    got = pd.concat(search._best(SimpleNamespace(value=sent), 2)(iter([rows[:1], rows[1:], rows[:0]])))
    assert [tuple(x) for x in got.round(3).to_numpy().tolist()] == [(0, 3, 1), (0, 5, 1), (1, 5, 2), (1, 3, 1)]
