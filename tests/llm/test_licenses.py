import random
import re

import pytest
from fixtures import edge_docs

from trigrove.llm import licenses

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_phrases(spark):
    rng = random.Random(3)
    voc = "cc by CC-BY general public license licence all rights reserved ALL Rights. x GNU Key ñİ".split(" ")
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(voc) for _ in range(rng.randrange(40)))) for i in range(300)] + [(400, None), (401, ""), (402, "cc by cc by")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score == 1) >= bool(r.n_base)


def test_templates_need_their_key_phrase_and_enough_else(spark):
    rows = [
        (1, "Released under the MIT License."),
        (2, "see the MIT license"),
        (3, "Licensed under the Apache License, Version 2.0"),
        (4, "under an Apache license of some version 2"),
        (5, "Permission is hereby granted, free of charge, to any person"),
        (6, "mit license"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("mit", 1.0) and got[2] == ("mit", 0.6) and got[3] == ("apache-2.0", 1.0) and got[4] == ("", 0.0)
    assert got[5][0] == "mit" and 0.5 < got[5][1] < 1 and got[6] == ("", 0.0)


def test_templates_of_a_text_and_every_place_of_them(spark):
    """Against every template at every place."""
    made = licenses.load("# label | before | key | after\n\none | a b | c d c | e\ntwo | | d c |\nthree | | b | a a a")
    assert [(t.label, t.words, t.start, t.end) for t in made] == [("one", tuple("abcdce"), 2, 5), ("two", ("d", "c"), 0, 2), ("three", tuple("baaa"), 0, 1)]
    for bad in ("label", "| | x |", "label | x | | y"):
        with pytest.raises(ValueError):
            licenses.load(bad)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(30)))) for i in range(200)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), made[1:2], made).collect()}
    for i, text in rows:
        w = text.split()
        found = []
        for t in (made[1], *made):
            for o in range(-len(t.words), len(w)):
                same = [0 <= o + k < len(w) and w[o + k] == x for k, x in enumerate(t.words)]
                if all(same[t.start : t.end]) and sum(same) / len(same) >= t.least:
                    found.append((t.label, sum(same) / len(same)))
        assert got[i].labels == ",".join(sorted({x for x, _ in found})) and got[i].score == max((x for _, x in found), default=0)
        assert got[i].n_base == sum(w[k : k + 2] == ["d", "c"] for k in range(len(w)))
    assert {(r.n_base, r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), (), ()).collect()} == {(0, "", 0.0)}


def test_edges(spark):
    got = licenses.scan(edge_docs(spark)).collect()
    assert len(got) == 11
    assert {r.base_labels for r in got if r.doc_id == 5} == {"cc-by,reserved"}
    assert licenses.scan(edge_docs(spark, empty=True)).count() == 0
