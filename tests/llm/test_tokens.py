import random

import pytest
from fixtures import edge_docs

from trigrove.llm.tokens import Automaton, counts


def greedy(word, begin, inside, unknown):
    n, at = 0, 0
    while at < len(word):
        fit = max((len(p) for p in (begin if at == 0 else inside) if word.startswith(p, at)), default=0)
        if not fit:
            return unknown
        n, at = n + 1, at + fit
    return n


@pytest.mark.parametrize("seed", range(40))
def test_same_as_taking_the_longest_piece_again_and_again(seed):
    rng = random.Random(seed)
    make = lambda: {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))}
    begin, inside = make(), make()
    one, two = Automaton(begin), Automaton(begin, inside, 7)
    for _ in range(200):
        w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        assert one.count(w) == greedy(w, begin, begin, 1)
        assert two.count(w) == greedy(w, begin, inside, 7)
    assert one.count(b"") == 0


def test_counts(spark):
    pieces = [b" ", b" a", b"a", b"b", b" ab", b"ba", *(bytes([c]) for c in range(128, 256)), *(bytes([c]) for c in range(99, 123))]
    docs = spark.createDataFrame([(1, "ab  aba\tñ"), (2, None), (3, ""), (4, "A"), (5, "a" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_words, r.n_tokens) for r in counts(docs, pieces).collect()}
    assert got == {1: (10, 3, 1 + 2 + 3), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 1, 1), 5: (100_000, 1, 100_000)}


def test_edges(spark):
    assert counts(edge_docs(spark)).count() == 11
    assert counts(edge_docs(spark, empty=True)).count() == 0
    with pytest.raises(ValueError):
        counts(edge_docs(spark), [b"x" * 65_000_000])
