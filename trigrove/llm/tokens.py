"""Token counts by a linear longest-match automaton.

Greedy longest-match segmentation of a word, without building its pieces: a trie
of the vocabulary whose nodes have a failure link and the number of pieces that
following it pops.  Both are computed once, from the root down; a word is then
read once, each character moving or failing, and pieces are only counted."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCAB_BYTES = 64_000_000  # a larger vocabulary isn't sent to executors
CACHE = 200_000  # words whose counts a worker remembers


class Automaton:
    """``begin``: pieces that a word can start with; ``inside``: those that go
    on (None: the same).  A word that has no segmentation counts ``unknown``."""

    def __init__(self, begin: Iterable[bytes], inside: Iterable[bytes] | None = None, unknown: int = 1):
        self.unknown = unknown
        self.go: list[dict[int, int]] = [{}]
        final = [False]

        def add(root: int, pieces: Iterable[bytes]) -> None:
            for piece in pieces:
                at = root
                for c in piece:
                    nxt = self.go[at].get(c)
                    if nxt is None:
                        nxt = self.go[at][c] = len(self.go)
                        self.go.append({})
                        final.append(False)
                    at = nxt
                if piece:
                    final[at] = True

        add(0, begin)
        self.cont = 0
        if inside is not None:
            self.cont = len(self.go)
            self.go.append({})
            final.append(False)
            add(self.cont, inside)
        n = len(self.go)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = [0] if self.cont == 0 else [0, self.cont]
        for u in queue:
            for c, v in self.go[u].items():
                if final[v]:
                    self.fail[v], self.pops[v] = self.cont, 1
                else:
                    z, k = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.go[z]:
                        k += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.go[z][c], k
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match segmentation."""
        go, fail, pops, u, k = self.go, self.fail, self.pops, 0, 0
        for c in word:
            v = go[u].get(c)
            while v is None:
                if fail[u] < 0:
                    return self.unknown
                k += pops[u]
                u = fail[u]
                v = go[u].get(c)
            u = v
        root = self.cont
        while u != root and not (u == 0 and not word):
            if fail[u] < 0:
                return self.unknown
            k += pops[u]
            u = fail[u]
        return k


class _Counts(dict):
    def __init__(self, automaton: Automaton, most: int):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        k = self.automaton.count(b" " + word)
        if len(word) < 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = k
        return k


def load(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a file of ranks: a base64 piece and its number on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_ready: dict[int, _Counts] = {}


def counts(docs: DataFrame, pieces: list[bytes] | None = None, path: str = VOCABULARY) -> DataFrame:
    """Words and tokens of ``docs(doc_id, text, ...)``: doc_id, n_bytes, n_words,
    n_tokens, a row for each row.

    Words are the runs of UTF-8 bytes other than 0x20 and 0x09-0x0D, and each is
    segmented with a space before it, as byte-level vocabularies have it; its
    tokens are the pieces of the greedy longest match.  A word that the
    vocabulary can't cover counts one token.  Null and empty texts have no words.
    Words of any length are read whole, in linear time.  A null doc_id stays
    null; other columns are ignored."""
    spark = ship(docs.sparkSession)
    pieces = load(path) if pieces is None else pieces
    if sum(map(len, pieces)) > VOCAB_BYTES:
        raise ValueError("the vocabulary is too large to send to every executor")
    sent = spark.sparkContext.broadcast(pieces)
    name = hash(tuple(pieces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _ready:
            _ready.clear()
            _ready[name] = _Counts(Automaton(sent.value), CACHE)
        get = _ready[name].__getitem__
        for pdf in batches:
            size, n, k = [], [], []
            for t in pdf["text"]:
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                size.append(len(raw))
                n.append(len(words))
                k.append(sum(map(get, words)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pd.Series(size, dtype="int64"), "n_words": pd.Series(n, dtype="int64"), "n_tokens": pd.Series(k, dtype="int64")})

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
