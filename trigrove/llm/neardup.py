"""MinHash near-duplicates by a multi-index Hamming join.

Signatures have ``K`` positions of 16 bits.  Two documents whose sets have
Jaccard similarity 0.85 differ in Bin(64, 0.15) positions: at most ``T`` = 23 but
for about one pair in 10^5.  The positions are cut into ``M`` = 12 chunks, so a
pair within ``T`` has a chunk with at most floor(23 / 12) = 1 differing
position; each document therefore enters its ``K`` chunk variants with one
position left out, and every pair within ``T`` meets under some key.

What meets is confirmed on full shingle sets.  No step lists the pairs of a
group: keys yield spanning forests, their components ("groups") are compared in
blocks through inverted lists, and again only forests leave a task.  A group of
many blocks is first compared with a few pivots, which joins copies of one text
at a linear cost.  What this leaves apart is narrowed by prefixes: of two linked sets
the first shingles in any fixed order, as many as leave too few for a link, have one
in common; with rare ones first, documents of one template that aren't linked share
none and fall out.  Only blocks of what still hangs together are compared in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Forest, components, mix64, staged, unsent

K, T, M = 64, 23, 12
SPREAD = 64  # keys that a group is spread over where its rows meet what is known of it
FEW = 200_000  # rows that are broadcast at most
SHINGLE = 5
BUCKET = 2048  # members of a key that are compared by signature in one task
BLOCK = 1024  # documents of a block
BLOCK_SHINGLES = 1_000_000  # and shingles of a block, on average
HOT = 100_000  # rows of one set from which they aren't shuffled to their class; of N rows there are N / HOT such sets at most
SLOTS = 1 << 20  # of the table by which shingles are counted
PIVOTS = 32  # documents, about, of a group of several blocks that each of its blocks is compared with first
_rng = np.random.default_rng(20240501)
_MUL = (_rng.integers(0, 2**31, K, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_MUL2 = (_rng.integers(0, 2**31, K, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, K, dtype=np.uint32)
_COEF = _rng.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_CHUNKS = np.array_split(np.arange(K), M)
_KEYCOEF = _rng.integers(0, 2**63, K, dtype=np.uint64) | np.uint64(1)


class Words(dict):
    """Hash of a word, remembered; forgotten when there are too many."""

    LIMIT = 300_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = Words()


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``n``-word shingles.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; a
    text with fewer than ``n`` words has its whole sequence as one shingle, one
    without words (or null) has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    m = min(n, len(w))
    s = h[: len(h) - m + 1] * _COEF[0]
    for i in range(1, m):
        s = mix64(s) if i == 3 else s ^ (s >> np.uint64(29))
        s = s + h[i : len(h) - m + 1 + i] * _COEF[i]
    return np.unique(mix64(s + np.uint64(m)))


def signature(s: np.ndarray) -> np.ndarray:
    """K minima of 32-bit permutation hashes, cut to 16 bits."""
    best = np.full(K, 0xFFFFFFFF, np.uint32)
    lo, hi = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(s), 4096):
        x = lo[at : at + 4096][None, :] * _MUL[:, None]
        x ^= (hi[at : at + 4096][None, :] + _ADD[:, None]) * _MUL2[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The K keys of a signature: each chunk without each of its positions."""
    v = mix64((sig.astype(np.uint64) + np.uint64(1)) * _KEYCOEF)
    out = np.empty(K, np.uint64)
    for c, idx in enumerate(_CHUNKS):
        out[idx] = mix64(v[idx].sum(dtype=np.uint64) - v[idx] + idx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n, h1, h2, sig = [], [], [], []
        for t in pdf["text"]:
            s = shingle_set(t)
            n.append(len(s))
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            h1.append((d >> 64) - 2**63)
            h2.append((d & (2**64 - 1)) - 2**63)
            sig.append(signature(s).tobytes() if len(s) else b"")
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": pd.Series(n, dtype="int64"), "h1": pd.Series(h1, dtype="int64"), "h2": pd.Series(h2, dtype="int64"), "sig": sig})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            part = pdf.iloc[at : at + 1000]
            k = [chunk_keys(np.frombuffer(s, np.uint16)) for s in part["sig"]]
            if k:
                yield pd.DataFrame({"key": np.concatenate(k), "rid": np.repeat(part["rid"].to_numpy(), K)})


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the members of a key within signature distance T."""
    rid = pdf["rid"].to_numpy()
    s = np.stack([np.frombuffer(x, np.uint16) for x in pdf["sig"]])
    f = Forest(len(rid))
    for i in range(len(rid) - 1):
        near = np.flatnonzero((s[i + 1 :] != s[i]).sum(axis=1) <= T) + i + 1
        for j in near.tolist():
            f.join(i, j)
        if f.left == 1:
            break
    return pd.DataFrame({"u": [int(rid[a]) for a, _ in f.edges], "v": [int(rid[b]) for _, b in f.edges]}, dtype="int64")


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a sorted stream; only the open group is held."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = pdf[by].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        edges = [0, *cut.tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[edges[-1] :]
    if rest is not None:
        yield rest


def _near_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[pd.DataFrame] = []
    for run in _runs(batches, ["key"]):
        out.append(_near(run))
        if len(out) >= 500:
            yield pd.concat(out)
            out = []
    if out:
        yield pd.concat(out)


def confirmed_forest(ids: list[int], side: list[int], group: list[int], texts: list, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that span the links (num * |union| <= den * |intersection|) of one
    or two blocks.  ``side`` is the block of each text; with two blocks only
    pairs across them count.  Texts of the same ``group`` >= 0 are known to be
    connected.  Intersections are counted over inverted lists, exactly."""
    n = len(ids)
    sets = [shingle_set(t) for t in texts]
    f = Forest(n)
    first: dict[int, int] = {}
    for i, g in enumerate(group):
        if g >= 0:
            f.join(first.setdefault(g, i), i)
    known = len(f.edges)
    sizes = np.array([len(s) for s in sets], np.int64)
    two = len(set(side)) == 2
    sd = np.array(side)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.searchsorted(flat, flat, "left")
    lo = np.empty(len(flat), np.int64)
    hi = np.empty(len(flat), np.int64)
    lo[order] = start
    hi[order] = np.searchsorted(flat, flat, "right")
    at = np.concatenate([[0], np.cumsum(sizes)])
    fewer = 1 if two and 2 * sum(side) <= n else 0
    for i in range(n):
        if f.left == 1:
            break
        if two and side[i] != fewer:
            continue
        count = np.zeros(n, np.int64)
        a, b = lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]]
        more = b - a > 1
        a, b = a[more], b[more]
        if len(a):
            step = 4096
            for k in range(0, len(a), step):
                la, lb = a[k : k + step], b[k : k + step]
                ln = lb - la
                idx = np.repeat(la - np.concatenate([[0], np.cumsum(ln)[:-1]]), ln) + np.arange(ln.sum())
                count += np.bincount(owner[idx], minlength=n)
        ok = (den * count >= num * (sizes + sizes[i] - count)) & (count > 0)
        ok &= (sd != side[i]) if two else (np.arange(n) > i)
        for j in np.flatnonzero(ok).tolist():
            f.join(i, j)
    return [(int(ids[x]), int(ids[y])) for x, y in f.edges[known:]]


def _verify(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for part in _runs(batches, ["gid", "b1", "b2"]):
            out += confirmed_forest(part["rid"].tolist(), part["side"].tolist(), part["known"].tolist(), part["text"].tolist(), num, den)
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
                out = []
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _compare(parts: DataFrame, num: int, den: int) -> DataFrame:
    """parts: gid, b1, b2, side, known, rid, text."""
    dealt = parts.repartition("gid", "b1", "b2").sortWithinPartitions("gid", "b1", "b2", "rid")
    return dealt.mapInPandas(_verify(num, den), "u long, v long")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """Classes of near-duplicate texts of ``docs(doc_id, text, ...)``.

    Two documents are linked if ``den * |A & B| >= num * |A | B|`` for their
    sets of 5-word shingles.  Returns a row per row of ``docs``: doc_id,
    n_shingles, component_id (the smallest doc_id reachable), kept (it is that
    document), n_exact (rows with the same set).

    Null and empty texts have no shingles and are linked with nothing.  Rows
    that repeat a doc_id are one document and reported as often as they come.  A row with
    a null doc_id is compared by equal sets only: it joins the component of a row
    with an id and the same set.  If no such row has an id, the set isn't searched
    for near copies, component_id is null and kept is true for all rows that have
    it.  Other columns of ``docs`` are ignored, whatever their names."""
    ship(docs.sparkSession)
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sketch = staged(src.mapInPandas(_sketch, "doc_id long, n long, h1 long, h2 long, sig binary"), "nd-sketch")
    # One representative for each set of shingles: exact copies meet here, map-side first.
    classes = staged(
        sketch.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rid"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")),
        "nd-classes",
    )
    reps = classes.where("rid is not null").select("rid", "sig", "n")
    # Written once: counted and joined below, neither of which then runs beside Python.
    keys = staged(reps.select("rid", "sig").mapInPandas(_keys, "key long, rid long"), "nd-keys")
    # Keys with company; of keys with the same members, one.
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("low"), F.bit_xor(F.xxhash64("rid")).alias("who")).where("m > 1")
    some = full.groupBy("m", "low", "who").agg(F.min("key").alias("key")).select("key", "m", "low")
    members = staged(keys.join(unsent(some), "key").select("key", "rid", "m", "low"), "nd-members")
    few = members.where(F.col("m") <= BUCKET).select("key", "rid").join(unsent(reps.select("rid", "sig")), "rid")
    near = few.repartition("key").sortWithinPartitions("key", "rid").mapInPandas(_near_runs, "u long, v long")
    # A larger key isn't looked into: all its members are one group, compared in blocks below.
    hot = members.where(F.col("m") > BUCKET).selectExpr("rid as u", "low as v")
    groups = components(near.unionByName(hot), "nd-group").selectExpr("node as rid", "root as gid")
    groups = groups.join(unsent(reps.select("rid", "n")), "rid")
    sizes = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("gn"), F.sum("n").alias("gs"))
    blocks = F.greatest(F.ceil(F.col("gn") / BLOCK), F.ceil(F.col("gs") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    groups = _told(groups, sizes.select("gid", blocks.alias("nb")), ["gid"])
    groups = groups.withColumn("b", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"))
    firsts = src.join(unsent(groups.select("gid", "nb", "b", "rid")), src["doc_id"] == groups["rid"])
    firsts = staged(firsts.select("gid", "nb", "b", "rid", "text"), "nd-texts")
    inner = firsts.select("gid", F.col("b").alias("b1"), F.col("b").alias("b2"), F.lit(0).alias("side"), F.lit(-1).cast("long").alias("known"), "rid", "text")
    links = staged(_compare(inner, num, den), "nd-links")
    wide = firsts.where("nb > 1")
    if not wide.isEmpty():
        links = staged(links.unionByName(_pivoted(wide, links, num, den)), "nd-pivoted")
        links = links.unionByName(_across(_narrowed(wide, links, num, den), num, den))
    root = components(links, "nd-cc").selectExpr("node as rid", "root")
    named = classes.select("h1", "h2", "rid", "copies").join(unsent(root), "rid", "left").select("h1", "h2", F.coalesce("root", "rid").alias("cid"), "copies")
    named = staged(named, "nd-named")
    slim, on = sketch.select("doc_id", "n", "h1", "h2"), ["h1", "h2"]
    hot = named.where(F.col("copies") > HOT)
    if hot.limit(FEW + 1).count() > FEW:
        raise ValueError("too many sets of HOT rows to send: raise HOT")
    told = slim.join(F.broadcast(hot), on)
    rest = slim.join(F.broadcast(hot.select(*on)), on, "left_anti").join(unsent(named.where(F.col("copies") <= HOT)), on, "left")
    out = told.unionByName(rest)
    cid = F.when(F.col("n") > 0, F.col("cid")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        cid.alias("component_id"),
        F.coalesce(F.col("doc_id") == cid, cid.isNull()).alias("kept"),
        F.coalesce("copies", F.lit(1)).alias("n_exact"),
    )


def _pivoted(wide: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the blocks of large groups and some of their documents: of
    each group those with a small hash, ``PIVOTS`` on average, sent to all its
    blocks.  It only saves work: what no pivot links, ``_across`` compares."""
    root = components(links, "nd-inner").selectExpr("node as rid", "root")
    w = wide.join(unsent(root), "rid", "left").select("gid", "nb", "b", F.coalesce("root", "rid").alias("known"), "rid", "text")
    w = staged(w, "nd-members-known")
    chosen = w.where(F.pmod(F.xxhash64(F.lit(5), "rid"), F.col("nb") * BLOCK) < PIVOTS)
    sent = chosen.select("gid", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("to"), "b", "known", "rid", "text").where("to <> b")
    block = F.lit(-1).alias("b2")
    parts = w.select("gid", F.col("b").alias("b1"), block, F.lit(0).alias("side"), "known", "rid", "text").unionByName(sent.select("gid", F.col("to").alias("b1"), block, F.lit(1).alias("side"), "known", "rid", "text"))
    return _compare(parts, num, den)


def prefix(s: np.ndarray, count: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set of n, by ``count`` and then value, and which of them
    come so early that a linked set of n or more has one of them among its own first.

    With a similarity of t, a linked set has t * n of it at least: among all but so many
    there is one.  One that isn't smaller has 2 * t / (1 + t) * n.  Shingles counted
    once are left out: no other set has them."""
    n = len(s)
    first = np.lexsort((s, count))[: n - -(-num * n // den) + 1]
    early = np.arange(len(first)) < n - -(-2 * num * n // (num + den)) + 1
    shared = count[first] > 1
    return s[first][shared], early[shared]


def _slots(gid: int, s: np.ndarray) -> np.ndarray:
    return (mix64(s + np.uint64(gid & (2**64 - 1))) % np.uint64(SLOTS)).astype(np.int64)


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SLOTS, np.int64)
    for pdf in batches:
        for gid, text in zip(pdf["gid"].tolist(), pdf["text"], strict=True):
            np.add.at(total, _slots(gid, shingle_set(text)), 1)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"slot": at, "n": total[at]})


def _prefixes(sent: Broadcast, num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                keys, early, sizes = [], [], []
                for gid, text in zip(part["gid"].tolist(), part["text"], strict=True):
                    s = shingle_set(text)
                    k, e = prefix(s, sent.value[_slots(gid, s)], num, den)
                    keys.append(k.view(np.int64))
                    early.append(e)
                    sizes.append(len(s))
                if keys:
                    many = [len(k) for k in keys]
                    same = {c: np.repeat(x, many) for c, x in (("gid", part["gid"].to_numpy()), ("rid", part["rid"].to_numpy()), ("n", np.array(sizes, np.int64)))}
                    yield pd.DataFrame({**same, "key": np.concatenate(keys), "early": np.concatenate(early)})[["gid", "key", "rid", "n", "early"]]

    return run


def _told(rows: DataFrame, each: DataFrame, by: list[str]) -> DataFrame:
    """Rows (with rid) joined with what is known of their group.  A group is spread over
    ``SPREAD`` keys, so that a large one isn't one task's; its one row is repeated."""
    spread = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SPREAD)).cast("int")).join(unsent(spread), [*by, "salt"]).drop("salt")


def _unsettled(w: DataFrame) -> DataFrame:
    """Groups that the links so far don't connect."""
    return _told(w, w.groupBy("gid").agg((F.min("known") < F.max("known")).alias("open")).where("open").select("gid"), ["gid"])


def _narrowed(wide: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Of groups of several blocks what may still be linked across them: gid, nb, known
    (the component so far), rid, text.  Groups are cut where no prefix is shared; a
    bucket of a shingle gives one edge for each member, not its pairs.

    Shingles are counted by slots of a table of fixed size, added up over partitions
    first.  A count may be too high by others in its slot, never too low, and the
    order is the same for all documents of a group, so nothing is lost."""
    root = components(links, "nd-part").selectExpr("node as rid", "root")
    w = wide.join(unsent(root), "rid", "left").select("gid", F.coalesce("root", "rid").alias("known"), "rid", "text")
    w = staged(_unsettled(w), "nd-open")
    tally = w.select("gid", "text").mapInPandas(_tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    told = tally.toArrow()  # SLOTS rows at most; as columns these are 16 MB, as Row objects hundreds
    count = np.zeros(SLOTS, np.int32)
    count[told["slot"].to_numpy()] = np.minimum(told["n"].to_numpy(), 2**31 - 1)
    sent = w.sparkSession.sparkContext.broadcast(count)
    keys = staged(w.select("gid", "rid", "text").mapInPandas(_prefixes(sent, num, den), "gid long, key long, rid long, n long, early boolean"), "nd-prefix")
    # Two linked sets meet where the smaller has a shingle early.  The smallest such set
    # of a shingle stands for all: whoever isn't smaller than it is joined to it.
    low = F.min(F.when(F.col("early"), F.struct("n", "rid"))).alias("low")
    full = keys.groupBy("gid", "key").agg(F.count(F.lit(1)).alias("m"), low).where("m > 1 and low is not null").drop("m")
    edges = keys.join(unsent(full), ["gid", "key"]).where("n >= low.n").selectExpr("rid as u", "low.rid as v")
    cut = components(edges, "nd-cut").selectExpr("node as rid", "root as gid")
    w = _unsettled(w.drop("gid").join(unsent(cut), "rid"))
    size = w.groupBy("gid").agg(F.count(F.lit(1)).alias("gn"), F.sum(F.length("text")).alias("gs"))
    blocks = F.greatest(F.ceil(F.col("gn") / BLOCK), F.ceil(F.col("gs") / (6 * BLOCK_SHINGLES)), F.lit(1)).cast("int")
    return staged(_told(w, size.select("gid", blocks.alias("nb")), ["gid"]), "nd-narrowed")


def _across(w: DataFrame, num: int, den: int) -> DataFrame:
    """Links between blocks of groups of more than one block (of ``_narrowed``).

    What the blocks have shown to be connected is settled by a chain: documents
    are dealt into blocks anew, those of a large known component into blocks of
    their own, and two blocks of one component aren't compared."""
    per = w.groupBy("gid", "known").agg(F.count(F.lit(1)).alias("kn"))
    own = F.col("kn") >= BLOCK // 2
    of = per.groupBy("gid").agg(F.sum("kn").alias("gn"), F.sum(F.when(~own, F.col("kn")).otherwise(0)).alias("mixed"))
    w = _told(_told(w, per, ["gid", "known"]), of, ["gid"])
    # Blocks of a known component are named by it; those of mixed documents by -1.
    w = w.withColumn("own", F.when(own, F.col("known")).otherwise(F.lit(-1)))
    share = lambda n: F.ceil(F.col("nb") * n / F.col("gn"))
    w = w.withColumn("slot", F.when(own, F.pmod(F.xxhash64("rid"), share(F.col("kn")))).otherwise(F.pmod(F.xxhash64("known"), F.greatest(share(F.col("mixed")), F.lit(1)))).cast("int"))
    w = staged(w.select("gid", "own", "slot", "known", "rid", "text"), "nd-wide")
    made = w.select("gid", "own", "slot").distinct()
    ids = made.withColumn("blk", F.xxhash64("own", "slot"))
    left, right = ids.selectExpr("gid", "own as o1", "blk as b1"), ids.selectExpr("gid", "own as o2", "blk as b2")
    # Only what isn't settled: mixed blocks with each block, and blocks of different components.
    pairs = left.join(unsent(right), "gid").where("b1 <= b2 and (o1 <> o2 or o1 = -1)").select("gid", "b1", "b2")
    ends = pairs.selectExpr("gid", "b1", "b2", "b1 as blk", "0 as side").unionByName(pairs.where("b1 <> b2").selectExpr("gid", "b1", "b2", "b2 as blk", "1 as side"))
    parts = w.withColumn("blk", F.xxhash64("own", "slot")).select("gid", "blk", "known", "rid", "text").join(unsent(ends), ["gid", "blk"])
    return staged(_compare(parts.select("gid", "b1", "b2", "side", "known", "rid", "text"), num, den), "nd-across")


def keep_one(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """``docs`` without near copies: the document with the smallest doc_id of
    each component stays, with all rows that repeat it.  Rows with a null
    doc_id aren't compared beyond equal sets, and they share a fate: all stay,
    copies included, if one of them has no text or a set that no row with an id
    has; otherwise all go."""
    kept = near_duplicates(docs, num, den).where("kept").select("doc_id").distinct()
    return docs.join(unsent(kept), docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
