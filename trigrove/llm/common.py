"""What several operators share: table access, lineage cuts and components."""

from __future__ import annotations

import atexit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

_made: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, by a path that only Spark resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _drop_staged() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    Staged tables are deleted when the driver ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if not _made:
        atexit.register(_drop_staged)
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by a shuffle, never broadcast.

    Spark broadcasts what is small as stored.  Columns of ids and counts are stored in
    a tenth of the memory that they take as a broadcast, which the driver builds."""
    return rows.hint("merge")


EDGES = 200_000


def _settle(batches):
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"a": nodes, "p": [find(x) for x in nodes]}, dtype="int64")


def components(edges: DataFrame, name: str = "cc", limit: int = EDGES) -> DataFrame:
    """Connected components of ``edges(u, v)``: rows ``(node, root)`` for every
    node of an edge, ``root`` being the smallest id of its component.

    Every round hooks each node on its smallest neighbour below it (a minimum,
    combined map-side, so a star's centre is no hot group), jumps pointers until
    each hangs on a root, and contracts the edges.  Rounds fall off
    logarithmically and each is written out, so lineage stays short.  Once at
    most ``limit`` edges are left, one task of that bound settles them.  Self
    loops (no node by themselves) and repeated edges are harmless, null ends are
    ignored."""
    e = edges.where("u <> v").selectExpr("greatest(u, v) as a", "least(u, v) as b").distinct()
    e = staged(e, f"{name}-edges")
    root = e.selectExpr("explode(array(a, b)) as node").distinct().selectExpr("node", "node as root")
    while e.limit(limit + 1).count() > limit:
        hook = staged(e.groupBy("a").agg(F.min("b").alias("p")), f"{name}-hook")
        while True:
            up = hook.selectExpr("a as p", "p as q")
            nxt = hook.join(unsent(up), "p", "left").selectExpr("a", "coalesce(q, p) as p", "q is not null as moved")
            nxt = staged(nxt, f"{name}-jump")
            hook = nxt.select("a", "p")
            if nxt.where("moved").isEmpty():
                break
        root = staged(_rooted(root, hook), f"{name}-root")
        e = (
            e.join(unsent(hook.selectExpr("a", "p as ra")), "a", "left")
            .selectExpr("coalesce(ra, a) as a", "b")
            .join(unsent(hook.selectExpr("a as b", "p as rb")), "b", "left")
            .selectExpr("a", "coalesce(rb, b) as b")
            .where("a <> b")
            .selectExpr("greatest(a, b) as a", "least(a, b) as b")
            .distinct()
        )
        e = staged(e, f"{name}-edges")
    last = e.coalesce(1).mapInPandas(_settle, "a long, p long")
    return staged(_rooted(root, last), f"{name}-root")


def _rooted(root: DataFrame, hook: DataFrame) -> DataFrame:
    return root.join(unsent(hook.selectExpr("a as root", "p")), "root", "left").selectExpr("node", "coalesce(p, root) as root")


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings as objects: an Arrow-backed column of several chunks can't be
    handed back to Spark."""
    for c in pdf.columns:
        if isinstance(pdf[c].dtype, pd.StringDtype):
            pdf[c] = pdf[c].astype(object)
    return pdf


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Forest:
    """Union-find over 0..n-1 that keeps the edges which joined two trees."""

    def __init__(self, n: int):
        self.up, self.left, self.edges = list(range(n)), n, []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.left -= 1
        self.edges.append((x, y))
        return True
