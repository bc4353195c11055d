"""Building an index, opening it, and answering requests."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import human
from ..functions.canonical import parse_number
from ..operators.terms import enum_values, field_stats, postings, term_stats, value_lengths, value_stats
from ..sources.tabular import read_source
from .search import Collection, Query, Range

MOST = 100_000  # matches that a request may page through, and that a total reports
LIMIT, MAX_LIMIT = 20, 1000
PARTS = 64  # files of the postings at least, by default
PART_TERMS = 1 << 20  # of documents whose postings are one file
META, TABLES = "meta.json", ("docs", "postings", "term_stats", "field_stats")


@dataclass(frozen=True)
class Imported:
    rows: int
    seconds: float
    per_source: dict[str, int]
    source_seconds: dict[str, float]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def build(spark: SparkSession, config: Config, docs: DataFrame | None = None, parts: int = PARTS, multiline: bool = True) -> Imported:
    """Builds the whole index anew: documents in order of _doc_id, postings in order
    of (field, term, _doc_id), statistics and metadata, under a version of its own.

    Sources are read one after the other, so that each has its time.  A document's
    terms are counted in its row, so postings are shuffled once, into ranges that no
    common term makes one task's.  Only when all is written does the metadata name
    the version: a bad boolean or a lost job leaves the old index in place.  Of older
    versions the last stays, for searches that still read it."""
    start, version = time.time(), f"v-{uuid.uuid4().hex[:12]}"
    root, fields = config.index_path.rstrip("/"), config.fields
    at = f"{root}/{version}"
    took: dict[str, float] = {}
    for i in range(len(config.sources) if docs is None else 1):
        since = time.time()
        part = read_source(spark, config, i, multiline) if docs is None else docs
        part.sortWithinPartitions("_doc_id").write.mode("append").parquet(f"{at}/docs")
        name = "" if docs is not None else config.sources[i].path.rsplit("/", 1)[-1]
        took[name] = took.get(name, 0.0) + time.time() - since
    d = spark.read.parquet(f"{at}/docs")

    def write_postings() -> None:
        order = ("field", "term", "_doc_id")
        lengths.result()
        terms = spark.read.parquet(f"{at}/field_stats").agg(F.sum("tokens")).first()[0] or 0
        postings(d, fields).repartitionByRange(max(parts, -(-terms // PART_TERMS)), *order).sortWithinPartitions(*order).write.parquet(f"{at}/postings")
        stats = term_stats(spark.read.parquet(f"{at}/postings")).unionByName(value_stats(d, fields))
        stats.sortWithinPartitions("field", "term").write.parquet(f"{at}/term_stats")

    def write_lengths() -> None:
        field_stats(d, fields).unionByName(value_lengths(d, fields)).coalesce(1).write.parquet(f"{at}/field_stats")

    def count_rows() -> dict[str, int]:
        return {r["_source"]: r["count"] for r in d.groupBy("_source").count().collect()}

    with ThreadPoolExecutor(4) as pool:  # jobs that don't wait for each other
        run = lambda job, *args: pool.submit(inheritable_thread_target(spark)(job), *args)
        lengths = run(write_lengths)
        written = [run(write_postings), lengths]
        found = {f.name: run(enum_values, d, f) for f in fields if f.type == "enum"}
        counted = run(count_rows)
        for job in written:
            job.result()
        enums, counts = {k: job.result() for k, job in found.items()}, counted.result()
    meta = {"version": version, "rows": sum(counts.values()), "per_source": counts, "fields": {k: {"values": v if config.named(k).values is None else [], "truncated": t} for k, (v, t) in enums.items()}}
    fs, top = _fs(spark, root)
    before = _metadata(spark, root).get("version")
    out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{META}"), True)
    out.write(bytearray(json.dumps(meta, indent=2).encode()))
    out.close()
    for s in fs.listStatus(top):
        name = s.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(s.getPath(), True)
    return Imported(meta["rows"], time.time() - start, counts, took if docs is None else dict.fromkeys(counts, took[""]))


def _metadata(spark: SparkSession, root: str) -> dict:
    """What the metadata says; of a missing file, nothing."""
    fs, path = _fs(spark, f"{root}/{META}")
    return json.loads(spark.read.text(f"{root}/{META}", wholetext=True).first()[0]) if fs.exists(path) else {"fields": {}}


def _latest(spark: SparkSession, root: str) -> str:
    """Without metadata: the version that was completed last."""
    fs, top = _fs(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done = [s for s in (fs.listStatus(top) if fs.exists(top) else []) if s.getPath().getName().startswith("v-") and all(fs.exists(path(f"{root}/{s.getPath().getName()}/{t}/_SUCCESS")) for t in TABLES)]
    if not done:
        raise FileNotFoundError(f"no index in {root}")
    return max(done, key=lambda s: s.getModificationTime()).getPath().getName()


def storage_memory(spark: SparkSession) -> int:
    """Bytes that executors have left to hold tables in."""
    left = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    total = 0
    while left.hasNext():
        total += left.next()._2()
    return total


class SearchEngine:
    """An opened index."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.started = spark, config, time.time()
        self.held: dict[str, DataFrame] = {}
        self.refresh()

    def refresh(self) -> None:
        """Opens the version that the metadata names now, or the last one if there is
        no metadata, and holds it in memory as far as the budget goes: the small
        tables first, and whole ones only.  No budget is what executors have free."""
        for d in self.held.values():
            d.unpersist()
        root = self.config.index_path.rstrip("/")
        self.meta = _metadata(self.spark, root)
        at = f"{root}/{self.meta.get('version') or _latest(self.spark, root)}"
        tables = {name: self.spark.read.parquet(f"{at}/{name}") for name in TABLES}
        sizes = {name: path_size(self.spark, f"{at}/{name}") for name in TABLES}
        budget = human.memory_budget(self.config.memory_budget, sum(sizes.values()))
        left = storage_memory(self.spark) if budget is None else budget
        self.held = {}
        for name in ("field_stats", "term_stats", "postings", "docs"):
            if sizes[name] <= left:
                left -= sizes[name]
                self.held[name] = tables[name] = tables[name].persist(StorageLevel.MEMORY_AND_DISK)
        self.collection = Collection(tables["docs"], self.config.fields, tables["postings"], tables["term_stats"], tables["field_stats"])

    def field_values(self) -> dict[str, dict]:
        """By field what a client may offer: values, and whether there are more."""
        out = {}
        for f in self.config.fields:
            if f.type == "boolean":
                got = {"values": ["TRUE", "FALSE"], "truncated": False}
            elif f.type == "enum" and f.values is not None:
                got = {"values": sorted({v.strip().upper() for v in f.values if v.strip()}), "truncated": False}
            else:
                got = self.meta["fields"].get(f.name, {"values": [], "truncated": False}) if f.type == "enum" else {"values": [], "truncated": False}
            if got["values"] or got["truncated"]:
                out[f.name] = got
        return out

    def _rows(self, hits: DataFrame, score: bool) -> list[dict]:
        rows = hits.orderBy("_rank").collect() if score else hits.collect()
        names = [f.name for f in self.config.fields] + ["_score"] * score
        return [{n: r[n] for n in names} for r in rows]

    def search(self, q: Query, pagination: bool = False) -> dict:
        start = time.time()
        seen = Observation() if pagination else None  # counts in the pass that ranks
        results = self._rows(self.collection.search(q, seen), True)
        # Where a filter can't hold, the plan is empty and nothing was counted.
        total = (seen.get["n"] if seen._jo.getRow().length() else 0) if pagination else None
        out = {"took_ms": round((time.time() - start) * 1000, 2), "total": len(results), "results": results}
        if total is not None:
            out["pagination"] = pagination_info(total, q.limit, q.offset, len(results))
        return out

    def lookup(self, filters: dict[str, str]) -> dict:
        start = time.time()
        results = self._rows(self.collection.lookup(tuple(filters.items())), False)
        return {"took_ms": round((time.time() - start) * 1000, 2), "total": len(results), "results": results}

    def stats(self) -> dict:
        root = self.config.index_path.rstrip("/")
        size, up = path_size(self.spark, root), int(time.time() - self.started)
        fields = self.field_values()
        try:
            with open("/proc/self/statm", encoding="ascii") as f:
                virtual, rss = (int(x) * 4096 for x in f.read().split()[:2])
            with open("/proc/meminfo", encoding="ascii") as f:
                memory = {k: int(v.split()[0]) * 1024 for k, _, v in (x.partition(":") for x in f)}
        except OSError:
            virtual = rss = 0
            memory = {}
        total, free = memory.get("MemTotal", 0), memory.get("MemAvailable", 0)
        return {
            "status": "online",
            "uptime_seconds": up,
            "uptime_human": human.duration(up),
            "documents": self.meta.get("rows", 0),
            "index": {"path": root, "size_bytes": size, "size_human": human.size(size), "segments": len(self.collection.posted.inputFiles()) if self.collection.posted is not None else 0},
            "memory": {"rss_bytes": rss, "rss_human": human.size(rss), "virtual_bytes": virtual, "virtual_human": human.size(virtual), "budget": self.config.memory_budget},
            "system": {"total_memory_bytes": total, "total_memory_human": human.size(total), "available_memory_bytes": free, "available_memory_human": human.size(free), "cpu_count": self.spark.sparkContext.defaultParallelism},
            "schema": {
                "fields": [
                    {"name": f.name, "type": f.type, "search": "fuzzy" if f.fuzzy else None, "values": fields.get(f.name, {}).get("values", []), "values_truncated": fields.get(f.name, {}).get("truncated", False)}
                    for f in self.config.fields
                ]
            },
        }


def pagination_info(matched: int, limit: int, offset: int, returned: int) -> dict:
    """Totals are capped; whether there is more isn't."""
    return {"offset": offset, "limit": limit, "returned": returned, "total": min(matched, MOST), "total_relation": "gte" if matched > MOST else "eq", "has_more": matched > offset + returned}


class BadRequest(ValueError):
    """A parameter that can't be read."""


def parse_search(params: dict[str, str]) -> tuple[Query, bool] | dict:
    """A query of request parameters, and whether totals are asked for; or the
    error that answers the request."""
    rest = dict(params)
    text = rest.pop("q", "")

    def whole(name: str, default: int) -> int:
        raw = rest.pop(name, None)
        if raw is None:
            return default
        if not raw.isascii() or not raw.removeprefix("+").isdigit():
            raise BadRequest(f"{name}: not a whole number")
        return int(raw)

    limit, offset = min(max(whole("limit", LIMIT), 1), MAX_LIMIT), whole("offset", 0)
    paged = rest.pop("include_pagination", "false")
    if paged not in ("true", "false"):
        raise BadRequest("include_pagination: neither true nor false")
    if offset + limit > MOST:
        return {"error": "pagination_window_too_large", "message": f"offset + limit must be <= {MOST}"}
    sort_by, order = rest.pop("sort_by", None), rest.pop("sort_order", None)
    bounds: dict[str, list[float | None]] = {}
    for key in [k for k in rest if k.endswith(("_min", "_max"))]:
        value = parse_number(rest.pop(key))
        if value is not None:
            bounds.setdefault(key[:-4], [None, None])[key.endswith("_max")] = value
    return Query(text, tuple(rest.items()), tuple(Range(f, *b) for f, b in bounds.items()), sort_by, order == "asc", limit, offset), paged == "true"


def search_request(engine: SearchEngine, params: dict[str, str]) -> dict:
    parsed = parse_search(params)
    if isinstance(parsed, dict):
        return parsed
    try:
        return engine.search(*parsed)
    except Exception as e:  # noqa: BLE001  errors are answers
        return {"error": str(e)}


def lookup_request(engine: SearchEngine, params: dict[str, str]) -> dict:
    try:
        return engine.lookup(params)
    except Exception as e:  # noqa: BLE001
        return {"error": str(e)}


def source_counts(docs: DataFrame) -> DataFrame:
    """Rows of each source."""
    return docs.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
