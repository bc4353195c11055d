"""Canonical forms, request parsing, budgets and what people read.

The budgets, aliases and pagination figures below are fixed values: results that
clients of such a service rely on."""

import pytest
from pyspark.sql import functions as F

from trigrove.config import Config, Field
from trigrove.functions import canonical as c
from trigrove.functions import human
from trigrove.plans.engine import BadRequest, pagination_info, parse_search
from trigrove.plans.search import Range
from trigrove.plans.service import authorized

CONFIG = """
[server]
index_path = "/nowhere"
[schema]
fields = [
  { name = "name", type = "text", search = "fuzzy" },
  { name = "kind", type = "enum", values = ["b", " a "] },
  { name = "city", type = "enum", values = "auto", max_values = 2 },
  { name = "id", type = "keyword" },
]
[[sources]]
path = "a.csv"
mapping = { name = "n" }
use_mapping = "shared"
[[sources]]
path = "b.csv"
mapping = { name = "n" }
use_mapping = "unknown"
defaults = { kind = "x" }
[mappings.shared]
name = "other"
"""


def test_enum_and_boolean_literals():
    assert c.filter_value(Field("f", "enum"), "  board chair ") == "BOARD CHAIR"
    b = Field("f", "boolean")
    assert [c.filter_value(b, v) for v in ("yes", "0", " T ", "n", "", "perhaps")] == ["TRUE", "FALSE", "TRUE", "FALSE", None, "PERHAPS"]
    assert c.filter_value(Field("f", "number"), "5") is None
    assert c.filter_values(Field("f", "keyword"), " a ,,b,a") == ["a", "b", "a"]


def test_columns(spark):
    rows = [(0, "  board chair "), (1, "　\t"), (2, None), (3, "10.5"), (4, " 12"), (5, "1e3"), (6, "1d"), (7, "NaN"), (8, "-inf"), (9, ".5"), (10, "+5."), (11, "0x1p3"), (12, ""), (13, "1_000")]
    d = spark.createDataFrame(rows, "k int, s string")
    got = {r.k: r for r in d.select("k", c.enum_value(F.col("s")).alias("e"), c.number_value(F.col("s")).alias("n")).collect()}
    assert (got[0].e, got[1].e, got[2].e) == ("BOARD CHAIR", None, None)
    assert [got[k].n for k in (3, 4, 5, 6, 9, 10, 11, 12, 13, 2)] == [10.5, 0.0, 1000.0, 0.0, 0.5, 5.0, 0.0, 0.0, 0.0, 0.0]
    assert got[7].n != got[7].n and got[8].n == float("-inf")
    shown = [r[0] for r in d.where("k in (3, 7, 8, 12)").select(c.shown_value(Field("f", "number"), c.number_value(F.col("s")))).collect()]
    assert shown == [10.5, None, None, None]
    with pytest.raises(Exception, match="invalid boolean value: 10.5"):
        d.where("k = 3").select(c.boolean_value(F.col("s"))).collect()


def test_trigrams_are_those_of_three_lines_of_python(spark):
    texts = ["", "a", "ab", "abc", "Ab Cd", "ñéß🙂x\ty", "aaaa", None, "x" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = {r.k: r.g for r in d.select("k", c.trigrams(F.col("s")).alias("g")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == (None if t is None else [t.lower()[i : i + 3] for i in range(len(t) - 2)])
    assert c.query_trigrams("aaaa") == {"aaa": 2} and not c.query_trigrams("ab")


def test_words_are_short_runs_of_letters_and_digits(spark):
    d = spark.createDataFrame([("Ab-c1 ñé_x " + "y" * 40,)], "s string")
    assert d.select(c.text_words(F.col("s"))).first()[0] == ["ab", "c1", "ñé", "x"]


def test_memory_budget():
    cases = [("100%", 1000, None), ("unlimited", 1000, None), ("50%", 1000, 500), ("512MB", 0, 536870912), ("2GB", 0, 2147483648), ("10%", 571473920, 57147392), ("1kb", 0, 1024), ("77", 0, 77), ("bad", 5, None), ("x%", 1000, None), ("0", 5, None)]
    assert [(b, s, human.memory_budget(b, s)) for b, s, _ in cases] == cases


def test_sizes_and_durations():
    assert [human.size(n) for n in (1 << 30, 1 << 20, 1 << 10, 1)] == ["1.00 GB", "1.0 MB", "1 KB", "1 B"]
    assert human.size(1536, "") == "2KB"
    assert [human.duration(s) for s in (5, 65, 3661, 90_000, 62 * 86400)] == ["5s", "1m 5s", "1h 1m 1s", "1d 1h", "2mo 2d"]


def test_pagination_is_capped_but_has_more_is_not():
    assert pagination_info(100_025, 1000, 99_000, 1000) == {"offset": 99_000, "limit": 1000, "returned": 1000, "total": 100_000, "total_relation": "gte", "has_more": True}
    assert pagination_info(3, 2, 1, 2)["has_more"] is False


def test_requests():
    q, paged = parse_search({"q": "Ab ", "limit": "5000", "offset": "3", "rev_min": "10", "rev_max": "x", "a_max": "1e2", "city": "x", "sort_by": "rev", "sort_order": "asc", "include_pagination": "true"})
    assert (q.text, q.limit, q.offset, q.sort_by, q.ascending, q.filters, paged) == ("Ab ", 1000, 3, "rev", True, (("city", "x"),), True)
    assert set(q.ranges) == {Range("rev", 10.0, None), Range("a", None, 100.0)}
    assert parse_search({"sort_by": "a", "sort_order": "ASC"})[0].ascending is False
    assert parse_search({"limit": "0"})[0].limit == 1 and parse_search({})[0].limit == 20
    assert parse_search({"offset": "99990", "limit": "20"})["error"] == "pagination_window_too_large"
    for bad in ({"limit": "x"}, {"offset": "-1"}, {"include_pagination": "1"}):
        with pytest.raises(BadRequest):
            parse_search(bad)


def test_config():
    cfg = Config.parse(CONFIG)
    assert (cfg.port, cfg.memory_budget, cfg.auth_token) == (8888, "100%", None)
    assert cfg.sources[0].resolved(cfg.mappings) == {"name": "other"}
    assert cfg.sources[1].resolved(cfg.mappings) == {"name": "n"}
    assert cfg.named("kind").values == ("b", " a ") and cfg.named("city").values is None and cfg.named("city").max_values == 2
    for bad in ('type = "int"', 'type = "text", search = "near"'):
        with pytest.raises(ValueError):
            Config.parse(CONFIG.replace('type = "keyword"', bad))


def test_authorization():
    assert authorized(None, "/search", None, "") and authorized("t", "/health", None, "") and authorized("t", "/", None, "")
    assert authorized("t", "/search", "Bearer t", "") and authorized("t", "/search", None, "q=x&token=t")
    assert authorized("t", "/search", "Bearer  t ", "") and not authorized("t", "/search", "t", "")
    assert not authorized("t", "/search", "Bearer x", "token=tt") and not authorized("t", "/stats", None, "")
