"""From CSV files to answers."""

import json
import math
import random
import threading
import urllib.error
import urllib.request
from collections import Counter
from dataclasses import replace

import pytest

from trigrove.config import Config, Field, Source
from trigrove.operators import terms
from trigrove.plans import search
from trigrove.plans.engine import SearchEngine, build, lookup_request, path_size, search_request
from trigrove.plans.search import Collection, Query, Range
from trigrove.plans.service import server
from trigrove.sources import tabular
from trigrove.sources.tabular import read_source

FIELDS = (Field("name", "text", True), Field("org", "keyword"), Field("rev", "number"), Field("flag", "boolean"), Field("note", "text"), Field("city", "enum"))
RAGGED = 'name,org,rev,flag,name\n"Comma, Inc",o1,10.5,yes,second\nShort,o2\n"",o3,,0\nLong,o4,1e3,T,x,extra\n\nPadded, o5 ,\' 12\',N,\n"Line\nfeed",o6, 12,,\n"Say ""hi""",o7,1d,1,\n'


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    top = tmp_path_factory.mktemp("csv")
    (top / "a.csv").write_text(RAGGED)
    (top / "b.csv").write_text("id,title,where,txt\nb1,Comet Works,oslo,Fine words here\nb2,Comma Works, bergen ,\n")
    return Config(
        FIELDS,
        (
            Source(str(top / "a.csv"), {"name": "name", "org": "org", "rev": "rev", "flag": "flag"}, {"rev": "7", "city": " oslo ", "org": "unused"}),
            Source(str(top / "b.csv"), {}, {"rev": "1"}, "second"),
        ),
        {"second": {"name": "title", "org": "id", "city": "where", "note": "txt"}},
        str(top / "index"),
    )


@pytest.fixture(scope="module")
def engine(spark, config):
    done = build(spark, config, parts=4)
    assert done.rows == 9 and done.per_source == {"a.csv": 7, "b.csv": 2}
    return SearchEngine(spark, config)


def test_ragged_rows_defaults_and_first_header(spark, config):
    rows = {r.org: r for r in read_source(spark, config, 0).collect()}
    assert rows["o1"].name == "Comma, Inc" and rows["o1"].rev == 10.5 and rows["o1"].flag is True
    assert rows["o2"].rev == 7.0 and rows["o2"].flag is None  # too short: the default
    assert rows["o3"].name is None and rows["o3"].rev == 0.0  # there but empty: no default
    assert rows["o4"].rev == 1000.0 and rows[" o5 "].flag is False and rows["o6"].name == "Line\nfeed"
    assert rows["o7"].name == 'Say "hi"' and rows["o7"].rev == 0.0
    assert {r.city for r in rows.values()} == {"OSLO"} and len(rows) == 7


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_a_file_is_read_in_pieces_like_as_a_whole(spark, tmp_path, ends):
    """Cells over many lines, quotes that open nothing, blank lines, files without an end."""
    rng = random.Random(3)
    some = ["a", "", "b c", '"x, y"', '"two{}lines"', '"{}{}{}"', '5" pipe', 'a"b"', '"say ""hi"""', '"so"me', '"so"me "more"', ' "p"', '"', '""', "é", '"' + "long {}" * 20 + '"']
    top = tmp_path / "many"
    top.mkdir()
    for name in "cab":
        lines = [",".join(rng.choice([x for x in some if x != '"' or rng.random() < 0.1]).replace("{}", ends) for _ in range(rng.randint(1, 4))) for _ in range(120)]
        (top / f"{name}.csv").write_bytes(("k,l" + ends + ends.join(lines) + ends * (name != "b")).encode())
    schema, options = tabular._options(3, True)
    plain = lambda r: tuple(x and x.replace("\r\n", "\n") for x in r)  # noqa: E731  the raw record, of which only separators are counted, may have either
    want = []
    for name in "abc":
        want += [plain(r) for r in spark.read.schema(schema).options(header=True, **options).csv(str(top / f"{name}.csv")).collect()]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("400", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = tabular.cells(spark, str(top), 3, True)
            tasks = got.rdd.getNumPartitions()
            rows = got.orderBy("_place").collect()
            assert [plain(r[1:]) for r in rows] == want
            pieces = Counter(r._place >> tabular.BITS for r in rows)
            assert all(sorted(r._place & tabular.LAST for r in rows if r._place >> tabular.BITS == p) == list(range(n)) for p, n in pieces.items())
            assert tasks > 3 or size == "100000"
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_ids_follow_sources_then_records(engine):
    ids = [r.org for r in engine.collection.docs.orderBy("_doc_id").collect()]
    assert ids == ["o1", "o2", "o3", "o4", " o5 ", "o6", "o7", "b1", "b2"]


def test_search_finds_misspelt_names_and_shows_values(engine):
    out = engine.search(Query("coma works"), pagination=True)
    assert [r["name"] for r in out["results"]][:2] == ["Comma Works", "Comet Works"]
    best = out["results"][0]
    assert best["flag"] is None and best["note"] == "" and best["rev"] == 1.0 and best["_score"] > 0
    assert out["total"] == len(out["results"]) == out["pagination"]["total"] and out["took_ms"] >= 0
    assert engine.search(Query("co"))["total"] == 9  # too short: browse
    zero = engine.search(Query(filters=(("org", "o3"),)))["results"][0]
    assert zero["rev"] is None and zero["name"] == ""


def test_a_stored_index_ranks_like_the_documents_do(engine):
    plain = Collection(engine.collection.docs, FIELDS)
    for q in (Query("comma wrks", limit=5), Query("say", (("city", "oslo,BERGEN"),), (Range("rev", None, 10),)), Query(filters=(("note", "words"),))):
        key = lambda c, q=q: sorted((r._rank, r._doc_id, r._score) for r in c.search(q).collect())
        assert key(engine.collection) == key(plain)


@pytest.mark.parametrize("literals", [0, 100])
def test_score_is_bm25(spark, monkeypatch, literals):
    monkeypatch.setattr(search, "LITERALS", literals)
    d = spark.createDataFrame([(1, "abcd", ""), (2, "abcabc", ""), (3, "zzz", ""), (4, None, "")], "_doc_id long, name string, _source string")
    got = {r._doc_id: r._score for r in Collection(d, (Field("name", "text", True),)).search(Query("abcx")).collect()}
    avg = (2 + 4 + 1 + 0) / 4
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    want = {i: idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) for i, tf, dl in ((1, 1, 2), (2, 2, 4))}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_numeric_pages_are_cut_from_the_whole(spark):
    rows = [(i, c, r, n, "") for i, (c, r, n) in enumerate([("OSLO", 200.0, "A"), ("OSLO", 150.0, "B"), ("OSLO", 120.0, "C"), ("BERGEN", 500.0, "D")])]
    fields = (Field("city", "enum"), Field("revenue", "number"), Field("name", "keyword"))
    c = Collection(spark.createDataFrame(rows, "_doc_id long, city string, revenue double, name string, _source string"), fields)
    q = Query(filters=(("city", "oslo"),), ranges=(Range("revenue", 100.0),), sort_by="revenue", limit=2, offset=1)
    assert [(r.revenue, r._score) for r in sorted(c.search(q).collect(), key=lambda r: r._rank)] == [(150.0, 150.0), (120.0, 120.0)]
    assert c.count(q) == 3


def test_strings_sort_only_the_page(engine):
    out = engine.search(Query(sort_by="org", limit=3))
    assert [r["org"] for r in out["results"]] == ["o3", "o2", "o1"]
    up = engine.search(Query(sort_by="org", ascending=True, limit=3, offset=6))
    assert [r["org"] for r in up["results"]] == ["b1", "b2", "o7"]


def test_lookup_takes_the_first_and_no_lists(engine):
    assert engine.lookup({"city": "oslo"})["results"][0]["org"] == "o1"
    assert "_score" not in engine.lookup({"city": "oslo"})["results"][0]
    assert engine.lookup({"org": "o1,o2"})["total"] == 0 and engine.search(Query(filters=(("org", "o1,o2"),)))["total"] == 2
    assert engine.lookup({"rev": "7"})["total"] == 0 and engine.lookup({})["total"] == 0


def test_filters_that_never_fit(engine):
    assert engine.search(Query(filters=(("org", " o5 "),)))["total"] == 0  # stored with its blanks
    assert engine.search(Query(filters=(("flag", "perhaps"),)))["total"] == 0
    assert engine.search(Query(filters=(("nothing", "x"), ("rev", "5"), ("org", " , "))))["total"] == 9
    assert engine.search(Query(ranges=(Range("rev", None, 5.0),)))["total"] == 6  # absent numbers are 0


def test_requests_answer_errors(engine):
    assert "error" in search_request(engine, {"org_min": "1"})
    assert search_request(engine, {"offset": "100000"})["error"] == "pagination_window_too_large"
    assert lookup_request(engine, {"org": "b2"})["results"][0]["name"] == "Comma Works"


def test_a_bad_boolean_leaves_the_old_index(spark, config, engine, tmp_path):
    (tmp_path / "bad.csv").write_text("flag\nperhaps\n")
    bad = Config(FIELDS, (Source(str(tmp_path / "bad.csv"), {"flag": "flag"}),), {}, config.index_path)
    with pytest.raises(Exception, match="invalid boolean value"):
        build(spark, bad)
    engine.refresh()
    assert engine.search(Query())["total"] == 9


def test_stats_and_field_values(engine):
    s = engine.stats()
    assert s["status"] == "online" and s["documents"] == 9 and s["index"]["size_bytes"] > 0
    assert engine.field_values() == {"flag": {"values": ["TRUE", "FALSE"], "truncated": False}, "city": {"values": ["BERGEN", "OSLO"], "truncated": False}}
    assert [f["name"] for f in s["schema"]["fields"]] == [f.name for f in FIELDS]


def test_http(engine):
    with server(engine, 0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        top = f"http://127.0.0.1:{http.server_port}"
        read = lambda p: json.loads(urllib.request.urlopen(top + p, timeout=60).read())  # noqa: E731,S310
        assert read("/health") == {"status": "ok"}
        assert read("/search?q=comet&limit=1")["results"][0]["org"] == "b1"
        assert read("/lookup?org=o7")["results"][0]["name"] == 'Say "hi"'
        for path, code in (("/nothing", 404), ("/search?limit=x", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(top + path, timeout=60)  # noqa: S310
            assert e.value.code == code
        http.shutdown()


def test_terms_are_counted_in_place_as_by_cutting(spark, monkeypatch):
    rows = [(1, "aaaa aba ababa"), (2, "ñañ ñañañ 🙂a🙂a🙂"), (3, "A.B\\Q\\E.. a+a+a"), (4, None), (5, ""), (6, "ab"), (7, "xyz XYZ xyzxyz")]
    docs = spark.createDataFrame(rows, "_doc_id long, t string")
    for fuzzy in (True, False):
        f = (Field("t", "text", fuzzy),)
        every = sorted(terms.postings(docs, f).collect())
        wanted = sorted({r.term for r in every} | {"zzz", "aa", "Aaa"})
        assert sorted(terms.postings(docs, f, {"t": wanted}).collect()) == every and every
        with monkeypatch.context() as m:
            m.setattr(terms, "DIRECT", 0)
            assert sorted(terms.postings(docs, f, {"t": wanted}).collect()) == every


def test_a_header_of_many_lines_is_read_whole(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"a' + "\n" * 500 + 'b",name\n1,x\n')
    assert tabular.header(spark, str(tmp_path / "h.csv")) == ["a" + "\n" * 500 + "b", "name"]
    (tmp_path / "one.csv").write_text("\n\nname")
    assert tabular.header(spark, str(tmp_path / "one.csv")) == ["name"]


def test_bytes_that_are_not_utf8_are_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"name\n\xff\xfe\n")
    with pytest.raises(ValueError, match="not UTF-8"):
        read_source(spark, Config(FIELDS, (Source(str(tmp_path / "bad.csv"), {"name": "name"}),)), 0)
    (tmp_path / "fine.csv").write_text("name\n� mark\n")
    assert read_source(spark, Config(FIELDS, (Source(str(tmp_path / "fine.csv"), {"name": "name"}),)), 0).first().name == "� mark"


def test_fuzzy_keywords_count_beside_fuzzy_texts(spark):
    d = spark.createDataFrame([(1, "hello", "zzz", ""), (2, "other", "hel", ""), (3, "none", None, "")], "_doc_id long, name string, code string, _source string")
    c = Collection(d, (Field("name", "text", True), Field("code", "keyword", True)))
    got = {r._doc_id: r._score for r in c.search(Query("hel")).collect()}
    assert set(got) == {1, 2}
    assert got[2] == pytest.approx(math.log(1 + 2.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 2)))


def test_a_budget_holds_small_tables_first(spark, config, engine):
    assert set(engine.held) == {"docs", "postings", "term_stats", "field_stats"}  # no limit: everything
    at = f"{config.index_path}/{engine.meta['version']}"
    size = {t: path_size(spark, f"{at}/{t}") for t in ("field_stats", "term_stats")}
    for budget, held in ((sum(size.values()), {"field_stats", "term_stats"}), (size["field_stats"], {"field_stats"}), (1, set())):
        some = SearchEngine(spark, replace(config, memory_budget=str(budget)))
        assert set(some.held) == held
        assert some.search(Query("coma works"))["results"] == engine.search(Query("coma works"))["results"]
        for d in some.held.values():
            d.unpersist()


def test_totals_come_with_the_page(engine):
    assert engine.search(Query("comma", limit=1), pagination=True)["pagination"]["total"] == engine.collection.count(Query("comma"))
    for none in (Query(filters=(("flag", "perhaps"),)), Query("qqqq"), Query(filters=(("note", "nowhere"),))):
        got = engine.search(none, pagination=True)
        assert got["total"] == got["pagination"]["total"] == 0
    assert engine.search(Query(offset=50), pagination=True)["pagination"]["total"] == 9


def test_a_page_reads_only_the_documents_around_it(engine):
    plan = engine.collection.search(Query("comet", limit=2))._jdf.queryExecution().optimizedPlan().toString()
    assert "_doc_id" in plan and ">=" in plan and "<=" in plan


def test_without_metadata_the_last_version_is_opened(spark, tmp_path):
    fields = (Field("name", "text", True), Field("kind", "enum"))
    docs = spark.createDataFrame([(5, "alpha", "A", "s"), (3, "beta", "B", "s")], "_doc_id long, name string, kind string, _source string")
    config = Config(fields, index_path=str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        SearchEngine(spark, config)
    assert build(spark, config, docs, parts=2).source_seconds.keys() == {"s"}
    build(spark, config, docs.limit(1), parts=2)
    build(spark, config, docs, parts=2)
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("v-")]) == 2  # this and the one before
    assert SearchEngine(spark, config).field_values() == {"kind": {"values": ["A", "B"], "truncated": False}}
    (tmp_path / "index" / "meta.json").unlink()
    for p in (tmp_path / "index").glob(".meta*"):
        p.unlink()
    bare = SearchEngine(spark, config)
    assert bare.field_values() == {} and bare.search(Query("alpha"))["total"] == 1
    (tmp_path / "index" / "meta.json").write_text("{")
    with pytest.raises(json.JSONDecodeError):
        SearchEngine(spark, config)


def test_terms_are_tallied_as_python_counts(spark):
    texts = ["a b a c a", "", "x", " ".join(f"w{i % 7}" for i in range(500))]
    d = spark.createDataFrame(list(enumerate(texts)), "_doc_id long, t string")
    got = {(r._doc_id, r.term): (r.tf, r.dl) for r in terms.postings(d, (Field("t", "text"),)).collect()}
    assert got == {(i, w): (n, len(t.split())) for i, t in enumerate(texts) for w, n in Counter(t.split()).items()}
