import random
from collections import Counter

from fixtures import edge_pages

from trigrove.llm import html


def texts(spark, rows):
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>top</header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">we use cookies</div><script>var x = "<p>no</p>";</script><!-- <p>no</p> -->
<div id="content"><h1>A &amp; B</h1><p>one   <b>two</b>
three<br>four<p>caf&eacute; &#x1F642;&nbsp;x<ul><li>i<li>ii</ul><table><tr><td>c1<td>c2</table></div>
<aside>side</aside><div class="ad banner">buy</div><form>mail <input></form><section id="comments"><p>first!</p></section><footer>(c)</footer></body></html>"""


def kept(page, *kinds):
    return [x for x, k in zip(*html.blocks(page), strict=True) if k in (kinds or (html.OWN, html.OPEN))]


def test_structure():
    assert kept(PAGE) == kept(PAGE, html.OPEN) == ["A & B", "one two three", "four", "café \U0001f642 x", "i", "ii", "c1", "c2"]
    assert kept(PAGE, html.GONE) == ["top", "menu", "we use cookies", "side", "buy", "mail", "first!", "(c)"]


def test_marked_article_is_whole_and_alone():
    page = "<p>teaser</p><main><article><header><h1>T</h1></header><p>a</p><nav>n</nav><div class='comments'>c</div><p>b</article></main><p>after</p>"
    assert kept(page, html.OWN) == ["T", "a", "b"] and kept(page, html.OPEN) == ["teaser", "after"]


def test_articles_in_wrappers_and_articles_that_are_none():
    # A wrapper that only hints at a sidebar, a form around the whole page.
    for a, z in (("<div class='layout has-sidebar'>", "</div>"), ("<form>", "</form>"), ("<form><div class='with-menu'>", "</div></form>")):
        page = f"{a}<p>lead</p><article class='post has-share'><p>a</p><aside>s</aside></article><p>tail</p>{z}<p>end"
        assert kept(page) == ["a", "end"] and kept(page, html.OWN) == ["a"]
    # In what surely is boilerplate there is no article, and a comment is none.
    assert kept("<aside><article>x</article></aside><div class='related'><article>y</article></div><p>z") == ["z"]
    assert kept("<article>a</article><article class='comment odd'>c</article>") == ["a"]


def test_neighbours_share_boilerplate(spark):
    page = lambda x: f"<div>site name</div><p>{x}</p><div>all the same</div>"
    got = texts(spark, [(1, "http://a.example/x/1", page("one")), (2, "http://a.example/x/2", page("two")), (3, "http://a.example/y", page("three")), (4, "http://b.example/", page("alone")), (5, "http://a.example/x/3", f"<article>{page('four')}</article>")])
    assert (got[1], got[2], got[3]) == ("one", "two", "three")
    assert got[4] == "site name\nalone\nall the same" and got[5] == "site name\nfour\nall the same"


def test_copies_keep_their_text(spark):
    page = lambda x: f"<div>site name</div>{x}<div>all the same</div>"
    long = [f"<p>paragraph {i}" for i in range(6)]
    rows = [(i, f"http://a.example/x/1?q={i}", page("".join(long))) for i in range(40)]  # over several ranges
    rows += [(50, "http://a.example/x/1/print", page("".join(long[:5])))]  # a near copy
    rows += [(100 + i, f"http://a.example/{'a' if i == 0 else 'y'}/{i}", page(f"<p>own {i}")) for i in range(4)]
    got = texts(spark, rows)
    whole = [x[3:] for x in long]
    assert {got[i] for i in range(40)} == {"\n".join(whole)} and got[50] == "\n".join(whole[:5])
    assert [got[100 + i] for i in range(4)] == [f"own {i}" for i in range(4)]
    # A host of nothing but copies has nothing to differ from.
    assert set(texts(spark, [(i, "http://c.example/", page("<p>x")) for i in range(5)]).values()) == {"site name\nx\nall the same"}
    assert [r.text for r in html.main_text(edge_pages(spark)).collect() if r.page_id == 3] == ["one\ntwo"] * 2


def test_lines_outside_a_marked_article_are_differenced(spark):
    page = lambda x: f"<div>site name</div><p>lead of {x}</p><article><p>{x}</p><p>all the same</p></article><div>all the same</div>"
    got = texts(spark, [(i, f"http://a.example/{i}", page(f"page {i}")) for i in range(4)])
    # The site's lines go, but not the article's own; what only this page has stays.
    assert got == {i: f"lead of page {i}\npage {i}\nall the same" for i in range(4)}


def test_neighbours_are_the_nearest_of_other_lines(spark):
    rng = random.Random(7)
    for parts in (1, 4, 9):
        rows, rid = [], 0
        for host in "ab":
            for i in range(40):  # runs of copies of one line
                rows += [(rid := rid + 1, 0, i, host, f"/{i:03}", x, [x])] if (x := rng.choice([1, 1, 1, 1, 2])) else []
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r.k1: r.other for r in html.neighbours(spark.createDataFrame(rows, "k1 long, k2 long, page_id long, host string, path string, digest long, hashes array<long>")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        for k, (r, _, _, host, _, _, own) in enumerate(rows):
            reach = [*reversed(rows[:k]), *rows[k + 1 :]]
            assert got[r] == next((x[6] for x in reach if x[3] == host and x[6] != own), None)


def in_common(a, b):
    """Places of ``a`` in a longest common subsequence, by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_texts(pages):
    """pages: (page_id, host, path, [(line, kind)]) -> page_id: (text, shared, removed), by the definition."""
    out = {}
    for host in {p[1] for p in pages}:
        mine = sorted((p for p in pages if p[1] == host), key=lambda p: (p[2], p[0]))
        text = lambda p: tuple(x for x, k in p[3] if k)
        distinct = {text(p): p for p in mine}.values()
        on = Counter(x for p in distinct for x in {x for x, _ in p[3]})
        for k, p in enumerate(mine):
            other = next((q for q in [*reversed(mine[:k]), *mine[k + 1 :]] if text(q) != text(p)), None)
            both = in_common([x for x, _ in p[3]], [x for x, _ in other[3]]) if other else set()
            gone = {i for i in both if p[3][i][1] == html.OPEN and on[p[3][i][0]] >= 3 and 2 * on[p[3][i][0]] >= len(distinct)}
            out[p[0]] = ("\n".join(x for i, (x, kind) in enumerate(p[3]) if kind and i not in gone), len(both), len(gone))
    return out


def test_whole_pages_with_and_without_an_article_are_as_by_the_definition(spark):
    rng = random.Random(11)
    rows, plain = [], []
    for n in range(160):
        host, path = rng.choice(["a.example", "b.example", "c.example"]), f"/{rng.choice('xyz')}/{rng.randrange(30)}"
        if plain and rng.random() < 0.15:  # a copy, of this or another host
            page = rng.choice(plain)[3]
        else:
            page = [("home", html.GONE), ("site of " + host, html.OPEN)] * (rng.random() < 0.9)
            kind = rng.choice([html.OWN, html.OPEN])
            page = page + [(x, kind) for x in [f"text {n} {i}" for i in range(rng.randrange(4))] + ["quoted by many"] * rng.randrange(2)]
            page += [("read more", html.OPEN)] * rng.randrange(2) + [(f"rare {n % 7}", html.OPEN)] * rng.randrange(2) + [("imprint", html.GONE)]
        tag = {html.GONE: "nav", html.OWN: "p", html.OPEN: "div"}
        body = "".join(f"<article><p>{x}</p></article>" if k == html.OWN else f"<{tag[k]}>{x}</{tag[k]}>" for x, k in page)
        rows.append((n, f"http://{host}{path}?n={n % 3}", body))
        plain.append((n, host, path, page))
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = plain_texts(plain)
    assert {k: (r.text, r.n_shared, r.n_removed) for k, r in got.items()} == want
    # Nearly every page has something in common with its neighbour, and some of that is deleted.
    assert sum(w[1] > 0 for w in want.values()) > 140 and sum(w[2] for w in want.values()) > 100


def test_every_page_of_the_table_is_aligned(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    asked = []
    real = html.neighbours

    def counted(lines):
        out = real(lines)
        asked.append(out.where("hashes is not null").count())
        return out

    html.neighbours = counted
    try:
        html.main_text(pages).count()
    finally:
        html.neighbours = real
    assert asked == [pages.count()]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        taken = [x for x, t in zip(a, html.shared(a, b), strict=True) if t]
        it = iter(b)
        assert len(taken) == len(in_common(a, b)) and all(any(x == y for y in it) for x in taken)


def test_broken_markup_ends_and_keeps_text():
    assert kept("<p>a<b>b</p>c</b></div></div><p>d <i>e") == ["ab", "c", "d e"]
    assert html.blocks("a < b and c > d")[0] == ["a < b and c > d"]
    assert html.blocks("<script>never closed <p>x</p>")[0] == []
    assert html.blocks("x <a href='un")[0] == ["x"]
    assert html.blocks(None)[0] == html.blocks("")[0] == []


def test_edges(spark):
    got = html.main_text(edge_pages(spark)).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[1].url is None
    assert by[5].text.startswith("a & b") and by[5].n_chars == len(by[5].text)
    assert html.main_text(edge_pages(spark, empty=True)).count() == 0
