"""Small tables and the plain definitions that operators are held against."""

import random
import re

EDGE_DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, gid string, known string, score string, mix_slot string, __kept int, here int"


def edge_docs(spark, empty=False):
    """Nulls, an empty text, repeated rows, a long text, columns that clash."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", None),
        (4, "one two", None, "a"),
        (5, "Cc by and ALL rights reserved you idiot", "en", "b"),
        (5, "Cc by and ALL rights reserved you idiot", "en", "b"),
        (None, "a null id with a text of its own here", "en", "b"),
        (None, None, None, None),
        (6, long, "en", "a"),
        (7, long, "en", "b"),
        (8, "ñé ß \x00   İK 🙂", "es", "a"),
    ]
    full = [(i, t, la, s, None, None, "g", "k", "x", "y", 1, None) for i, t, la, s in rows]
    return spark.createDataFrame([] if empty else full, EDGE_DOCS)


def edge_pages(spark, empty=False):
    rows = [
        (1, None, None),
        (2, "", ""),
        (3, "https://EXAMPLE.org/en/12?x#y", "<p>one</p><p>two"),
        (3, "https://EXAMPLE.org/en/12?x#y", "<p>one</p><p>two"),
        (None, "http://a.example.com/fr/1", "<nav>menu</nav><p>one</p>" + "x" * 200),
        (4, "no scheme", "<p>one</p>" + "x" * 200),
        (5, "http://a.example.com/fr/1", "<article><p>a &amp; b</p></article>" + "y " * 100_000),
    ]
    return spark.createDataFrame([] if empty else [(i, u, h, "h", 1, None) for i, u, h in rows], "page_id long, url string, html string, host string, rid long, digest string")


def near_copies(seed=3, n=60):
    """Texts with exact copies, edited copies at all distances and loners."""
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(400)]
    out = []
    for k in range(6):
        base = [rng.choice(voc) for _ in range(rng.choice([8, 40, 120]))]
        for j in range(n // 6):
            w = list(base)
            for _ in range(j // 2):
                w[rng.randrange(len(w))] = rng.choice(voc)
            out.append((len(out), " ".join(w)))
    out += [(len(out) + i, " ".join(rng.choice(voc) for _ in range(30))) for i in range(10)]
    out += [(900, "too few words"), (901, "Too FEW  words"), (902, None), (903, ""), (904, " ")]
    rng.shuffle(out)
    return out


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows, num, den):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}
