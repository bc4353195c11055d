"""URL filters: pattern rules behind an index of their rarest literal tokens.

A rule is a regular expression over host + path, made of a host and path, of words or
of a line in the usual syntax of block lists (see ``pattern_rule``).  Each rule is
filed under that of its literal tokens which is rarest among the URLs of the table; a
URL's tokens fetch the rules filed under them, and only those are run.  DataFrame
functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BEYOND = r"\x{80}-\x{10ffff}"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
INDEX_RULES = 2000  # rules that are held in the plan; more are joined as a table


@dataclass(frozen=True)
class Rule:
    """``tokens``: literal words (a-z, 0-9, beyond ASCII) which any URL that the
    rule fits has whole; without any, the rule is run on every URL.  Of the rules
    that fit, the longest of the highest rank wins, then the least name."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    rank: int = 0

    @property
    def size(self) -> int:
        return len(self.name)


def host_rule(host: str, path: str, action: str, rank: int = 1) -> Rule:
    """Fits a host and its subdomains where the path starts with ``path``."""
    whole = path[: path.rfind("/") + 1]  # its last word may be part of the URL's
    tokens = [t for t in re.split(r"[^a-z0-9\u0080-\U0010ffff]+", _lower(host + whole)) if t]
    return Rule(host + path, action, r"(?s)^(?:[^/]*\.)?" + _quote(host + path), tuple(tokens), rank)


def word_rule(*words: str) -> Rule:
    """Blocks hosts that have these words next to each other."""
    name = "-".join(words)
    return Rule(name, "block", rf"(?s)^(?:[^/]*[^a-z0-9/{_BEYOND}])?" + f"[^a-z0-9/{_BEYOND}]".join(map(_quote, words)) + rf"(?:[^a-z0-9{_BEYOND}].*)?$", tuple(words), -1)


def pattern_rule(line: str) -> Rule:
    """A rule of a block list.  ``||`` at its start stands for a host or its
    subdomains, ``|`` at its start or end for that of the URL (without scheme and
    query), ``*`` for anything, ``^`` for a character that no word has, or the end; all
    else for itself, whatever the case of A-Z.  ``@@`` before it makes an exception,
    which outranks blocks.  A line within slashes is a regular expression, which has no
    literal tokens.  Options (``$``) are an error."""
    text, action = (line.strip().removeprefix("@@"), "allow") if line.strip().startswith("@@") else (line.strip(), "block")
    rank = 0 if action == "allow" else -1
    if len(text) > 2 and text.startswith("/") and text.endswith("/") and re.search(r"[\\^$*+?()\[{|]", text):
        return Rule(line.strip(), action, text[1:-1], (), rank)
    if "$" in text:
        raise ValueError(f"options aren't supported: {line}")
    start, end = "", ""
    if text.startswith("||"):
        start, text = r"^(?:[^/]*\.)?", text[2:]
    elif text.startswith("|"):
        start, text = "^", re.sub(r"(?i)^[a-z][a-z0-9+.-]*://", "", text[1:])
    if text.endswith("|"):
        end, text = "$", text[:-1]
    if not text.strip("*^"):
        raise ValueError(f"no pattern: {line}")
    edge = f"(?:[^a-zA-Z0-9_.%{_BEYOND}-]|$)"
    regex = "(?is)" + start + "".join(".*" if c == "*" else edge if c == "^" else _quote(c) for c in text) + end
    # A run of word characters is a whole token if what is next to it can't be one's.
    framed = ("^" if start else "*") + _lower(text) + ("^" if end else "*")
    tokens = re.findall(r"(?<=[^a-z0-9\u0080-\U0010ffff*])[a-z0-9\u0080-\U0010ffff]+(?=[^a-z0-9\u0080-\U0010ffff*])", framed)
    return Rule(line.strip(), action, regex, tuple(tokens), rank)


def load(text: str) -> tuple[Rule, ...]:
    """Rules of a block list: a pattern a line; blank lines and those that start with
    ! or # don't count."""
    return tuple(pattern_rule(x) for x in text.splitlines() if x.strip() and x.lstrip()[0] not in "!#")


def _quote(s: str) -> str:
    return re.sub(r"([^\w\s/])", r"\\\1", s, flags=re.A) if s.isascii() else re.escape(s)


def _lower(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _UPPER.lower()))


BASE = (
    host_rule("org", "/", "allow"),
    host_rule("example.org", "/es/", "block"),
    host_rule("example.org", "/en/1", "block"),
    host_rule("com", "/fr/", "allow"),
    host_rule("com", "/de/", "block"),
)
#: Kinds of host, and addresses, that are of no use as text.
WORDS = tuple(
    tuple(w.split())
    for w in ("casino", "casino win", "free bets", "bets", "poker", "pills", "cheap pills", "viagra", "spam", "spam farm", "link farm", "ads", "ads track", "adserver", "tracker", "porn", "xxx", "escorts", "warez", "torrent")
)
LIST = """
||doubleclick.net^
||googlesyndication.com^
/wp-login.php|
/xmlrpc.php|
"""
PATTERNS = (*(word_rule(*w) for w in WORDS), *load(LIST))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end, A-Z
    lower-cased; then up to ? # or the end.  Both empty for null or without."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.translate(target, _UPPER, _UPPER.lower()), r"[^a-z0-9\x{80}-\x{10ffff}]+"))


def _filed(urls: DataFrame, rules: list[Rule]) -> list[tuple[str | None, Rule]]:
    """Each rule with its literal token that the fewest URLs have."""
    spark = urls.sparkSession
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return [(None, r) for r in rules]
    if len(known) <= INDEX_RULES:
        there = urls.select(F.explode(F.array_intersect(_tokens(F.col("target")), F.array(*map(F.lit, known)))).alias("t"))
    else:
        there = urls.select(F.explode(_tokens(F.col("target"))).alias("t")).join(spark.createDataFrame([(t,) for t in known], "t string"), "t", "left_semi")
    count = {r.t: r.n for r in there.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the rules
    return [(min(r.tokens, key=lambda t: (count.get(t, 0), t)) if r.tokens else None, r) for r in rules]


def _best(found: Column) -> Column:
    """Of an array of (rank, size, name, action): highest rank, longest, least name."""
    return F.reduce(
        found,
        F.lit(None).cast("struct<rank:int,size:int,name:string,action:string>"),
        lambda a, x: F.when(a.isNull() | (x["rank"] > a["rank"]) | ((x["rank"] == a["rank"]) & ((x["size"] > a["size"]) | ((x["size"] == a["size"]) & (x["name"] < a["name"])))), x).otherwise(a),
    )


def judge(pages: DataFrame, base: tuple[Rule, ...] = BASE, patterns: tuple[Rule, ...] = PATTERNS) -> DataFrame:
    """A verdict on each ``url`` of ``pages(page_id, url, ...)``: page_id, host,
    path, rule (the base rule that fits best, else null), verdict (its action;
    else that of the best pattern; else allow) and pattern (the best pattern rule
    that fits, else null).

    A null url or one without ``://`` has an empty host and path, fits no rule and
    is allowed.  Rows that repeat others and null ids are judged like any; other
    columns are ignored.

    Up to ``INDEX_RULES`` rules the index is part of the expression: no join, no
    shuffle.  Larger rule sets are joined by token as a table."""
    host, path = split_url(F.col("url"))
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path")).withColumn("target", F.concat("host", "path"))
    rules = [*(replace(r, rank=1) for r in base), *(replace(r, rank=min(r.rank, 0)) for r in patterns)]
    filed = _filed(p, rules)
    if len(rules) <= INDEX_RULES:
        found = _inline(filed)
        judged = p.withColumn("found", found)
    else:
        judged = _joined(p, filed)
    own = _best(F.filter("found", lambda x: x["rank"] == 1))
    other = _best(F.filter("found", lambda x: x["rank"] < 1))
    judged = judged.select("page_id", "host", "path", own.alias("own"), other.alias("other"))
    return judged.select("page_id", "host", "path", F.col("own.name").alias("rule"), F.coalesce("own.action", "other.action", F.lit("allow")).alias("verdict"), F.col("other.name").alias("pattern"))


def _inline(filed: list[tuple[str | None, Rule]]) -> Column:
    def lit(r: Rule) -> Column:
        return F.struct(F.lit(r.rank).alias("rank"), F.lit(r.size).alias("size"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex"))

    by: dict[str | None, list[Rule]] = {}
    for t, r in filed:
        by.setdefault(t, []).append(r)
    always = F.array(*[lit(r) for r in by.pop(None)]) if None in by else None
    fetched = []
    if by:
        index = F.create_map(*[x for t, rs in sorted(by.items()) for x in (F.lit(t), F.array(*map(lit, rs)))])
        keys = F.array(*[F.lit(t) for t in sorted(by)])
        fetched.append(F.flatten(F.transform(F.array_intersect(_tokens(F.col("target")), keys), lambda t: F.element_at(index, t))))
    if always is not None:
        fetched.append(always)
    if not fetched:
        return F.array().cast("array<struct<rank:int,size:int,name:string,action:string>>")
    candidates = F.concat(*fetched) if len(fetched) > 1 else fetched[0]
    fits = F.filter(candidates, lambda r: F.regexp_like(F.col("target"), r["regex"]))
    return F.transform(fits, lambda r: F.struct(r["rank"].alias("rank"), r["size"].alias("size"), r["name"].alias("name"), r["action"].alias("action")))


def _joined(p: DataFrame, filed: list[tuple[str | None, Rule]]) -> DataFrame:
    spark = p.sparkSession
    p = p.withColumn("rid", F.xxhash64("host", "path"))
    table = spark.createDataFrame([(t, r.rank, r.size, r.name, r.action, r.regex) for t, r in filed if t is not None], "t string, rank int, size int, name string, action string, regex string")
    distinct = p.select("host", "path", "target").distinct()
    hits = distinct.select("host", "path", "target", F.explode(_tokens(F.col("target"))).alias("t")).join(table, "t").where(F.regexp_like("target", F.col("regex")))
    best = F.max_by(F.struct("rank", "size", "name", "action"), F.struct("size", F.transform(F.split("name", ""), lambda c: -F.ascii(c))))
    hits = hits.groupBy("host", "path", "rank").agg(best.alias("best")).groupBy("host", "path").agg(F.collect_list("best").alias("found"))
    always = _inline([x for x in filed if x[0] is None])
    out = p.join(hits, ["host", "path"], "left")
    return out.withColumn("found", F.concat(F.coalesce("found", F.array().cast("array<struct<rank:int,size:int,name:string,action:string>>")), always))
