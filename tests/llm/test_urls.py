"""op6's rules, features and shares of suffixes against plain Python; clashing columns and long URLs."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tamarisk.llm import url_filter
from tamarisk.llm.queries_urls import RULES


def parts(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in found[1]), found[2]) if found else ("", "")


def rule(url):
    host, path = parts(url)
    fits = [(len(text), text, verdict) for verdict, text in RULES for name, _, start in (text.partition("/"),) if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
    return max(fits)[1:] if fits else (None, None)


def features(url):
    host, path = parts(url)
    u = url or ""
    share = [n / len(u) for n in Counter(u).values()]
    count = lambda s, of: sum(c in of for c in s)
    return {
        "url_length": len(u), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "digit_ratio": count(u, "0123456789") / max(len(u), 1), "entropy": -sum(p * math.log2(p) for p in share), "parameters": count(u, "&?"),
        "host_labels": host.count("."), "hyphens": host.count("-"),
    }


def urls():
    r = random.Random(6)
    hosts = ("example.com", "www.example.com", "EXAMPLE.com", "a.b.net", "net", "xnet", "é.net", "x-y.org", "www.example.com.net", "example.com:80")
    paths = ("", "/", "/en", "/en/", "/en/1", "/es/a", "/fr/", "/fr/b/c?x=1&y=2#z", "?q=/en/", "#en/", "/EN/", "/es/é 1")
    some = [f"{r.choice(('http', 'https', 'ftp', ''))}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    return [*some, None, "", "no scheme", "://", "http://", "http:///en/", "a://b.net/es/://c.com/", "http://long.net/" + "a1-/" * 30_000 + "?x&y", "http://" + "l." * 9_000 + "net/fr/", "x\n://q.net/es/"]


def test_rules_and_parts(spark):
    rows = [(i, u, "h", "p", 1, None, "x") for i, u in enumerate(urls())] + [(None, "http://a.net/es/1", None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, Host string, path string, _rule int, verdict string, suffix string").repartition(3)
    got = url_filter.judge_urls(frame, RULES, columns=("page_id", "Host", "suffix", "_rule"))
    assert got.columns == ["page_id", "suffix", "_rule", "host", "path", "rule", "verdict"]
    by_id = {x.page_id: x for x in got.collect()}
    assert len(by_id) == len(rows)
    for i, u, *_ in rows:
        x, (text, verdict) = by_id[i], rule(u)
        assert (x.host, x.path) == parts(u) and x.rule == text and (x.verdict == verdict or text is None and x.verdict in ("allow", "block"))


def test_features(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls())], "i long, _url string").withColumns({"_host": url_filter.host(F.col("_url")), "_path": url_filter.path(F.col("_url"))})
    for x, u in zip(url_filter.with_features(rows, "_url", "_host", "_path").orderBy("i").collect(), urls(), strict=True):
        want = features(u)
        assert {k: round(x[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}, u


def test_shares_of_suffixes(spark):
    r = random.Random(2)
    rows = [(i, r.choice("abc"), r.choice("pqrs"), float(r.random() < 0.4), r.randrange(5)) for i in range(80)]
    sample = spark.createDataFrame(rows, "i long, suffix string, domain string, label double, fold int")
    mean = sum(x[3] for x in rows) / len(rows)
    share = lambda k, v, fold: (lambda own: (sum(own) + 2 * mean) / (len(own) + 2))([x[3] for x in rows if x[k] == v and x[4] != fold])
    for x in url_filter.with_shares(sample, sample, mean, other_folds=True).collect():
        assert abs(x.suffix_share - share(1, x.suffix, x.fold)) < 1e-12 and abs(x.domain_share - share(2, x.domain, x.fold)) < 1e-12
    new = spark.createDataFrame([("a", "zz")], "suffix string, domain string")
    x = url_filter.with_shares(new, sample, mean).first()
    assert abs(x.suffix_share - share(1, "a", None)) < 1e-12 and abs(x.domain_share - mean) < 1e-12
