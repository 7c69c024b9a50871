import re

import numpy as np

from rasterloom.llm import url_filter as U

URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "https://anet/x", "http://example.net/en/1", "http://Sub.Example.NET/en/", "http://example.net/EN/", "http://example.net/en", "http://example.net?x=/en/", "http://x.org/fr/a#b", "http://org/fr/", "http://a.example.com/de/1?q", "http://example.com#/de/", "a://b://net/x", "http://user@h.net:80/x", "http://h.net./", "ftp://..net/x", "http://é.net/é", "http://x.net/" + "p/" * 60000]


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("", "") if not m else ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2])
    fits = [r for r, _ in U.RULES if (host == (d := r.split("/")[0]) or host.endswith("." + d)) and path.startswith(r[len(d) :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, dict(U.RULES).get(rule, "allow")


def open_(tmp_path, rules):
    (tmp_path / "rules").write_bytes(U.build(rules))
    return U.DigestArray.open(str(tmp_path / "rules"))


def test_judgements(tmp_path):
    assert U.judge(open_(tmp_path, U.RULES), URLS) == [plain(u) for u in URLS]


def test_colliding_digests_need_the_stored_string(tmp_path, monkeypatch):
    monkeypatch.setattr(U, "digest", lambda key: len(key) % 3)
    assert U.judge(open_(tmp_path, U.RULES), URLS) == [plain(u) for u in URLS]


def test_many_rules(tmp_path):
    rules = [(f"host{i}.example/p{i}/", "block") for i in range(5000)]
    array = open_(tmp_path, rules)
    assert (np.diff(array.digests.astype(object)) > 0).all()
    assert (array.find([r for r, _ in rules]) >= 0).all() and (array.find([f"other{i}/" for i in range(5000)]) < 0).all()
    assert U.judge(array, ["http://a.host77.example/p77/x", "http://host77.example/p78/"], "allow") == [("a.host77.example", "/p77/x", "host77.example/p77/", "block"), ("host77.example", "/p78/", None, "allow")]


def test_no_rules(tmp_path):
    assert U.judge(open_(tmp_path, []), ["http://net/"]) == [("net", "/", None, "allow")]


def test_edges(spark):
    df = spark.createDataFrame([(None if i == 3 else i // 2, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = sorted((tuple(r)[1:] for r in U.filter_urls(df).collect()), key=repr)
    assert got == sorted((plain(u) for u in URLS), key=repr)
    assert U.filter_urls(df.where("false")).collect() == []


def test_query(same_as_sql):
    same_as_sql("op4_url_filter")
