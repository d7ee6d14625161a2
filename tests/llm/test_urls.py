import pytest

pytest.importorskip("rollcall.llm")
from rollcall.llm import urls


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c
    path = ""
    for c in rest[len(host):]:
        if c in "?#":
            break
        path += c
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for _, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


URLS = [None, "", "no scheme", "http://", "http://COM/en/x", "https://a.Example.com/en/71?x=1#y", "https://example.com/en/8", "http://notcom/en/", "http://xexample.net/de/8",
        "http://example.net/de/80", "http://example.net/de/7", "ftp://x.org/es/", "http://É.org/es/1", "a://b://c/d", "http://h?q=/en/", "http://com/en", "http://x\ny.com/en/z", "http://com#/en/", "://com/en/"]


def test_hosts_paths_and_rules_like_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(1, "", "h"), (None, "http://com/en/1", None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    verdicts = {w: v for v, w in urls.RULES}
    by = {r.page_id: r for r in got}
    for i, u in enumerate(URLS):
        assert (by[i].host, by[i].path, by[i].rule) == brute(u), u
        assert by[i].verdict == verdicts.get(by[i].rule, by[i].verdict) and by[i].verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    good = [(f"https://site{i % 50}.example.org/articles/{i}", False) for i in range(400)]
    bad = [(f"http://x{i}-cheap-pills-{i}.biz/?a={i}&b={i * 7}&c=1&d=2", True) for i in range(400)]
    labelled = spark.createDataFrame(good[:300] + bad[:300] + [(None, True), ("x", None)], "url string, bad boolean")
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(good[300:] + bad[300:])], "page_id long, url string, bad boolean")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labelled, rules=()).collect()}
    want = {r.page_id: "block" if r.bad else "allow" for r in pages.collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_copies_of_one_url_leave_room_for_others_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE", 60)
    good = [f"https://site{i}.example.org/about" for i in range(30)]
    bad = [f"http://w{i}-{i}-x.example.biz/a/b/c/d/{i}?q={i}&r=1%20{i}" for i in range(30)]
    hashes = {r.u: r.h for r in spark.createDataFrame([(u,) for u in good + bad], "u string").selectExpr("u", "xxhash64(u) AS h").collect()}
    first = min(good, key=hashes.get)
    bad = [u for u in bad if hashes[u] > hashes[first]]
    assert len(bad) > 20
    labelled = spark.createDataFrame([(u, False) for u in good] + [(u, True) for u in bad] + [(first, False)] * 200, "url string, bad boolean")
    pages = spark.createDataFrame(list(enumerate(good + bad)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labelled, rules=()).collect()}
    assert got == {i: "allow" if i < 30 else "block" for i in range(30 + len(bad))}
