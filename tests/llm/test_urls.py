import pytest

from tamiz.llm import urls as U


def brute(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1].split("?", 1)[0].split("#", 1)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + tail
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


URLS = [None, "", "no scheme", "http://", "https://example.com", "https://EXAMPLE.com/en/1", "https://www.example.com/en/1?q=/x", "https://a.b.example.com/en/", "http://x.net/es/1", "http://x.net/fr#top",
        "http://net/fr/", "http://xcom/", "http://com/", "http://a.com?x=/en/", "http://a.com/://b.net/es/", "http://notexample.com/en/9", "http://Ünï.net/es/é", "http://a.com:80/en/", "http://" + "a." * 5000 + "net/es/"]


def test_verdicts_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS + URLS)], "page_id long, url string, host string, rule string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(pages, U.rule_frame(spark, U.RULES)).collect()}
    assert got == {k: brute(u, U.RULES) for k, u in enumerate(URLS + URLS)}


@pytest.mark.parametrize("digest", [lambda r: 7, lambda r: len(r), U.digest])
def test_collisions_are_confirmed(tmp_path, digest):
    rules = [("a.com/", True), ("b.com/", False), ("com/en/", True), ("org/", True)]
    U.DigestArray.write(str(tmp_path / "index"), rules, digest)
    array = U.DigestArray(str(tmp_path / "index"), digest)
    assert array.judge(["http://a.com/", "http://b.com/en/", "http://c.com/en/", "http://d.org/x", "http://e.net/"])[2:] == (
        ["a.com/", "com/en/", "com/en/", "org/", None], [True, True, True, True, False])


def test_many_files_give_the_same(spark):
    rules = [(f"h{k}.com", "/", "block") for k in range(40)] + [("com", "/a/", "allow"), ("h1.com", "/a/", "block")]
    pages = spark.createDataFrame([(k, f"http://www.h{k}.com/a/b") for k in range(60)], "page_id long, url string")
    one, many = (sorted(U.filter_urls(pages, U.rule_frame(spark, rules), most_rules=m).collect()) for m in (1000, 7))
    assert one == many and [tuple(r)[1:] for r in one] == [brute(f"http://www.h{k}.com/a/b", rules) for k in range(60)]


def test_empty_lists_and_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    nulls = spark.createDataFrame([(None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    for rules in (none, nulls):
        assert [tuple(r) for r in U.filter_urls(pages, rules).collect()] == [(1, "a.com", "/", None, "allow")]
    assert U.filter_urls(pages.limit(0), none).count() == 0
