import random

from linkwright.llm import url_filter as U

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules=U.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = rest[:end].translate(UPPER), rest[end:]
        path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, U.DEFAULT))
    return host, path, best[2], best[3]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>x</p>") for i, u in urls], "page_id long, url string, html string")


def test_against_brute_force(spark, cluttered):
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "x.net", "net", "a.b.www.example.com", "notexample.com", "com", "x.org", "..com", "", "com.", "example.com:80"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/", "/EN/", "/en/x/y?/es/", "//es/", "/en/#a/b"]
    urls = [(i, f"{rng.choice(['http', 'https', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/es/', '#t', '?a://b'])}") for i in range(400)]
    urls += [(900, None), (901, ""), (902, "no scheme/en/"), (903, "http://x.net/es/" + "a/" * 20_000), (904, "http://" + "a." * 5_000 + "example.com/en/"), (None, "http://x.net/fr/"), (5, urls[5][1]), (905, "line\nhttp://example.com/en/\n")]
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(cluttered(pages(spark, urls)), U.rule_table(spark)).collect()), key=repr)
    assert got == sorted(((i, *brute(u)) for i, u in urls), key=repr)
    assert U.judge(pages(spark, []), U.rule_table(spark)).collect() == []


def test_other_rules(spark):
    rules = [("block", "a.example.org", "/private"), ("allow", "example.org", "/private/x/"), ("block", "t.example.org", "/"), ("allow", "t.example.org", "/")]
    urls = [(1, "http://a.example.org/private-not"), (2, "http://b.example.org/private/x/y"), (3, "http://a.example.org/private/x/"), (4, "http://t.example.org/"), (5, "http://example.org/else")]
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages(spark, urls), U.rule_table(spark, rules)).collect()}
    assert got == {1: "block", 2: "allow", 3: brute(urls[2][1], rules)[3], 4: "block", 5: U.DEFAULT}
