import html
import random
import re
from urllib.parse import urljoin

from pairlab.llm import urls
from pairlab.llm.common import table
from pairlab.llm.queries import URL_RULES, op3_judge_urls
from tests.conftest import SF001

PAGE = "page_id long, url string, html string, host int, verdict string"


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(url, rules=URL_RULES):
    host, path = parts(url)
    fits = [(len(h + p), h + p, a) for h, p, a in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def judged(spark, rows, rules=URL_RULES, redirects=None):
    pages = spark.createDataFrame([(i, u, h, 0, "x") for i, (u, h) in enumerate(rows)], PAGE)
    rules = spark.createDataFrame(list(rules), "host string, path string, action string")
    links = None if redirects is None else spark.createDataFrame(redirects, "a string, b string")
    return {r["page_id"]: r for r in urls.judge(pages, rules, links).collect()}


def test_rules(spark):
    names = ["http://EXAMPLE.com/en/a", "https://www.Example.com/en/", "http://a.b.www.example.com/en/x?y#z", "http://example.com/de/",
             "http://notexample.com/en/", "x://net/es/1", "x://a.net/fr", "x://a.net/fr/", "http://net?/es/", "http://", "nothing", "", None,
             "http://a.com", "http://org/en/", "a://b://c.net/es/", "http://É.NET/fr/ü", "http://com/", "://net/es/"]
    got = judged(spark, [(n, None) for n in names])
    assert len(got) == len(names)
    for i, n in enumerate(names):
        rule, action = rule_of(n)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (*parts(n), rule, action or "allow"), n


def test_blocks_spread_to_aliases_unless_one_is_allowed(spark):
    rules = (("bad.org", "/", "block"), ("good.org", "/", "allow"))
    link = '<html><LINK href="{}" rel="canonical"></html>'
    rows = [("http://a.io/1", link.format("http://bad.org/x")),          # 0 blocked through the link
            ("http://a.io/2#top", None), ("http://a.io/2", '<meta http-equiv="refresh" content="3; URL=/3">'),  # 1, 2 blocked: 2 -> 3 -> bad
            ("http://a.io/3", "<meta property='og:url' content='http://bad.org/y'>"),  # 3
            ("http://a.io/4", link.format("http://bad.org/z")), ("http://good.org/4", link.format("http://a.io/4")),  # 4 stays: an allowed alias
            ("http://bad.org/q", link.format("http://good.org/q")),      # 6 keeps its own rule
            ("http://a.io/7", link.format("../other")), ("http://a.io/8", None), ("http://a.io/9", None)]
    got = judged(spark, rows, rules, [("http://a.io/8", "http://bad.org/r"), ("http://a.io/9", None)])
    assert [got[i]["verdict"] for i in range(10)] == ["block"] * 4 + ["allow", "allow", "block", "allow", "block", "allow"]
    assert got[0]["rule"] is None and got[6]["rule"] == "bad.org/"


def test_a_popular_alias(spark):
    rows = [(f"http://p{i}.io/", '<link rel=canonical href="http://hub.io/">') for i in range(300)]
    got = judged(spark, rows + [("http://hub.io/", '<link rel="canonical" href="http://net/es/">')])
    assert all(r["verdict"] == "block" for r in got.values())


def test_table_and_empty(spark):
    rows = op3_judge_urls(spark, SF001).collect()
    pages = {r["page_id"]: r["url"] for r in table(spark, SF001, "pages").collect()}
    assert len(rows) == len(pages)
    assert all((r["host"], r["path"]) == parts(pages[r["page_id"]]) and r["rule"] == rule_of(pages[r["page_id"]])[0] for r in rows)
    assert judged(spark, []) == {}
    same = judged(spark, [("http://a.net/es/", None)] * 3 + [(None, None)] * 2)
    assert [same[i]["verdict"] for i in range(5)] == ["block"] * 3 + ["allow"] * 2


def test_links_of_each_kind_match_a_plain_version(spark):
    draw = random.Random(7)
    links = ["/a/b", "c", "../x", "./y/../z", "../../../up", "?q=1&r=2", "//other.org/p", "http://t.org/a?x=1&y=2", "d/..", "e/.", "#top",
             "mailto:a@b.c", "javascript:void(0)", "data:text/plain,x", "https://u.org/a/./b/../c#frag"]
    tags = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel='alternate canonical' />", "<link rel=canonical href={}>",
            '<meta property="og:url" content="{}">', '<meta http-equiv="refresh" content="0; url=\'{}\'">',
            '<meta http-equiv=refresh content="5;URL={}">']
    rows, want = [], set()
    for i in range(200):
        page = f"http://h{i}.io/" + draw.choice(["", "d/", "d/e/page.html", "d/page?z=1"])
        body = "<p>text</p>"
        for link in draw.sample(links, 2):
            body += draw.choice(tags).format(html.escape(link)) + "<br>"
            full = urljoin(page, link).replace("/a/./b/../c", "/a/c")  # urljoin leaves full urls as they are
            if "://" in full and re.sub("#.*", "", full) != page and full != page:
                want.add((page, re.sub("#.*", "", full)))
        rows.append((page, body))
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {(r["a"], r["b"]) for r in urls.alias_edges(pages).collect() if r["a"] != r["b"]}
    assert got == want


def test_numbers_of_urls_keep_the_edges(spark):
    draw = random.Random(3)
    pairs = [(f"http://h.io/{draw.randrange(60)}", f"http://h.io/{draw.randrange(60)}") for _ in range(150)] + [("x://hub", "x://hub")]
    pairs += [(f"http://h.io/{i}", "x://hub") for i in range(60)]
    nodes, links = urls.numbered(spark.createDataFrame(pairs, "a string, b string").repartition(5))
    name = {r["node"]: r["url"] for r in nodes.collect()}
    assert len(name) == len(set(name.values())) == nodes.count()
    assert sorted((name[r["a"]], name[r["b"]]) for r in links.collect()) == sorted(p for p in pairs if p[0] != p[1])
    assert dict(links.dtypes) == {"a": "bigint", "b": "bigint"}
